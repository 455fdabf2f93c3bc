import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strainframe.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, fields):
    cells = (row[name] for name in fields)
    return H(*("-" if cell is None else f"{len(str(cell).encode())}:{cell}" for cell in cells))


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][n : n + 8]) for n in range(0, len(levels[-1]), 8)])
    return levels


def plain_path(levels, at):
    sides, places = [], []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        sides.append("".join(run[: at % 8] + run[at % 8 + 1 :]))
        places.append(at % 8)
        at //= 8
    return sides, places


def plain_proofs(rows, fields):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda name: (name is not None, (name or "").encode()))
    trees = {}
    for name in names:
        trees[name] = sorted(groups[name], key=lambda row: (row["doc_id"] is not None, row["doc_id"] or 0, plain_leaf(row, fields)))
    levels = {name: plain_tree([plain_leaf(row, fields) for row in trees[name]]) for name in names}
    top = plain_tree([levels[name][-1][0] for name in names])
    out = []
    for at, name in enumerate(names):
        upper = plain_path(top, at)
        for n, row in enumerate(trees[name]):
            lower = plain_path(levels[name], n)
            out.append((row["doc_id"], levels[name][0][n], lower[0] + upper[0], lower[1] + upper[1], levels[name][-1][0], top[-1][0]))
    return sorted(out, key=repr)


FIELDS = ("doc_id", "lang", "text")


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 9}, {"en": 1200, "é": 64, "": 65, None: 1, "z": 513}])
def test_proofs_equal_the_plain_tree(spark, sizes):
    dice, rows = random.Random(1), []
    for lang, count in sizes.items():
        rows += [(dice.choice([None, n, n, n]), lang, dice.choice([None, "", f"t{dice.random()}"]), 0, "r") for n in range(count)]
    rows += rows[:3]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string, pos int, tree string").repartition(4)
    manifest = merkle.build_manifest(frame, FIELDS, "lang", "doc_id")
    got = sorted(((r["id"], r["leaf"], r["sides"], r["places"], r["subroot"], r["root"]) for r in manifest.proofs(["id"]).collect()), key=repr)
    plain = [{"doc_id": i, "lang": lang, "text": text} for i, lang, text, _, _ in rows]
    assert got == plain_proofs(plain, FIELDS)
    assert manifest.root == got[0][5]
    for _, leaf, sides, places, _, root in got[:50]:
        assert merkle.fold(leaf, sides, places) == root


def test_stored_levels_lie_far_apart(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.col("id").cast("string").alias("text"))
    manifest = merkle.build_manifest(rows, FIELDS, "lang", "doc_id")
    assert [level.count() for level in manifest.levels] == [5000, 10, 1]


def test_tampered_leaves_are_found(spark):
    rows = spark.range(700).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("string").alias("lang"), F.concat(F.lit("T"), "id").alias("text"))
    other = F.when(F.col("doc_id") % 5 == 0, merkle.leaf_digest([F.col("doc_id"), F.col("lang"), F.lower("text")]))
    manifest = merkle.build_manifest(rows, FIELDS, "lang", "doc_id", {"given": other})
    found = merkle.verify(manifest, "given").collect()
    assert len(found) == 700
    assert all((row["folded_root"] == row["root"]) == (row["id"] % 5 != 0) for row in found)


def test_awkward_rows(spark, awkward):
    manifest = merkle.build_manifest(awkward, ("doc_id", "lang", "text"), "lang", "doc_id", {"given": F.lit(None).cast("string")})
    found = merkle.verify(manifest, "given").collect()
    assert len(found) == awkward.count() and all(row["folded_root"] == row["root"] == manifest.root for row in found)
    plain = plain_proofs([row.asDict() for row in awkward.collect()], FIELDS)
    assert sorted(H(*p[2]) for p in plain) == sorted(row["proof_sha256"] for row in found)


def test_no_rows(spark, awkward):
    manifest = merkle.build_manifest(awkward.limit(0), FIELDS, "lang", "doc_id", {"given": F.lit("x")})
    assert manifest.root is None and merkle.verify(manifest, "given").count() == 0
    assert manifest.proofs().count() == 0
