import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strainframe.llm import near_dedup


def plain_simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[n : n + 4]) for n in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(values, distance=4):
    label = list(range(len(values)))
    for n, a in enumerate(values):
        for m in range(n):
            if (a ^ values[m]).bit_count() <= distance:
                old, new = max(label[n], label[m]), min(label[n], label[m])
                label = [new if x == old else x for x in label]
    return label


def neighbours(count, seed):
    """Chains and balls of close values among random ones."""
    dice, out = random.Random(seed), []
    while len(out) < count:
        value = dice.getrandbits(64)
        for _ in range(dice.choice([1, 1, 2, 30])):
            out.append(value)
            for _ in range(dice.randint(0, 5)):
                value ^= 1 << dice.randrange(64)
    return out[:count]


@pytest.mark.parametrize("group_rows", [near_dedup.GROUP_ROWS, 8])
def test_links_connect_as_brute_force(spark, group_rows):
    values = sorted(set(neighbours(500, 1)) | {0, 1, 2**64 - 1})
    frame = spark.createDataFrame([(near_dedup._signed(v),) for v in values], "print long")
    roots = {r["node"]: r["root"] for r in near_dedup.components(near_dedup.links(frame, 4, group_rows)).collect()}
    found = [roots.get(near_dedup._signed(v), near_dedup._signed(v)) for v in values]
    groups = brute_components(values)
    assert len(set(zip(groups, found, strict=True))) == len(set(groups)) == len(set(found))


def test_index_finds_every_pair():
    values = np.unique(np.array(neighbours(400, 2), np.uint64))
    order = np.argsort(near_dedup.gray_rank(values))
    values = values[order]
    levels = near_dedup.build_index(np.zeros(len(values), np.int64), values)
    left, right = near_dedup.search(levels, values, np.arange(len(values)), 4)
    expected = {(a, b) for a in range(len(values)) for b in range(a + 1, len(values)) if int(values[a] ^ values[b]).bit_count() <= 4}
    assert set(zip(left.tolist(), right.tolist(), strict=True)) == expected
    covered = np.zeros(len(values), np.uint64)
    for level in levels:  # masks of nested nodes share no bit and together hold all bits
        own = level["own"][np.searchsorted(level["last"], np.arange(len(values)))]
        assert not (covered & own).any()
        covered |= own
    assert (covered == np.uint64(2**64 - 1)).all()


def test_gray_rank():
    codes = np.array([n ^ n >> 1 for n in range(1000)], np.uint64)
    assert near_dedup.gray_rank(codes).tolist() == list(range(1000))


def test_awkward_rows(spark, awkward):
    rows = near_dedup.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    found = {r["id"]: r for r in rows}
    for row in awkward.collect():
        assert found[row["doc_id"]]["print"] % 2**64 == plain_simhash(row["text"])
    assert [found[n]["component"] for n in (1, 2, 3, 4, 5, 6, 7, 8, None)] == [1, 1, 3, 3, 3, 6, 7, 8, None]


def test_no_rows(spark, awkward):
    assert near_dedup.near_duplicates(awkward.limit(0)).count() == 0


def test_chain_of_components(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(900, 901), (901, 900)], "a long, b long"))
    roots = {r["node"]: r["root"] for r in near_dedup.components(edges).collect()}
    assert {roots[n] for n in range(1, 201)} == {0} and roots[901] == 900
