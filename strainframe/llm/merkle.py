"""Merkle manifest of a table: stored levels far apart, and proofs that regenerate what lies between them.

Every row becomes a leaf. The leaves of one group (a language, say) form a tree
in ascending order of the id, whose runs of ``ARITY`` neighbours become their
parent; the group's roots, in order of the group's name, form the tree above.

Only every third level is stored (``KEPT_EVERY``), so that the stored levels
above the leaves add a five-hundredth to them. A stored node heads an aligned
subtree of at most ``ARITY ** KEPT_EVERY`` stored descendants; whoever needs
what lies between builds that subtree anew in memory, takes the siblings of
each descendant from it and drops it. Proofs go from the top downwards: the
proof of a stored node is the head row of the subtree below it.

A subtree is all that a task ever holds, however large a group is; positions
come from ranges of the ids and counts per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.llm.common import scan_width
from strainframe.session import cut_lineage

#: Children of a node.
ARITY = 8
#: Levels from one stored level to the next.
KEPT_EVERY = 3
SUBTREE = ARITY**KEPT_EVERY
#: Name of the tree over the groups' roots.
TOP = ""

_PATH = "sides array<string>, places array<int>, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, values)), 256)


def group_name(group: Column) -> Column:
    """A group's name as text that sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


# --- positions ---------------------------------------------------------------------------------------------------


def with_positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with their position in ``tree`` by the given columns (pos, from 0) and the rows of that tree (n).

    Rows are dealt by ranges of (tree, order); a range counts its rows, and the ranges before it add up to its offset.
    The table of ranges has a row for each range and each tree that begins in it.
    """
    dealt = rows.repartitionByRange(scan_width(rows), "tree", *order).withColumn("run", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    runs = dealt.groupBy("run", "tree").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("tree").orderBy("run"))
    runs = runs.select("run", "tree", (before - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    inside = F.row_number().over(Window.partitionBy("run", "tree").orderBy(*order)) - 1
    placed = dealt.withColumn("inside", inside).join(runs, ["run", "tree"])
    return placed.withColumn("pos", F.col("before") + F.col("inside")).drop("run", "before", "inside")


# --- levels ------------------------------------------------------------------------------------------------------


def _levels(digests: list[str], size: int) -> list[list[str]]:
    """The nodes of a subtree level by level, up to the next stored one; size counts the lowest level of the whole tree."""
    levels = [digests]
    while len(levels) <= KEPT_EVERY and size > 1:
        below = levels[-1]
        levels.append([digest("".join(below[start : start + ARITY])) for start in range(0, len(below), ARITY)])
        size = -(-size // ARITY)
    return levels


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (tree, block, ...) of one subtree after another; they arrive in that order."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _climb_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []

    def answer():
        columns = list(zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            names=["tree", "pos", "n", "digest"],
        )

    for rows in _subtrees(batches):
        tree, block, _, size, _ = rows[0]
        levels = _levels([row[4] for row in rows], size)
        found.append((tree, block, -(-size // ARITY ** (len(levels) - 1)), levels[-1][0]))
        if len(found) == 1024:
            yield answer()
            found.clear()
    if found:
        yield answer()


def _by_subtree(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block() -> Column:
    return F.floor(F.col("pos") / SUBTREE).cast("long").alias("block")


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """Stored levels (tree, pos, n, digest) from the leaves upwards; a node with n = 1 is the root of its tree."""
    levels = [leaves.select("tree", "pos", "n", "digest")]
    while not (open_ := levels[-1].filter("n > 1")).isEmpty():
        grouped = _by_subtree(open_.select("tree", _block(), "pos", "n", "digest"))
        levels.append(cut_lineage(grouped.mapInArrow(_climb_batches, "tree string, pos long, n long, digest string")))
    return levels


def roots(levels: Sequence[DataFrame]) -> DataFrame:
    """(tree, digest) of every tree."""
    found = levels[0].filter("n = 1")
    for level in levels[1:]:
        found = found.unionByName(level.filter("n = 1"))
    return found.select("tree", "digest")


# --- proofs ------------------------------------------------------------------------------------------------------


def fold(leaf: str, sides: Sequence[str], places: Sequence[int]) -> str:
    """The root that a leaf and its siblings give."""
    for side, place in zip(sides, places, strict=True):
        cut = 64 * place
        leaf = digest(side[:cut] + leaf + side[cut:])
    return leaf


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], list[int], str, str]]:
    """Each node with its siblings level by level (joined) and its places among them, up to the root of all.

    The first row of a subtree holds the path of the stored node above it. Interior nodes live as long as their subtree.
    """
    for head, *rows in _subtrees(batches):
        _, _, _, _, _, above_sides, above_places, subroot, root = head[:9]
        levels = _levels([row[4] for row in rows], rows[0][3])
        sides = []
        for level in levels[:-1]:
            runs = [level[start : start + ARITY] for start in range(0, len(level), ARITY)]
            sides.append(["".join(run[:place] + run[place + 1 :]) for run in runs for place in range(len(run))])
        for at, row in enumerate(rows):
            own = [side[at // ARITY**depth] for depth, side in enumerate(sides)]
            places = [at // ARITY**depth % ARITY for depth in range(len(sides))]
            yield row, own + above_sides, places + above_places, subroot, root


_PATH_TYPES = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.string(), pa.string()]


def _path_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """(tree, pos, path, then what the rows carry beyond their path) of every node."""
    types: list[pa.DataType] = []

    def watched():
        for batch in batches:
            types[:] = [pa.string(), pa.int64(), *_PATH_TYPES, *batch.schema.types[9:]]
            yield batch

    def answer(found):
        return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found, strict=True), types)), names=[str(n) for n in range(len(types))])

    found = []
    for row, *path in _walk(watched()):
        found.append((row[0], row[2], *path, *row[9:]))
        if len(found) == rows:
            yield answer(found)
            found = []
    if found:
        yield answer(found)


def _headed(level: DataFrame, above: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """The rows of a level by subtree, each subtree after the path of the node above it; above: (tree, pos, path)."""
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (("sides", "array<string>"), ("places", "array<int>"), ("subroot", "string"), ("root", "string"))]
    nodes = level.select("tree", _block(), "pos", "n", "digest", *none, *more)
    empty = [F.lit(None).cast(level.schema[name].dataType).alias(name) for name in more]
    heads = above.select(
        "tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"),
        "sides", "places", "subroot", "root", *empty,
    )
    return _by_subtree(nodes.unionByName(heads))


def paths(levels: Sequence[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the stored nodes that head subtrees of leaves; top: (tree, path of its root).

    Going down, a level's subtrees are rebuilt from its stored nodes and headed by the paths of the level above.
    """
    waiting, above = top.withColumn("pos", F.lit(0).cast("long")), None  # a tree joins at the level of its root
    for level in reversed(levels[1:]):
        ended = level.filter("n = 1").select("tree").join(waiting, "tree")
        if above is None:
            above = ended
            continue
        inner = _headed(level.filter("n > 1"), above).mapInArrow(_path_batches, f"tree string, pos long, {_PATH}")
        above = cut_lineage(inner.unionByName(ended))
    lone = levels[0].filter("n = 1").select("tree").join(waiting, "tree")
    return lone if above is None else above.unionByName(lone)


class Manifest:
    """Stored levels of a table's trees, those of the tree above them, and the root of all.

    ``rows`` has the leaves with everything that was given for them.
    """

    def __init__(self, rows: DataFrame):
        """rows: (tree, digest, order columns, ...) with pos and n from ``with_positions``."""
        self.rows = rows
        self.levels = stored_levels(rows)
        groups = roots(self.levels).select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "digest")
        self.groups = cut_lineage(with_positions(groups, ["name"]))
        self.top_levels = stored_levels(self.groups)
        first = roots(self.top_levels).first()
        self.root = first["digest"] if first else None

    def heads(self) -> DataFrame:
        """(tree, pos, path) of every stored node right above a subtree of leaves."""
        if self.root is None:
            return self.rows.sparkSession.createDataFrame([], f"tree string, pos long, {_PATH}")
        end = self.rows.sparkSession.createDataFrame([(TOP, [], [], None, self.root)], f"tree string, {_PATH}")
        top = paths(self.top_levels, end)
        groups = _headed(self.groups, top, ["name"]).mapInArrow(_path_batches, f"tree string, pos long, {_PATH}, name string")
        named = groups.select(F.col("name").alias("tree"), "sides", "places", "root").join(roots(self.levels), "tree")
        return cut_lineage(paths(self.levels, cut_lineage(named.select("tree", "sides", "places", F.col("digest").alias("subroot"), "root"))))

    def leaves_with_heads(self, more: Sequence[str]) -> DataFrame:
        return _headed(self.rows.withColumn("leaf", F.col("digest")), self.heads(), more)

    def proofs(self, more: Sequence[str] = ()) -> DataFrame:
        """(tree, pos, sides, places, subroot, root, leaf, more) of every leaf: its siblings level by level and its places among them."""
        types = "".join(f", `{name}` {self.rows.schema[name].dataType.simpleString()}" for name in more)
        return self.leaves_with_heads(["leaf", *more]).mapInArrow(_path_batches, f"tree string, pos long, {_PATH}, leaf string{types}")


def build_manifest(docs: DataFrame, fields: Sequence[str], group_column: str, id_column: str, carried: dict[str, Column] | None = None) -> Manifest:
    """Manifest over all rows: a leaf is the digest of the named fields, a tree holds a group in ascending order of the id.

    Null fields are written ``-``; null ids come first, rows that repeat an id are ordered by their digest, equal rows
    are leaves of their own. A null group is a group. Other columns are not read, whatever their names, unless
    ``carried`` takes values from them along with the leaves. No rows: no root and no proofs.
    """
    columns = [F.col(f"`{name}`") for name in fields]
    rows = docs.select(
        group_name(F.col(f"`{group_column}`")).alias("tree"), F.col(f"`{id_column}`").alias("id"), leaf_digest(columns).alias("digest"),
        *(value.alias(name) for name, value in (carried or {}).items()),
    )
    return Manifest(cut_lineage(with_positions(cut_lineage(rows), ["id", "digest"])))


def _check_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []
    kind: list[pa.DataType] = []

    def watched():
        for batch in batches:
            kind[:] = [batch.schema.types[9]]
            yield batch

    def answer():
        types = [*kind, *[pa.string()] * 5]
        return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*found, strict=True), types)), names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    for row, sides, places, subroot, root in _walk(watched()):
        leaf, (id_, given) = row[4], row[9:]
        found.append((id_, leaf, subroot, root, digest("".join(sides)), fold(given or leaf, sides, places)))
        if len(found) == 1024:
            yield answer()
            found.clear()
    if found:
        yield answer()


def verify(manifest: Manifest, given: str) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root) of every leaf.

    ``folded_root`` comes from the digest in the carried column ``given`` (null: the leaf itself) and the siblings of
    the leaf; it equals the root only if the digests are equal.
    """
    kind = manifest.rows.schema["id"].dataType.simpleString()
    rows = manifest.leaves_with_heads(["id", given])
    return rows.mapInArrow(_check_batches, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
