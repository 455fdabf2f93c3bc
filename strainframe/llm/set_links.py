"""Links between texts whose sets of word shingles are similar, without a row for every pair.

A set has a signature: for each of ``COORDINATES`` hash functions the least
value over its shingles. Two sets agree in one coordinate with a probability
equal to their Jaccard similarity. Sets are posted under each (coordinate,
value) pair; the postings that two sets share are their collisions, and a pair
is retained if it has ``MATCHES`` of them or more. At a similarity of 0.8 a pair
has fewer with a probability of about 1.2e-6.

Prefix: with its postings in order of rising list length, a set needs no more
than the first ``COORDINATES - MATCHES + 1`` of them to meet every set it can
have enough collisions with. Postings of one set alone come first in that order,
so most sets end without a list, and what many documents share (a passage, a
licence) lies behind the prefix of all but those that consist of it.

Sets that meet in prefix lists, directly or through others, form a cell. One
task reads a cell, merges the short lists of each set, probes the long ones only
for the candidates found (skip merging), and compares retained pairs of
different components on the whole sets. A cell answers with a forest of links.
Cells too large for a task are taken apart into lists, and lists into pairs of
blocks; no pair is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.llm.common import byte_slices
from strainframe.llm.near_dedup import _signed, components, shingle_hashes, simhash
from strainframe.session import cut_lineage

COORDINATES = 64
MATCHES = 35
#: Least Jaccard similarity as a fraction.
SIMILAR = (4, 5)
#: Sets and bytes of shingle hashes that one task compares with each other.
CELL_NODES = 8192
CELL_BYTES = 32 << 20
SEED = 7

_COORDINATE_BITS = COORDINATES.bit_length() - 1
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)


# --- sets and signatures -----------------------------------------------------------------------------------------


def postings(shingles: np.ndarray) -> np.ndarray:
    """One number for each (coordinate, least value) of a set; none of an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    lowest = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), 256):
        np.minimum(lowest, (shingles[start : start + 256, None] * _FACTORS).min(axis=0), out=lowest)
    return (lowest << np.uint64(_COORDINATE_BITS) | np.arange(COORDINATES, dtype=np.uint64)).view(np.int64)


def set_name(shingles: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED))


def _mark_batches(batches: Iterator[pa.RecordBatch], size: int, prints: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in byte_slices(batch, 1):
            hashes = [shingle_hashes(text, size) for text in texts]
            sets = [np.unique(x) for x in hashes]
            keys = [postings(x) for x in sets]
            ends = np.cumsum([0, *map(len, keys)])
            columns = {
                "row": batch.column(0).slice(first, len(texts)),
                "node": pa.array(map(set_name, sets), pa.int64()),
                "size": pa.array(map(len, sets), pa.int64()),
                "keys": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys), pa.int64())),
            }
            if prints:
                columns["print"] = pa.array([_signed(simhash(x)) for x in hashes], pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def marked(rows: DataFrame, size: int, prints: bool = False) -> DataFrame:
    """(row, node, size, keys) of each (row, text): the name of its set, the set's size and postings; with its fingerprint, if asked for.

    Equal sets have one name of 64 bits. A null text has no words, and without words a set is empty and has no postings.
    """
    kind = rows.schema["row"].dataType.simpleString()
    more = ", print long" if prints else ""
    return rows.select("row", "text").mapInArrow(partial(_mark_batches, size=size, prints=prints), f"row {kind}, node long, size long, keys array<long>{more}")


def row_hash(docs: DataFrame) -> Column:
    """Tells rows of one id apart; maps have no hash in Spark and are passed over."""
    return F.xxhash64(*(F.col(f"`{field.name}`") for field in docs.schema.fields if "map<" not in field.dataType.simpleString()))


def rows_with_text(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(row, text): every row with what orders it among others, a null id last."""
    key = F.col(f"`{id_column}`")
    row = F.struct(key.isNull().alias("none"), key.alias("id"), row_hash(docs).alias("hash"))
    return docs.select(row.alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))


def texts_of(docs: DataFrame, chosen: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, text) of the rows named by chosen (node, row); both sides are dealt by id and hash and merged."""
    rows = rows_with_text(docs, id_column, text_column)
    wanted = chosen.select("node", F.col("row.id").alias("i"), F.col("row.hash").alias("h"))
    same = rows["row.id"].eqNullSafe(wanted["i"]) & (rows["row.hash"] == wanted["h"])
    return rows.join(wanted.hint("merge"), same).select("node", "text")


# --- prefix lists and cells --------------------------------------------------------------------------------------


def prefix_lists(nodes: DataFrame) -> DataFrame:
    """(node, keys, prefix) of the sets that can meet another: the postings shared with others, by rising list length, and their prefix."""
    posted = nodes.select("node", F.explode("keys").alias("key"))
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = posted.join(lists, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key")))["key"].alias("keys"))
    length = F.greatest(F.size("keys") - F.lit(MATCHES - 1), F.lit(0))  # postings of the set alone hold the first places
    return cut_lineage(shared.select("node", "keys", F.slice("keys", F.lit(1), length).alias("prefix")).filter(F.size("prefix") > 0))


def _cell_name(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def _halves(total: Column, count: Column) -> Column:
    """Blocks of half a cell."""
    return F.ceil(F.greatest(total * 8 / F.lit(CELL_BYTES), count / F.lit(CELL_NODES)) * 2).cast("int")


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node", "key"), blocks).cast("int")


def similar_links(nodes: DataFrame, fetch: Callable[[DataFrame], DataFrame], size: int, kin: DataFrame | None = None) -> DataFrame:
    """(a, b): links that connect all sets of the least similarity, transitively.

    nodes: (node, size, keys), one row for each set. ``fetch`` gives (node, text) for the nodes it gets. ``kin``: further
    pairs (a, b) of nodes to be compared, however few their collisions.
    """
    filed = prefix_lists(nodes)
    lists = filed.select("node", F.explode("prefix").alias("key"))
    lows = lists.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1")
    edges = lists.join(lows, "key").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    if kin is not None:
        edges = edges.unionByName(kin)
    met = components(edges)
    met = cut_lineage(met.unionByName(met.select(F.col("root").alias("node"), "root").distinct()))
    weighed = met.join(nodes.select("node", "size"), "node")
    large = cut_lineage(weighed.groupBy("root").agg(F.sum("size").alias("total"), F.count("*").alias("n")).filter(F.expr(f"total * 8 > {CELL_BYTES} or n > {CELL_NODES}")))
    members = met.join(filed.select("node", "keys"), "node", "left")
    if kin is not None:
        near = kin.filter("a <> b").groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("kin"))
        members = members.join(near, "node", "left")
    else:
        members = members.withColumn("kin", F.lit(None).cast("array<long>"))
    texts = cut_lineage(fetch(met.select("node")))
    members = cut_lineage(members.select("node", "root", "keys", "kin"))
    whole = members.join(large, "root", "left_anti").select(F.col("root").alias("cell"), "node", F.col("node").alias("root"), "keys", "kin")
    found = _compared(whole, texts, size)
    if large.isEmpty():
        return found
    return found.unionByName(_links_of_lists(members.join(large, "root", "left_semi"), lists, nodes, texts, size))


def _links_of_lists(members: DataFrame, lists: DataFrame, nodes: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links within components that no task can compare at once, list by list.

    A list is cut into blocks of half a cell. First every block is compared with itself and with the list's first set.
    What the largest component of a list then holds needs no comparison with itself, so only the other sets are
    compared with all blocks.
    """
    own = lists.join(members.select("node"), "node", "left_semi")
    pairs = members.filter(F.size("kin") > 0).select("node", F.explode("kin").alias("b"))
    pairs = pairs.select(F.explode(F.array("node", "b")).alias("node"), F.xxhash64(F.lit("kin"), "node", "b").alias("key"))
    own = own.unionByName(pairs.select("node", "key")).join(nodes.select("node", "size"), "node")
    sizes = own.groupBy("key").agg(F.sum("size").alias("total"), F.count("*").alias("n"), F.min("node").alias("low")).filter("n > 1")
    sizes = sizes.withColumn("blocks", F.when(F.expr(f"total * 8 > {CELL_BYTES} or n > {CELL_NODES}"), _halves(F.col("total"), F.col("n"))).otherwise(1))
    own = cut_lineage(own.join(sizes.select("key", "low", "blocks"), "key"))
    blocks = own.select("node", "key", _block(F.col("blocks")).alias("block"))
    firsts = own.filter("blocks > 1 and node = low").select("node", "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = blocks.unionByName(firsts).select(_cell_name(F.lit("block"), F.col("key"), F.col("block")).alias("cell"), "node").distinct()
    more = members.select("node", "keys", "kin")
    found = cut_lineage(_compared(cells.join(more, "node").withColumn("root", F.col("node")), texts, size))
    long = own.filter("blocks > 1").select("key", "node", "size").join(components(found), "node", "left")
    long = cut_lineage(long.withColumn("root", F.coalesce("root", "node")))
    if long.isEmpty():
        return found
    modal = long.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("modal"))
    long = long.join(modal, "key").withColumn("other", F.col("root") != F.col("modal"))
    spread = long.groupBy("key").agg(
        *(_halves(F.sum(F.when(side, F.col("size")).otherwise(0)), F.count(F.when(side, 1))).alias(name) for name, side in (("b", F.col("other")), ("a", ~F.col("other"))))
    )
    long = cut_lineage(long.join(spread.filter("b > 0"), "key").withColumn("block", _block(F.when(F.col("other"), F.col("b")).otherwise(F.col("a")))))
    rest = long.filter("other").select("key", "node", "root", "block", "a", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("at"))
    among = rest.select("node", "root", _cell_name(F.lit("bb"), F.col("key"), F.least("block", "at"), F.greatest("block", "at")).alias("cell"))
    across = long.filter("other").select("key", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("at"))
    across = across.select("node", "root", _cell_name(F.lit("ab"), F.col("key"), F.col("at"), F.col("block")).alias("cell"))
    inner = long.filter("not other").select("key", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("at"))
    inner = inner.select("node", "root", _cell_name(F.lit("ab"), F.col("key"), F.col("block"), F.col("at")).alias("cell"))
    cells = among.unionByName(across).unionByName(inner).join(more, "node")
    return found.unionByName(_compared(cells, texts, size))


# --- comparison in a cell ----------------------------------------------------------------------------------------


def cell_links(names: np.ndarray, roots: np.ndarray, keys: list[np.ndarray], kin: list[list[int]], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Forest links between the sets of a cell that are similar and not yet in one component."""
    count = len(names)
    label = np.unique(roots, return_inverse=True)[1]
    if count < 2 or not label.any():
        return []
    over, under = SIMILAR
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marks = np.zeros(ids.max() + 1, bool)
    # Lists of the cell, and the signatures by coordinate.
    posted = np.concatenate(keys)
    owner = np.repeat(np.arange(count), [len(x) for x in keys])
    list_of = np.unique(posted, return_inverse=True)[1]
    lengths = np.bincount(list_of) if len(posted) else np.empty(0, np.int64)
    members = owner[np.argsort(list_of, kind="stable")]
    list_ends = np.cumsum(lengths)
    table = np.zeros((count, COORDINATES), np.int64)
    table[owner, posted & (COORDINATES - 1)] = posted
    own_starts = np.concatenate(([0], np.cumsum([len(x) for x in keys])))
    place = {name: n for n, name in enumerate(names.tolist())}
    asked: list[list[int]] = [[] for _ in range(count)]
    for n, others in enumerate(kin):
        for other in others:
            if (m := place.get(other)) is not None:
                asked[max(n, m)].append(min(n, m))
    links = []
    for x in range(1, count):
        own = list_of[own_starts[x] : own_starts[x + 1]]
        short = own[np.argsort(lengths[own], kind="stable")][: max(0, len(own) - MATCHES + 1)]
        found = [members[list_ends[n] - lengths[n] : list_ends[n]] for n in short]
        met = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        met = met[met < x]
        met = met[label[met] != label[x]]
        if len(met):  # the long lists are probed for these alone
            met = met[((table[met] == table[x]) & (table[x] != 0)).sum(axis=1) >= MATCHES]
        met = np.union1d(met, [m for m in asked[x] if label[m] != label[x]]).astype(np.int64)
        met = met[np.minimum(sizes[met], sizes[x]) * under >= np.maximum(sizes[met], sizes[x]) * over]
        if not len(met):
            continue
        marks[ids[starts[x] : starts[x + 1]]] = True
        both = np.array([np.count_nonzero(marks[ids[starts[m] : starts[m + 1]]]) for m in met])
        marks[ids[starts[x] : starts[x + 1]]] = False
        alike = met[both * under >= over * (sizes[met] + sizes[x] - both)]
        joined, first = np.unique(label[alike], return_index=True)
        if len(joined):
            links += [(int(names[x]), int(names[alike[n]])) for n in first]
            label[np.isin(label, joined) | (label == label[x])] = min(int(joined[0]), int(label[x]))
    return links


def _cell_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node, root, keys, kin, text) by cell and node; copies of one row count once."""
    held: dict[int, tuple] = {}
    cell = None

    def answer():
        if len(held) < 2:
            return []
        roots, keys, kin, sets = zip(*held.values(), strict=True)
        return cell_links(np.array(list(held)), np.array(roots), list(keys), list(kin), list(sets))

    links: list[tuple[int, int]] = []
    for batch in batches:
        cells, nodes, roots = (batch.column(n).to_numpy() for n in range(3))
        for first, texts in byte_slices(batch, 5):
            for n, text in enumerate(texts, first):
                if cells[n] != cell:
                    links += answer()
                    held.clear()
                    cell = cells[n]
                if int(nodes[n]) not in held:
                    keys = np.array(batch.column(3)[n].as_py() or [], np.int64)
                    held[int(nodes[n])] = (roots[n], keys, batch.column(4)[n].as_py() or [], np.unique(shingle_hashes(text, size)))
        if links:
            yield _link_batch(links)
            links = []
    if found := links + answer():
        yield _link_batch(found)


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*links, strict=True)], names=["a", "b"])


def _compared(cells: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Links of all cells; cells: (cell, node, root, keys, kin), a node as often as cells want it."""
    rows = cells.join(texts, "node").select("cell", "node", "root", "keys", "kin", "text")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "node")
    return rows.mapInArrow(partial(_cell_batches, size=size), "a long, b long")
