"""SimHash near-duplicates through a hierarchical index in Gray order.

Fingerprints that differ in at most ``d`` of 64 bits agree on at least one of
``d + 1`` bit blocks. Every fingerprint is filed once under each block; a group
(same bits under the same mask) is the top node of an index. Groups that are too
large are split again by the blocks of the bits that remain, so a group of any
size ends in bounded ones and no pair within distance ``d`` is lost.

Inside a group the fingerprints are sorted by Gray rank, which puts those with
long shared bit patterns side by side. Runs of them become nodes that hold the
bits all members share; the bits an upper node already holds are factored out
of the lower ones. A search adds up the differing bits on its way down and drops
a whole node as soon as the sum exceeds ``d``.

A group answers with a spanning forest of its links, not with its pairs, and
rounds of large-star and small-star steps join the forests to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.llm.common import byte_slices
from strainframe.session import cut_lineage

BITS = 64
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
#: Fingerprints of a group that one task searches; larger groups are split by further bits.
GROUP_ROWS = 4096
#: Children of an index node.
FAN_OUT = 8
#: Rows a task gathers before it builds the indexes of the groups it has read.
BATCH_ROWS = 1 << 17
#: Query-times-group-size products searched at a time.
SEARCH_CELLS = 1 << 22
SEED = 42
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# --- fingerprints ------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of a text's words, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hashed(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it; no hashes: zero."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(len(hashes), 8)
    if len(hashes) < 2000:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, place], minlength=256) @ _BYTE_BITS for place in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in byte_slices(batch, 1):
            prints = np.fromiter((simhash(shingle_hashes(text, size)) for text in texts), np.uint64, len(texts))
            ids = batch.column(0).slice(first, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(prints.view(np.int64))], names=["id", "print"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, print): the 64-bit fingerprint of every row's whole text as a signed long."""
    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(partial(_fingerprint_batches, size=size), f"id {kind}, print long")


def hexadecimal(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


# --- the index ---------------------------------------------------------------------------------------------------


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    rank = prints.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _chunks(groups: np.ndarray, fan_out: int) -> np.ndarray:
    """Starts of runs of at most ``fan_out`` neighbours of the same group."""
    begins = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    place = np.arange(len(groups)) - np.repeat(begins, np.diff(np.append(begins, len(groups))))
    return np.flatnonzero(place % fan_out == 0)


def build_index(groups: np.ndarray, prints: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Levels of the index from the top nodes (one a group) to the fingerprints; rows are sorted by group and rank."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = len(prints)
    level = {"group": groups, "all": prints, "any": prints, "last": np.arange(rows), "mask": np.full(rows, full)}
    levels = [level]
    while len(level["group"]) > len(np.unique(groups)):
        cuts = _chunks(level["group"], FAN_OUT)
        ends = np.append(cuts[1:], len(level["group"]))
        every, some = np.bitwise_and.reduceat(level["all"], cuts), np.bitwise_or.reduceat(level["any"], cuts)
        parent = {"group": level["group"][cuts], "all": every, "any": some, "last": level["last"][ends - 1], "mask": every | ~some}
        parent |= {"first": cuts, "children": ends - cuts}
        # What the upper node holds is factored out of the lower ones.
        level["own"] = level["mask"] & ~np.repeat(parent["mask"], parent["children"])
        levels.append(parent)
        level = parent
    level["own"] = level["mask"]
    return levels[::-1]


def search(levels: list[dict[str, np.ndarray]], prints: np.ndarray, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, match) row pairs within the distance, matches after their query only."""
    top = levels[0]
    node = np.searchsorted(top["last"], queries)
    asked, spent = queries, np.zeros(len(queries), np.int64)
    for depth, level in enumerate(levels):
        if depth:
            upper = levels[depth - 1]
            count = upper["children"][node]
            offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            node, asked, spent = np.repeat(upper["first"][node], count) + offset, np.repeat(asked, count), np.repeat(spent, count)
        spent = spent + np.bitwise_count((prints[asked] ^ level["all"][node]) & level["own"][node])
        kept = (spent <= distance) & (level["last"][node] > asked)
        node, asked, spent = node[kept], asked[kept], spent[kept]
    return asked, node


def forest(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row over the given links."""
    label = np.arange(size)
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


def group_links(groups: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest links (member, root) of all groups; group numbers in any order, values distinct within a group."""
    order = np.lexsort((gray_rank(prints), groups))
    groups, prints = groups[order], prints[order]
    sizes = np.bincount(np.unique(groups, return_inverse=True)[1])
    many = np.repeat(sizes > 1, sizes)
    groups, prints = groups[many], prints[many]
    if not len(prints):
        return prints, prints
    levels = build_index(groups, prints)
    cost = np.cumsum(np.repeat(sizes[sizes > 1], sizes[sizes > 1]))
    label, start = np.arange(len(prints)), 0
    while start < len(prints):
        stop = int(np.searchsorted(cost, (cost[start - 1] if start else 0) + SEARCH_CELLS)) + 1
        left, right = search(levels, prints, np.arange(start, min(stop, len(prints))), distance)
        linked = np.flatnonzero(label != np.arange(len(label)))
        label = forest(len(label), np.concatenate((left, linked)), np.concatenate((right, label[linked])))
        start = stop
    member = np.flatnonzero(label != np.arange(len(label)))
    return prints[member], prints[label[member]]


def _link_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, bits, print) sorted by mask and bits; whole groups are searched together."""

    def answer(masks, bits, prints):
        new = np.concatenate(([True], (masks[1:] != masks[:-1]) | (bits[1:] != bits[:-1])))
        left, right = group_links(np.cumsum(new), prints.view(np.uint64), distance)
        return pa.RecordBatch.from_arrays([pa.array(left.view(np.int64)), pa.array(right.view(np.int64))], names=["a", "b"])

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate((old, batch.column(n).to_numpy())) for n, old in enumerate(held)]
        if len(held[0]) < BATCH_ROWS:
            continue
        masks, bits, _ = held
        last = np.flatnonzero((masks != masks[-1]) | (bits != bits[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield answer(*(part[:cut] for part in held))
            held = [part[cut:] for part in held]
    if len(held[0]):
        yield answer(*held)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks(used: int, distance: int) -> list[int]:
    """``used`` plus each of ``distance + 1`` blocks of the other bits."""
    free = [bit for bit in range(BITS) if not used >> bit & 1]
    cuts = [len(free) * n // (distance + 1) for n in range(distance + 2)]
    blocks = [free[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return [used | sum(1 << bit for bit in block) for block in blocks if block]


def _filed(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each (mask, print) row once under every finer mask."""
    finer = F.create_map(*[x for key, new in masks.items() for x in (F.lit(_signed(key)), F.array(*map(F.lit, map(_signed, new))))])
    spread = rows.select(F.explode(finer[F.col("mask")]).alias("mask"), "print")
    return spread.select("mask", F.col("mask").bitwiseAND(F.col("print")).alias("bits"), "print")


def links(prints: DataFrame, distance: int = MAX_DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within the distance, transitively."""
    masks = {0: block_masks(0, distance)}
    rows, done = _filed(prints.select(F.lit(0).cast("long").alias("mask"), "print"), masks), []
    while True:
        # Sizes are at most one row for each group that is too large.
        rows = cut_lineage(rows)
        large = cut_lineage(rows.groupBy("mask", "bits").count().filter(F.col("count") > group_rows).drop("count"))
        used = [row["mask"] & (2**64 - 1) for row in large.select("mask").distinct().collect()]
        splittable = {mask: finer for mask in used if len(finer := block_masks(mask, distance)) > 1}
        if not splittable:
            done.append(rows)
            break
        hot = large.filter(F.col("mask").isin([_signed(mask) for mask in splittable]))
        done.append(rows.join(hot, ["mask", "bits"], "left_anti").select("mask", "bits", "print"))
        rows = _filed(rows.join(hot, ["mask", "bits"], "left_semi"), splittable).distinct()
    filed = done[0]
    for more in done[1:]:
        filed = filed.unionByName(more)
    filed = filed.repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return filed.mapInArrow(partial(_link_batches, distance=distance), "a long, b long")


# --- components --------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has an edge.

    Large-star and small-star rounds; every round is written to the shared
    folder, so a lost executor costs no more than the round. A hub's rows meet one
    row with its smallest neighbour, a join that Spark can split.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low"))
        large = both.join(lowest, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        large = large.filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        met = large.join(lowest, "a")
        small = met.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        edges = cut_lineage(small.select("e.a", "e.b").filter("a <> b").distinct())


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE
) -> DataFrame:
    """(id, print, component): the smallest id reachable over links of at most ``distance`` differing bits.

    A null text counts as empty; texts without words have fingerprint zero and are
    linked like any other. Rows with a null id belong to groups as well, but name
    none unless no member has an id. Other columns are not read; an empty table
    gives an empty result, repeated rows one row each.
    """
    prints = cut_lineage(fingerprints(docs, id_column, text_column, size))
    nodes = cut_lineage(prints.groupBy("print").agg(F.min("id").alias("least")))
    roots = components(links(nodes, distance))
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = cut_lineage(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(named, "root").select("print", "component")
    return prints.join(named, "print").select("id", "print", "component")
