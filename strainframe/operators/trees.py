"""Extremely randomised trees as joins and aggregates: all trees of all models grow level by level.

A node draws a few features and one cut for each of them; the cut that lowers
the squared error of the scaled targets most becomes its split. Draws come from
md5 of (seed, tree, node, feature), so a forest is the same wherever and in
whatever order its rows are read.

A level takes two aggregates over the rows of its large nodes: extent and
totals of each node, then both sides of each drawn cut. Both are combined before
the shuffle. A node of at most ``LOCAL_ROWS`` rows is bounded work, so it leaves
the levels and is grown to its leaves by one task; the levels left are those
that halve a tree's rows down to that number. A model with no more rows than
that has no levels: a task takes its rows once, packed, and grows a block of
its trees, a few at a time; there are no more blocks than keep the cores busy.
Where only the values of held-out rows are asked for, these walk down while
the trees grow, and the trees are not stored.
Inside a task all nodes of a level are tried together as arrays. Features,
weights and targets are whole numbers, so sums are exact, both ways give the
same splits, and equal partitions tie exactly. The tables of nodes are joined
like any others; only the plans, one row a model, are broadcast.

Sums are longs: with weights up to 1000 and targets of some million they hold
more than 10**9 rows a tree, and an overflow is an error.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strainframe.session import cut_lineage, shuffle_width

# The task function travels with the query; a cluster needs no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Steps of a feature or target, and of a weight, in one unit.
STEPS = 1_000_000
WEIGHT_STEPS = 1_000
NODE = ["model", "tree", "node"]
#: Levels that a prediction walks before its rows are stored.
WALKED = 8
#: Rows of a node that one task grows to its leaves: about 200 bytes each while it does.
LOCAL_ROWS = 1 << 20
#: Rows of all trees that a task grows together, and nodes of the trees that one task walks together.
BLOCK_ROWS = BLOCK_NODES = 500_000
#: Blocks of trees for each core, where rows are many: every block is sent all rows of its model.
BLOCKS_A_CORE = 16
#: Nodes of the largest tree that a task walks; larger ones are walked by joins.
TREE_NODES = 1 << 21
#: Nodes, and rows of them, that are tried at a time inside a task.
NODES_AT_ONCE, ROWS_AT_ONCE = 4096, 1 << 17
#: Nodes whose draws are hashed at a time.
HASHED_AT_ONCE = 4096


@dataclass(frozen=True)
class ForestOptions:
    trees: int = 200
    min_leaf: int = 2
    max_features: str | float = "sqrt"
    seed: int = 42

    def drawn(self, features: int) -> int:
        """Features drawn in a node."""
        if self.max_features == "sqrt":
            return max(1, int(math.sqrt(features)))
        if self.max_features == "log2":
            return max(1, int(math.log2(features)))
        share = float(self.max_features)
        if not 0 < share <= 1:
            raise ValueError("max_features is sqrt, log2 or a share in (0, 1]")
        return max(1, int(share * features))

    def seeded(self, more: int) -> ForestOptions:
        return replace(self, seed=self.seed + more)


def steps(value: Column, of: int = STEPS) -> Column:
    """Whole steps; the last bits of a mean do not decide which way a half is rounded."""
    return F.round(F.round(value.cast("double"), 9) * F.lit(of)).cast("long")


def sample(rows: DataFrame, features: Sequence[str], targets: Sequence[str] = (), weight: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, x, y, w): features and targets in millionths, weights in thousandths (at least one)."""
    columns = [*keep, F.array(*[steps(F.col(name)) for name in features]).alias("x")]
    if targets:
        columns.append(F.array(*[steps(F.col(name)) for name in targets]).alias("y"))
        columns.append((F.greatest(steps(F.col(weight), WEIGHT_STEPS), F.lit(1)) if weight else F.lit(WEIGHT_STEPS)).cast("long").alias("w"))
    return rows.select(*columns)


def plan_rows(spark: SparkSession, plans: Sequence[tuple[str, ForestOptions, int]]) -> DataFrame:
    """(model, seed, trees, min_leaf, width, drawn) from (model, options, features used)."""
    rows = [(name, o.seed, o.trees, o.min_leaf, width, o.drawn(width)) for name, o, width in plans]
    return spark.createDataFrame(rows, "model string, seed long, trees int, min_leaf int, width int, drawn int")


def target_scales(rows: DataFrame, targets: int) -> DataFrame:
    """(model, scale, n): population deviation of each target, in whole steps, 1 for constant ones, and the rows."""
    spread = [F.greatest(F.round(F.stddev_pop(F.col("y")[t])).cast("long"), F.lit(1).cast("long")) for t in range(targets)]
    return rows.groupBy("model").agg(F.array(*spread).alias("scale"), F.count("*").alias("n"))


def _extents(state: DataFrame, features: int, targets: int) -> DataFrame:
    """Rows, weight, weighted targets and ranges of every open node."""
    x, y = ([F.col(name)[n] for n in range(count)] for name, count in (("x", features), ("y", targets)))
    return state.groupBy(*NODE).agg(
        F.count("*").alias("n"),
        F.sum("w").alias("weight"),
        F.array(*[F.sum(F.col("w") * value) for value in y]).alias("sums"),
        F.array(*map(F.min, x)).alias("low"),
        F.array(*map(F.max, x)).alias("high"),
        F.array(*map(F.min, y)).alias("y_low"),
        F.array(*map(F.max, y)).alias("y_high"),
    )


def _draws(extents: DataFrame, plans: DataFrame) -> DataFrame:
    """The cuts that each splittable node tries: (feature, cut).

    Features are taken in the order of their hash. If all that are drawn are constant in the node, the next one that
    is not takes their place. The cut lies between the least and the largest value, at a place given by the same hash.
    """
    open_ = extents.join(F.broadcast(plans), "model").filter("n >= 2 * min_leaf and y_low <> y_high")
    order = "array_sort(transform(sequence(0, width - 1), f -> struct(md5(concat_ws('|', seed, tree, node, f)) AS h, f, low[f] AS low, high[f] AS high)))"
    live = "filter(slice(hashed, 1, drawn), c -> c.low < c.high)"
    spare = "slice(filter(hashed, c -> c.low < c.high), 1, 1)"
    place = "cast(conv(substring(c.h, 17, 8), 16, 10) as double) / 4294967296D"
    cut = f"transform(chosen, c -> struct(c.f AS f, cast(c.low as double) + cast(c.high - c.low as double) * ({place}) AS cut))"
    chosen = open_.withColumn("hashed", F.expr(order)).withColumn("chosen", F.expr(f"if(size({live}) > 0, {live}, {spare})"))
    return chosen.select(*NODE, F.expr(cut).alias("cuts"))


def _best_cuts(state: DataFrame, draws: DataFrame, plans: DataFrame, targets: int) -> DataFrame:
    """(model, tree, node, f, cut, gain) of the nodes that are split."""
    asked = state.join(draws, NODE).select(*NODE, "x", "y", "w", F.explode("cuts").alias("c"))
    asked = asked.select(*NODE, "c.f", "c.cut", "y", "w", (F.col("x")[F.col("c.f")] <= F.col("c.cut")).alias("left"))
    weighted = [F.col("w") * F.col("y")[t] for t in range(targets)]
    sides = asked.groupBy(*NODE, "f", "cut").agg(
        F.count("*").alias("n"),
        F.count_if("left").alias("n_left"),
        F.sum("w").alias("weight"),
        F.sum(F.when(F.col("left"), F.col("w")).otherwise(0)).alias("w_left"),
        *[F.sum(value).alias(f"s{t}") for t, value in enumerate(weighted)],
        *[F.sum(F.when(F.col("left"), value).otherwise(0)).alias(f"l{t}") for t, value in enumerate(weighted)],
    )
    sides = sides.join(F.broadcast(plans), "model").filter("n_left >= min_leaf and n - n_left >= min_leaf")
    number = lambda text: F.expr(text).cast("double")
    score, before = F.lit(0.0), F.lit(0.0)
    for t in range(targets):
        left, right, both, scale = number(f"l{t}"), number(f"s{t} - l{t}"), number(f"s{t}"), number(f"scale[{t}]")
        score = score + (left * left / number("w_left") + right * right / number("weight - w_left")) / (scale * scale)
        before = before + both * both / number("weight") / (scale * scale)
    ranked = sides.select(*NODE, F.struct(score.alias("score"), (-F.col("f")).alias("order"), F.col("cut"), (score - before).alias("gain")).alias("s"))
    best = ranked.groupBy(*NODE).agg(F.max("s").alias("s"))
    return best.select(*NODE, (-F.col("s.order")).cast("int").alias("f"), "s.cut", "s.gain")


def _side() -> Column:
    return F.when(F.col("x")[F.col("f")] <= F.col("cut"), "L").otherwise("R")


@dataclass(frozen=True)
class Trees:
    """Splits (model, tree, node, f, cut, gain) and leaves (model, tree, node, weight, sums); a node is its path of L and R."""

    splits: DataFrame
    leaves: DataFrame

    def values(self, rows: DataFrame, keys: Sequence[str], trees: DataFrame, targets: int, limits: Sequence[int] | None = None) -> DataFrame:
        """(keys, model, values): mean over trees of the leaf means, for rows (keys, model, x); trees: (model, trees).

        With ``limits`` there is a further column ``trees``: the mean over the first so many trees, for each limit.
        """
        nodes = self.splits.groupBy("model", "tree").agg((2 * F.count("*") + 1).alias("nodes"))
        sized = nodes.groupBy("model").agg(F.max("nodes").alias("nodes"))
        # One row a model: trees that are all leaf have no splits.
        sized = trees.join(sized, "model", "left").join(rows.groupBy("model").agg(F.count("*").alias("n")), "model").fillna(1, ["nodes"])
        sized = cut_lineage(sized)
        if (sized.agg(F.max("nodes")).first()[0] or 0) > TREE_NODES:
            return self._joined(rows, keys, trees, targets, limits)
        per = F.greatest(F.lit(1), F.least(F.col("trees"), F.floor(F.lit(BLOCK_NODES) / F.col("nodes")).cast("int"))).cast("int")
        sized = sized.withColumn("per", per).withColumn("parts", F.ceil(F.col("n") / F.lit(LOCAL_ROWS)).cast("int")).drop("n", "nodes")
        sized = cut_lineage(sized.withColumn("blocks", F.ceil(F.col("trees") / F.col("per")).cast("int")))
        groups = sized.agg(F.coalesce(F.sum(F.col("blocks") * F.col("parts")), F.lit(0)).alias("n")).first()["n"]
        wide, group = max(shuffle_width(rows.sparkSession), min(4 * groups, 4096)), ["model", "_block", "_part"]
        asked = rows.join(F.broadcast(sized), "model").withColumn("_part", F.pmod(F.xxhash64(*keys), F.col("parts")).cast("int"))
        asked = asked.select(*keys, "model", "x", "_part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_block"))
        means = F.transform("sums", lambda total: total.cast("double") / F.col("weight").cast("double"))
        grown = self.splits.select(*NODE, "f", "cut", F.lit(None).cast("array<double>").alias("means"))
        grown = grown.unionByName(self.leaves.select(*NODE, F.lit(None).cast("int").alias("f"), F.lit(None).cast("double").alias("cut"), means.alias("means")))
        grown = grown.join(F.broadcast(sized), "model").filter("tree <= trees")
        grown = grown.withColumn("_block", F.floor((F.col("tree") - 1) / F.col("per")).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        grown = grown.select(*NODE, "f", "cut", "means", "_block", "_part")
        kinds = StructType([*rows.select(*keys).schema.fields, *StructType.fromDDL("model string, trees int, total array<double>, count long").fields])

        def walked(some: pa.Table, nodes: pa.Table) -> pa.Table:
            return _walked(some, nodes, keys, targets, limits)

        pairs = asked.repartition(wide, *group).groupBy(*group).cogroup(grown.repartition(wide, *group).groupBy(*group))
        found = pairs.applyInArrow(walked, kinds)
        by = [*keys, "model"] if limits is None else [*keys, "trees", "model"]
        mean = [F.sum(F.col("total")[t]) / F.sum("count") / STEPS for t in range(targets)]
        return found.groupBy(*by).agg(F.array(*mean).alias("values"))

    def _joined(self, rows: DataFrame, keys: Sequence[str], trees: DataFrame, targets: int, limits: Sequence[int] | None) -> DataFrame:
        """The same for trees of any size: a join a level."""
        state = rows.join(F.broadcast(trees), "model").select(*keys, "model", "x", F.explode(F.sequence(F.lit(1), "trees")).alias("tree"))
        state = state.withColumn("node", F.lit(""))
        depth = self.splits.agg(F.max(F.length("node")).alias("depth")).first()["depth"]
        for level in range(-1 if depth is None else depth + 1):
            here = self.splits.filter(F.length("node") == level).select(*NODE, "f", "cut")
            state = state.join(here, NODE, "left").withColumn("node", F.concat("node", F.when(F.col("f").isNull(), "").otherwise(_side()))).drop("f", "cut")
            if level % WALKED == WALKED - 1:
                state = cut_lineage(state)
        found = state.join(self.leaves, NODE).drop("x", "node")
        if limits is not None:
            found = found.withColumn("trees", F.explode(F.array(*map(F.lit, limits)))).filter("tree <= trees")
            keys = [*keys, "trees"]
        mean = [F.avg(F.col("sums")[t].cast("double") / F.col("weight").cast("double")) / STEPS for t in range(targets)]
        return found.groupBy(*keys, "model").agg(F.array(*mean).alias("values"))

    def importances(self) -> DataFrame:
        """(model, f, importance): shares of the error removed, by tree, averaged over the trees that have a split."""
        by_tree = self.splits.groupBy("model", "tree", "f").agg(F.sum("gain").alias("gain"))
        totals = by_tree.groupBy("model", "tree").agg(F.sum("gain").alias("total")).filter("total > 0")
        grown = totals.groupBy("model").agg(F.count("*").alias("grown"))
        shares = by_tree.join(totals, ["model", "tree"]).groupBy("model", "f").agg(F.sum(F.col("gain") / F.col("total")).alias("share"))
        return shares.join(grown, "model").select("model", "f", (F.col("share") / F.col("grown")).alias("importance"))


# --- small nodes -------------------------------------------------------------------------------------------------

_SHIFTS = np.array([7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21], np.uint32).reshape(4, 4)
_SINES = np.array([int(abs(math.sin(n + 1)) * 2**32) & 0xFFFFFFFF for n in range(64)], np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(words: Sequence[np.ndarray | None]) -> list[np.ndarray]:
    """The four words of the md5 of padded messages: little-endian words, lines of features by nodes, or one for all of either; None is zero."""
    shape = np.broadcast_shapes(*(word.shape for word in words if word is not None))
    state = [np.full((1, 1), value, np.uint32) for value in _START]
    buffers = [np.empty(shape, np.uint32) for _ in range(2)]
    for first in range(0, len(words), 16):
        a, b, c, d = state
        wide = False
        for n in range(64):
            turn = n // 16
            k = (n, (5 * n + 1) % 16, (3 * n + 5) % 16, (7 * n) % 16)[turn]
            word = words[first + k]
            if not wide and (a.shape == shape or word is not None and word.shape[0] == shape[0]):
                # Up to here all features of a node have the same words.
                a, b, c, d = (np.broadcast_to(value, shape).copy() for value in (a, b, c, d))
                mixed, other = buffers
                wide = True
            out, spare = (mixed, other) if wide else (None, None)
            if turn < 2:
                x, y, z = (b, c, d) if turn == 0 else (d, b, c)
                found = np.bitwise_xor(np.bitwise_and(np.bitwise_xor(y, z, out=out), x, out=out), z, out=out)
            elif turn == 2:
                found = np.bitwise_xor(np.bitwise_xor(b, c, out=out), d, out=out)
            else:
                found = np.bitwise_xor(np.bitwise_or(np.bitwise_not(d, out=out), b, out=out), c, out=out)
            found = np.add(found, a, out=out)
            if word is not None:
                found = np.add(found, word, out=out)
            found = np.add(found, _SINES[n], out=out)
            by = _SHIFTS[turn, n % 4]
            high = np.right_shift(found, np.uint32(32 - by), out=spare)
            found = np.bitwise_or(np.left_shift(found, by, out=out), high, out=out)
            found = np.add(found, b, out=out)
            # The old first word's place takes the next product.
            a, b, c, d, mixed = d, found, b, c, a
        if wide:
            buffers = [mixed, other]
        state = [old + new for old, new in zip(state, (a, b, c, d), strict=True)]
    return state


def _hashes(heads: list[bytes], which: np.ndarray, paths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, place) of every feature in every node: the first 64 bits and the third word of md5 of head, path, '|', feature.

    Nodes are rows of ``paths``; ``which`` numbers their heads ('seed|tree|'). Nodes with heads of one length and features
    with numbers of one length have messages of one length, whose words before the feature are those of the node.
    """
    nodes, depth = paths.shape
    order, place = np.empty((nodes, width), np.uint64), np.empty((nodes, width))
    lengths = np.array([len(head) for head in heads])[which]
    for size in np.unique(lengths):
        every = np.flatnonzero(lengths == size)
        table = np.array([np.frombuffer(head.ljust(size), np.uint8)[:size] for head in heads])
        for first in range(0, len(every), HASHED_AT_ONCE):
            own = every[first : first + HASHED_AT_ONCE]
            for digits in range(1, len(str(width - 1)) + 1):
                some = np.arange(10 ** (digits - 1) if digits > 1 else 0, min(10**digits, width))
                start = int(size) + depth
                end = start + 1 + digits
                blocks = (end + 9 + 63) // 64
                text, tails = np.zeros((len(own), 64 * blocks), np.uint8), np.zeros((len(some), 64 * blocks), np.uint8)
                text[:, :size], text[:, size:start] = table[which[own]], paths[own]
                tails[:, start:end] = [np.frombuffer(f"|{f}".encode(), np.uint8) for f in some]
                tails[:, end] = 0x80
                tails[:, -8:] = np.frombuffer((8 * end).to_bytes(8, "little"), np.uint8)
                of_node, of_feature = np.ascontiguousarray(text.view("<u4").T), np.ascontiguousarray(tails.view("<u4").T)
                words: list[np.ndarray | None] = []
                for n in range(16 * blocks):
                    node, feature = of_node[n][None, :], of_feature[n][:, None]
                    if start // 4 <= n <= end // 4:
                        words.append(node | feature)
                    elif n < start // 4:
                        words.append(node)
                    else:
                        words.append(np.broadcast_to(feature[:1], (1, 1)) if feature.any() else None)
                a, b, c, _ = (word.byteswap() for word in _md5(words))
                order[own[:, None], some] = ((a.astype(np.uint64) << np.uint64(32)) | b).T
                place[own[:, None], some] = (c / 4294967296.0).T
    return order, place


def _best_cuts_of(x: np.ndarray, held: np.ndarray, shift: int, rows: np.ndarray, sizes: np.ndarray, totals: np.ndarray, hashed: tuple, plan: dict) -> tuple:
    """(split, feature, cut, gain, rows and totals of the left side, whether a row goes left) of nodes whose rows lie one after another.

    What ``_draws`` and ``_best_cuts`` give, from the same whole sums. ``held`` has a row's weight and weighted targets,
    ``totals`` their sums in a node; the weight carries a one ``shift`` bits up, so that rows are counted with it.
    """
    width, drawn, least = plan["width"], plan["drawn"], plan["min_leaf"]
    order, place = hashed
    starts, lanes, flat = np.cumsum(sizes) - sizes, np.arange(len(sizes)), x.ravel()
    ranked = np.argsort(order, axis=1, kind="stable")
    f = np.sort(ranked[:, :drawn], axis=1)
    row_at = rows * x.shape[1]
    values = np.ascontiguousarray(flat.take(row_at[:, None] + np.repeat(f, sizes, axis=0)).T)
    low, high = np.minimum.reduceat(values, starts, axis=1), np.maximum.reduceat(values, starts, axis=1)
    dead = np.flatnonzero(~(low < high).any(axis=0))
    if len(dead) and drawn < width:
        # All that are drawn are constant: the next one that is not, in the order of the hash, takes their place.
        some = np.flatnonzero(np.repeat(np.isin(lanes, dead), sizes))
        inner = np.cumsum(sizes[dead]) - sizes[dead]
        at, taken = np.repeat(np.arange(len(dead)), sizes[dead]), np.zeros(len(dead), bool)
        for k in range(drawn, width):
            spare = ranked[dead, k]
            value = flat[row_at[some] + spare[at]]
            least_value, largest = np.minimum.reduceat(value, inner), np.maximum.reduceat(value, inner)
            fresh = ~taken & (least_value < largest)
            own = dead[fresh]
            f[own, 0], low[0, own], high[0, own] = spare[fresh], least_value[fresh], largest[fresh]
            here = fresh[at]
            values[0][some[here]] = value[here]
            taken |= fresh
            if taken.all():
                break
    cuts = low.astype(np.float64) + (high - low).astype(np.float64) * place[lanes, f.T]
    # Whole features lie at or below a cut if they do so for the whole number below it.
    bounds = np.floor(cuts).astype(x.dtype) if x.dtype.kind == "i" else cuts
    own = np.ascontiguousarray(held.take(rows, axis=0).T)
    squares = [float(scale) * float(scale) for scale in plan["scale"]]
    mask = (1 << shift) - 1
    weight = totals[0] & mask
    before = np.zeros(len(sizes))
    for total, square in zip(totals[1:], squares, strict=True):
        before += total.astype(np.float64) * total.astype(np.float64) / weight.astype(np.float64) / square
    best, chosen, lefts = np.full(len(sizes), -np.inf), np.full(len(sizes), -1), np.zeros_like(totals)
    sides = np.empty((drawn, len(rows)), bool)
    for k in range(drawn):
        np.less_equal(values[k], np.repeat(bounds[k], sizes), out=sides[k])
        part = np.add.reduceat(own & -sides[k].astype(np.int64), starts, axis=1)
        count, w_left = part[0] >> shift, part[0] & mask
        valid = (low[k] < high[k]) & (count >= least) & (sizes - count >= least)
        if not valid.any():
            continue
        score = np.zeros(len(sizes))
        with np.errstate(divide="ignore", invalid="ignore"):
            for one, total, square in zip(part[1:], totals[1:], squares, strict=True):
                a, b = one.astype(np.float64), (total - one).astype(np.float64)
                score = score + (a * a / w_left.astype(np.float64) + b * b / (weight - w_left).astype(np.float64)) / square
        better = np.flatnonzero(valid & (score > best))  # the first of equals: features ascend
        best[better], chosen[better], lefts[:, better] = score[better], k, part[:, better]
    k = np.maximum(chosen, 0)
    left = sides.ravel().take(np.repeat(k * len(rows), sizes) + np.arange(len(rows)))
    return chosen >= 0, f[lanes, k], cuts[k, lanes], best - before, lefts, left


def _strings(paths: np.ndarray) -> pa.Array:
    """Rows of letters as strings."""
    count, depth = paths.shape
    offsets = np.arange(count + 1, dtype=np.int64) * depth
    return pa.LargeStringArray.from_buffers(count, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(paths).tobytes())).cast(pa.string())


@dataclass(frozen=True)
class Level:
    """Nodes of one depth: number of their tree, letters of their path, splits, weight and weighted targets."""

    which: np.ndarray
    paths: np.ndarray
    split: np.ndarray
    f: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    weight: np.ndarray
    sums: np.ndarray


def _levels(x: np.ndarray, y: np.ndarray, w: np.ndarray, plan: dict, trees: Sequence[int], start: str = "") -> Iterator[Level]:
    """The nodes below one node of each of some trees, level by level, all trees together."""
    heads = [f"{plan['seed']}|{tree}|".encode() for tree in trees]
    shift = int(w.sum()).bit_length()
    if shift + len(w).bit_length() > 62:
        raise OverflowError("weights are too large to be summed")
    held = np.column_stack([w + (1 << shift), w[:, None] * y])
    # Rows with the same targets have the same number.
    alike = np.zeros(len(w), np.int64)
    for target in y.T:
        alike = np.unique(alike * (len(w) + 1) + np.unique(target, return_inverse=True)[1], return_inverse=True)[1]
    rows, sizes = np.tile(np.arange(len(w)), len(trees)), np.full(len(trees), len(w))
    which, totals = np.arange(len(trees)), np.tile(held.sum(axis=0)[:, None], len(trees))
    paths = np.tile(np.frombuffer(start.encode(), np.uint8), (len(trees), 1))
    while len(sizes):
        starts = np.cumsum(sizes) - sizes
        found = Level(which, paths, np.zeros(len(sizes), bool), *(np.zeros(len(sizes), kind) for kind in (np.int64, float, float)), totals[0] & ((1 << shift) - 1), totals[1:])
        lefts, dealt = np.zeros_like(totals), []
        tried = np.flatnonzero(sizes >= 2 * plan["min_leaf"])
        # Some nodes at a time: their hashes and drawn values are in memory together.
        first, upto = 0, np.cumsum(sizes[tried])
        while first < len(tried):
            done = upto[first - 1] if first else 0
            last = max(first + 1, min(first + NODES_AT_ONCE, int(np.searchsorted(upto, done + ROWS_AT_ONCE, side="right"))))
            some, first = tried[first:last], last
            own = rows[np.repeat(starts[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(int(sizes[some].sum()))]
            kinds, begin = alike.take(own), np.cumsum(sizes[some]) - sizes[some]
            varies = np.minimum.reduceat(kinds, begin) != np.maximum.reduceat(kinds, begin)
            if not varies.all():
                own, some = own[np.repeat(varies, sizes[some])], some[varies]
                if not len(some):
                    continue
            split, f, cut, gain, part, left = _best_cuts_of(
                x, held, shift, own, sizes[some], totals[:, some], _hashes(heads, which[some], paths[some], plan["width"]), plan
            )
            kept = np.repeat(split, sizes[some])
            some = some[split]
            found.split[some], found.f[some], found.cut[some], found.gain[some], lefts[:, some] = True, f[split], cut[split], gain[split], part[:, split]
            # Rows of a node that is split: those that go left, then the others, each in their order.
            ones, counts = part[0, split] >> shift, sizes[some]
            begin, place = np.cumsum(counts) - counts, np.empty(int(counts.sum()), rows.dtype)
            place[np.repeat(begin - np.cumsum(ones) + ones, ones) + np.arange(int(ones.sum()))] = own[kept & left]
            rest = counts - ones
            place[np.repeat(begin + ones - np.cumsum(rest) + rest, rest) + np.arange(int(rest.sum()))] = own[kept & ~left]
            dealt.append(place)
        yield found
        inner = np.flatnonzero(found.split)
        if not len(inner):
            return
        rows = np.concatenate(dealt)
        totals = np.stack([lefts[:, inner], totals[:, inner] - lefts[:, inner]], axis=2).reshape(len(totals), -1)
        sizes, which = totals[0] >> shift, np.repeat(which[inner], 2)
        sides = np.tile(np.frombuffer(b"LR", np.uint8), len(inner))
        paths = np.column_stack([np.repeat(paths[inner], 2, axis=0), sides])


def _grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, plan: dict, trees: Sequence[int], start: str = "") -> pa.Table:
    """Splits and leaves below one node of each of some trees."""
    parts, numbers, lists = [], np.array(trees, np.int32), pa.list_(pa.int64())
    for level in _levels(x, y, w, plan, trees, start):
        names = _strings(level.paths)
        for own in (np.flatnonzero(level.split), np.flatnonzero(~level.split)):
            if not len(own):
                continue
            empty = lambda kind: pa.nulls(len(own), kind)  # noqa: B023
            if level.split[own[0]]:
                columns = [pa.array(level.f[own], pa.int32()), pa.array(level.cut[own]), pa.array(level.gain[own]), empty(pa.int64()), empty(lists)]
            else:
                offsets = np.arange(len(own) + 1, dtype=np.int32) * y.shape[1]
                sums = pa.ListArray.from_arrays(pa.array(offsets), pa.array(level.sums[:, own].T.ravel(), pa.int64()))
                columns = [*map(empty, (pa.int32(), pa.float64(), pa.float64())), pa.array(level.weight[own], pa.int64()), sums]
            model = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(own), np.int32)), pa.array([plan["model"]])).cast(pa.string())
            parts.append(pa.table([model, pa.array(numbers[level.which[own]]), names.take(pa.array(own)), *columns], names=[*NODE, "f", "cut", "gain", "weight", "sums"]))
    return pa.concat_tables(parts)


def _scored(x: np.ndarray, y: np.ndarray, w: np.ndarray, plan: dict, trees: Sequence[int], asked: np.ndarray) -> np.ndarray:
    """(tree, row, target): the leaf means of further rows, which walk down with the trees as these grow."""
    values = np.empty((len(trees), len(asked), y.shape[1]))
    row, node, flat = np.tile(np.arange(len(asked)), len(trees)), np.repeat(np.arange(len(trees)), len(asked)), asked.ravel()
    for level in _levels(x, y, w, plan, trees):
        means = (level.sums / level.weight.astype(np.float64)).T
        ends = ~level.split[node]
        if ends.any():
            at = node[ends]
            values[level.which[at], row[ends]] = means[at]
            row, node = row[~ends], node[~ends]
        right = ~(flat.take(row * asked.shape[1] + level.f[node]) <= level.cut[node])
        node = 2 * (np.cumsum(level.split) - 1)[node] + right
    return values


def _numbers(group: pa.Table | pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = group[name].combine_chunks() if isinstance(group, pa.Table) else group[name]
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, width)


def _packed(rows: DataFrame, columns: Sequence[tuple[str, int]], model: bool) -> DataFrame:
    """([model,] n, data): rows in chunks, numbers of a column after one another, so that they are sent as they are and few."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["model"].unique().to_pylist() if model else [None]
            for name in names if batch.num_rows else []:
                own = batch.filter(pc.equal(batch["model"], name)) if model else batch
                numbers = [_whole_numbers(own[column], width) for column, width in columns]
                data = pa.compress(np.ascontiguousarray(np.concatenate(numbers, axis=1).T).tobytes(), codec="zstd", asbytes=True)
                found = {"n": pa.array([own.num_rows], pa.int32()), "data": pa.array([data], pa.binary())}
                yield pa.record_batch({"model": pa.array([name]), **found} if model else found)

    kept = rows.select(*(["model"] if model else []), *[name for name, _ in columns])
    return kept.mapInArrow(packed, f"{'model string, ' if model else ''}n int, data binary")


def _whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs or of lists of longs; NULL is the least long."""
    flat = column.flatten() if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else column
    return flat.cast(pa.int64()).fill_null(NOTHING).to_numpy(zero_copy_only=False).reshape(-1, width)


def _unpacked(chunks: Sequence[tuple[int, bytes]], width: int) -> np.ndarray:
    """The chunks' rows, a line a column."""
    parts = [np.frombuffer(pa.decompress(data, decompressed_size=8 * n * width, codec="zstd"), np.int64).reshape(width, n) for n, data in chunks]
    return np.concatenate(parts, axis=1)


def _features(columns: np.ndarray) -> np.ndarray:
    """Rows of features, as narrow as they allow; a feature with a NULL in a node is not drawn there."""
    if (columns == NOTHING).any():
        return np.ascontiguousarray(np.where(columns == NOTHING, np.nan, columns).T)
    fits = columns.size and columns.min() >= np.iinfo(np.int32).min and columns.max() <= np.iinfo(np.int32).max
    return np.ascontiguousarray(columns.T, np.int32 if fits else np.int64)


def _asked_rows(columns: np.ndarray, targets: int) -> tuple[np.ndarray, np.ndarray]:
    """(targets, weight) of rows; both have to be there."""
    if (columns[: targets + 1] == NOTHING).any():
        raise ValueError("targets and weights of trees may not be NULL")
    return np.ascontiguousarray(columns[:targets].T), columns[targets].copy()


def _dealt(chunks: DataFrame, plans: DataFrame, width: int) -> tuple[DataFrame, Callable]:
    """Chunks of (model, n, data), or of (n, data) for all models, sent to the blocks of trees that need them; a partition is a block.

    The function gives (plan, lists of trees to be grown together, columns of the rows) of the blocks of a partition.
    """
    spark = chunks.sparkSession
    most, least = (-(-count * spark.sparkContext.defaultParallelism // max(1, plans.count())) for count in (BLOCKS_A_CORE, 4))
    blocks = [(row.asDict(), block) for row in _blocked(plans, most, least).collect() for block in range(row["blocks"])]
    asked = spark.createDataFrame([(n, plan["model"]) for n, (plan, _) in enumerate(blocks)], "block int, model string")
    both = chunks.join(F.broadcast(asked), "model") if "model" in chunks.columns else chunks.crossJoin(F.broadcast(asked))
    some = both.select("block", "n", "data").repartitionById(max(1, len(blocks)), F.col("block"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[range], np.ndarray]]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for block, n, data in zip(*(batch[name].to_pylist() for name in ("block", "n", "data")), strict=True):
                held.setdefault(block, []).append((n, data))
        for number in sorted(held):
            plan, block = blocks[number]
            first, last = block * plan["per"] + 1, min((block + 1) * plan["per"], plan["trees"])
            together = max(1, BLOCK_ROWS // max(1, plan["n"]))
            yield plan, [range(tree, min(tree + together, last + 1)) for tree in range(first, last + 1, together)], _unpacked(held.pop(number), width)

    return some, work


#: How a NULL is packed.
NOTHING = np.iinfo(np.int64).min
GROWN = "model string, tree int, node string, f int, cut double, gain double, weight long, sums array<long>"


def _finished(state: DataFrame, plans: DataFrame, features: int, targets: int) -> DataFrame:
    """Everything below small nodes."""
    # A number of tasks of its own: rows are narrow, but the work on them is not, so small partitions stay apart.
    rows = state.join(F.broadcast(plans.drop("trees")), "model").repartition(shuffle_width(state.sparkSession), *NODE)

    def grown(group: pa.Table) -> pa.Table:
        plan = {name: group[name][0].as_py() for name in ("model", "tree", "node", "seed", "min_leaf", "width", "drawn", "scale")}
        return _grown(_numbers(group, "x", features), _numbers(group, "y", targets), group["w"].to_numpy(), plan, [plan["tree"]], plan["node"])

    return rows.groupBy(*NODE).applyInArrow(grown, GROWN)


def _whole(rows: DataFrame, plans: DataFrame, features: int, targets: int) -> DataFrame:
    """All trees of models with few rows: a task takes the rows of a model once and grows a block of its trees."""
    chunks = _packed(rows, [("x", features), ("y", targets), ("w", 1)], model=True)
    spread, work = _dealt(chunks, plans, features + targets + 1)

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for plan, groups, columns in work(batches):
            x, (y, w) = _features(columns[:features]), _asked_rows(columns[features:], targets)
            del columns
            for trees in groups:
                yield from _grown(x, y, w, plan, trees).to_batches()

    return spread.mapInArrow(grown, GROWN)


def held_out_values(rows: DataFrame, plans: DataFrame, of: Mapping[str, int], limits: Mapping[str, Sequence[int]], features: int, targets: int) -> DataFrame:
    """(model, trees, row, total, count): sums over the first so many trees of the leaf means, for each limit of a model.

    Rows (row, fold, x, y, w) outside the fold a model is ``of`` are what its trees grow on, those in it walk down with
    them. So trees are not stored, and a task is sent all rows once for a block of trees.
    """
    chunks = _packed(rows, [("x", features), ("y", targets), ("w", 1), ("fold", 1), ("row", 1)], model=False)
    spread, work = _dealt(chunks, plans, features + targets + 3)
    of, limits = dict(of), {name: sorted(values) for name, values in limits.items()}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for plan, groups, columns in work(batches):
            fold, names, model = columns[-2], columns[-1], plan["model"]
            held, train = fold == of[model], (fold != of[model]) & (fold != NOTHING)
            every, (y, w) = _features(columns[: plan["width"]]), _asked_rows(columns[features:, train], targets)
            names = names[held].copy()
            x, asked = every[train], every[held]
            del columns, fold, every
            sums = {limit: np.zeros((len(names), targets)) for limit in limits[model]}
            counts = dict.fromkeys(sums, 0)
            for trees in groups:
                for tree, values in zip(trees, _scored(x, y, w, plan, trees, asked), strict=True):
                    for limit in sums:
                        if tree <= limit:
                            sums[limit] += values
                            counts[limit] += 1
            for limit, total in sums.items():
                if counts[limit] and len(names):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * targets), pa.array(total.ravel()))
                    same = lambda value, kind: pa.array(np.full(len(names), value), kind)  # noqa: B023
                    found = [pa.array([model] * len(names)), same(limit, pa.int32()), pa.array(names), lists, same(counts[limit], pa.int64())]
                    yield from pa.table(found, names=["model", "trees", "row", "total", "count"]).to_batches()

    return spread.mapInArrow(scored, "model string, trees int, row long, total array<double>, count long")


def _blocked(plans: DataFrame, most: int = 200, least: int = 1) -> DataFrame:
    """Adds ``per``, the trees of a block, and ``blocks``, from the rows of each model; many rows have few blocks, few rows enough of them."""
    few = F.least(F.ceil(F.col("trees") / F.lit(least)), F.floor(F.lit(BLOCK_ROWS) / F.greatest("n", F.lit(1))))
    per = F.greatest(F.lit(1), few, F.ceil(F.col("trees") / F.lit(most)))
    return plans.withColumn("per", per.cast("int")).withColumn("blocks", F.ceil(F.col("trees") / F.col("per")).cast("int"))


def _walked(some: pa.Table, nodes: pa.Table, keys: Sequence[str], targets: int, limits: Sequence[int] | None) -> pa.Table:
    """(keys, model, trees, total, count): sums over a block's trees of the leaf means, for each limit."""
    wanted = [None] if limits is None else list(limits)
    parts = []
    if some.num_rows and nodes.num_rows:
        lists = some["x"].combine_chunks()
        x = np.array(lists.flatten().to_numpy(zero_copy_only=False)).reshape(some.num_rows, -1)
        tree = nodes["tree"].to_numpy()
        f, cut = nodes["f"].fill_null(-1).to_numpy(), nodes["cut"].fill_null(0.0).to_numpy()
        leaf = np.flatnonzero(f < 0)
        means = np.zeros((len(tree), targets))
        means[leaf] = nodes["means"].combine_chunks().take(pa.array(leaf)).flatten().to_numpy(zero_copy_only=False).reshape(-1, targets)
        names = nodes["node"].combine_chunks()
        totals, counts = [np.zeros((some.num_rows, targets)) for _ in wanted], [0] * len(wanted)
        for number in np.unique(tree):
            own = np.flatnonzero(tree == number)
            value = means[own][_places(x, names.take(pa.array(own)).to_pylist(), f[own], cut[own])]
            for n, limit in enumerate(wanted):
                if limit is None or number <= limit:
                    totals[n] += value
                    counts[n] += 1
        offsets = np.arange(some.num_rows + 1, dtype=np.int32) * targets
        for limit, total, count in zip(wanted, totals, counts, strict=True):
            if count:
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel()))
                more = [pa.array([limit] * some.num_rows, pa.int32()), listed, pa.array(np.full(some.num_rows, count, np.int64))]
                parts.append(pa.table([*(some[name] for name in keys), some["model"], *more], names=[*keys, "model", "trees", "total", "count"]))
    if parts:
        return pa.concat_tables(parts)
    types = [*(some.schema.field(name).type for name in keys), pa.string(), pa.int32(), pa.list_(pa.float64()), pa.int64()]
    return pa.table([pa.array([], kind) for kind in types], names=[*keys, "model", "trees", "total", "count"])


def _places(x: np.ndarray, names: list[str], f: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The number of each row's leaf among the nodes of one tree."""
    number = {name: n for n, name in enumerate(names)}
    inner = np.flatnonzero(f >= 0)
    sides = np.zeros((2, len(names)), np.int64)
    for side, letter in enumerate("LR"):
        sides[side, inner] = [number[names[n] + letter] for n in inner]
    at, moving = np.full(len(x), number[""]), np.arange(len(x))
    while len(moving):
        moving = moving[f[at[moving]] >= 0]
        node = at[moving]
        right = ~(x[moving, f[node]] <= cut[node])
        at[moving] = sides[right.astype(np.int64), node]
    return at


# --- a forest ----------------------------------------------------------------------------------------------------


def grow(rows: DataFrame, plans: DataFrame, features: int, targets: int, local_rows: int = LOCAL_ROWS) -> Trees:
    """Trees of every model in plans from rows (model, x, y, w).

    A node ends if it has fewer than twice the least leaf, if its targets are constant, or if no drawn cut leaves enough
    rows on both sides. Nodes of at most ``local_rows`` rows are grown by one task each, larger ones level by level;
    trees of a model that is no larger are grown in blocks.
    """
    sized = cut_lineage(plans.join(target_scales(rows, targets), "model"))
    splits, leaves = [], []
    few = sized.filter(F.col("n") <= local_rows)
    if not few.isEmpty():
        grown = cut_lineage(_whole(rows, few, features, targets))
        splits.append(grown.filter("f is not null").select(*NODE, "f", "cut", "gain"))
        leaves.append(grown.filter("f is null").select(*NODE, "weight", "sums"))
    plans = sized.filter(F.col("n") > local_rows).drop("n")
    if plans.isEmpty() and splits:
        return Trees(splits[0], leaves[0])
    state = rows.join(F.broadcast(plans.select("model", "trees")), "model")
    state = state.select("model", F.explode(F.sequence(F.lit(1), "trees")).alias("tree"), F.lit("").alias("node"), "x", "y", "w")
    while True:
        state = cut_lineage(state)
        sizes = cut_lineage(state.groupBy(*NODE).agg(F.count("*").alias("n")))
        small = cut_lineage(_finished(state.join(sizes.filter(F.col("n") <= local_rows), NODE, "left_semi"), plans, features, targets))
        splits.append(small.filter("f is not null").select(*NODE, "f", "cut", "gain"))
        leaves.append(small.filter("f is null").select(*NODE, "weight", "sums"))
        large = sizes.filter(F.col("n") > local_rows)
        if large.isEmpty():
            break
        state = state.join(large, NODE, "left_semi")
        extents = cut_lineage(_extents(state, features, targets))
        best = cut_lineage(_best_cuts(state, _draws(extents, plans), plans, targets))
        splits.append(best)
        leaves.append(extents.join(best, NODE, "left_anti").select(*NODE, "weight", "sums"))
        state = state.join(best, NODE).withColumn("node", F.concat("node", _side())).select(*state.columns)
    return Trees(_stacked(splits), _stacked(leaves))


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return cut_lineage(whole)
