"""Ordered window work that does not put an unbounded key into one task.

``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task,
which fails when one key holds a third of the table. The rows per key are
counted first (one narrow column, combined before the shuffle). While the
largest key stays below ``KEY_ROWS`` the plain window is the best plan: one hash
shuffle on the key, shared by all steps.

Otherwise the rows are range partitioned on (key, order), so a long key is
spread over many sorted *runs*. Windows are evaluated per (key, run), and what a
run has to know about the runs before it travels in a small carry table.

Size bound of the carry table: only a key that crosses a run boundary has an
entry, there are ``runs - 1`` boundaries, so it holds at most one row per run
(times the number of distinct ``within`` values, e.g. chart columns). That is
why it is safe to broadcast.

The run number depends on sampled range bounds, so the frame is checkpointed
once; every later step reads the same runs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.session import checkpointed, shuffle_width

RUN = "_run"

# Most rows a key may have for its window to stay in one task.
KEY_ROWS = 1_000_000
# Rows of a run, about.
RUN_ROWS = 1_000_000


class Fit(int):
    """Whether every key is small enough for a plain window; remembers the rows it has counted."""

    rows = 0


def keys_fit(frame: DataFrame, keys: Sequence[str]) -> Fit:
    limit = int(frame.sparkSession.conf.get("spark.strainframe.keyRows", str(KEY_ROWS)))
    if keys:
        sizes = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        largest, rows = sizes.agg(F.max("n"), F.sum("n")).head()
    else:
        largest = rows = frame.count()
    fit = Fit((largest or 0) <= limit)
    fit.rows = rows or 0
    return fit


def _keys_over_runs(base: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys found in more than one run: they end one run and begin another, so at most one per boundary."""
    if not keys:
        return None
    key = F.struct(*keys)
    edges = base.groupBy(RUN).agg(F.array(F.min(key), F.max(key)).alias("k")).select(RUN, F.explode("k").alias("k"))
    spread = edges.groupBy("k").agg(F.countDistinct(RUN).alias("n")).filter("n > 1").select("k.*")
    return base.sparkSession.createDataFrame(spread.collect(), base.select(*keys).schema)


def matched(left: DataFrame, right: DataFrame, names: Sequence[str]) -> DataFrame:
    """Left join on null-safe equality, dropping the right-hand key copies."""
    renamed = right
    condition = F.lit(True)
    for name in names:
        renamed = renamed.withColumnRenamed(name, f"_c_{name}")
        condition = condition & left[name].eqNullSafe(F.col(f"_c_{name}"))
    return left.join(F.broadcast(renamed), condition, "left").drop(*[f"_c_{name}" for name in names])


class OrderedRuns:
    """A frame sorted by (keys, order) and cut into runs of bounded size."""

    def __init__(
        self,
        frame: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        base: DataFrame | None = None,
        whole: bool = False,
        long_keys: DataFrame | None = None,
    ):
        self.frame = frame
        self.whole = whole
        self.long_keys = long_keys
        self.keys = list(keys)
        self.order = list(order)
        self.base = frame if base is None else base

    @classmethod
    def build(
        cls,
        frame: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        runs: int | None = None,
        whole: bool | None = None,
    ) -> OrderedRuns:
        """``order`` must be unique per key: ties then cannot pile up in one run.

        ``runs`` forces the split plan; ``whole`` passes on what ``keys_fit`` said.
        """
        if whole is None:
            whole = runs is None and keys_fit(frame, keys)
        if whole:
            return cls(frame, keys, order, whole=True)
        # The number of runs grows with the rows, so that a run stays bounded.
        width = runs or max(shuffle_width(frame.sparkSession), -(-getattr(whole, "rows", 0) // RUN_ROWS))
        placed = frame.repartitionByRange(width, *keys, *order).withColumn(RUN, F.spark_partition_id())
        base = checkpointed(placed.repartition(width, *keys, RUN))
        return cls(base, keys, order, long_keys=_keys_over_runs(base, keys))

    def _replace(self, frame: DataFrame) -> OrderedRuns:
        return OrderedRuns(frame, self.keys, self.order, self.base, self.whole, self.long_keys)

    def _carry_source(self, inputs: Mapping[str, Column], names: Sequence[str]) -> DataFrame:
        """Where carries are read from: the checkpointed rows, if they have the inputs.

        Reading the derived frame instead would repeat all earlier steps once
        per chained call. Only keys that cross a run boundary have carries.
        """
        wanted = [*dict.fromkeys([*self.keys, *names]), *[value.alias(name) for name, value in inputs.items()]]
        try:
            source = self.base.select(*wanted)
        except AnalysisException:
            source = self.frame.select(*wanted)
        if self.long_keys is None:
            return source
        renamed = self.long_keys.select([F.col(name).alias(f"_k_{name}") for name in self.keys])
        same = F.lit(True)
        for name in self.keys:
            same = same & source[name].eqNullSafe(renamed[f"_k_{name}"])
        return source.join(F.broadcast(renamed), same, "left_semi")

    def settled(self) -> OrderedRuns:
        """Checkpoint the derived columns too, before more steps build on them."""
        if self.whole:
            return self
        return OrderedRuns(checkpointed(self.frame), self.keys, self.order, long_keys=self.long_keys)

    def _span(self, *names: str):
        """Rows a window may see: the whole key, or the key's share of one run."""
        columns = list(dict.fromkeys(names)) if self.whole else [*dict.fromkeys(names), RUN]
        return Window.partitionBy(*(columns or [F.lit(0)]))

    def _window(self, within: Sequence[str] = ()):
        return self._span(*self.keys, *within).orderBy(*self.order)

    def with_columns(self, columns: Mapping[str, Column]) -> OrderedRuns:
        return self._replace(self.frame.withColumns(dict(columns)))

    def rows(self) -> DataFrame:
        return self.frame.drop(RUN)

    def attach(self, dimension: DataFrame) -> OrderedRuns:
        """Inner join with one row per key, keeping a long key spread over its runs.

        The dimension is first widened to the (key, run) pairs that exist, so the
        join is on (key, run), which the rows are already partitioned by.
        """
        if self.whole:
            return self._replace(self.frame.join(dimension, self.keys))
        places = self.base.select(*self.keys, RUN).distinct()
        return self._replace(self.frame.join(places.join(dimension, self.keys), [*self.keys, RUN]))

    def running(
        self,
        columns: Mapping[str, tuple[str, Column]],
        *,
        within: Sequence[str] = (),
        inclusive: bool = True,
    ) -> OrderedRuns:
        """Running sum / min / max / last non-null over all earlier rows of the key."""
        group = [*self.keys, *within]
        local = self._window(within).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        if self.whole:
            return self.with_columns(
                {name: _FOLD[kind](value).over(local) for name, (kind, value) in columns.items()}
            )
        inputs = {f"_in_{name}": value for name, (_, value) in columns.items()}
        frame = self.frame.withColumns(inputs)
        frame = frame.withColumns(
            {f"_own_{name}": _FOLD[kind](F.col(f"_in_{name}")).over(local) for name, (kind, _) in columns.items()}
        )
        source = self._carry_source(inputs, list(dict.fromkeys([*group, RUN, *self.order])))
        per_run = source.groupBy(*group, RUN).agg(
            *[_TOTAL[kind](F.col(f"_in_{name}"), self.order).alias(f"_t_{name}") for name, (kind, _) in columns.items()]
        )
        earlier = (
            Window.partitionBy(*group).orderBy(RUN).rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = per_run.withColumn("_seen", F.count(F.lit(1)).over(earlier))
        carry = carry.withColumns(
            {f"_cy_{name}": _FOLD[kind](F.col(f"_t_{name}")).over(earlier) for name, (kind, _) in columns.items()}
        )
        carry = carry.filter("_seen > 0").select(*group, RUN, *[f"_cy_{name}" for name in columns])
        joined = matched(frame, carry, [*group, RUN])
        joined = joined.withColumns(
            {name: _MERGE[kind](F.col(f"_cy_{name}"), F.col(f"_own_{name}")) for name, (kind, _) in columns.items()}
        )
        scratch = [f"{p}{name}" for name in columns for p in ("_in_", "_own_", "_cy_")]
        return self._replace(joined.drop(*scratch))

    def indexed(self, name: str) -> OrderedRuns:
        """0-based position of the row inside its key."""
        counted = self.running({name: ("sum", F.lit(1).cast("long"))})
        return counted.with_columns({name: F.col(name) - 1})

    def lagged(
        self,
        columns: Mapping[str, tuple[str, int]],
        *,
        within: Sequence[str] = (),
    ) -> OrderedRuns:
        """``alias -> (column, offset)``: the value ``offset`` rows earlier, across runs."""
        group = [*self.keys, *within]
        depth = max(offset for _, offset in columns.values())
        sources = sorted({source for source, _ in columns.values()})
        window = self._window(within)
        if self.whole:
            return self.with_columns(
                {alias: F.lag(source, offset).over(window) for alias, (source, offset) in columns.items()}
            )
        frame = self.frame.withColumn("_pos", F.row_number().over(window))
        wanted = list(dict.fromkeys([*group, RUN, *self.order]))
        extra = {name: F.col(name) for name in sources if name not in wanted}
        tail_rows = self._carry_source(extra, wanted).withColumn(
            "_back",
            F.row_number().over(
                Window.partitionBy(*group, RUN).orderBy(*[F.col(name).desc() for name in self.order])
            ),
        ).filter(F.col("_back") <= depth)
        tails = tail_rows.groupBy(*group, RUN).agg(
            F.sort_array(
                F.collect_list(F.struct(F.col("_back"), *[F.col(source) for source in sources]))
            ).alias("_tail")
        )
        recent = Window.partitionBy(*group).orderBy(F.col(RUN).desc()).rowsBetween(1, depth)
        carry = (
            tails.withColumn("_before", F.flatten(F.collect_list("_tail").over(recent)))
            .filter(F.size("_before") > 0)
            .select(*group, RUN, F.slice("_before", 1, depth).alias("_before"))
        )
        frame = frame.withColumns(
            {
                f"_l_{alias}": F.lag(F.struct(F.col(source).alias("v")), offset).over(window)
                for alias, (source, offset) in columns.items()
            }
        )
        joined = matched(frame, carry, [*group, RUN])
        picked = {}
        for alias, (source, offset) in columns.items():
            slot = F.lit(offset + 1) - F.col("_pos")
            carried = F.when(slot >= 1, F.get("_before", (slot - 1).cast("int"))[source])
            picked[alias] = F.when(F.col("_pos") > offset, F.col(f"_l_{alias}")["v"]).otherwise(carried)
        joined = joined.withColumns(picked)
        return self._replace(joined.drop("_pos", "_before", *[f"_l_{alias}" for alias in columns]))

    def group_totals(self, by: Sequence[str], columns: Mapping[str, tuple[str, Column]]) -> OrderedRuns:
        """Whole-group sum / min / max put on every row of the group.

        ``by`` has to be the key columns followed by leading order columns, so
        that a group is contiguous: only groups crossing a run boundary need the
        other runs' shares, again at most one per boundary.
        """
        local = self._span(*by)
        if self.whole:
            return self.with_columns(
                {name: _FOLD[kind](value).over(local) for name, (kind, value) in columns.items()}
            )
        inputs = {f"_in_{name}": value for name, (_, value) in columns.items()}
        frame = self.frame.withColumns(inputs)
        frame = frame.withColumns(
            {f"_own_{name}": _FOLD[kind](F.col(f"_in_{name}")).over(local) for name, (kind, _) in columns.items()}
        )
        source = self._carry_source(inputs, [*by, RUN])
        per_run = source.groupBy(*by, RUN).agg(
            *[_FOLD[kind](F.col(f"_in_{name}")).alias(f"_t_{name}") for name, (kind, _) in columns.items()]
        )
        whole = per_run.groupBy(*by).agg(
            F.count(F.lit(1)).alias("_spread"),
            *[_FOLD[kind](F.col(f"_t_{name}")).alias(f"_cy_{name}") for name, (kind, _) in columns.items()],
        )
        carry = whole.filter("_spread > 1").drop("_spread")
        joined = matched(frame, carry, list(by))
        joined = joined.withColumns(
            {name: F.coalesce(F.col(f"_cy_{name}"), F.col(f"_own_{name}")) for name in columns}
        )
        scratch = [f"{p}{name}" for name in columns for p in ("_in_", "_own_", "_cy_")]
        return self._replace(joined.drop(*scratch))


def _last_present(value: Column) -> Column:
    return F.last(value, ignorenulls=True)


def _last_by_order(value: Column, order: Sequence[str]) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*[F.col(name) for name in order])))


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max, "last": _last_present}
_TOTAL = {
    "sum": lambda value, order: F.sum(value),
    "min": lambda value, order: F.min(value),
    "max": lambda value, order: F.max(value),
    "last": _last_by_order,
}
_MERGE = {
    "sum": lambda carry, own: F.when(
        carry.isNotNull() | own.isNotNull(), F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
    ),
    "min": lambda carry, own: F.least(carry, own),
    "max": lambda carry, own: F.greatest(carry, own),
    "last": lambda carry, own: F.coalesce(own, carry),
}
