"""Statistics over all pairs of rows without forming the pairs.

Counts: rows are ordered as arrays inside tasks, in runs of bounded size along
both orderings (``rank_cells``).

Extremes: two rows whose ranks differ agree on the leading base-8 digits of the
rank up to one position and differ in the next one. Each row is therefore
written once per digit position, keyed by (position, leading digits); two rows
meet in exactly one of those groups. Inside a group, running totals per digit
along the other ordering give extremes over all partners seen so far. That is
n log n rows instead of n^2 pairs, and the running totals are spread over runs
by ``OrderedRuns`` however large a group is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.plans import cells
from strainframe.plans.ordered import OrderedRuns, keys_fit, matched
from strainframe.session import cut_lineage, shuffle_width

DIGIT_BITS = 3
DIGITS = 1 << DIGIT_BITS


#: Rows of a run of rank cells, about: one task orders them as arrays.
CELL_ROWS = 1 << 18


@dataclass(frozen=True)
class RankCells:
    """Ranked distinct (actual, pred) values; runs of keys that lie in several ones."""

    frame: DataFrame
    keys: tuple[str, ...]
    grid: DataFrame | None = None


def rank_cells(frame: DataFrame, keys: Sequence[str], actual: str, pred: str) -> RankCells:
    """Distinct (actual, pred) values with copies and both rank positions.

    ``a_before`` / ``p_before`` count smaller rows, ``a_ties`` / ``p_ties`` the rows sharing the value, ``total`` the
    rows of the key, ``own`` the smaller rows on both sides that were met in one run.

    Keys that fit one task are ordered there. Longer ones are cut into runs along both orders. Two rows with both values
    smaller in one of them lie in one run by ``actual``, or else in one run by ``pred``, or else in runs one before the
    other on both sides, which the counts of runs tell. So a row is sent once an order, however long its key is.
    """
    usable = frame.select(*keys, F.col(actual).cast("double").alias("a"), F.col(pred).cast("double").alias("p"))
    usable = usable.filter("a is not null and p is not null and not isnan(a) and not isnan(p)")
    fit = keys_fit(usable, keys)
    width = max(shuffle_width(frame.sparkSession), -(-fit.rows // CELL_ROWS))
    if fit:
        return RankCells(cells.whole_cells(usable.repartition(width, *keys) if keys else usable.repartition(1), keys), tuple(keys))
    rows = usable.groupBy(*keys, "a", "p").agg(F.count(F.lit(1)).alias("n"))
    for side, other, asked in (("a", "p", "p"), ("p", "a", "a_run")):
        runs = rows.repartitionByRange(width, *keys, side, F.col(other).desc()).withColumn(f"{side}_run", F.spark_partition_id())
        # The runs depend on sampled bounds, so they are kept.
        rows = _whole_ranks(cut_lineage(cells.placed(runs, keys, side, other, asked)), keys, side)
    grid = rows.groupBy(*keys, "a_run", "p_run").agg(F.sum("n").alias("n"))
    return RankCells(rows, tuple(keys), grid)


def _whole_ranks(rows: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Ranks within runs become ranks within keys; only the first and the last value of a run can lie in others."""
    run, before, ties = f"{side}_run", f"{side}_before", f"{side}_ties"
    ends = cut_lineage(
        rows.groupBy(*keys, run).agg(
            F.sum("n").alias("_n"),
            F.min(side).alias("_low"),
            F.max(side).alias("_high"),
            F.min_by(ties, side).alias("_low_ties"),
            F.max_by(ties, side).alias("_high_ties"),
        )
    )
    key = [*keys] or [F.lit(0)]
    earlier = Window.partitionBy(*key).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({"_off": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy(*key))})
    low = F.struct(F.col("_low").alias("value"), F.col("_off").alias("before"), F.col("_low_ties").alias("ties"))
    high = F.struct(F.col("_high").alias("value"), (F.col("_off") + F.col("_n") - F.col("_high_ties")).alias("before"), F.col("_high_ties").alias("ties"))
    # Both ends of a run may be one value.
    both = F.when(F.col("_low") == F.col("_high"), F.array(low)).otherwise(F.array(low, high))
    shared = Window.partitionBy(*keys, "value")
    values = ends.select(*keys, run, "_off", "_total", F.explode(both).alias("_e")).select(*keys, run, "_off", "_total", "_e.*")
    values = values.withColumns({"_before": F.min("before").over(shared), "_ties": F.sum("ties").over(shared)})
    carry = values.groupBy(*keys, run).agg(
        F.max("_off").alias("_off"), F.max("_total").alias("_total"), F.collect_list(F.struct("value", "_before", "_ties")).alias("_ends")
    )
    joined = matched(rows, cut_lineage(carry), [*keys, run])
    end = F.get(F.filter("_ends", lambda e: e["value"] == F.col(side)), F.lit(0))
    joined = joined.withColumns({"_end": end, "total": F.col("_total")})
    joined = joined.withColumns(
        {before: F.coalesce(F.col("_end._before"), F.col("_off") + F.col(before)), ties: F.coalesce(F.col("_end._ties"), F.col(ties))}
    )
    return joined.drop("_end", "_ends", "_off", "_total")


def _by_digit(
    rows: DataFrame, keys: Sequence[str], rank: str, last: Column, order: Sequence[str], carried: Sequence[str], whole: bool
) -> OrderedRuns:
    """One row per digit position of ``rank`` (at most ``last``), ordered along ``order`` in its group.

    The largest group has one row for each row of its key.
    """
    last_level = F.floor(F.log2(F.greatest(last, F.lit(2)).cast("double")) / DIGIT_BITS).cast("int")
    leveled = rows.withColumn("_level", F.explode(F.sequence(F.lit(0), last_level)))
    shift = (F.col("_level") * DIGIT_BITS).cast("int")
    digits = leveled.select(
        *keys,
        *dict.fromkeys([*order, *carried]),
        "_level",
        F.call_function("shiftright", F.col(rank), (shift + DIGIT_BITS).cast("int")).alias("_prefix"),
        F.call_function("shiftright", F.col(rank), shift).bitwiseAND(DIGITS - 1).cast("int").alias("_digit"),
    )
    return OrderedRuns.build(digits, [*keys, "_level", "_prefix"], order, whole=whole)


def _whole(count: Column) -> Column:
    """A count as a decimal: products of two stay exact up to 38 digits."""
    return count.cast("decimal(19,0)")


def comparable_pairs() -> Column:
    """Pairs without a tie on either side, as an aggregate over rank cells.

    Each value's ties are counted once per row: n rows share a group of t. Twice the
    number is summed, so that no half is ever formed.
    """
    n, a_ties, p_ties, total = (_whole(F.col(name)) for name in ("n", "a_ties", "p_ties", "total"))
    ordered = lambda count: count * _whole(count - 1)
    twice = F.max(ordered(total)) - F.sum(n * _whole(a_ties - 1)) - F.sum(n * _whole(p_ties - 1)) + F.sum(ordered(n))
    return (twice.cast("decimal(38,0)") / 2).cast("decimal(38,0)")


def order_statistics(ranked: RankCells, *more: Column) -> DataFrame:
    """Per key: comparable pairs (no tie on either side), those in the same order, and further aggregates of the cells."""
    keys, names = list(ranked.keys), [*ranked.keys, "comparable", "correct"]
    met = F.sum(_whole(F.col("n")) * _whole(F.col("own"))).cast("decimal(38,0)")
    found = ranked.frame.groupBy(*keys).agg(comparable_pairs().alias("comparable"), met.alias("correct"), *more)
    if ranked.grid is None:
        return found
    # Runs of a key squared at most, far fewer than its rows.
    width = shuffle_width(ranked.frame.sparkSession)
    counted = cells.grid_counts(ranked.grid.repartition(width, *keys) if keys else ranked.grid.repartition(1), keys)
    across = counted.filter("smaller > 0").groupBy(*keys).agg(F.sum(_whole(F.col("n")) * _whole(F.col("smaller"))).cast("decimal(38,0)").alias("_across"))
    found = matched(found, across, keys)
    correct = (F.col("correct") + F.coalesce("_across", F.lit(0).cast("decimal(38,0)"))).cast("decimal(38,0)")
    return found.withColumn("correct", correct).select(*names, *[name for name in found.columns if name not in (*names, "_across")])


def concordance(ranked: RankCells) -> DataFrame:
    """Per key: comparable pairs (no tie on either side) and those in the same order."""
    found = order_statistics(ranked)
    return found.dropna(subset=list(ranked.keys)) if ranked.keys else found


def spearman_aggregates() -> list[Column]:
    """Pearson correlation of average ranks over rank cells; 0 for fewer than two rows or a constant side."""
    middle = (F.col("total") - 1) / F.lit(2.0)
    rank = lambda side: F.col(f"{side}_before") + (F.col(f"{side}_ties") - 1) / F.lit(2.0) - middle
    product = lambda left, right: F.sum(F.col("n") * rank(left) * rank(right))
    bottom = F.sqrt(product("a", "a")) * F.sqrt(product("p", "p"))
    return [F.coalesce(F.try_divide(product("a", "p"), bottom), F.lit(0.0)).alias("spearman")]


#: Digits to which strengths are told apart; beyond them the ids decide.
STRENGTH_DIGITS = 9


def strongest_inversions(
    rows: DataFrame,
    actual: str,
    pred: str,
    identity: str,
    *,
    top_n: int,
    min_pred_gap: float = 0.0,
    min_actual_gap: float = 0.0,
) -> DataFrame:
    """Top ``top_n`` pairs ordered differently by ``pred`` and ``actual``.

    For a pair with pred_i < pred_j and actual_i > actual_j the strength
    |gap| + |gap| equals (actual - pred)_i - (actual - pred)_j. Every row i looks for
    the smallest (actual - pred) among its possible partners. Minimum gaps only
    shift the place it looks from, to (actual - gap, pred + gap), so the strongest
    pair of every row is known without forming pairs, with or without gaps. A pair
    among the ``top_n`` has its row i among the ``top_n`` rows by that strength; only
    those rows are joined with the table.
    """
    scored = rows.select(
        F.col(identity).alias("id"), F.col(actual).cast("double").alias("a"), F.col(pred).cast("double").alias("p")
    ).filter((F.abs("a") < float("inf")) & (F.abs("p") < float("inf")))
    values = cut_lineage(scored.select("a", "p").distinct())
    pred_gap, actual_gap = max(min_pred_gap, 0.0), max(min_actual_gap, 0.0)
    # Where a value and a place to look from are equal, the one comes first that makes them partners or not.
    shape = lambda look, x, y, x_turn, y_turn: F.struct(
        F.lit(look).alias("look"), x.alias("x"), y.alias("y"), F.lit(x_turn).alias("x_turn"), F.lit(y_turn).alias("y_turn")
    )
    held = shape(False, F.col("p"), F.col("a"), 1, 1)
    looks = shape(True, F.col("p") + pred_gap, F.col("a") - actual_gap, 0 if pred_gap > 0 else 2, 2 if actual_gap > 0 else 0)
    points = values.select("a", "p", F.explode(F.array(held, looks)).alias("e")).select("a", "p", "e.*")
    # Values beyond a look come after it along x and before it along y.
    whole = keys_fit(points, [])
    placed = OrderedRuns.build(points, [], ["x", "x_turn", "y", "a", "p"], whole=whole).indexed("place")
    placed = placed.group_totals([], {"total": ("sum", F.lit(1).cast("long"))}).rows()
    surplus = F.when(~F.col("look"), F.col("a") - F.col("p"))
    runs = _by_digit(placed, [], "place", F.col("total"), ["y", "y_turn", "x", "x_turn", "a", "p"], ["look"], whole)
    lowest = {f"_m{digit}": ("min", F.when(F.col("_digit") == digit, surplus)) for digit in range(1, DIGITS)}
    runs = runs.running(lowest, inclusive=False)
    partner = F.least(*[F.when(F.col("_digit") < digit, F.col(f"_m{digit}")) for digit in range(1, DIGITS)], F.lit(None).cast("double"))
    found = runs.frame.filter("look").groupBy("a", "p").agg((F.max("a") - F.max("p") - F.min(partner)).alias("best"))
    left = scored.join(found.filter("best is not null"), ["a", "p"])
    left = left.select(F.col("id").alias("i_id"), F.col("a").alias("i_a"), F.col("p").alias("i_p"), F.round("best", STRENGTH_DIGITS).alias("best"))
    left = left.orderBy(F.col("best").desc(), "i_id").limit(top_n).drop("best")
    met = scored.join(F.broadcast(left), (F.col("p") > F.col("i_p")) & (F.col("a") < F.col("i_a")))
    gaps = met.select("i_id", F.col("id").alias("j_id"), (F.col("i_p") - F.col("p")).alias("pred_gap"), (F.col("i_a") - F.col("a")).alias("actual_gap"))
    hits = gaps.filter((F.abs("pred_gap") >= min_pred_gap) & (F.abs("actual_gap") >= min_actual_gap))
    hits = hits.withColumn("strength", F.abs("pred_gap") + F.abs("actual_gap"))
    return hits.orderBy(F.round("strength", STRENGTH_DIGITS).desc(), "i_id", "j_id").limit(top_n)
