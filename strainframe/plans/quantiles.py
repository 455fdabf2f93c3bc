"""Exact statistics of a value per key, without holding a key's values in one task.

Equal values are counted first (partial aggregation before the shuffle), the
distinct values are put in order over runs, and a rank is then looked up by
comparing it with the running count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.plans.ordered import OrderedRuns, keys_fit


def counted_values(frame: DataFrame, keys: Sequence[str], value: str) -> OrderedRuns:
    """Distinct values per key with ``_n`` copies, ``_before`` smaller rows and ``_total`` rows."""
    usable = frame.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    # Counting rows is cheaper than counting distinct values and bounds them.
    whole = keys_fit(usable, keys) or None
    if whole and keys:
        # Dealt by the key once, for the counts and for the windows.
        usable = usable.repartition(*keys)
    cells = (
        usable.groupBy(*keys, F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    runs = OrderedRuns.build(cells, keys, ["_value"], whole=whole)
    runs = runs.running({"_upto": ("sum", F.col("_n"))})
    runs = runs.group_totals(keys, {"_total": ("sum", F.col("_n"))})
    return runs.with_columns({"_before": F.col("_upto") - F.col("_n")})


def _value_at(rank: Column) -> Column:
    """Aggregate giving the value at a 0-based rank."""
    return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_upto")), F.col("_value")))


def quantile_columns(quantiles: Mapping[str, float]) -> list[Column]:
    """Linear interpolation at q * (n - 1), as aggregates over counted values."""
    columns = []
    for name, q in quantiles.items():
        position = F.lit(q) * (F.col("_total") - 1)
        low = F.floor(position)
        high = F.least(low + 1, F.col("_total") - 1)
        share = F.max(position - low)
        columns.append((_value_at(low) * (F.lit(1.0) - share) + _value_at(high) * share).alias(name))
    return columns


def rank_slice_mean(first: Column, last: Column) -> Column:
    """Mean of the values at ranks first..last-1 (columns constant within the key)."""
    inside = F.greatest(F.lit(0), F.least(F.col("_upto"), last) - F.greatest(F.col("_before"), first))
    return F.sum(F.col("_value") * inside) / F.sum(inside)


def exact_quantiles(frame: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    usable = frame.select(*keys, value).filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if keys_fit(usable, keys):
        return usable.groupBy(*keys).agg(*[F.percentile(value, q).alias(name) for name, q in quantiles.items()])
    return counted_values(usable, keys, value).frame.groupBy(*keys).agg(*quantile_columns(quantiles))


def average_ranks(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, value) -> 0-based rank, ties sharing the mean of their places."""
    counted = counted_values(frame, keys, value).frame
    return counted.select(
        *keys,
        F.col("_value").alias(value),
        (F.col("_before") + (F.col("_n") - 1) / F.lit(2.0)).alias(name),
        F.col("_n"),
        F.col("_before"),
        F.col("_total"),
    )
