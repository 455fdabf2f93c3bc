"""Regression and ranking metrics per group of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.plans.pairs import concordance, order_statistics, rank_cells, spearman_aggregates
from strainframe.plans.quantiles import average_ranks, exact_quantiles
from strainframe.session import cut_lineage

MIN_STD = 1e-6


def long_predictions(wide: DataFrame, targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """actual_<t>, pred_<t> columns -> one row per (row, target)."""
    present = [t for t in targets if f"actual_{t}" in wide.columns and f"pred_{t}" in wide.columns]
    entries = [
        F.struct(
            F.lit(target).alias("target"),
            F.col(f"actual_{target}").alias("actual"),
            F.col(f"pred_{target}").alias("pred"),
        )
        for target in present
    ]
    unpivoted = wide.select("beatmap_id", *keep, F.explode(F.array(*entries)).alias("_e"))
    return unpivoted.select("beatmap_id", *keep, "_e.target", "_e.actual", "_e.pred")


def wide_predictions(long: DataFrame, targets: Sequence[str]) -> DataFrame:
    """The per-chart table with actual, pred and error columns per target."""
    pick = lambda target, value: F.max(F.when(F.col("target") == target, value))
    columns = []
    for target in targets:
        columns += [
            pick(target, F.col("actual")).alias(f"actual_{target}"),
            pick(target, F.col("pred")).alias(f"pred_{target}"),
            pick(target, F.col("pred") - F.col("actual")).alias(f"error_{target}"),
        ]
    return long.groupBy("beatmap_id").agg(*columns)


def r_squared(actual: Column, pred: Column) -> Column:
    """1 - residual / total sum of squares, 0 when the target does not vary."""
    residual = F.sum((actual - pred) * (actual - pred))
    total = F.var_pop(actual) * F.count(actual)
    # A constant column may leave a rounding residue in the variance.
    varies = F.max(actual) > F.min(actual)
    return F.when(varies, F.lit(1.0) - F.try_divide(residual, total)).otherwise(F.lit(0.0))


def pairwise_order_accuracy(frame: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    """Share of comparable pairs put in the same order by both columns."""
    counts = concordance(rank_cells(frame, keys, actual, pred))
    share = F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("comparable").cast("double")), F.lit(0.0))
    return counts.withColumn("pairwise_order_accuracy", share)


def spearman(frame: DataFrame, keys: Sequence[str], actual: str = "actual", pred: str = "pred") -> DataFrame:
    return rank_cells(frame, keys, actual, pred).frame.groupBy(*keys).agg(*spearman_aggregates())


def usable_rows(frame: DataFrame) -> DataFrame:
    """Rows with both values, written once: reports read them several times."""
    return cut_lineage(frame.filter("actual is not null and pred is not null"))


def regression_report(frame: DataFrame, keys: Sequence[str], baselines: Sequence[str] = (), *, stored: bool = False) -> DataFrame:
    """MAE, R2, Spearman and pairwise order per key, and gains over baseline columns.

    ``baseline`` is reported under the plain names, any other column
    ``<name>_baseline`` under names carrying it. ``stored`` rows are ``usable_rows`` already.
    """
    usable = frame if stored else usable_rows(frame)
    actual, pred = F.col("actual"), F.col("pred")
    columns = [
        F.count(F.lit(1)).alias("count"),
        F.avg(F.abs(actual - pred)).alias("mae"),
        r_squared(actual, pred).alias("r2"),
    ]
    columns += [F.avg(F.abs(actual - F.col(name))).alias(f"_mae_{name}") for name in baselines]
    report = usable.groupBy(*keys).agg(*columns)
    order = order_statistics(rank_cells(usable, keys, "actual", "pred"), *spearman_aggregates()).withColumn(
        "pairwise_order_accuracy", F.coalesce(F.try_divide(F.col("correct").cast("double"), F.col("comparable").cast("double")), F.lit(0.0))
    )
    report = report.join(order.drop("correct", "comparable"), list(keys))
    for name in baselines:
        suffix = "baseline" if name == "baseline" else name
        base, mae = F.col(f"_mae_{name}"), F.col("mae")
        pct = "mae_improvement_pct" if name == "baseline" else f"mae_improvement_pct_vs_{name}"
        report = report.withColumns(
            {
                f"{suffix}_mae": base,
                f"mae_improvement_vs_{suffix}": base - mae,
                pct: F.coalesce(F.try_divide(base - mae, base), F.when(base.isNotNull(), F.lit(0.0))),
            }
        ).drop(f"_mae_{name}")
    return report


def prediction_summary(long: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Twelve error statistics per target."""
    keys = list(keys)
    usable = long.select(
        *keys, F.col("actual").try_cast("double").alias("actual"), F.col("pred").try_cast("double").alias("pred")
    ).filter("actual is not null and pred is not null and not isnan(actual) and not isnan(pred)")
    error = F.col("pred") - F.col("actual")
    usable = usable.withColumns({"error": error, "abs_error": F.abs(error)})
    moments = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("actual").alias("actual_mean"),
        F.avg("pred").alias("pred_mean"),
        F.avg("error").alias("bias"),
        F.avg("abs_error").alias("mae"),
        F.max("abs_error").alias("max_abs_error"),
        F.avg((F.col("error") > 0).cast("double")).alias("over_prediction_rate"),
        F.avg((F.col("error") < 0).cast("double")).alias("under_prediction_rate"),
        F.stddev_pop("actual").alias("actual_std"),
        F.stddev_pop("pred").alias("pred_std"),
    )
    quantiles = exact_quantiles(usable, keys, "abs_error", {"median_abs_error": 0.5, "p90_abs_error": 0.9})
    return moments.join(quantiles, keys)


def target_stats(long: DataFrame, keys: Sequence[str] = ("target",)) -> DataFrame:
    """Mean and population deviation per target; a near-constant target scales by 1."""
    std = F.stddev_pop("actual")
    return long.groupBy(*keys).agg(
        F.avg("actual").alias("target_mean"), F.when(std < MIN_STD, 1.0).otherwise(std).alias("target_std")
    )


def standardised(long: DataFrame, stats: DataFrame) -> DataFrame:
    """(value - mean) / std and its inverse; ``stats`` has one row per target."""
    joined = long.join(F.broadcast(stats), "target")
    scaled = (F.col("actual") - F.col("target_mean")) / F.col("target_std")
    return joined.withColumns(
        {"scaled": scaled, "restored": scaled * F.col("target_std") + F.col("target_mean")}
    ).drop("target_mean", "target_std")


def huber_loss(frame: DataFrame, keys: Sequence[str], *, delta: float = 1.0, target_weight: str, row_weight: str) -> DataFrame:
    """Weighted Huber loss: mean of weighted losses over max(mean row weight, 1e-6)."""
    gap = F.abs(F.col("pred") - F.col("actual"))
    loss = F.when(gap <= delta, gap * gap * 0.5).otherwise((gap - 0.5 * delta) * delta)
    weighted = F.avg(loss * F.col(target_weight) * F.col(row_weight))
    return frame.groupBy(*keys).agg(
        (weighted / F.greatest(F.avg(row_weight), F.lit(1e-6))).alias("huber_loss")
    )


def validation_metrics(report: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over targets of MAE and pairwise order."""
    return report.groupBy(*keys).agg(
        F.avg("mae").alias("val_mean_mae"),
        F.avg("pairwise_order_accuracy").alias("val_mean_pairwise_order_accuracy"),
    )


def ranked_values(frame: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Put the average rank of ``value`` on every row."""
    ranks = average_ranks(frame, keys, value, name).drop("_n", "_before", "_total")
    return frame.join(ranks, [*keys, value], "left")
