"""Leaderboard accuracies -> label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.plans.quantiles import counted_values, quantile_columns, rank_slice_mean

# Leaderboard page size and the shares behind the skill gap.
SCORE_LIMIT = 100
TOP_SHARE = 0.10
BOTTOM_SHARE = 0.50
SCORE_MODE = "mania"

LABEL_COLUMNS = ["mean_acc", "acc_std", "skill_gap", "median_acc", "p10_acc", "p90_acc", "score_count"]


def share_of(count: Column, share: float) -> Column:
    """max(1, half-even rounding of count * share)."""
    return F.greatest(F.lit(1), F.bround(count * F.lit(share), 0).cast("long"))


def accuracy_labels(scores: DataFrame) -> DataFrame:
    """Label columns per chart over all of its scores, however many there are."""
    total = F.col("_total")
    counted = counted_values(scores, ["beatmap_id"], "accuracy")
    counted = counted.group_totals(["beatmap_id"], {"_sum": ("sum", F.col("_value") * F.col("_n"))}).frame
    off = F.col("_value") - F.col("_sum") / total
    spread = counted.groupBy("beatmap_id").agg(
        (F.max("_sum") / F.max("_total")).alias("mean_acc"),
        F.sum("_n").alias("score_count"),
        rank_slice_mean(total - share_of(total, TOP_SHARE), total).alias("_top"),
        rank_slice_mean(F.lit(0), share_of(total, BOTTOM_SHARE)).alias("_bottom"),
        *quantile_columns({"median_acc": 0.5, "p10_acc": 0.1, "p90_acc": 0.9}),
        (F.sum(off * off * F.col("_n")) / F.max("_total")).alias("_variance"),
    )
    return spread.select(
        "beatmap_id",
        "mean_acc",
        F.sqrt("_variance").alias("acc_std"),
        (F.col("_top") - F.col("_bottom")).alias("skill_gap"),
        "median_acc",
        "p10_acc",
        "p90_acc",
        "score_count",
    )


def leaderboard(scores: DataFrame, limit: int) -> DataFrame:
    """Best ``limit`` scores of each chart.

    The rank filter is pushed below the shuffle by Spark (WindowGroupLimit), so
    a chart with a third of all scores sends at most ``limit`` rows per task.
    """
    best_first = Window.partitionBy("beatmap_id").orderBy(F.col("accuracy").desc())
    return (
        scores.filter(F.col("accuracy").isNotNull())
        .withColumn("place", F.row_number().over(best_first))
        .filter(F.col("place") <= limit)
    )


def leaderboard_labels(scores: DataFrame, limit: int) -> DataFrame:
    """Label columns over the leaderboard; a group has at most ``limit`` rows here.

    The place already orders the scores, so quantiles are looked up by rank.
    """
    board = leaderboard(scores, limit).withColumn(
        "_total", F.count(F.lit(1)).over(Window.partitionBy("beatmap_id"))
    )
    place, size = F.col("place"), F.col("_total")
    ranked = board.withColumns({"_value": F.col("accuracy"), "_before": size - place, "_upto": size - place + 1})
    top = F.avg(F.when(place <= share_of(size, TOP_SHARE), F.col("accuracy")))
    bottom = F.avg(F.when(place > size - share_of(size, BOTTOM_SHARE), F.col("accuracy")))
    return ranked.groupBy("beatmap_id").agg(
        F.avg("accuracy").alias("mean_acc"),
        F.stddev_pop("accuracy").alias("acc_std"),
        (top - bottom).alias("skill_gap"),
        *quantile_columns({"median_acc": 0.5, "p10_acc": 0.1, "p90_acc": 0.9}),
        F.count(F.lit(1)).alias("score_count"),
    )


def score_labels(scores: DataFrame, maps: DataFrame, *, min_scores: int = 1, limit: int | None = None) -> DataFrame:
    """Map rows with label columns over all scores, or over the best ``limit``; charts below ``min_scores`` dropped."""
    labels = accuracy_labels(scores) if limit is None else leaderboard_labels(scores, limit)
    labels = labels.filter(F.col("score_count") >= min_scores)
    # Both sides grow with the charts, and map files are far smaller than their rows: no broadcast.
    return (
        maps.join(labels.hint("merge"), "beatmap_id")
        .withColumn("score_mode", F.lit(SCORE_MODE))
        .withColumn("score_limit", F.lit(limit).cast("long"))
    )


def sample_weight(value: Column, *, min_weight: float = 0.25, max_value: float = 100.0) -> Column:
    """clip(value / max_value, min_weight, 1); not a finite number -> min_weight."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    scaled = F.lit(1.0) if max_value <= 0 else F.greatest(F.lit(min_weight), F.least(F.lit(1.0), number / max_value))
    return F.when(finite, scaled).otherwise(F.lit(float(min_weight)))


def sample_weight_summary(labels: DataFrame, column: str, *, min_weight: float = 0.25, max_value: float = 100.0) -> DataFrame:
    weight = sample_weight(F.col(column), min_weight=min_weight, max_value=max_value)
    down = (F.col("_w") < 1.0).cast("long")
    return labels.select(weight.alias("_w")).agg(
        F.count(F.lit(1)).alias("sample_weight_count"),
        F.avg("_w").alias("sample_weight_mean"),
        F.min("_w").alias("sample_weight_min"),
        F.max("_w").alias("sample_weight_max"),
        F.coalesce(F.sum(down), F.lit(0)).alias("sample_weight_downweighted_count"),
        F.avg(down).alias("sample_weight_downweighted_rate"),
    )
