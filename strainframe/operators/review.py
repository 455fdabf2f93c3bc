"""Review tables over predictions: rankings, queues, slices, disagreeing pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.plans.ordered import OrderedRuns
from strainframe.plans.pairs import strongest_inversions
from strainframe.session import cut_lineage

IDENTITY = ["title", "artist", "mapper", "version"]
# Default slice columns.
SLICE_COLUMNS = ("score_count", "num_notes", "length_ms", "bpm")


def join_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """predictions left join labels on the chart id; clashing label columns get ``_label``."""
    taken = set(predictions.columns) - {"beatmap_id"}
    renamed = labels.select([F.col(c).alias(f"{c}_label" if c in taken else c) for c in labels.columns])
    return predictions.join(renamed, "beatmap_id", "left")


def top_rows(frame: DataFrame, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows; the rank is given to those n rows only."""
    best = frame.orderBy(*order).limit(n)
    if rank is None:
        return best
    return best.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def _text(name: str, frame: DataFrame) -> Column:
    value = F.col(name).cast("string") if name in frame.columns else F.lit("")
    return F.coalesce(value, F.lit("")).alias(name)


def prediction_rankings(predictions: DataFrame, labels: DataFrame, *, target: str = "mean_acc", top_n: int = 20) -> DataFrame:
    """Lowest and highest predicted charts and largest errors, ranked."""
    merged = join_labels(predictions, labels)
    pred, actual, error = f"pred_{target}", f"actual_{target}", f"error_{target}"
    if error not in merged.columns:
        merged = merged.withColumn(error, F.col(pred) - F.col(actual))
    merged = merged.withColumn(f"abs_{error}", F.abs(F.col(error)))
    sections = {
        "predicted_hardest": [F.col(pred).asc_nulls_last(), F.col("beatmap_id")],
        "predicted_easiest": [F.col(pred).desc(), F.col("beatmap_id")],
        "largest_abs_error": [F.col(f"abs_{error}").desc(), F.col("beatmap_id")],
    }
    parts = [
        top_rows(merged, order, top_n, "rank").withColumn("ranking_section", F.lit(section))
        for section, order in sections.items()
    ]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    texts = [_text(name, merged) for name in IDENTITY]
    return stacked.select("ranking_section", "rank", "beatmap_id", *texts, pred, actual, error, f"abs_{error}")


def human_review(predictions: DataFrame, labels: DataFrame, targets: Sequence[str], *, top_n: int = 10) -> DataFrame:
    """Charts worth a look: lowest predicted, lowest observed, largest error per target."""
    merged = join_labels(predictions, labels)
    for target in targets:
        if f"error_{target}" not in merged.columns:
            merged = merged.withColumn(f"error_{target}", F.col(f"pred_{target}") - F.col(f"actual_{target}"))
    reasons = []
    if "pred_mean_acc" in merged.columns:
        reasons.append(("model_lowest_predicted_mean_acc", F.col("pred_mean_acc").asc_nulls_last(), None))
    if "actual_mean_acc" in merged.columns:
        reasons.append(("observed_lowest_mean_acc", F.col("actual_mean_acc").asc_nulls_last(), None))
    for target in targets:
        size = F.abs(F.col(f"error_{target}").try_cast("double"))
        reasons.append((f"largest_{target}_disagreement", size.desc(), size.isNotNull()))
    parts = []
    for reason, order, condition in reasons:
        rows = merged if condition is None else merged.filter(condition)
        parts.append(top_rows(rows, [order, F.col("beatmap_id")], top_n).withColumn("review_reason", F.lit(reason)))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    values = []
    for target in targets:
        values += [
            F.col(f"actual_{target}").alias(f"observed_{target}"),
            F.col(f"pred_{target}").alias(f"predicted_{target}"),
            F.col(f"error_{target}"),
        ]
    texts = [F.col(name) for name in IDENTITY if name in merged.columns]
    return stacked.select("review_reason", "beatmap_id", *texts, *values).dropDuplicates(["review_reason", "beatmap_id"])


def pairwise_review(
    predictions: DataFrame,
    labels: DataFrame,
    *,
    target: str = "mean_acc",
    top_n: int = 20,
    min_abs_pred_gap: float = 0.0,
    min_abs_actual_gap: float = 0.0,
) -> DataFrame:
    """Pairs the model orders against the observation, strongest first."""
    merged = join_labels(predictions, labels)
    texts = [_text(name, merged) for name in IDENTITY]
    actual, pred = f"actual_{target}", f"pred_{target}"
    rows = merged.select(F.struct("beatmap_id", *texts).alias("chart"), actual, pred, "beatmap_id")
    # The chart id decides ties, the remaining fields only separate copies of a chart.
    rows = rows.withColumn("who", F.struct("beatmap_id", "chart", actual, pred))
    pairs = strongest_inversions(
        rows, actual, pred, "who", top_n=top_n, min_pred_gap=min_abs_pred_gap, min_actual_gap=min_abs_actual_gap
    )
    columns = [F.lit("pairwise_rank_disagreement").alias("review_reason")]
    for prefix, side in (("model_harder", "i_id"), ("observed_harder", "j_id")):
        columns += [F.col(f"{side}.chart.{name}").alias(f"{prefix}_{name}") for name in ["beatmap_id", *IDENTITY]]
        columns += [
            F.col(f"{side}.{pred}").alias(f"{prefix}_{pred}"),
            F.col(f"{side}.{actual}").alias(f"{prefix}_observed_{target}"),
        ]
    return pairs.select(
        *columns,
        F.col("pred_gap").alias("predicted_acc_gap_model_minus_observed"),
        F.col("actual_gap").alias("observed_acc_gap_model_minus_observed"),
        F.col("strength").alias("disagreement_strength"),
    )


def quantile_bins(rows: DataFrame, keys: Sequence[str], value: str, identity: Sequence[str]) -> DataFrame:
    """Adds ``bin``: low / mid / high by first-come rank, 'missing', or 'all' for at most one value."""
    number = F.col(value).try_cast("double")
    number = F.when(~F.isnan(number), number)
    runs = OrderedRuns.build(rows.withColumn("_number", number), keys, ["_number", *identity])
    valid = F.col("_number").isNotNull().cast("long")
    runs = runs.running({"_rank": ("sum", valid)}).group_totals(keys, {"_valid": ("sum", valid)})
    before, size = F.col("_rank") - 1, F.col("_valid")
    label = (
        F.when(size <= 1, "all")
        .when(F.col("_number").isNull(), "missing")
        .when(size == 2, F.when(before == 0, "low").otherwise("high"))
        .when(3 * before < size - 1, "low")
        .when(3 * before < 2 * (size - 1), "mid")
        .otherwise("high")
    )
    return runs.with_columns({"bin": label}).rows().drop("_number", "_rank", "_valid")


def error_slices(
    predictions: DataFrame,
    labels: DataFrame,
    *,
    target: str = "mean_acc",
    slice_columns: Sequence[str] = SLICE_COLUMNS,
) -> DataFrame:
    """Error metrics overall and per tertile of the metadata columns that exist."""
    merged = join_labels(predictions, labels)
    bounded = lambda name: F.when(F.abs(F.col(name)) < float("inf"), F.col(name))
    merged = merged.withColumns({"actual": bounded(f"actual_{target}"), "pred": bounded(f"pred_{target}")})
    # Read by the overall row and by the slices.
    merged = cut_lineage(merged.filter("actual is not null and pred is not null"))
    present = [name for name in slice_columns if name in merged.columns]
    slices = F.explode(
        F.array(*[F.struct(F.lit(n).alias("slice_column"), F.col(n).cast("string").alias("value")) for n in present])
    )
    stacked = merged.select("beatmap_id", "actual", "pred", slices.alias("_s"))
    stacked = stacked.select("beatmap_id", "actual", "pred", "_s.slice_column", "_s.value")
    binned = quantile_bins(stacked, ["slice_column"], "value", ["beatmap_id", "actual", "pred"])
    sliced = binned.groupBy("slice_column", F.col("bin").alias("slice_value")).agg(*slice_metrics())
    overall = merged.groupBy().agg(*slice_metrics()).filter("count > 0")
    return overall.select(F.lit("overall").alias("slice_column"), F.lit("all").alias("slice_value"), "*").unionByName(sliced)


def slice_metrics() -> list[Column]:
    error = F.col("pred") - F.col("actual")
    return [
        F.count(F.lit(1)).alias("count"),
        F.avg("actual").alias("actual_mean"),
        F.avg("pred").alias("pred_mean"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
        F.max(F.abs(error)).alias("max_abs_error"),
    ]


def worst_slices(slices: DataFrame, *, top_n: int = 5) -> DataFrame:
    """Slices with the largest MAE; the overall row only when there is nothing else."""
    usable = slices.filter(F.col("mae").isNotNull())
    own = F.max((F.col("slice_column") != "overall").cast("int"))
    # One row per slice and column: a handful, so the flag join is tiny.
    flagged = usable.crossJoin(F.broadcast(usable.agg(own.alias("_has_own"))))
    kept = flagged.filter((F.col("_has_own") == 0) | (F.col("slice_column") != "overall"))
    order = [F.col("mae").desc(), F.col("max_abs_error").desc(), F.col("slice_column"), F.col("slice_value")]
    name = F.concat_ws(": ", "slice_column", "slice_value")
    return top_rows(kept, order, top_n).select(name.alias("slice"), "count", "mae", "bias", "max_abs_error")
