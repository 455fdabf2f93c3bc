"""Pairwise ranker: stage-aware feature differences and a weighted logistic fit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.operators.curves import PRESSURES, SCORES
from strainframe.operators.judgments import usable_judgments
from strainframe.operators.stages import ABILITIES
from strainframe.plans.ordered import OrderedRuns
from strainframe.session import cut_lineage

STRAINS = ["peak_strain", "mean_strain", "p90_strain", "fatigue_area"]
SUMMARY_FEATURES = [*STRAINS, *[f"{name}_score" for name in SCORES], *PRESSURES]
STAGE_FEATURES = [f"stage_{name}" for name in PRESSURES]
PAIR_FEATURES = [
    *[f"raw_{name}" for name in SUMMARY_FEATURES],
    *[f"ability_{name}" for name in ABILITIES],
    *STAGE_FEATURES,
    "stage_pattern_memory_pressure",
    "stage_total_pressure",
]


def segment_summary(
    segments: DataFrame, curve: DataFrame, summary: DataFrame, *, window_sec: float = 2.0, step_sec: float = 0.5
) -> DataFrame:
    """Summary values of each distinct (beatmap_id, start_sec, end_sec).

    Windows fully inside the segment replace the chart's strain and pressure
    values; without a segment or without such windows the chart's values stay.
    A segment names the windows it contains, so only those meet it in the join.
    """
    wanted = segments.select("beatmap_id", "start_sec", "end_sec").distinct()
    last = curve.groupBy("beatmap_id").agg(F.max("window_index").alias("last_index"))
    step = F.lit(float(step_sec))
    # One index of slack on both sides; the filter below decides exactly.
    low = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("start_sec") / step) - 1)
    high = F.least(F.col("last_index"), F.floor((F.col("end_sec") - F.lit(float(window_sec))) / step) + 1)
    named = (
        wanted.filter("start_sec is not null and end_sec is not null")
        .join(last, "beatmap_id")
        .filter(low <= high)
        .select("beatmap_id", "start_sec", "end_sec", F.explode(F.sequence(low, high)).alias("window_index"))
    )
    windows = curve.select(
        "beatmap_id", "window_index", F.col("start_sec").alias("w_start"), F.col("end_sec").alias("w_end"), "feel_strain", *PRESSURES
    )
    inside = (F.col("w_start") >= F.col("start_sec")) & (F.col("w_end") <= F.col("end_sec"))
    stats = (
        named.join(windows, ["beatmap_id", "window_index"])
        .filter(inside)
        .groupBy("beatmap_id", "start_sec", "end_sec")
        .agg(
            F.max("feel_strain").alias("s_peak_strain"),
            F.avg("feel_strain").alias("s_mean_strain"),
            F.percentile("feel_strain", 0.9).alias("s_p90_strain"),
            F.sum("feel_strain").alias("s_fatigue_area"),
            *[F.percentile(name, 0.9).alias(f"s_{name}") for name in PRESSURES],
        )
    )
    replaced = [*STRAINS, *PRESSURES]
    base = wanted.join(stats, ["beatmap_id", "start_sec", "end_sec"], "left").join(
        summary.select("beatmap_id", *SUMMARY_FEATURES), "beatmap_id"
    )
    usable = lambda column: F.coalesce(F.when(F.abs(column) < float("inf"), column), F.lit(0.0))
    return base.select(
        "beatmap_id",
        "start_sec",
        "end_sec",
        *[
            (F.coalesce(F.col(f"s_{n}"), usable(F.col(n))) if n in replaced else usable(F.col(n))).alias(n)
            for n in SUMMARY_FEATURES
        ],
    )


def _side(rows: DataFrame, facts: DataFrame, side: str) -> DataFrame:
    """Join one side's values and turn them into prefixed features."""
    renamed = facts.select([F.col(name).alias(f"{side}__{name}") for name in facts.columns])
    match = (
        (F.col(f"{side}_beatmap_id").cast("long") == F.col(f"{side}__beatmap_id"))
        & F.col(f"{side}_start_sec").eqNullSafe(F.col(f"{side}__start_sec"))
        & F.col(f"{side}_end_sec").eqNullSafe(F.col(f"{side}__end_sec"))
    )
    joined = rows.join(renamed, match)
    value = lambda name: F.col(f"{side}__{name}")
    lacking = lambda ability: F.lit(1.0) - F.col(ability)
    stage = {f"stage_{n}": value(n) * lacking(n.removesuffix("_pressure")) for n in PRESSURES}
    stage["stage_pattern_memory_pressure"] = value("peak_strain") * lacking("pattern_memory")
    total = F.lit(0.0)
    for column in stage.values():
        total = total + column
    features = {f"raw_{n}": value(n) for n in SUMMARY_FEATURES} | {f"ability_{n}": F.col(n) for n in ABILITIES} | stage
    features["stage_total_pressure"] = total
    joined = joined.withColumns({f"{side}::{name}": column for name, column in features.items()})
    return joined.drop(*renamed.columns)


def pair_features(judgments: DataFrame, summary: DataFrame, curve: DataFrame, stages: DataFrame) -> DataFrame:
    """Usable judgments with a-minus-b features; unknown charts or stages drop the row.

    Needs pair columns a/b_beatmap_id, a/b_start_sec, a/b_end_sec, player_stage.
    """
    usable = usable_judgments(judgments)
    stacked = usable.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.col(f"{s}_beatmap_id").cast("long").alias("beatmap_id"),
                        F.col(f"{s}_start_sec").alias("start_sec"),
                        F.col(f"{s}_end_sec").alias("end_sec"),
                    )
                    for s in ("a", "b")
                ]
            )
        ).alias("s")
    ).select("s.*")
    facts = cut_lineage(segment_summary(stacked, curve, summary))  # joined twice
    rows = usable.join(stages, F.col("player_stage") == F.col("stage_id"))
    rows = _side(_side(rows, facts, "a"), facts, "b")
    kept = ["pair_id", "normalized_harder_choice", "sample_weight"]
    return rows.select(
        *kept,
        (F.col("normalized_harder_choice") == "a").cast("int").alias("target"),
        *[(F.col(f"`a::{name}`") - F.col(f"`b::{name}`")).alias(name) for name in PAIR_FEATURES],
    )


def holdout_flags(rows: DataFrame, *, test_size: float, seed: int) -> DataFrame:
    """Stratified hold-out by hashed order within each class; all rows train below four."""
    runs = OrderedRuns.build(
        rows.withColumn("_order", F.md5(F.concat(F.lit(f"{seed}|"), F.col("pair_id").cast("string")))),
        ["target"],
        ["_order", "pair_id"],
    )
    runs = runs.indexed("_place").group_totals(["target"], {"_class": ("sum", F.lit(1).cast("long"))})
    placed = runs.rows()
    share = F.bround(F.col("_class") * F.lit(test_size), 0)
    enough = placed.count() >= 4 and test_size > 0
    flag = (F.col("_place") >= share) if enough else F.lit(True)
    return placed.withColumn("is_train", flag).drop("_order", "_place", "_class")


def _sums(rows: DataFrame, beta: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of the weighted logistic loss at beta; rows: (z, target, sample_weight).

    Each task adds up its rows, and equal places of the tasks' sums are added by a shuffle, so the driver gets one number
    a place.
    """
    size = len(beta)

    def added(batches):
        total = np.zeros(1 + size + size * size)
        for batch in batches:
            x = np.ones((batch.num_rows, size))
            x[:, :-1] = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, size - 1)
            y, w = (batch.column(n).to_numpy().astype(np.float64) for n in (1, 2))
            margin = x @ beta
            p = np.exp(-np.logaddexp(0.0, -margin))
            total[0] += w @ (np.logaddexp(0.0, margin) - y * margin)
            total[1 : size + 1] += x.T @ (w * (p - y))
            total[size + 1 :] += (x.T @ (x * (w * p * (1 - p))[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    found = rows.mapInArrow(added, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    sums = np.zeros(1 + size + size * size)
    for row in found:
        sums[row["place"]] = row["value"]
    return sums


def newton_fit(rows: DataFrame, features: int, *, tolerance: float = 1e-10, steps: int = 100) -> np.ndarray:
    """Coefficients and intercept that minimise sum(w * loss) + |coefficients|^2 / 2.

    Every step is one pass over the rows and one solution of a system as wide as the features; a step that does not
    lower the loss is halved. Eight passes or so are enough where a first-order method takes hundreds.
    """
    beta, step, best = np.zeros(features + 1), np.zeros(features + 1), np.inf
    penalty = np.append(np.ones(features), 0.0)
    for _ in range(steps):
        tried = beta + step
        sums = _sums(rows, tried)
        loss = sums[0] + 0.5 * (penalty * tried) @ tried
        if loss > best + 1e-12 * abs(best) and np.abs(step).max() > tolerance:
            step = step / 2
            continue
        beta, best = tried, loss
        gradient = sums[1 : features + 2] + penalty * beta
        curvature = sums[features + 2 :].reshape(features + 1, features + 1) + np.diag(penalty)
        step = -np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        if np.abs(step).max() <= tolerance:
            break
    return beta


def standardised_features(rows: DataFrame) -> DataFrame:
    """Adds ``z``: the features less the train rows' mean, over their population deviation (constant -> 1)."""
    stats = rows.filter("is_train").agg(
        F.array(*[F.avg(n) for n in PAIR_FEATURES]).alias("_mean"),
        F.array(*[F.when(F.stddev_pop(n) > 1e-12, F.stddev_pop(n)).otherwise(1.0) for n in PAIR_FEATURES]).alias("_std"),
    )
    scaled = F.array(*[(F.col(n) - F.get("_mean", F.lit(place))) / F.get("_std", F.lit(place)) for place, n in enumerate(PAIR_FEATURES)])
    return rows.crossJoin(F.broadcast(stats)).withColumn("z", scaled).drop("_mean", "_std")  # one row


def _margin(beta: np.ndarray) -> Column:
    weights = F.array(*[F.lit(float(value)) for value in beta[:-1]])
    products = F.zip_with("z", weights, lambda x, b: x * b)
    return F.aggregate(products, F.lit(float(beta[-1])), lambda total, x: total + x)


def fit_ranker(rows: DataFrame, *, test_size: float = 0.25, seed: int = 42):
    """Fit on train rows; returns (scored rows, metrics frame, coefficients frame)."""
    rows = cut_lineage(standardised_features(cut_lineage(holdout_flags(rows, test_size=test_size, seed=seed))))
    train = rows.filter("is_train")
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("target").alias("classes")).head()
    if stats["n"] < 2:
        raise RuntimeError("Need at least two usable pair judgments.")
    if stats["classes"] < 2:
        raise RuntimeError("Need both outcomes among the training judgments.")
    beta = newton_fit(train.select("z", "target", F.col("sample_weight").cast("double").alias("w")), len(PAIR_FEATURES))
    scored = rows.withColumn("p", 1.0 / (1.0 + F.exp(-_margin(beta))))
    choice = F.when(F.col("p") >= 0.5, "a").otherwise("b")
    scored = scored.select(
        "pair_id",
        "is_train",
        "normalized_harder_choice",
        "target",
        F.col("p").alias("pred_a_harder_probability"),
        choice.alias("predicted_choice"),
        (choice == F.col("normalized_harder_choice")).alias("correct"),
    )
    hit = F.col("correct").cast("double")
    metrics = scored.agg(
        F.count(F.lit(1)).alias("usable_judgments"),
        F.lit(len(PAIR_FEATURES)).alias("feature_count"),
        F.count_if(F.col("is_train")).alias("train_rows"),
        F.count_if(~F.col("is_train")).alias("test_rows"),
        F.coalesce(F.avg(F.when(F.col("is_train"), hit)), F.lit(0.0)).alias("train_agreement"),
        F.coalesce(F.avg(F.when(~F.col("is_train"), hit)), F.lit(0.0)).alias("holdout_agreement"),
    )
    coefficients = rows.sparkSession.createDataFrame(
        list(zip([*PAIR_FEATURES, "intercept"], map(float, beta), strict=True)), "feature string, coefficient double"
    )
    return scored, metrics, coefficients
