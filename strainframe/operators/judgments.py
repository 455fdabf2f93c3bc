"""Pairwise judgments: tables, cleaning, scoring, labeling queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.functions import choices
from strainframe.operators.review import top_rows
from strainframe.plans.ordered import OrderedRuns
from strainframe.plans.quantiles import counted_values

# Table layouts.
ANNOTATION_COLUMNS = [
    "pair_id", "scope", "player_stage", "a_beatmap_id", "a_start_sec", "a_end_sec", "a_title", "a_artist",
    "a_version", "a_dominant_skill", "a_peak_strain", "b_beatmap_id", "b_start_sec", "b_end_sec", "b_title",
    "b_artist", "b_version", "b_dominant_skill", "b_peak_strain", "harder_choice", "confidence", "reason_tags",
    "notes",
]
JUDGMENT_COLUMNS = ["human_harder_beatmap_id", "human_confidence", "human_notes"]
STATUSES = ["judged", "open", "uncertain", "out_of_range", "tie", "skip"]


def annotation_table(frame: DataFrame) -> DataFrame:
    """All annotation columns in order, absent ones as ''."""
    return frame.select(
        [F.col(name) if name in frame.columns else F.lit("").alias(name) for name in ANNOTATION_COLUMNS]
    )


def empty_annotations(spark) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{name} string" for name in ANNOTATION_COLUMNS))


def judgment_template(review: DataFrame) -> DataFrame:
    """Pair review with the three judgment columns added where absent."""
    missing = [name for name in JUDGMENT_COLUMNS if name not in review.columns]
    return review.withColumns({name: F.lit("") for name in missing})


def usable_judgments(frame: DataFrame) -> DataFrame:
    side = choices.harder_side(F.col("harder_choice"))
    weight = choices.annotation_confidence(F.col("confidence"))
    return frame.withColumns({"normalized_harder_choice": side, "sample_weight": weight}).filter(
        F.col("normalized_harder_choice").isin("a", "b") & (F.col("sample_weight") > 0)
    )


def judgment_scores(frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Agreement of people with the model and with the observed order, plain and weighted."""
    keys = keys or []
    chosen = choices.judged_chart(F.col("human_harder_beatmap_id"))
    weight = choices.judgment_confidence(F.col("human_confidence"))
    model = F.col("_chosen") == F.col("model_harder_beatmap_id").cast("long")
    proxy = F.col("_chosen") == F.col("observed_harder_beatmap_id").cast("long")
    outcome = (
        F.when(F.col("_chosen").isNull(), "unjudged").when(model, "model").when(proxy, "proxy").otherwise("invalid")
    )
    rows = frame.withColumns({"_chosen": chosen, "_weight": weight}).withColumn("_outcome", outcome)
    count = lambda *names: F.coalesce(F.sum(F.col("_outcome").isin(*names).cast("long")), F.lit(0))
    weigh = lambda *names: F.coalesce(F.sum(F.when(F.col("_outcome").isin(*names), F.col("_weight"))), F.lit(0.0))
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        count("model", "proxy").alias("judged_count"),
        count("unjudged").alias("unjudged_count"),
        count("invalid").alias("invalid_choice_count"),
        count("model").alias("model_agree_count"),
        count("proxy").alias("proxy_agree_count"),
        weigh("model", "proxy").alias("confidence_weighted_judged_count"),
        weigh("model").alias("confidence_weighted_model_agree_count"),
        weigh("proxy").alias("confidence_weighted_proxy_agree_count"),
    )
    rate = lambda top, bottom: F.coalesce(F.try_divide(top, F.col(bottom)), F.lit(0.0))
    model_rate = rate(F.col("model_agree_count"), "judged_count")
    proxy_rate = rate(F.col("proxy_agree_count"), "judged_count")
    weighted = "confidence_weighted_"
    return counts.withColumns(
        {
            "judgment_coverage_rate": rate(F.col("judged_count"), "row_count"),
            "model_agreement_rate": model_rate,
            "proxy_agreement_rate": proxy_rate,
            "model_vs_proxy_agreement_delta": model_rate - proxy_rate,
            f"{weighted}model_agreement_rate": rate(F.col(f"{weighted}model_agree_count"), f"{weighted}judged_count"),
            f"{weighted}proxy_agreement_rate": rate(F.col(f"{weighted}proxy_agree_count"), f"{weighted}judged_count"),
            f"{weighted}model_vs_proxy_delta": rate(
                F.col(f"{weighted}model_agree_count") - F.col(f"{weighted}proxy_agree_count"), f"{weighted}judged_count"
            ),
        }
    )


def _strain(side: str) -> Column:
    number = F.col(f"{side}_peak_strain").try_cast("double")
    return F.when(~F.isnan(number), number)


def strain_percentiles(pairs: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Share of all side strains not above each side's strain, in percent with one decimal."""
    stacked = pairs.select(F.explode(F.array(_strain("a"), _strain("b"))).alias("strain"))
    share = F.bround(F.col("_upto") / F.col("_total") * 100.0, 1)
    ranks = counted_values(stacked, [], "strain").frame.select(F.col("_value").alias("_strain"), share.alias("_share"))
    result = pairs if wanted is None else wanted
    for side in ("a", "b"):
        named = ranks.withColumnRenamed("_share", f"{side}_strain_percentile")
        result = result.withColumn("_strain", _strain(side)).join(named, "_strain", "left").drop("_strain")
    return result


def pair_queue(pairs: DataFrame, *, stage: str = "", scope: str = "", status: str = "") -> DataFrame:
    """Filtered pairs with their status and stronger side, strongest first by ``position``."""
    runs = OrderedRuns.build(_queued(pairs, stage, scope, status).withColumn("_fall", -F.col("pair_peak")), [], ["_fall", "pair_id"])
    return runs.indexed("position").rows().drop("_fall")


def _queued(pairs: DataFrame, stage: str, scope: str, status: str) -> DataFrame:
    peak = F.greatest(F.coalesce(_strain("a"), F.lit(0.0)), F.coalesce(_strain("b"), F.lit(0.0)))
    rows = pairs.withColumns({"status": choices.labeler_status(F.col("harder_choice")), "pair_peak": peak})
    for name, wanted in (("player_stage", stage), ("scope", scope), ("status", status)):
        if wanted:
            rows = rows.filter(F.col(name) == wanted)
    return rows


def queue_state(pairs: DataFrame, *, stage: str = "", scope: str = "", status: str = "", index: int = 0) -> DataFrame:
    """One row: the pair to judge next, how many are in each status, stages, scopes, strain range."""
    everything = _queued(pairs, "", "", "")
    filtered = _queued(pairs, stage, scope, status)
    counts = everything.agg(
        F.count(F.lit(1)).alias("total_count"),
        *[F.count_if(F.col("status") == name).alias(f"{name}_count") for name in STATUSES],
        F.array_join(F.array_sort(F.collect_set("player_stage")), ",").alias("stages"),
        F.array_join(F.array_sort(F.collect_set("scope")), ",").alias("scopes"),
        F.bround(F.least(F.min(_strain("a")), F.min(_strain("b"))), 3).alias("strain_min"),
        F.bround(F.greatest(F.max(_strain("a")), F.max(_strain("b"))), 3).alias("strain_max"),
    )
    size = filtered.count()
    place = max(0, min(index, max(size - 1, 0)))
    ahead = top_rows(filtered, [F.col("pair_peak").desc(), F.col("pair_id")], place + 1)
    current = ahead.orderBy(F.col("pair_peak").asc(), F.col("pair_id").desc()).limit(1)
    current = strain_percentiles(pairs, current).select(
        F.col("pair_id").alias("current_pair_id"),
        F.col("pair_peak").alias("current_pair_peak"),
        "a_strain_percentile",
        "b_strain_percentile",
    )
    state = counts.withColumns({"filtered_count": F.lit(size).cast("long"), "index": F.lit(place).cast("long")})
    return state.join(F.broadcast(current), F.lit(True), "left")


def upsert_judgments(pairs: DataFrame, updates: DataFrame, order: list[str]) -> DataFrame:
    """Apply saved judgments. ``updates`` has pair_id, harder_choice and optional columns, NULL = not supplied.

    Saves are applied in ``order``; an unknown pair id is an error.
    """
    unknown = updates.select("pair_id").join(pairs.select("pair_id"), "pair_id", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(f"Unknown pair_id: {unknown[0][0]}")
    moment = F.struct(*[F.col(name) for name in order])
    extra = [name for name in ("confidence", "reason_tags", "notes") if name in updates.columns]
    last = updates.groupBy("pair_id").agg(
        F.max_by(choices.labeler_choice(F.col("harder_choice")), moment).alias("_new_harder_choice"),
        *[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), moment)).alias(f"_new_{n}") for n in extra],
    )
    merged = pairs.join(last, "pair_id", "left")
    return merged.select(
        [
            F.coalesce(F.col(f"_new_{name}"), F.col(name)).alias(name)
            if name in ["harder_choice", *extra]
            else F.col(name)
            for name in pairs.columns
        ]
    )
