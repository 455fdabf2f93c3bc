"""Per-chart feature vectors built from the ordered notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.functions.casts import first_finite
from strainframe.operators.sequences import (
    adjacency_aggregates,
    feature_sequence,
    sorted_notes,
    time_density,
    truncated,
    with_chords,
    with_extent,
    with_neighbours,
)

# Feature names in vector order.
CORE_FEATURES = [
    "note_count_log", "duration_sec_log", "notes_per_sec", "delta_mean", "delta_std", "delta_p10", "delta_p50",
    "delta_p90", "short_gap_50ms_ratio", "short_gap_100ms_ratio", "short_gap_200ms_ratio", "column_mean",
    "column_std", "column_change_mean", "same_column_ratio", "jump_column_ratio", "column_entropy",
    "column_imbalance", "ln_ratio", "ln_length_mean", "ln_length_std", "ln_length_max", "ln_total_per_sec",
    "chord_mean", "chord_std", "chord_max", "chord_2_ratio", "chord_3_ratio", "chord_4_ratio",
]
BURST_FEATURES = [
    "peak_notes_per_sec_1s", "peak_notes_per_sec_2s", "mean_notes_per_sec_1s", "burst_10nps_ratio",
    "burst_15nps_ratio", "jack_ratio_100ms", "jack_ratio_150ms", "trill_like_ratio_120ms", "burst_chord_2_ratio",
    "burst_chord_3_ratio",
]
METADATA_FEATURES = [
    "metadata_mode", "metadata_keys", "metadata_hp_drain_rate", "metadata_overall_difficulty",
    "metadata_approach_rate", "metadata_difficulty_rating", "metadata_length_sec", "metadata_bpm",
]

# Accepted column names per metadata feature, first usable one wins.
METADATA_ALIASES = {
    "metadata_mode": ["mode", "mode_int"],
    "metadata_keys": ["keys", "circle_size", "cs"],
    "metadata_hp_drain_rate": ["hp_drain_rate", "hp", "drain"],
    "metadata_overall_difficulty": ["overall_difficulty", "od", "accuracy"],
    "metadata_approach_rate": ["approach_rate", "ar"],
    "metadata_difficulty_rating": ["difficulty_rating"],
    "metadata_bpm": ["bpm"],
}


def feature_names(feature_set: str) -> list[str]:
    base = feature_set.removesuffix("_metadata")
    if base not in ("core", "burst"):
        raise ValueError(f"Unknown feature set: {feature_set}")
    names = CORE_FEATURES + (BURST_FEATURES if base == "burst" else [])
    return names + (METADATA_FEATURES if feature_set.endswith("_metadata") else [])


def metadata_features(labels: DataFrame) -> DataFrame:
    """Eight metadata features per chart; NULL, '', text and non-finite values fall through to 0."""
    values = {name: first_finite(labels, aliases) for name, aliases in METADATA_ALIASES.items()}
    seconds = first_finite(labels, ["length_sec"])
    millis = first_finite(labels, ["length_ms"])
    values["metadata_length_sec"] = F.when(seconds != 0.0, seconds).otherwise(millis / 1000.0)
    return labels.select("beatmap_id", *[values[name].alias(name) for name in METADATA_FEATURES])


def _spread(name: str, value: Column, scale: float) -> list[Column]:
    return [
        F.coalesce(F.avg(value) / scale, F.lit(0.0)).alias(f"{name}_mean"),
        F.coalesce(F.stddev_pop(value) / scale, F.lit(0.0)).alias(f"{name}_std"),
    ]


def _core_aggregates(keys: int) -> list[Column]:
    gap = F.col("time_ms") - F.col("prev_time_ms")
    positive = F.when(gap > 0, gap)
    # A chart without a positive gap counts as one gap of zero, hence ratio 1.
    short = lambda limit: F.coalesce(F.avg((positive <= limit).cast("double")), F.lit(1.0))
    column = F.col("col") / F.lit(float(max(1, keys - 1)))
    chord = F.col("chord_size") * F.lit(4.0 / keys)
    long_note = F.col("is_ln") > 0
    ln_length = F.when(long_note, F.greatest(F.col("ln_length_ms"), F.lit(0)))
    slot = F.rint(column * 3)
    return [
        F.count(F.lit(1)).alias("_notes"),
        F.coalesce(F.sum(positive), F.lit(0)).alias("_span_ms"),
        (F.max("time_ms") / F.greatest(F.max("last_time_ms"), F.lit(1))).alias("_last_frac"),
        *_spread("delta", positive, 1000.0),
        F.percentile(positive, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_gap_quantiles"),
        short(50).alias("short_gap_50ms_ratio"),
        short(100).alias("short_gap_100ms_ratio"),
        short(200).alias("short_gap_200ms_ratio"),
        *_spread("column", column, 1.0),
        *[F.avg((slot == place).cast("double")).alias(f"_slot{place}") for place in range(4)],
        F.avg(long_note.cast("double")).alias("ln_ratio"),
        *_spread("ln_length", ln_length, 1000.0),
        F.coalesce(F.max(ln_length) / 1000.0, F.lit(0.0)).alias("ln_length_max"),
        F.sum(F.greatest(F.col("ln_length_ms"), F.lit(0))).alias("_ln_ms"),
        *_spread("chord", chord, 1.0),
        F.max(chord).alias("chord_max"),
        *[F.avg((chord >= size).cast("double")).alias(f"chord_{size}_ratio") for size in (2, 3, 4)],
        *adjacency_aggregates(keys),
    ]


def _finish_core(grouped: DataFrame) -> DataFrame:
    fallback = F.greatest(F.col("_last_frac"), F.lit(1e-6))
    seconds = F.when(F.col("_span_ms") > 0, F.col("_span_ms") / F.lit(1000.0)).otherwise(fallback)
    slots = [F.col(f"_slot{place}") for place in range(4)]
    part = lambda share: F.when(share > 0, share * F.log2(share)).otherwise(0.0)
    quantile = lambda place: F.coalesce(F.get("_gap_quantiles", F.lit(place)) / 1000.0, F.lit(0.0))
    return grouped.withColumns(
        {
            "note_count_log": F.log1p("_notes"),
            "duration_sec_log": F.log1p(seconds),
            "notes_per_sec": F.col("_notes") / seconds,
            "delta_p10": quantile(0),
            "delta_p50": quantile(1),
            "delta_p90": quantile(2),
            "column_entropy": -(part(slots[0]) + part(slots[1]) + part(slots[2]) + part(slots[3])) / 2.0,
            "column_imbalance": F.greatest(*slots) - F.least(*slots),
            "ln_total_per_sec": F.col("_ln_ms") / F.lit(1000.0) / seconds,
        }
    )


def burst_features(notes: DataFrame, keys: int) -> DataFrame:
    """Density features from (chart, time) cells; a cell of n notes stands for n densities.

    The k-th of n stacked notes sees ``ahead - k`` notes, so sums over the
    stack have closed forms and no per-note row is needed.
    """
    cells = time_density(notes, {"ahead_1s": 1000, "ahead_2s": 2000}, {"chord": F.max("chord_size")})
    here, ahead = F.col("here"), F.col("ahead_1s")
    at_least = lambda limit: F.greatest(F.lit(0), F.least(here, ahead - limit + 1))
    chord = F.col("chord") * F.lit(4.0 / keys)
    dense = F.sum(at_least(10))
    dense_chord = lambda size: F.coalesce(
        F.try_divide(F.sum(F.when(chord >= size, at_least(10)).otherwise(0)), dense), F.lit(0.0)
    )
    return cells.groupBy("beatmap_id").agg(
        F.max("ahead_1s").cast("double").alias("peak_notes_per_sec_1s"),
        (F.max("ahead_2s") / 2.0).alias("peak_notes_per_sec_2s"),
        (F.sum(here * ahead - here * (here - 1) / 2) / F.sum(here)).alias("mean_notes_per_sec_1s"),
        (dense / F.sum(here)).alias("burst_10nps_ratio"),
        (F.sum(at_least(15)) / F.sum(here)).alias("burst_15nps_ratio"),
        dense_chord(2).alias("burst_chord_2_ratio"),
        dense_chord(3).alias("burst_chord_3_ratio"),
    )


def chart_features(
    raw: DataFrame,
    *,
    feature_set: str = "core",
    keys: int = 4,
    max_notes: int | None = None,
    charts: DataFrame | None = None,
) -> DataFrame:
    """One feature row per chart.

    With ``charts`` (ids plus metadata) the result has a row for each of them:
    a chart without notes gets zeros, and the ``*_metadata`` sets read it too.
    """
    names = feature_names(feature_set)
    ordered = with_neighbours(with_extent(with_chords(sorted_notes(raw))), depth=2)
    notes = ordered.rows() if max_notes is None else truncated(ordered.rows(), max_notes)
    result = _finish_core(notes.groupBy("beatmap_id").agg(*_core_aggregates(keys)))
    if feature_set.startswith("burst"):
        result = result.join(burst_features(notes, keys), "beatmap_id")
    own = [name for name in names if name not in METADATA_FEATURES]
    result = result.select("beatmap_id", *own)
    if charts is not None:
        result = charts.select("beatmap_id").join(result, "beatmap_id", "left").fillna(0.0, own)
    if feature_set.endswith("_metadata"):
        if charts is None:
            raise ValueError("a metadata feature set needs the charts frame")
        result = result.join(metadata_features(charts), "beatmap_id")
    return result.select("beatmap_id", *names)


def pooled_sequence(raw: DataFrame, keys: int = 4, max_notes: int | None = None) -> DataFrame:
    """Mean, deviation and maximum of the six note features per chart, plus log note count."""
    notes = feature_sequence(raw, keys).rows()
    if max_notes is not None:
        notes = truncated(notes, max_notes)
    names = ["time_frac", "delta_sec", "col_frac", "ln_flag", "ln_length_sec", "chord_frac"]
    return notes.groupBy("beatmap_id").agg(
        *[F.avg(name).alias(f"mean_{name}") for name in names],
        *[F.sqrt(F.greatest(F.var_pop(name), F.lit(1e-8))).alias(f"std_{name}") for name in names],
        *[F.max(name).alias(f"max_{name}") for name in names],
        (F.log1p(F.count(F.lit(1))) / 10.0).alias("note_count_log10th"),
    )
