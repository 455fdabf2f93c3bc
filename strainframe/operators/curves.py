"""Strain curves over sliding windows, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.functions.casts import first_finite
from strainframe.operators.review import top_rows
from strainframe.operators.sequences import sorted_notes, with_chords, with_extent, with_neighbours
from strainframe.plans.ordered import OrderedRuns

# Weights of the pressures and limits of the flags.
JACK_SEC = 0.22
BURST_MS = 120
PRESSURES = [
    "reading_pressure",
    "speed_pressure",
    "stamina_pressure",
    "jack_pressure",
    "chord_pressure",
    "ln_pressure",
    "accuracy_pressure",
]
DENSITIES = ["note_density", "rice_density", "burst_density", "jack_density", "chord_load", "ln_density", "ln_load"]
CURVE_COLUMNS = [
    "beatmap_id", "window_index", "start_sec", "end_sec", "note_count", *DENSITIES, "od_multiplier", *PRESSURES, "feel_strain",
]
SKILL_ORDER = ["reading", "speed", "jack", "chord", "ln"]
SCORES = ["reading", "speed", "rice", "jack", "chord", "ln", "stamina", "accuracy"]


def chart_dimension(labels: DataFrame) -> DataFrame:
    """What a curve needs to know about its chart, with defaults for unusable values."""
    seconds = first_finite(labels, ["length_sec"])
    millis = first_finite(labels, ["length_ms"]) / 1000.0
    length = F.when(seconds > 0, seconds).when(millis > 0, millis).otherwise(F.lit(1.0))
    keys = F.greatest(F.lit(1), first_finite(labels, ["keys", "circle_size", "cs"], 4.0).cast("int"))
    return labels.select(
        "beatmap_id",
        length.alias("length_sec"),
        millis.alias("stated_sec"),
        keys.alias("keys"),
        first_finite(labels, ["overall_difficulty", "od", "accuracy"], 5.0).alias("od"),
    )


def timed_notes(raw: DataFrame, labels: DataFrame, parsed_keys: int = 4) -> OrderedRuns:
    """Notes with their time scaled to the chart length and their lane.

    Charts without a label row, and labels without notes, drop out.
    """
    notes = with_neighbours(with_extent(with_chords(sorted_notes(raw)))).attach(chart_dimension(labels))
    span = F.greatest(F.col("last_time_ms"), F.lit(1)).cast("double")
    scale = F.greatest(F.col("time_ms") / span, F.lit(0.0))
    lanes = F.greatest(F.lit(1), F.col("keys") - 1)
    return notes.with_columns(
        {
            "time_sec": scale * F.col("length_sec"),
            "last_sec": F.greatest(F.col("last_time_ms") / span, F.lit(0.0)) * F.col("length_sec"),
            "lane": F.rint(F.col("col") / F.lit(float(max(1, parsed_keys - 1))) * lanes).cast("int"),
            "chord": F.greatest(F.lit(1.0), F.rint(F.col("chord_size") / F.lit(float(parsed_keys)) * F.col("keys"))),
            "gap_ms": F.coalesce(F.col("time_ms") - F.col("prev_time_ms"), F.lit(0)),
        }
    )


def flagged_notes(raw: DataFrame, labels: DataFrame, parsed_keys: int = 4) -> DataFrame:
    notes = timed_notes(raw, labels, parsed_keys).lagged({"lane_sec": ("time_sec", 1)}, within=["lane"])
    repeat = F.col("time_sec") - F.col("lane_sec")
    return notes.with_columns(
        {
            "is_jack": F.coalesce((repeat > 0) & (repeat <= JACK_SEC), F.lit(False)),
            "is_burst": (F.col("gap_ms") > 0) & (F.col("gap_ms") <= BURST_MS),
        }
    ).rows()


#: Windows of a chart that are listed in one array.
GRID_BLOCK = 8192


def window_count(duration: Column, window_sec: float, step_sec: float) -> Column:
    """Number of windows starting at 0, step, 2 * step, ... over the duration."""
    full = F.ceil((duration - F.lit(window_sec) + F.lit(step_sec)) / F.lit(step_sec))
    return F.when(duration <= window_sec, F.lit(1)).otherwise(full).cast("long")


def window_grid(durations: DataFrame, window_sec: float, step_sec: float) -> DataFrame:
    """One row per chart and window, empty windows included.

    Windows are listed a block at a time, so a chart with an absurd length needs no long array.
    """
    last = window_count(F.col("duration_sec"), window_sec, step_sec) - 1
    block, size = F.col("_block"), F.lit(GRID_BLOCK).cast("long")
    grid = durations.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / size))))
    indexes = F.sequence(block * size, F.least(last, (block + 1) * size - 1))
    grid = grid.withColumn("window_index", F.explode(indexes)).drop("_block")
    start = F.col("window_index") * F.lit(float(step_sec))
    return grid.withColumns({"start_sec": start, "end_sec": start + F.lit(float(window_sec))})


def feel_curve(raw: DataFrame, labels: DataFrame, *, window_sec: float = 2.0, step_sec: float = 0.5) -> DataFrame:
    """Pressures and strain per chart and window [start, start + window).

    A note names the few windows it lies in, so the interval join becomes an
    aggregation by (chart, window) that starts before the shuffle.
    """
    notes = flagged_notes(raw, labels)
    duration = F.greatest(F.col("last_sec"), F.col("stated_sec"), F.lit(float(window_sec)))
    last = window_count(duration, window_sec, step_sec) - 1
    time, step, width = F.col("time_sec"), F.lit(float(step_sec)), F.lit(float(window_sec))
    # One index of slack on both sides; the filter below decides exactly.
    low = F.greatest(F.lit(0).cast("long"), F.floor((time - width) / step))
    high = F.least(last, F.floor(time / step) + 1)
    placed = notes.filter(low <= high).withColumn("window_index", F.explode(F.sequence(low, high)))
    start = F.col("window_index") * step
    placed = placed.filter((time >= start) & (time < start + width))
    long_note = F.col("is_ln") > 0
    tally = lambda flag: F.sum(flag.cast("long"))
    sums = placed.groupBy("beatmap_id", "window_index").agg(
        F.count(F.lit(1)).alias("note_count"),
        tally(~long_note).alias("_rice"),
        tally(F.col("is_jack")).alias("_jack"),
        tally(F.col("is_burst")).alias("_burst"),
        F.sum(F.col("chord") - 1.0).alias("_chord"),
        tally(long_note).alias("_ln"),
        F.sum(F.greatest(F.col("ln_length_ms"), F.lit(0))).alias("_ln_ms"),
    )
    durations = _durations(raw, labels, window_sec)
    grid = window_grid(durations, window_sec, step_sec)
    return _pressures(grid.join(sums, ["beatmap_id", "window_index"], "left"), window_sec)


def _durations(raw: DataFrame, labels: DataFrame, window_sec: float) -> DataFrame:
    """Curve length per chart, from its last note alone."""
    last = raw.groupBy("beatmap_id").agg(F.max("time_ms").alias("last_time_ms"))
    reached = F.greatest(F.col("last_time_ms") / F.greatest(F.col("last_time_ms"), F.lit(1)).cast("double"), F.lit(0.0))
    duration = F.greatest(reached * F.col("length_sec"), F.col("stated_sec"), F.lit(float(window_sec)))
    return last.join(chart_dimension(labels), "beatmap_id").select("beatmap_id", "od", duration.alias("duration_sec"))


def _pressures(windows: DataFrame, window_sec: float) -> DataFrame:
    per_sec = lambda name: F.coalesce(F.col(name), F.lit(0)) / F.lit(float(window_sec))
    c = F.col
    above_five = F.greatest(F.lit(0.0), c("od") - 5.0)
    measured = windows.withColumns(
        {
            "note_count": F.coalesce(c("note_count"), F.lit(0)),
            "note_density": per_sec("note_count"),
            "rice_density": per_sec("_rice"),
            "burst_density": per_sec("_burst"),
            "jack_density": per_sec("_jack"),
            "chord_load": per_sec("_chord"),
            "ln_density": per_sec("_ln"),
            "ln_load": F.coalesce(c("_ln_ms"), F.lit(0)) / F.lit(1000.0) / F.lit(float(window_sec)),
            "od_multiplier": F.lit(1.0) + above_five / 20.0,
        }
    )
    pressed = measured.withColumns(
        {
            "reading_pressure": F.greatest(F.lit(0.0), c("note_density") - 1.0) * 0.35 + c("chord_load") * 0.25,
            "speed_pressure": c("rice_density") * 0.35 + c("burst_density") * 0.90,
            "stamina_pressure": c("note_density") * 0.25 + c("ln_load") * 0.15,
            "jack_pressure": c("jack_density") * 1.30,
            "chord_pressure": c("chord_load") * 1.10,
            "ln_pressure": c("ln_density") * 0.55 + c("ln_load") * 0.45,
        }
    )
    eased = c("speed_pressure") * 0.35 + c("chord_pressure") * 0.25 + c("ln_pressure") * 0.20 + above_five * 0.10
    strain = F.lit(0.0)
    for name in PRESSURES:
        strain = strain + c(name)
    return (
        pressed.withColumn("accuracy_pressure", eased)
        .withColumn("feel_strain", strain * c("od_multiplier"))
        .select(*CURVE_COLUMNS)
    )


def _leading(scores: dict[str, Column]) -> Column:
    """Name of the largest score, the first one winning a tie."""
    ranked = [
        F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name"))
        for place, (name, score) in enumerate(scores.items())
    ]
    return F.array_max(F.array(*ranked))["name"]


def curve_summary(curve: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per chart. A group holds one chart's windows, bounded by its length."""
    p90 = lambda value: F.percentile(value, 0.9)
    c = F.col
    scores = {
        "reading": p90(c("reading_pressure")),
        "speed": p90(c("speed_pressure")),
        "rice": p90(c("rice_density")),
        "jack": F.max("jack_density"),
        "chord": p90(c("chord_load")),
        "ln": p90(c("ln_load") + c("ln_density")),
        "stamina": F.avg("feel_strain"),
        "accuracy": p90(c("feel_strain") * c("od_multiplier")),
    }
    grouped = curve.groupBy("beatmap_id").agg(
        F.max("feel_strain").alias("peak_strain"),
        F.avg("feel_strain").alias("mean_strain"),
        p90(c("feel_strain")).alias("p90_strain"),
        F.sum("feel_strain").alias("fatigue_area"),
        F.min_by("start_sec", F.struct(-c("feel_strain"), c("start_sec"))).alias("peak_time_sec"),
        *[scores[name].alias(f"{name}_score") for name in SCORES],
        *[p90(c(name)).alias(name) for name in PRESSURES],
    )
    skill = _leading({name: c(f"{name}_score") for name in SKILL_ORDER})
    summary = grouped.withColumn("dominant_skill", skill)
    if labels is None:
        return summary
    kept = [name for name in ("title", "artist", "version", "keys") if name in labels.columns]
    return labels.select("beatmap_id", *kept).join(summary, "beatmap_id")


def segment_skill() -> Column:
    """Dominant skill of a single window, by its pressures."""
    return _leading({name: F.coalesce(F.col(f"{name}_pressure"), F.lit(0.0)) for name in SKILL_ORDER})


def top_segments(curve: DataFrame, per_chart: int = 2) -> DataFrame:
    strongest = Window.partitionBy("beatmap_id").orderBy(F.col("feel_strain").desc(), F.col("start_sec"))
    return (
        curve.withColumn("place", F.row_number().over(strongest)).filter(F.col("place") <= per_chart).drop("place")
    )


def top_curves(curve: DataFrame, summary: DataFrame, top_n: int = 12) -> DataFrame:
    """Windows of the ``top_n`` charts with the highest peak."""
    best = top_rows(summary, [F.col("peak_strain").desc(), F.col("beatmap_id")], top_n).select("beatmap_id")
    return curve.join(F.broadcast(best), "beatmap_id", "left_semi")
