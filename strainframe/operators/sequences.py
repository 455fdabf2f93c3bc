"""Ordered note sequences: sorting, chords, neighbours, windows of density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.plans.ordered import OrderedRuns

NOTE_ORDER = ["time_ms", "col", "source_order"]
CHART = ["beatmap_id"]

# Gap limits in milliseconds.
JACK_SHORT_MS = 100
JACK_MEDIUM_MS = 150
TRILL_MS = 120


def sorted_notes(raw: DataFrame) -> OrderedRuns:
    """Notes in (time, column) order with their place in the chart."""
    columns = ["beatmap_id", *NOTE_ORDER, "is_ln", "ln_length_ms"]
    return OrderedRuns.build(raw.select(*columns), CHART, NOTE_ORDER).indexed("note_index")


def with_chords(notes: OrderedRuns) -> OrderedRuns:
    return notes.group_totals([*CHART, "time_ms"], {"chord_size": ("sum", F.lit(1).cast("long"))})


def with_extent(notes: OrderedRuns) -> OrderedRuns:
    """Last note time and number of notes of the chart."""
    return notes.group_totals(
        CHART,
        {"last_time_ms": ("max", F.col("time_ms")), "note_count": ("sum", F.lit(1).cast("long"))},
    )


def with_neighbours(notes: OrderedRuns, depth: int = 1) -> OrderedRuns:
    wanted = {"prev_time_ms": ("time_ms", 1), "prev_col": ("col", 1)}
    if depth > 1:
        wanted |= {"prev2_time_ms": ("time_ms", 2), "prev2_col": ("col", 2)}
    return notes.lagged(wanted)


def parsed_notes(raw: DataFrame) -> DataFrame:
    return with_chords(sorted_notes(raw)).rows()


def normalised_features(keys: int) -> dict[str, Column]:
    """The six model inputs per note; needs chords, extent and the previous note."""
    span = F.greatest(F.col("last_time_ms"), F.lit(1)).cast("double")
    gap = F.coalesce(F.col("time_ms") - F.col("prev_time_ms"), F.lit(0))
    return {
        "time_frac": F.col("time_ms") / span,
        "delta_sec": gap / F.lit(1000.0),
        "col_frac": F.col("col") / F.lit(float(max(1, keys - 1))),
        "ln_flag": F.col("is_ln").cast("double"),
        "ln_length_sec": F.col("ln_length_ms") / F.lit(1000.0),
        "chord_frac": F.col("chord_size") / F.lit(float(keys)),
    }


def feature_sequence(raw: DataFrame, keys: int = 4) -> OrderedRuns:
    notes = with_neighbours(with_extent(with_chords(sorted_notes(raw))))
    return notes.with_columns(normalised_features(keys))


def truncated(notes: DataFrame, max_notes: int) -> DataFrame:
    """First ``max_notes`` notes of every chart; a plain filter on a stored sequence."""
    return notes.filter(F.col("note_index") < max_notes)


def sequence_rows(raw: DataFrame) -> DataFrame:
    """Notes with their place in the chart, as they are stored."""
    return sorted_notes(raw).rows().select(*CHART, "note_index", "time_ms", "col", "is_ln", "ln_length_ms")


def stored_overview(stored: DataFrame, charts: DataFrame) -> DataFrame:
    """Charts with a stored sequence: ``notes``, ``last_time_ms``, ``longest_gap_ms`` and the chart's own columns.

    On tables in buckets by chart, window, group and join take the rows as they lie.
    """
    notes = OrderedRuns.build(stored, CHART, ["note_index"]).lagged({"prev_time_ms": ("time_ms", 1)}).rows()
    sizes = notes.groupBy(*CHART).agg(
        F.count(F.lit(1)).alias("notes"),
        F.max("time_ms").alias("last_time_ms"),
        F.max(F.col("time_ms") - F.col("prev_time_ms")).alias("longest_gap_ms"),
    )
    return sizes.join(charts, CHART)


def adjacency_patterns(raw: DataFrame, keys: int = 4) -> DataFrame:
    """Repeats, jumps and trills between neighbouring notes, per chart."""
    notes = with_neighbours(sorted_notes(raw), depth=2).rows()
    return notes.groupBy("beatmap_id").agg(*adjacency_aggregates(keys))


def adjacency_aggregates(keys: int) -> list[Column]:
    gap = F.col("time_ms") - F.col("prev_time_ms")
    earlier_gap = F.col("prev_time_ms") - F.col("prev2_time_ms")
    has_one, has_two = F.col("prev_time_ms").isNotNull(), F.col("prev2_time_ms").isNotNull()
    same = F.col("col") == F.col("prev_col")
    steps = max(1, keys - 1)
    # Column distances are compared in single precision, where |1 - 1/3| falls
    # just short of 2/3; the published ratios depend on it.
    single = lambda name: (F.col(name) / F.lit(float(steps))).cast("float")
    jump = F.abs(single("col") - single("prev_col")) >= F.lit(2.0 / 3.0).cast("float")
    trill = (
        (F.col("col") == F.col("prev2_col"))
        & (F.col("prev_col") != F.col("prev2_col"))
        & (gap <= TRILL_MS)
        & (earlier_gap <= TRILL_MS)
    )
    rate = lambda flag, valid: F.coalesce(F.avg(F.when(valid, flag.cast("double"))), F.lit(0.0))
    change = F.abs(F.col("col") - F.col("prev_col")) / F.lit(float(steps))
    return [
        F.coalesce(F.avg(F.when(has_one, change)), F.lit(0.0)).alias("column_change_mean"),
        rate(same, has_one).alias("same_column_ratio"),
        rate(jump, has_one).alias("jump_column_ratio"),
        rate(same & (gap <= JACK_SHORT_MS), has_one).alias("jack_ratio_100ms"),
        rate(same & (gap <= JACK_MEDIUM_MS), has_one).alias("jack_ratio_150ms"),
        rate(trill, has_two).alias("trill_like_ratio_120ms"),
    ]


# Size of a density block. A block holds at most one row per millisecond of
# (block + longest window), whatever the number of notes in the chart.
BLOCK_MS = 60_000


def time_density(
    notes: DataFrame, windows_ms: dict[str, int], kept: dict[str, Column] | None = None
) -> DataFrame:
    """Per (chart, time): notes at that time and notes in [time, time + window].

    Notes are counted per time first, so stacked notes never travel. Every time
    is also sent to the previous block if a window starting there can see it.
    """
    widest = max(windows_ms.values())
    cells = notes.groupBy("beatmap_id", "time_ms").agg(
        F.count(F.lit(1)).alias("here"), *[value.alias(name) for name, value in (kept or {}).items()]
    )
    home = F.floor(F.col("time_ms") / BLOCK_MS)
    first = F.floor((F.col("time_ms") - widest) / BLOCK_MS)
    spread = cells.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(first, home)))
    ahead = Window.partitionBy("beatmap_id", "_block").orderBy("time_ms")
    counted = spread.withColumns(
        {name: F.sum("here").over(ahead.rangeBetween(0, span)) for name, span in windows_ms.items()}
    )
    return counted.filter(F.col("_block") == F.col("_home")).drop("_block", "_home")


def window_density(raw: DataFrame, window_ms: int) -> DataFrame:
    """Per note: notes from it forward within the window, divided by its length."""
    notes = sorted_notes(raw).running({"_rank_in_time": ("sum", F.lit(1).cast("long"))}, within=["time_ms"]).rows()
    density = time_density(raw, {"ahead": window_ms})
    joined = notes.join(density, ["beatmap_id", "time_ms"])
    count = F.col("ahead") - (F.col("_rank_in_time") - 1)
    return joined.select("beatmap_id", "note_index", "time_ms", (count / F.lit(window_ms / 1000.0)).alias("density"))


def jack_notes(notes: OrderedRuns, limit: float, time: Column) -> OrderedRuns:
    """Flag same-column repeats: 0 < time - previous time in that column <= limit."""
    timed = notes.lagged({"_column_time_ms": ("time_ms", 1)}, within=["col"])
    gap = time - F.col("_column_time_ms")
    return timed.with_columns({"is_jack": F.coalesce((gap > 0) & (gap <= limit), F.lit(False))})
