"""Dataset audit: coverage, reliability, truncation, source checks, warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.plans.quantiles import exact_quantiles

# Thresholds and checked columns.
LOW_SCORE_COUNT = 80
FULL_SCORE_COUNT = 100
MIN_USABLE_ROWS = 100
MIN_FULL_RATE = 0.8
MAX_LOW_RATE = 0.25
MAX_TRUNCATED_RATE = 0.05
DIFFICULTY = ["hp_drain_rate", "overall_difficulty", "approach_rate"]
CHECKED = ["mode", "keys", *DIFFICULTY]
METADATA = ["mode", "circle_size", "keys", *DIFFICULTY]


def usable_labels(labels: DataFrame, notes: DataFrame) -> DataFrame:
    """Labels that have a note sequence. An empty result is an error."""
    usable = labels.join(notes.select("beatmap_id").distinct(), "beatmap_id", "left_semi")
    if usable.head() is None:
        raise RuntimeError("No labels have a matching note sequence.")
    return usable


def missing_sequences(labels: DataFrame, notes: DataFrame) -> DataFrame:
    names = [n for n in ("title", "artist", "mapper", "version") if n in labels.columns]
    lacking = labels.join(notes.select("beatmap_id").distinct(), "beatmap_id", "left_anti")
    return lacking.select("beatmap_id", *names)


def enriched(labels: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata columns replaced by what the chart file says, NULL where it says nothing."""
    kept = [name for name in labels.columns if name not in METADATA]
    return labels.select(*kept).join(metadata.select("beatmap_id", *METADATA), "beatmap_id", "left")


def numeric_summary(frame: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: count, min, median, mean, max, population deviation; zeros when empty."""
    number = F.col(column).try_cast("double")
    values = frame.select(number.alias("v")).filter("v is not null and not isnan(v)")
    zero = lambda value: F.coalesce(value, F.lit(0.0))
    plain = values.agg(
        F.count("v").alias(f"{prefix}_count"),
        zero(F.min("v")).alias(f"{prefix}_min"),
        zero(F.avg("v")).alias(f"{prefix}_mean"),
        zero(F.max("v")).alias(f"{prefix}_max"),
        zero(F.stddev_pop("v")).alias(f"{prefix}_std"),
    )
    median = exact_quantiles(values, [], "v", {"m": 0.5}).select(zero(F.col("m")).alias(f"{prefix}_median"))
    return plain.crossJoin(F.broadcast(median))  # one row each


def label_reliability(usable: DataFrame, *, low: int = LOW_SCORE_COUNT) -> DataFrame:
    score = F.col("score_count").try_cast("double")
    values = usable.select(score.alias("v")).filter("v is not null and not isnan(v)")
    rate = lambda flag: F.avg(flag.cast("double"))
    counts = values.agg(
        F.count("v").alias("usable_score_count_rows"),
        F.count_if(F.col("v") < low).alias("low_score_count_rows"),
        rate(F.col("v") < low).alias("low_score_count_rate"),
        F.count_if(F.col("v") >= FULL_SCORE_COUNT).alias("full_top100_rows"),
        rate(F.col("v") >= FULL_SCORE_COUNT).alias("full_top100_rate"),
        F.min("v").alias("min_score_count"),
    )
    median = exact_quantiles(values, [], "v", {"median_score_count": 0.5})
    return counts.crossJoin(F.broadcast(median)).withColumn("low_score_count_threshold", F.lit(low))


def truncation(lengths: DataFrame, *, max_notes: int) -> DataFrame:
    """``lengths``: one note_count per usable label row."""
    over = F.greatest(F.col("note_count") - max_notes, F.lit(0))
    return lengths.agg(
        F.count_if(over > 0).alias("truncated_rows"),
        F.coalesce(F.avg((over > 0).cast("double")), F.lit(0.0)).alias("truncated_rate"),
        F.coalesce(F.max(over), F.lit(0)).cast("long").alias("max_notes_over_limit"),
    ).withColumn("max_notes", F.lit(max_notes).cast("long"))


def _number(frame: DataFrame, name: str) -> Column:
    if name not in frame.columns:
        return F.lit(None).cast("double")
    number = F.col(name).try_cast("double")
    return F.when(~F.isnan(number), number)


def mismatched(label: Column, chart: Column) -> Column:
    """Differs beyond 1e-6 + 1e-5 * |chart|; a blank label differs from any chart value."""
    far = F.abs(label - chart) > F.lit(1e-6) + F.lit(1e-5) * F.abs(chart)
    return chart.isNotNull() & (label.isNull() | far)


def chart_mismatches(labels: DataFrame, metadata: DataFrame, *, columns: list[str] = CHECKED) -> DataFrame:
    """Labels with a chart file and the list of columns in which the two disagree."""
    present = [name for name in columns if name in labels.columns]
    sides = labels.select("beatmap_id", *[_number(labels, n).alias(f"l_{n}") for n in present]).join(
        metadata.select("beatmap_id", *[F.col(n).alias(f"c_{n}") for n in columns]), "beatmap_id"
    )
    names = [F.when(mismatched(F.col(f"l_{n}"), F.col(f"c_{n}")), F.lit(n)) for n in present]
    return sides.withColumn("columns", F.array_join(F.array_compact(F.array(*names)), ","))


def mismatch_examples(labels: DataFrame, metadata: DataFrame, top_n: int = 10) -> DataFrame:
    rows = chart_mismatches(labels, metadata).filter(F.col("columns") != "")
    return rows.select("beatmap_id", "columns").orderBy("beatmap_id").limit(top_n)


def source_integrity(
    labels: DataFrame, metadata: DataFrame | None = None, *, expected_mode: int = 3, expected_keys: int = 4
) -> DataFrame:
    """Counts of missing and wrong mode, keys and difficulty values, and of chart files that disagree."""
    key_column = "keys" if "keys" in labels.columns else "circle_size"
    mode, keys = _number(labels, "mode"), _number(labels, key_column)
    own = labels.agg(
        F.count(F.lit(1)).alias("checked_rows"),
        F.count_if(mode.isNull()).alias("mode_missing_rows"),
        F.count_if(mode != expected_mode).alias("mode_mismatch_rows"),
        F.count_if(keys.isNull()).alias("keys_missing_rows"),
        F.count_if(keys != expected_keys).alias("keys_mismatch_rows"),
        *[F.count_if(_number(labels, n).isNull()).alias(f"{n}_missing_rows") for n in DIFFICULTY],
    ).withColumns(
        {
            "mode_column_available": F.lit("mode" in labels.columns),
            "keys_column_available": F.lit(key_column in labels.columns),
            "expected_keys": F.lit(expected_keys),
            "osu_dir_checked": F.lit(metadata is not None),
        }
    )
    files = ["osu_files_checked", "osu_missing_files", "osu_mode_mismatch_rows", "osu_keys_mismatch_rows", "osu_metadata_label_mismatch_rows"]
    if metadata is None:
        return own.withColumns({name: F.lit(0).cast("long") for name in files})
    wrong = lambda name, expected: F.coalesce(F.col(f"c_{name}") != expected, F.lit(True))
    checked = chart_mismatches(labels, metadata).agg(
        F.count(F.lit(1)).alias("osu_files_checked"),
        F.count_if(wrong("mode", expected_mode)).alias("osu_mode_mismatch_rows"),
        F.count_if(wrong("keys", expected_keys)).alias("osu_keys_mismatch_rows"),
        F.count_if(F.col("columns") != "").alias("osu_metadata_label_mismatch_rows"),
    )
    both = own.crossJoin(F.broadcast(checked))  # one row each
    return both.withColumn("osu_missing_files", F.col("checked_rows") - F.col("osu_files_checked"))


def audit_counts(labels: DataFrame, notes: DataFrame) -> DataFrame:
    """Label, usable, missing, extra and duplicate rows, and number of groups."""
    ids = notes.select("beatmap_id").distinct().withColumn("_has", F.lit(1))
    known = labels.groupBy("beatmap_id").agg(F.count(F.lit(1)).alias("_rows"))
    both = known.join(ids, "beatmap_id", "full")
    rows, has = F.coalesce(F.col("_rows"), F.lit(0)), F.col("_has").isNotNull()
    counts = both.agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("label_rows"),
        F.coalesce(F.sum(F.when(has, rows).otherwise(0)), F.lit(0)).alias("usable_rows"),
        F.coalesce(F.sum(F.when(has, 0).otherwise(rows)), F.lit(0)).alias("missing_sequence_count"),
        F.count_if(has & F.col("_rows").isNull()).alias("extra_sequence_count"),
        F.coalesce(F.sum(F.greatest(rows - 1, F.lit(0))), F.lit(0)).alias("duplicate_beatmap_id_count"),
    )
    if "beatmapset_id" not in labels.columns:
        return counts.withColumn("group_count", F.lit(0).cast("long"))
    groups = labels.agg(F.countDistinct("beatmapset_id").alias("group_count"))
    return counts.crossJoin(F.broadcast(groups))  # one row each


def audit_summary(
    labels: DataFrame,
    notes: DataFrame,
    metadata: DataFrame | None = None,
    *,
    targets: list[str],
    max_notes: int = 3000,
    expected_mode: int = 3,
    expected_keys: int = 4,
) -> DataFrame:
    """All audit numbers in one row; input of the warnings."""
    lengths = notes.groupBy("beatmap_id").agg(F.count(F.lit(1)).alias("note_count"))
    usable = labels.join(lengths, "beatmap_id")
    parts = [
        audit_counts(labels, notes),
        numeric_summary(usable, "note_count", "sequence_length"),
        truncation(usable, max_notes=max_notes),
        source_integrity(labels, metadata, expected_mode=expected_mode, expected_keys=expected_keys),
    ]
    if "score_count" in labels.columns:
        parts.append(label_reliability(usable))
    parts += [numeric_summary(usable, name, f"target_{name}") for name in targets if name in labels.columns]
    missing = [name for name in targets if name not in labels.columns]
    summary = parts[0]
    for part in parts[1:]:
        summary = summary.crossJoin(F.broadcast(part))  # one row each
    return summary.withColumn("target_missing", F.lit(", ".join(missing)))


def _percent(value: Column) -> Column:
    return F.format_string("%.2f%%", value * 100)


def quality_warnings(summary: DataFrame) -> DataFrame:
    """(position, code, severity, message) of every rule the audit row breaks."""
    have = set(summary.columns)
    c = lambda name: F.col(name) if name in have else F.lit(0)
    text = lambda *parts: F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    scored = c("usable_score_count_rows") > 0
    difficulty = F.greatest(*[c(f"{name}_missing_rows") for name in DIFFICULTY])
    checked = c("osu_dir_checked") == F.lit(True)
    # Codes and messages in reporting order.
    rules = [
        ("missing_sequences", "warning", c("missing_sequence_count") > 0,
         text(c("missing_sequence_count"), " labels are missing parsed note sequences and cannot be trained.")),
        ("missing_targets", "error", c("target_missing") != "", text("Missing target columns: ", c("target_missing"), ".")),
        ("small_usable_dataset", "warning", c("usable_rows") < MIN_USABLE_ROWS,
         text("Only ", c("usable_rows"), " usable maps are available; use this for smoke tests, not final model comparison.")),
        ("duplicate_beatmap_ids", "warning", c("duplicate_beatmap_id_count") > 0,
         text(c("duplicate_beatmap_id_count"), " duplicate beatmap_id rows were found; deduplicate labels before training.")),
        ("sequence_truncation", "warning", c("truncated_rate") > MAX_TRUNCATED_RATE,
         text(_percent(c("truncated_rate")), " of usable maps exceed max_notes ", c("max_notes"),
              "; raise --max-notes or inspect GPU memory.")),
        ("low_full_top100_rate", "warning", scored & (c("full_top100_rate") < MIN_FULL_RATE),
         text("Only ", _percent(c("full_top100_rate")), " of usable maps have full top100 score coverage; "
              "keep sample weighting on and verify with human judgments.")),
        ("high_low_score_count_rate", "warning", scored & (c("low_score_count_rate") > MAX_LOW_RATE),
         text(_percent(c("low_score_count_rate")), " of usable maps are below score_count ", c("low_score_count_threshold"),
              "; labels may be noisy.")),
        ("missing_mode_metadata", "error", ~c("mode_column_available"),
         text("Labels do not include a mode column; cannot prove rows are osu!mania.")),
        ("non_mania_rows", "error", c("mode_mismatch_rows") > 0,
         text(c("mode_mismatch_rows"), " label rows do not match expected osu!mania mode 3.")),
        ("missing_key_metadata", "error", ~c("keys_column_available"),
         text("Labels do not include keys/circle_size; cannot prove the key mode.")),
        ("wrong_key_mode_rows", "error", c("keys_mismatch_rows") > 0,
         text(c("keys_mismatch_rows"), " label rows do not match expected ", c("expected_keys"), "K mania.")),
        ("missing_difficulty_metadata", "warning", difficulty > 0,
         text("Up to ", difficulty, " rows are missing HP/OD/AR metadata.")),
        ("missing_osu_files", "warning", checked & (c("osu_missing_files") > 0),
         text(c("osu_missing_files"), " labels do not have a matching raw .osu file for source verification.")),
        ("osu_non_mania_files", "error", checked & (c("osu_mode_mismatch_rows") > 0),
         text(c("osu_mode_mismatch_rows"), " raw .osu files do not declare mode 3.")),
        ("osu_wrong_key_mode_files", "error", checked & (c("osu_keys_mismatch_rows") > 0),
         text(c("osu_keys_mismatch_rows"), " raw .osu files do not declare ", c("expected_keys"), "K.")),
        ("osu_label_metadata_mismatch", "error", checked & (c("osu_metadata_label_mismatch_rows") > 0),
         text(c("osu_metadata_label_mismatch_rows"), " raw .osu files disagree with label metadata.")),
    ]
    entries = [
        F.when(
            condition,
            F.struct(F.lit(place).alias("position"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message")),
        )
        for place, (code, severity, condition, message) in enumerate(rules)
    ]
    return summary.select(F.explode(F.array_compact(F.array(*entries))).alias("w")).select("w.*")
