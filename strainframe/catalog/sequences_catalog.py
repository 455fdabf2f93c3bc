"""Sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainframe.catalog.registry import query, rounded
from strainframe.catalog.views import VIEWS
from strainframe.operators import features, labels, sequences
from strainframe.sources import tables


@query(
    "q_notes",
    "SELECT beatmap_id, note_index, time_ms, col, is_ln, ln_length_ms, chord_size FROM notes",
)
def q_notes(spark, folder):
    notes = sequences.parsed_notes(tables.raw_notes(spark, folder))
    return notes.select("beatmap_id", "note_index", "time_ms", "col", "is_ln", "ln_length_ms", "chord_size")


@query(
    "q_note_features",
    """SELECT beatmap_id, note_index, round(time_frac, 6) AS time_frac, round(delta_sec, 6) AS delta_sec,
              round(col_frac, 6) AS col_frac, is_ln AS ln_flag, round(ln_length_sec, 6) AS ln_length_sec,
              round(chord_frac, 6) AS chord_frac FROM note_features""",
)
def q_note_features(spark, folder):
    notes = sequences.feature_sequence(tables.raw_notes(spark, folder)).rows()
    names = ["time_frac", "delta_sec", "col_frac", "ln_flag", "ln_length_sec", "chord_frac"]
    return rounded(notes.select("beatmap_id", "note_index", *names), *names)


@query(
    "q_truncate_notes",
    "SELECT beatmap_id, note_index, time_ms, col FROM notes WHERE note_index < 50",
)
def q_truncate_notes(spark, folder):
    notes = sequences.sorted_notes(tables.raw_notes(spark, folder)).rows()
    return sequences.truncated(notes, 50).select("beatmap_id", "note_index", "time_ms", "col")


@query(
    "q_jack_flags",
    """SELECT beatmap_id, note_index, time_ms, col,
              coalesce(gap > 0 AND gap <= 220, false) AS is_jack
       FROM (SELECT *, time_ms - lag(time_ms) OVER (PARTITION BY beatmap_id, col ORDER BY note_index) AS gap FROM notes)""",
)
def q_jack_flags(spark, folder):
    notes = sequences.sorted_notes(tables.raw_notes(spark, folder))
    flagged = sequences.jack_notes(notes, 220, F.col("time_ms")).rows()
    return flagged.select("beatmap_id", "note_index", "time_ms", "col", "is_jack")


DENSITY_SQL = """
    SELECT *, count(*) OVER (PARTITION BY beatmap_id ORDER BY time_ms RANGE BETWEEN CURRENT ROW AND 1000 FOLLOWING)
              - (row_number() OVER w - rank() OVER (PARTITION BY beatmap_id ORDER BY time_ms)) AS ahead_1s,
           count(*) OVER (PARTITION BY beatmap_id ORDER BY time_ms RANGE BETWEEN CURRENT ROW AND 2000 FOLLOWING)
              - (row_number() OVER w - rank() OVER (PARTITION BY beatmap_id ORDER BY time_ms)) AS ahead_2s
    FROM notes WINDOW w AS (PARTITION BY beatmap_id ORDER BY note_index)"""


@query(
    "q_window_density",
    "SELECT beatmap_id, note_index, time_ms, round(ahead_1s / 1.0::DOUBLE, 6) AS density FROM note_density",
    extra={"note_density": DENSITY_SQL},
)
def q_window_density(spark, folder):
    return rounded(sequences.window_density(tables.raw_notes(spark, folder), 1000), "density")


ADJACENCY_SQL = """
    SELECT beatmap_id,
           coalesce(avg(abs(col - prev_col) / 3.0::DOUBLE), 0) AS column_change_mean,
           coalesce(avg((col = prev_col)::INT), 0) AS same_column_ratio,
           coalesce(avg((abs((col / 3.0::DOUBLE)::FLOAT - (prev_col / 3.0::DOUBLE)::FLOAT) >= (2.0::DOUBLE / 3.0::DOUBLE)::FLOAT)::INT), 0)
               AS jump_column_ratio,
           coalesce(avg((col = prev_col AND time_ms - prev_time_ms <= 100)::INT), 0) AS jack_ratio_100ms,
           coalesce(avg((col = prev_col AND time_ms - prev_time_ms <= 150)::INT), 0) AS jack_ratio_150ms,
           coalesce(avg((col = prev2_col AND prev_col <> prev2_col AND time_ms - prev_time_ms <= 120
                AND prev_time_ms - prev2_time_ms <= 120)::INT) FILTER (WHERE prev2_time_ms IS NOT NULL), 0) AS trill_like_ratio_120ms
    FROM notes GROUP BY beatmap_id"""

CORE_SQL = """
    SELECT n.beatmap_id, ln(1 + n) AS note_count_log, ln(1 + secs) AS duration_sec_log, n / secs AS notes_per_sec,
           delta_mean, delta_std, delta_p10, delta_p50, delta_p90, short_gap_50ms_ratio, short_gap_100ms_ratio,
           short_gap_200ms_ratio, column_mean, column_std, column_change_mean, same_column_ratio, jump_column_ratio,
           -(CASE WHEN b0 > 0 THEN b0 * log2(b0) ELSE 0 END + CASE WHEN b1 > 0 THEN b1 * log2(b1) ELSE 0 END
             + CASE WHEN b2 > 0 THEN b2 * log2(b2) ELSE 0 END + CASE WHEN b3 > 0 THEN b3 * log2(b3) ELSE 0 END) / 2
               AS column_entropy,
           greatest(b0, b1, b2, b3) - least(b0, b1, b2, b3) AS column_imbalance,
           ln_ratio, ln_length_mean, ln_length_std, ln_length_max, ln_total / secs AS ln_total_per_sec,
           chord_mean, chord_std, chord_max, chord_2_ratio, chord_3_ratio, chord_4_ratio,
           jack_ratio_100ms, jack_ratio_150ms, trill_like_ratio_120ms
    FROM (
        SELECT beatmap_id, count(*) AS n,
               CASE WHEN sum(gap) > 0 THEN sum(gap) / 1000.0::DOUBLE
                    ELSE greatest(max(last_time_ms) / greatest(max(last_time_ms), 1), 1e-6) END AS secs,
               coalesce(avg(pos_gap) / 1000.0::DOUBLE, 0) AS delta_mean,
               coalesce(stddev_pop(pos_gap) / 1000.0::DOUBLE, 0) AS delta_std,
               coalesce(quantile_cont(pos_gap, 0.1) / 1000.0::DOUBLE, 0) AS delta_p10,
               coalesce(quantile_cont(pos_gap, 0.5) / 1000.0::DOUBLE, 0) AS delta_p50,
               coalesce(quantile_cont(pos_gap, 0.9) / 1000.0::DOUBLE, 0) AS delta_p90,
               coalesce(avg((pos_gap <= 50)::INT), 1) AS short_gap_50ms_ratio,
               coalesce(avg((pos_gap <= 100)::INT), 1) AS short_gap_100ms_ratio,
               coalesce(avg((pos_gap <= 200)::INT), 1) AS short_gap_200ms_ratio,
               avg(col / 3.0::DOUBLE) AS column_mean, stddev_pop(col / 3.0::DOUBLE) AS column_std,
               avg((col = 0)::INT) AS b0, avg((col = 1)::INT) AS b1, avg((col = 2)::INT) AS b2, avg((col = 3)::INT) AS b3,
               avg(is_ln) AS ln_ratio,
               coalesce(avg(ln_length_ms) FILTER (WHERE is_ln = 1) / 1000.0::DOUBLE, 0) AS ln_length_mean,
               coalesce(stddev_pop(ln_length_ms) FILTER (WHERE is_ln = 1) / 1000.0::DOUBLE, 0) AS ln_length_std,
               coalesce(max(ln_length_ms) FILTER (WHERE is_ln = 1) / 1000.0::DOUBLE, 0) AS ln_length_max,
               sum(ln_length_ms) / 1000.0::DOUBLE AS ln_total,
               avg(chord_size) AS chord_mean, stddev_pop(chord_size) AS chord_std, max(chord_size) AS chord_max,
               avg((chord_size >= 2)::INT) AS chord_2_ratio, avg((chord_size >= 3)::INT) AS chord_3_ratio,
               avg((chord_size >= 4)::INT) AS chord_4_ratio
        FROM (SELECT *, time_ms - prev_time_ms AS gap,
                     CAST(CASE WHEN time_ms > prev_time_ms THEN time_ms - prev_time_ms END AS DOUBLE) AS pos_gap FROM notes)
        GROUP BY beatmap_id
    ) n JOIN adjacency USING (beatmap_id)"""

BURST_SQL = """
    SELECT beatmap_id, max(ahead_1s)::DOUBLE AS peak_notes_per_sec_1s, max(ahead_2s) / 2.0::DOUBLE AS peak_notes_per_sec_2s,
           avg(ahead_1s) AS mean_notes_per_sec_1s, avg((ahead_1s >= 10)::INT) AS burst_10nps_ratio,
           avg((ahead_1s >= 15)::INT) AS burst_15nps_ratio,
           coalesce(avg((chord_size >= 2)::INT) FILTER (WHERE ahead_1s >= 10), 0) AS burst_chord_2_ratio,
           coalesce(avg((chord_size >= 3)::INT) FILTER (WHERE ahead_1s >= 10), 0) AS burst_chord_3_ratio
    FROM note_density GROUP BY beatmap_id"""

FEATURE_VIEWS = {
    "note_density": DENSITY_SQL,
    "adjacency": ADJACENCY_SQL,
    "core": CORE_SQL,
    "burst": BURST_SQL,
    "core_features": "SELECT " + ", ".join(["beatmap_id", *features.CORE_FEATURES]) + " FROM core",
    "metadata_features": """
        SELECT beatmap_id, mode::DOUBLE AS metadata_mode, keys::DOUBLE AS metadata_keys, hp_drain_rate AS metadata_hp_drain_rate,
               coalesce(overall_difficulty, 0) AS metadata_overall_difficulty, approach_rate AS metadata_approach_rate,
               difficulty_rating AS metadata_difficulty_rating, length_ms / 1000.0::DOUBLE AS metadata_length_sec,
               bpm AS metadata_bpm FROM maps""",
}


def _round_sql(names, digits=6):
    return ", ".join(f"round(CAST({name} AS DOUBLE), {digits}) AS {name}" for name in names)


ADJACENCY_NAMES = [
    "column_change_mean",
    "same_column_ratio",
    "jump_column_ratio",
    "jack_ratio_100ms",
    "jack_ratio_150ms",
    "trill_like_ratio_120ms",
]


@query(
    "q_adjacency_patterns",
    f"SELECT beatmap_id, {_round_sql(ADJACENCY_NAMES)} FROM adjacency",
    extra=FEATURE_VIEWS,
)
def q_adjacency_patterns(spark, folder):
    return rounded(sequences.adjacency_patterns(tables.raw_notes(spark, folder)), *ADJACENCY_NAMES)


@query(
    "q_core_features",
    f"SELECT beatmap_id, {_round_sql(features.CORE_FEATURES)} FROM core",
    extra=FEATURE_VIEWS,
)
def q_core_features(spark, folder):
    return rounded(features.chart_features(tables.raw_notes(spark, folder)), *features.CORE_FEATURES)


@query(
    "q_burst_features",
    f"""SELECT maps.beatmap_id, {', '.join(f'round(coalesce(CAST({n} AS DOUBLE), 0), 6) AS {n}' for n in features.feature_names('burst_metadata'))}
        FROM maps JOIN metadata_features USING (beatmap_id) LEFT JOIN core USING (beatmap_id) LEFT JOIN burst USING (beatmap_id)""",
    extra=FEATURE_VIEWS,
)
def q_burst_features(spark, folder):
    charts = tables.maps(spark, folder)
    result = features.chart_features(
        tables.raw_notes(spark, folder), feature_set="burst_metadata", charts=charts
    )
    return rounded(result, *features.feature_names("burst_metadata"))


@query(
    "q_metadata_features",
    f"SELECT beatmap_id, {_round_sql(features.METADATA_FEATURES)} FROM metadata_features",
    extra=FEATURE_VIEWS,
)
def q_metadata_features(spark, folder):
    return rounded(features.metadata_features(tables.maps(spark, folder)), *features.METADATA_FEATURES)


POOL = ["time_frac", "delta_sec", "col_frac", "is_ln", "ln_length_sec", "chord_frac"]


@query(
    "q_sequence_pooling",
    "SELECT beatmap_id, "
    + ", ".join(
        f"round(avg({n}), 6) AS mean_{o}, round(sqrt(greatest(var_pop({n}), 1e-8)), 6) AS std_{o}, round(max({n}), 6) AS max_{o}"
        for n, o in zip(POOL, [n if n != "is_ln" else "ln_flag" for n in POOL])
    )
    + ", round(ln(1 + count(*)) / 10, 6) AS note_count_log10th FROM note_features GROUP BY beatmap_id",
)
def q_sequence_pooling(spark, folder):
    pooled = features.pooled_sequence(tables.raw_notes(spark, folder))
    return rounded(pooled, *[name for name in pooled.columns if name != "beatmap_id"])


@query(
    "q_attention_rows",
    """SELECT beatmap_id, note_index, round(time_frac, 6) AS time_fraction, round(delta_sec, 6) AS time_delta_sec,
              CAST(round_even(col_frac * 3, 0) AS BIGINT) AS "column", round(col_frac, 6) AS column_fraction,
              CAST(round_even(is_ln, 0) AS BIGINT) AS is_ln, round(ln_length_sec, 6) AS ln_length_sec,
              round(chord_frac * 4, 6) AS chord_size FROM note_features""",
)
def q_attention_rows(spark, folder):
    notes = sequences.feature_sequence(tables.raw_notes(spark, folder), 4).rows()
    report = notes.select(
        "beatmap_id",
        "note_index",
        F.col("time_frac").alias("time_fraction"),
        F.col("delta_sec").alias("time_delta_sec"),
        F.rint(F.col("col_frac") * 3).cast("long").alias("column"),
        F.col("col_frac").alias("column_fraction"),
        F.rint("ln_flag").cast("long").alias("is_ln"),
        "ln_length_sec",
        (F.col("chord_frac") * 4).alias("chord_size"),
    )
    return rounded(report, "time_fraction", "time_delta_sec", "column_fraction", "ln_length_sec", "chord_size")


LABEL_SQL = ", ".join(
    f"round({name}, 9) AS {name}" for name in ["mean_acc", "acc_std", "skill_gap", "median_acc", "p10_acc", "p90_acc"]
)


@query(
    "q_accuracy_labels",
    f"SELECT beatmap_id, {LABEL_SQL}, score_count FROM chart_scores",
)
def q_accuracy_labels(spark, folder):
    result = labels.accuracy_labels(tables.scores(spark, folder))
    return rounded(result, *labels.LABEL_COLUMNS[:-1], digits=9)


@query(
    "q_score_labels",
    f"""SELECT beatmap_id, beatmapset_id, title, artist, mapper, version, length_ms, {LABEL_SQL}, score_count,
               'mania' AS score_mode, CAST(100 AS BIGINT) AS score_limit FROM maps JOIN board_scores USING (beatmap_id) WHERE score_count >= 30""",
    extra={"board_scores": VIEWS["chart_scores"].replace("FROM scores)", "FROM best_scores)"), "best_scores": """
        SELECT beatmap_id, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY beatmap_id ORDER BY accuracy DESC) AS place FROM scores) WHERE place <= 100"""},
)
def q_score_labels(spark, folder):
    """The leaderboard page of 100 scores and the least number of scores are this query's subject."""
    result = labels.score_labels(tables.scores(spark, folder), tables.maps(spark, folder), min_scores=30, limit=labels.SCORE_LIMIT)
    names = ["beatmap_id", "beatmapset_id", "title", "artist", "mapper", "version", "length_ms"]
    return rounded(
        result.select(*names, *labels.LABEL_COLUMNS, "score_mode", "score_limit"),
        *labels.LABEL_COLUMNS[:-1],
        digits=9,
    )


@query(
    "q_sample_weight",
    """SELECT beatmap_id, score_count,
              round(greatest(0.25, least(1.0, score_count / 100.0::DOUBLE)), 6) AS sample_weight FROM chart_labels""",
)
def q_sample_weight(spark, folder):
    rows = labels.score_labels(tables.scores(spark, folder), tables.maps(spark, folder))
    return rounded(
        rows.select("beatmap_id", "score_count", labels.sample_weight(F.col("score_count")).alias("sample_weight")),
        "sample_weight",
    )


@query(
    "q_sample_weight_summary",
    """SELECT count(*) AS sample_weight_count, round(avg(w), 6) AS sample_weight_mean, round(min(w), 6) AS sample_weight_min,
              round(max(w), 6) AS sample_weight_max, CAST(count_if(w < 1) AS BIGINT) AS sample_weight_downweighted_count,
              round(avg((w < 1)::INT), 6) AS sample_weight_downweighted_rate
       FROM (SELECT greatest(0.25, least(1.0, score_count / 32.0::DOUBLE)) AS w FROM chart_labels)""",
)
def q_sample_weight_summary(spark, folder):
    rows = labels.score_labels(tables.scores(spark, folder), tables.maps(spark, folder))
    summary = labels.sample_weight_summary(rows, "score_count", max_value=32.0)
    return rounded(
        summary, "sample_weight_mean", "sample_weight_min", "sample_weight_max", "sample_weight_downweighted_rate"
    )
