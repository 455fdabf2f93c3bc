"""Strain curve, pair generation and ranker queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainframe.catalog import registry
from strainframe.catalog.registry import query
from strainframe.operators import curves, judgments, pairgen, ranker, stages
from strainframe.session import cut_lineage
from strainframe.sources import tables


def rounded(frame, *names):
    return registry.rounded(frame, *names, digits=10)


CURVE_VIEWS = {
    "chart_dim": """
        SELECT beatmap_id, CASE WHEN length_ms > 0 THEN length_ms / 1000.0::DOUBLE ELSE 1.0 END AS length_sec,
               length_ms / 1000.0::DOUBLE AS stated_sec, keys, coalesce(overall_difficulty, 5.0::DOUBLE) AS od,
               title, artist, version FROM maps""",
    "timed": """
        SELECT notes.*, keys, od, length_sec, stated_sec,
               (time_ms / greatest(last_time_ms, 1)::DOUBLE) * length_sec AS time_sec,
               (last_time_ms / greatest(last_time_ms, 1)::DOUBLE) * length_sec AS last_sec,
               CAST(round_even(col / 3.0::DOUBLE * greatest(1, keys - 1), 0) AS INT) AS lane,
               greatest(1.0, round_even(chord_size / 4.0::DOUBLE * keys, 0)) AS chord,
               coalesce(time_ms - prev_time_ms, 0) AS gap_ms
        FROM notes JOIN chart_dim USING (beatmap_id)""",
    "flagged": """
        SELECT *, coalesce(back > 0 AND back <= 0.22::DOUBLE, false) AS is_jack, gap_ms > 0 AND gap_ms <= 120 AS is_burst
        FROM (SELECT *, time_sec - lag(time_sec) OVER (PARTITION BY beatmap_id, lane ORDER BY note_index) AS back FROM timed)""",
    "durations": """
        SELECT beatmap_id, max(greatest(last_sec, stated_sec, 2.0::DOUBLE)) AS duration_sec, max(od) AS od FROM flagged GROUP BY beatmap_id""",
    "grid": """
        SELECT beatmap_id, od, duration_sec, i AS window_index, i * 0.5::DOUBLE AS start_sec, i * 0.5::DOUBLE + 2.0::DOUBLE AS end_sec
        FROM (SELECT *, unnest(range(CASE WHEN duration_sec <= 2 THEN 1
                     ELSE CAST(ceil((duration_sec - 2.0::DOUBLE + 0.5::DOUBLE) / 0.5::DOUBLE) AS BIGINT) END)) AS i FROM durations)""",
    "window_sums": """
        SELECT g.beatmap_id, g.window_index, g.start_sec, g.end_sec, g.od, count(f.note_index) AS note_count,
               count(f.note_index) / 2.0::DOUBLE AS note_density,
               count(f.note_index) FILTER (WHERE f.is_ln = 0) / 2.0::DOUBLE AS rice_density,
               count(f.note_index) FILTER (WHERE f.is_burst) / 2.0::DOUBLE AS burst_density,
               count(f.note_index) FILTER (WHERE f.is_jack) / 2.0::DOUBLE AS jack_density,
               coalesce(sum(f.chord - 1), 0)::DOUBLE / 2.0::DOUBLE AS chord_load,
               count(f.note_index) FILTER (WHERE f.is_ln = 1) / 2.0::DOUBLE AS ln_density,
               coalesce(sum(f.ln_length_ms), 0)::DOUBLE / 1000.0::DOUBLE / 2.0::DOUBLE AS ln_load,
               1.0::DOUBLE + greatest(0, g.od - 5.0::DOUBLE) / 20.0::DOUBLE AS od_multiplier
        FROM grid g LEFT JOIN flagged f ON f.beatmap_id = g.beatmap_id AND f.time_sec >= g.start_sec AND f.time_sec < g.end_sec
        GROUP BY ALL""",
    "pressed": """
        SELECT *, greatest(0, note_density - 1) * 0.35::DOUBLE + chord_load * 0.25::DOUBLE AS reading_pressure,
               rice_density * 0.35::DOUBLE + burst_density * 0.90::DOUBLE AS speed_pressure,
               note_density * 0.25::DOUBLE + ln_load * 0.15::DOUBLE AS stamina_pressure, jack_density * 1.30::DOUBLE AS jack_pressure,
               chord_load * 1.10::DOUBLE AS chord_pressure, ln_density * 0.55::DOUBLE + ln_load * 0.45::DOUBLE AS ln_pressure
        FROM window_sums""",
    "curve": """
        SELECT *, (reading_pressure + speed_pressure + stamina_pressure + jack_pressure + chord_pressure + ln_pressure
                   + accuracy_pressure) * od_multiplier AS feel_strain
        FROM (SELECT *, speed_pressure * 0.35::DOUBLE + chord_pressure * 0.25::DOUBLE + ln_pressure * 0.20::DOUBLE
                        + greatest(0, od - 5.0::DOUBLE) * 0.10::DOUBLE AS accuracy_pressure FROM pressed)""",
    "summary_values": """
        SELECT beatmap_id, max(feel_strain) AS peak_strain, avg(feel_strain) AS mean_strain,
               quantile_cont(feel_strain, 0.9) AS p90_strain, sum(feel_strain) AS fatigue_area,
               arg_min(start_sec, start_sec) FILTER (WHERE is_peak) AS peak_time_sec,
               quantile_cont(reading_pressure, 0.9) AS reading_score, quantile_cont(speed_pressure, 0.9) AS speed_score,
               quantile_cont(rice_density, 0.9) AS rice_score, max(jack_density) AS jack_score,
               quantile_cont(chord_load, 0.9) AS chord_score, quantile_cont(ln_load + ln_density, 0.9) AS ln_score,
               avg(feel_strain) AS stamina_score, quantile_cont(feel_strain * od_multiplier, 0.9) AS accuracy_score,
               quantile_cont(reading_pressure, 0.9) AS reading_pressure, quantile_cont(speed_pressure, 0.9) AS speed_pressure,
               quantile_cont(stamina_pressure, 0.9) AS stamina_pressure, quantile_cont(jack_pressure, 0.9) AS jack_pressure,
               quantile_cont(chord_pressure, 0.9) AS chord_pressure, quantile_cont(ln_pressure, 0.9) AS ln_pressure,
               quantile_cont(accuracy_pressure, 0.9) AS accuracy_pressure
        FROM (SELECT *, feel_strain = max(feel_strain) OVER (PARTITION BY beatmap_id) AS is_peak FROM curve)
        GROUP BY beatmap_id""",
    "feel_summary": """
        SELECT summary_values.*, title, artist, version, keys,
               CASE greatest(reading_score, speed_score, jack_score, chord_score, ln_score)
                    WHEN reading_score THEN 'reading' WHEN speed_score THEN 'speed' WHEN jack_score THEN 'jack'
                    WHEN chord_score THEN 'chord' ELSE 'ln' END AS dominant_skill
        FROM summary_values JOIN chart_dim USING (beatmap_id)""",
    "segments": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY beatmap_id ORDER BY feel_strain DESC, start_sec) AS place,
               CASE greatest(reading_pressure, speed_pressure, jack_pressure, chord_pressure, ln_pressure)
                    WHEN reading_pressure THEN 'reading' WHEN speed_pressure THEN 'speed' WHEN jack_pressure THEN 'jack'
                    WHEN chord_pressure THEN 'chord' ELSE 'ln' END AS dominant_skill FROM curve) WHERE place <= 2""",
}


def _curve(spark, folder):
    return curves.feel_curve(tables.raw_notes(spark, folder), tables.maps(spark, folder))


def _summary(spark, folder, curve=None):
    return curves.curve_summary(curve or _curve(spark, folder), tables.maps(spark, folder))


def _r(names, digits=10):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query(
    "q_event_times",
    "SELECT beatmap_id, note_index, round(time_sec, 10) AS time_sec, lane FROM timed",
    extra=CURVE_VIEWS,
)
def q_event_times(spark, folder):
    notes = curves.timed_notes(tables.raw_notes(spark, folder), tables.maps(spark, folder)).rows()
    return rounded(notes.select("beatmap_id", "note_index", "time_sec", "lane"), "time_sec")


@query(
    "q_feel_windows",
    """SELECT beatmap_id, window_index, start_sec, end_sec FROM (
         SELECT beatmap_id, i AS window_index, i * 0.5::DOUBLE AS start_sec, i * 0.5::DOUBLE + 2.0::DOUBLE AS end_sec
         FROM (SELECT beatmap_id, unnest(range(CASE WHEN length_ms <= 2000 THEN 1
               ELSE CAST(ceil((length_ms - 1500) / 500.0::DOUBLE) AS BIGINT) END)) AS i FROM maps))""",
)
def q_feel_windows(spark, folder):
    durations = tables.maps(spark, folder).select("beatmap_id", (F.col("length_ms") / 1000.0).alias("duration_sec"))
    return curves.window_grid(durations, 2.0, 0.5).drop("duration_sec")


VALUES = [*curves.DENSITIES, "od_multiplier", *curves.PRESSURES, "feel_strain"]


@query(
    "q_feel_curve",
    f"SELECT beatmap_id, window_index, start_sec, end_sec, note_count, {_r(VALUES)} FROM curve",
    extra=CURVE_VIEWS,
)
def q_feel_curve(spark, folder):
    return rounded(_curve(spark, folder), *VALUES)


SUMMARY_VALUES = ["peak_strain", "mean_strain", "p90_strain", "fatigue_area", *[f"{n}_score" for n in curves.SCORES], *curves.PRESSURES]


@query(
    "q_curve_summary",
    f"SELECT beatmap_id, title, artist, version, keys, peak_time_sec, dominant_skill, {_r(SUMMARY_VALUES)} FROM feel_summary",
    extra=CURVE_VIEWS,
)
def q_curve_summary(spark, folder):
    return rounded(_summary(spark, folder), *SUMMARY_VALUES)


@query(
    "q_top_segments",
    "SELECT beatmap_id, start_sec, end_sec, dominant_skill, round(feel_strain, 10) AS feel_strain FROM segments",
    extra=CURVE_VIEWS,
)
def q_top_segments(spark, folder):
    rows = curves.top_segments(_curve(spark, folder)).withColumn("dominant_skill", curves.segment_skill())
    return rounded(rows.select("beatmap_id", "start_sec", "end_sec", "dominant_skill", "feel_strain"), "feel_strain")


@query(
    "q_top_curves",
    """SELECT beatmap_id, window_index, round(feel_strain, 10) AS feel_strain FROM curve
       WHERE beatmap_id IN (SELECT beatmap_id FROM feel_summary ORDER BY peak_strain DESC, beatmap_id LIMIT 12)""",
    extra=CURVE_VIEWS,
)
def q_top_curves(spark, folder):
    curve, summary = _sides(spark, folder)
    rows = curves.top_curves(curve, summary)
    return rounded(rows.select("beatmap_id", "window_index", "feel_strain"), "feel_strain")


PAIR_VIEWS = {
    **CURVE_VIEWS,
    "map_sides": """
        SELECT *, row_number() OVER (ORDER BY peak_strain, beatmap_id) AS place,
               lag(beatmap_id) OVER w AS l_id, lag(peak_strain) OVER w AS l_peak, lag(dominant_skill) OVER w AS l_skill
        FROM feel_summary WINDOW w AS (ORDER BY peak_strain, beatmap_id)""",
    "map_pairs": """
        SELECT *, row_number() OVER (ORDER BY abs(l_peak - peak_strain), (l_skill = dominant_skill)::INT, place) - 1 AS number
        FROM map_sides WHERE l_id IS NOT NULL""",
    "segment_sides": """
        SELECT *, row_number() OVER w AS rn, lag(beatmap_id) OVER w AS l_id, lag(feel_strain) OVER w AS l_peak,
               lag(dominant_skill) OVER w AS l_skill, lag(start_sec) OVER w AS l_start, lag(end_sec) OVER w AS l_end
        FROM segments WINDOW w AS (ORDER BY feel_strain, beatmap_id, start_sec)""",
    "segment_pairs": """
        SELECT *, row_number() OVER (ORDER BY abs(l_peak - feel_strain), rn) - 1 AS number
        FROM segment_sides WHERE l_id IS NOT NULL""",
}


def _sides(spark, folder):
    curve = cut_lineage(_curve(spark, folder))
    return curve, _summary(spark, folder, curve)


@query(
    "q_map_pairs",
    """SELECT number, l_id AS left_id, beatmap_id AS right_id, round(l_peak, 10) AS left_peak, round(peak_strain, 10) AS right_peak,
              l_skill AS left_skill, dominant_skill AS right_skill FROM map_pairs WHERE number < 80""",
    extra=PAIR_VIEWS,
)
def q_map_pairs(spark, folder):
    rows = pairgen.map_pairs(cut_lineage(_summary(spark, folder)), 80)
    side = lambda s: [F.col(f"{s}.beatmap_id").alias(f"{s}_id"), F.col(f"{s}.peak_strain").alias(f"{s}_peak"), F.col(f"{s}.dominant_skill").alias(f"{s}_skill")]
    return rounded(rows.select("number", *side("left"), *side("right")), "left_peak", "right_peak")


@query(
    "q_segment_pairs",
    """SELECT number, l_id AS left_id, beatmap_id AS right_id, l_start AS left_start, start_sec AS right_start,
              round(l_peak, 10) AS left_peak, round(feel_strain, 10) AS right_peak FROM segment_pairs WHERE number < 80""",
    extra=PAIR_VIEWS,
)
def q_segment_pairs(spark, folder):
    rows = pairgen.segment_pairs(cut_lineage(_curve(spark, folder)), tables.maps(spark, folder), 80)
    side = lambda s: [F.col(f"{s}.beatmap_id").alias(f"{s}_id"), F.col(f"{s}.start_sec").alias(f"{s}_start"), F.col(f"{s}.peak_strain").alias(f"{s}_peak")]
    return rounded(rows.select("number", *side("left"), *side("right")), "left_peak", "right_peak")


@query(
    "q_pair_candidates",
    """SELECT scope || '_' || stage || '_' || printf('%04d', number) AS pair_id, scope, stage AS player_stage,
              CASE WHEN number % 2 = 1 THEN r_id ELSE l_id END AS a_beatmap_id, CASE WHEN number % 2 = 1 THEN l_id ELSE r_id END AS b_beatmap_id,
              CASE WHEN number % 2 = 1 THEN r_start ELSE l_start END AS a_start_sec,
              round(CASE WHEN number % 2 = 1 THEN r_peak ELSE l_peak END, 10) AS a_peak_strain,
              CASE WHEN number % 2 = 1 THEN l_skill ELSE r_skill END AS b_dominant_skill,
              CASE WHEN number % 2 = 1 THEN ml.title ELSE mr.title END AS b_title, '' AS harder_choice
       FROM (SELECT *, (['readless_beginner', 'beginner', 'novice', 'intermediate', 'advanced', 'dan_ready'])[CAST((turn - 1) % 6 + 1 AS INT)] AS stage
             FROM (SELECT *, row_number() OVER (ORDER BY scope, number) AS turn FROM (
                 SELECT 'map' AS scope, number, l_id, beatmap_id AS r_id, l_peak, peak_strain AS r_peak, l_skill, dominant_skill AS r_skill,
                        NULL::DOUBLE AS l_start, NULL::DOUBLE AS r_start FROM map_pairs
                 UNION ALL
                 SELECT 'segment', number, l_id, beatmap_id, l_peak, feel_strain, l_skill, dominant_skill, l_start, start_sec FROM segment_pairs))
             WHERE turn <= 200) JOIN maps ml ON ml.beatmap_id = l_id JOIN maps mr ON mr.beatmap_id = r_id""",
    extra=PAIR_VIEWS,
)
def q_pair_candidates(spark, folder):
    curve, summary = _sides(spark, folder)
    ids = [row[0] for row in stages.DEFAULT_STAGES]
    rows = pairgen.pair_candidates(summary, curve, tables.maps(spark, folder), ids, max_pairs=200)
    names = ["pair_id", "scope", "player_stage", "a_beatmap_id", "b_beatmap_id", "a_start_sec", "a_peak_strain", "b_dominant_skill", "b_title", "harder_choice"]
    return rounded(rows.select(*names), "a_peak_strain")


ABILITY_LIST = ", ".join(stages.ABILITIES)


@query("q_stage_dim", f"SELECT stage_id, {', '.join(f'{n}::DOUBLE AS {n}' for n in stages.ABILITIES)}, pair_rows FROM stages "
       "LEFT JOIN (SELECT player_stage AS stage_id, count(*) AS pair_rows FROM pairs GROUP BY 1) USING (stage_id)")
def q_stage_dim(spark, folder):
    used = tables.pairs(spark, folder).groupBy(F.col("player_stage").alias("stage_id")).agg(F.count(F.lit(1)).alias("pair_rows"))
    return stages.validated_stages(stages.default_stages(spark)).join(used, "stage_id", "left")


def _loose_stages(spark, folder):
    """Customers as a stage table with every kind of mistake."""
    key, share = F.col("c_custkey"), F.col("c_acctbal") / 8000
    text = lambda shift: F.when((key + shift) % 31 == 0, "high").otherwise(F.format_string("%.4f", F.abs(share) * (1 + shift / 40)))
    return tables.table(spark, folder, "customer").select(
        F.when(key % 41 == 0, " ").when(key % 37 == 0, "shared").otherwise(F.col("c_name")).alias("stage_id"),
        *[text(shift).alias(name) for shift, name in enumerate(stages.ABILITIES)],
    )


@query(
    "q_stage_validate",
    """SELECT "column", problem, count(*) AS violations FROM (
         SELECT 'stage_id' AS "column", 'empty' AS problem FROM loose WHERE trim(stage_id) = ''
         UNION ALL SELECT 'stage_id', 'duplicate' FROM (SELECT stage_id FROM loose GROUP BY stage_id HAVING count(*) > 1)
         UNION ALL SELECT ability, CASE WHEN TRY_CAST(value AS DOUBLE) IS NULL THEN 'not a number' ELSE 'outside 0..1' END
         FROM (UNPIVOT loose ON """ + ABILITY_LIST + """ INTO NAME ability VALUE value)
         WHERE TRY_CAST(value AS DOUBLE) IS NULL OR TRY_CAST(value AS DOUBLE) NOT BETWEEN 0 AND 1) GROUP BY ALL""",
    extra={
        "loose": "SELECT CASE WHEN c_custkey % 41 = 0 THEN ' ' WHEN c_custkey % 37 = 0 THEN 'shared' ELSE c_name END AS stage_id, "
        + ", ".join(
            f"CASE WHEN (c_custkey + {i}) % 31 = 0 THEN 'high' ELSE printf('%.4f', abs(c_acctbal / 8000) * {1 + i / 40}::DOUBLE) END AS {n}"
            for i, n in enumerate(stages.ABILITIES)
        )
        + " FROM customer"
    },
)
def q_stage_validate(spark, folder):
    found = stages.stage_violations(_loose_stages(spark, folder))
    return found.groupBy("column", "problem").agg(F.count(F.lit(1)).alias("violations"))


def _judged_sides(spark, folder):
    rows = tables.pairs(spark, folder)
    return rows.withColumns(
        {f"{side}_{edge}": F.col(edge) for side in ("a", "b") for edge in ("start_sec", "end_sec")}
    )


SEGMENT_VIEWS = {
    **CURVE_VIEWS,
    "usable": """
        SELECT * FROM (
            SELECT *, CASE WHEN harder_choice = 'A' THEN 'a' WHEN harder_choice = 'right' THEN 'b' END AS normalized_harder_choice,
                   coalesce(greatest(0.0, least(TRY_CAST(nullif(trim(confidence), '') AS DOUBLE), 5.0)), 1.0) AS sample_weight FROM pairs)
        WHERE normalized_harder_choice IS NOT NULL AND sample_weight > 0""",
    "wanted": """
        SELECT DISTINCT * FROM (SELECT a_beatmap_id AS beatmap_id, start_sec, end_sec FROM pairs
                                UNION ALL SELECT b_beatmap_id, start_sec, end_sec FROM pairs)""",
    "segment_stats": """
        SELECT w.beatmap_id, w.start_sec, w.end_sec, max(feel_strain) AS peak_strain, avg(feel_strain) AS mean_strain,
               quantile_cont(feel_strain, 0.9) AS p90_strain, sum(feel_strain) AS fatigue_area, """
    + ", ".join(f"quantile_cont({n}, 0.9) AS {n}" for n in curves.PRESSURES)
    + """ FROM wanted w JOIN curve c ON c.beatmap_id = w.beatmap_id AND c.start_sec >= w.start_sec AND c.end_sec <= w.end_sec
        GROUP BY ALL""",
    "facts": "SELECT w.beatmap_id, w.start_sec, w.end_sec, "
    + ", ".join(f"coalesce(s.{n}, f.{n}) AS {n}" for n in [*ranker.STRAINS, *curves.PRESSURES])
    + ", "
    + ", ".join(f"f.{n}_score" for n in curves.SCORES)
    + """ FROM wanted w JOIN feel_summary f USING (beatmap_id)
        LEFT JOIN segment_stats s ON s.beatmap_id = w.beatmap_id AND s.start_sec = w.start_sec AND s.end_sec = w.end_sec""",
}


@query(
    "q_segment_summary",
    f"SELECT beatmap_id, start_sec, end_sec, {_r(ranker.SUMMARY_FEATURES)} FROM facts",
    extra=SEGMENT_VIEWS,
)
def q_segment_summary(spark, folder):
    curve, summary = _sides(spark, folder)
    rows = tables.pairs(spark, folder)
    stacked = rows.select(F.col("a_beatmap_id").alias("beatmap_id"), "start_sec", "end_sec").unionByName(
        rows.select(F.col("b_beatmap_id").alias("beatmap_id"), "start_sec", "end_sec")
    )
    return rounded(ranker.segment_summary(stacked, curve, summary), *ranker.SUMMARY_FEATURES)


def _pair_sql():
    terms = [f"a.{n} - b.{n} AS raw_{n}" for n in ranker.SUMMARY_FEATURES] + [f"0.0::DOUBLE AS ability_{n}" for n in stages.ABILITIES]
    stage = {f"stage_{n}": f"(a.{n} - b.{n}) * (1 - s.{n.removesuffix('_pressure')}::DOUBLE)" for n in curves.PRESSURES}
    stage["stage_pattern_memory_pressure"] = "(a.peak_strain - b.peak_strain) * (1 - s.pattern_memory::DOUBLE)"
    stage["stage_total_pressure"] = " + ".join(stage.values())
    terms += [f"{value} AS {name}" for name, value in stage.items()]
    return f"""
    SELECT u.pair_id, normalized_harder_choice, sample_weight, CASE WHEN normalized_harder_choice = 'a' THEN 1 ELSE 0 END AS target, {', '.join(terms)}
    FROM usable u JOIN stages s ON s.stage_id = u.player_stage
    JOIN facts a ON a.beatmap_id = u.a_beatmap_id AND a.start_sec IS NOT DISTINCT FROM u.start_sec AND a.end_sec IS NOT DISTINCT FROM u.end_sec
    JOIN facts b ON b.beatmap_id = u.b_beatmap_id AND b.start_sec IS NOT DISTINCT FROM u.start_sec AND b.end_sec IS NOT DISTINCT FROM u.end_sec"""


def _pair_features(spark, folder):
    curve, summary = _sides(spark, folder)
    return ranker.pair_features(_judged_sides(spark, folder), summary, curve, stages.default_stages(spark))


@query(
    "q_pair_features",
    f"SELECT pair_id, normalized_harder_choice, sample_weight, target, {', '.join(f'round({n}, 10) + 0.0 AS {n}' for n in ranker.PAIR_FEATURES)} FROM pair_rows",
    extra={**SEGMENT_VIEWS, "pair_rows": _pair_sql()},
)
def q_pair_features(spark, folder):
    rows = _pair_features(spark, folder)
    return rows.withColumns({n: F.round(n, 10) + F.lit(0.0) for n in ranker.PAIR_FEATURES})


RANKER_SAMPLE_SQL = f"""
    SELECT pair_id, is_train, target, sample_weight, {", ".join(f"round((d.{n} - avg(d.{n}) FILTER (is_train) OVER ()) / CASE WHEN stddev_pop(d.{n}) FILTER (is_train) OVER () > 1e-12 THEN stddev_pop(d.{n}) FILTER (is_train) OVER () ELSE 1 END, 5) + 0.0 AS z_{n}" for n in ranker.PAIR_FEATURES)}
    FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5('42|' || pair_id), pair_id) - 1 >= round_even(count(*) OVER (PARTITION BY target) * 0.25::DOUBLE, 0)
                 OR count(*) OVER () < 4 AS is_train FROM pair_rows) d"""


@query("q_pair_ranker_sample", RANKER_SAMPLE_SQL, extra={**SEGMENT_VIEWS, "pair_rows": _pair_sql()})
def q_pair_ranker_sample(spark, folder):
    """What the ranker is fitted on: hold-out flags and the features scaled by the train rows."""
    rows = cut_lineage(ranker.holdout_flags(_pair_features(spark, folder), test_size=0.25, seed=42))
    scaled = [(F.round(F.col("z")[place], 5) + F.lit(0.0)).alias(f"z_{n}") for place, n in enumerate(ranker.PAIR_FEATURES)]
    return ranker.standardised_features(rows).select("pair_id", "is_train", "target", "sample_weight", *scaled)


@query("q_pair_ranker")
def q_pair_ranker(spark, folder):
    return ranker.fit_ranker(_pair_features(spark, folder))[0]


@query("q_pair_ranker_metrics")
def q_pair_ranker_metrics(spark, folder):
    return ranker.fit_ranker(_pair_features(spark, folder))[1]


@query("q_pair_ranker_coefficients")
def q_pair_ranker_coefficients(spark, folder):
    return ranker.fit_ranker(_pair_features(spark, folder))[2]
