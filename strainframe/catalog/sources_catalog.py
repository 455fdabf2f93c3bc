"""Landing and audit queries. The raw texts and JSON are derived from the tables row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainframe.catalog.metrics_catalog import chart_labels, stored_labels
from strainframe.catalog.registry import query, rounded
from strainframe.operators import audit, sequences
from strainframe.plans.ordered import OrderedRuns
from strainframe.session import cut_lineage, scratch_path
from strainframe.sources import chart_text, files, landed_json, tables


def chart_texts(spark, folder):
    """One text per part: header lines from its metadata, p_size + 5 hit objects from arithmetic."""
    rows = tables.maps(spark, folder).repartition("beatmap_id")
    key = F.col("beatmap_id")
    hit = lambda i: F.concat_ws(
        ",",
        F.concat(((key * 37 + i * 53) % 512).cast("string"), F.when(i % 3 == 0, ".9").otherwise("")),
        F.lit("192"),
        (F.floor(i / 2) * 150 + key % 7).cast("string"),
        F.when(i % 7 == 3, "bad").when(i % 5 == 0, "128").otherwise("1"),
        F.when(i % 11 == 4, None).otherwise("0"),
        F.when(i % 11 == 4, None)
        .when(i % 13 == 0, "x:0")
        .otherwise(F.concat((F.floor(i / 2) * 150 + key % 7 + 40 * (i % 9) - 80).cast("string"), F.lit(":0:0:0:0:"))),
    )
    objects = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("length_ms") / 1000 + 4).cast("int")), hit), "\r\n")
    line = lambda name, value: F.concat(F.lit(f"{name}:"), value.cast("string"))
    od = F.when(F.col("overall_difficulty").isNull(), "OverallDifficulty: n/a").otherwise(
        line("OverallDifficulty", F.col("overall_difficulty") + F.when(key % 8 == 0, 0.5).otherwise(0.0))
    )
    text = F.concat_ws(
        "\n",
        F.lit("\ufeffosu file format v14\r"),
        F.lit("Mode: 9"),
        F.lit("[General]"),
        F.lit("// Mode: 7"),
        F.lit("Mode: 1"),
        F.concat(F.lit("  Mode : "), F.col("mode").cast("string"), F.lit("  ")),
        F.lit(""),
        F.lit("[Difficulty]"),
        line("HPDrainRate", F.col("hp_drain_rate")),
        line("CircleSize", F.col("keys")),
        od,
        line("ApproachRate", F.col("approach_rate")),
        F.lit("no separator here"),
        F.lit(" [HitObjects] "),
        F.lit("// 1,2,3,4,5"),
        objects,
        F.lit("[Colours]"),
        F.lit("1,2,3,1,0"),
    )
    return rows.select("beatmap_id", text.alias("text"))


def chart_line_rows(spark, folder):
    return chart_text.chart_lines(chart_texts(spark, folder))


TEXT_VIEWS = {
    "objects": """
        SELECT beatmap_id, i, (beatmap_id * 37 + i * 53) % 512 AS x, (i // 2) * 150 + beatmap_id % 7 AS time_ms,
               CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS is_ln,
               CASE WHEN i % 5 = 0 AND i % 13 <> 0 THEN greatest(0, 40 * (i % 9) - 80) ELSE 0 END AS ln_length_ms
        FROM (SELECT beatmap_id, unnest(range(0, length_ms // 1000 + 5)) AS i FROM maps)""",
    "kept_objects": """
        SELECT *, CAST(greatest(0, least(3, floor(x * 4 / 512.0::DOUBLE))) AS INT) AS col
        FROM objects WHERE i % 7 <> 3 AND i % 11 <> 4""",
    "chart_meta": """
        SELECT beatmap_id, mode::DOUBLE AS mode, keys::DOUBLE AS circle_size, keys::DOUBLE AS keys, hp_drain_rate,
               overall_difficulty + CASE WHEN beatmap_id % 8 = 0 THEN 0.5::DOUBLE ELSE 0 END AS overall_difficulty, approach_rate
        FROM maps""",
    "text_lines": """
         SELECT beatmap_id, 0 AS place, 0 AS i, '' AS section, 'osu file format v14' AS line FROM maps
         UNION ALL SELECT beatmap_id, 1, 0, '', 'Mode: 9' FROM maps
         UNION ALL SELECT beatmap_id, 2, 0, 'General', 'Mode: 1' FROM maps
         UNION ALL SELECT beatmap_id, 3, 0, 'General', 'Mode : ' || mode FROM maps
         UNION ALL SELECT beatmap_id, 4, 0, 'Difficulty', 'HPDrainRate:' || hp_drain_rate FROM maps
         UNION ALL SELECT beatmap_id, 5, 0, 'Difficulty', 'CircleSize:' || keys FROM maps
         UNION ALL SELECT beatmap_id, 6, 0, 'Difficulty', CASE WHEN overall_difficulty IS NULL THEN 'OverallDifficulty: n/a'
                   ELSE 'OverallDifficulty:' || (overall_difficulty + CASE WHEN beatmap_id % 8 = 0 THEN 0.5::DOUBLE ELSE 0 END) END FROM maps
         UNION ALL SELECT beatmap_id, 7, 0, 'Difficulty', 'ApproachRate:' || approach_rate FROM maps
         UNION ALL SELECT beatmap_id, 8, 0, 'Difficulty', 'no separator here' FROM maps
         UNION ALL SELECT beatmap_id, 9, i, 'HitObjects', concat_ws(',', x || CASE WHEN i % 3 = 0 THEN '.9' ELSE '' END, '192', CAST(time_ms AS BIGINT),
                   CASE WHEN i % 7 = 3 THEN 'bad' WHEN i % 5 = 0 THEN '128' ELSE '1' END, CASE WHEN i % 11 <> 4 THEN '0' END,
                   CASE WHEN i % 11 = 4 THEN NULL WHEN i % 13 = 0 THEN 'x:0' ELSE CAST(time_ms + 40 * (i % 9) - 80 AS BIGINT) || ':0:0:0:0:' END) FROM objects
         UNION ALL SELECT beatmap_id, 10, 0, 'Colours', '1,2,3,1,0' FROM maps""",
}


@query(
    "q_chart_lines",
    "SELECT beatmap_id, section, line, row_number() OVER (PARTITION BY beatmap_id ORDER BY place, i) - 1 AS line_no FROM text_lines",
    extra=TEXT_VIEWS,
)
def q_chart_lines(spark, folder):
    """Every kept line of every chart with its section and number."""
    lines = chart_line_rows(spark, folder)
    runs = OrderedRuns.build(lines, ["beatmap_id"], ["line_order"]).indexed("line_no")
    return runs.rows().select("beatmap_id", "section", "line", "line_no")


@query(
    "q_chart_files",
    """SELECT beatmap_id, section, line, row_number() OVER (PARTITION BY beatmap_id ORDER BY place, i) - 1 AS line_no FROM (
         SELECT beatmap_id, place, i, section, line FROM text_lines
         UNION ALL SELECT beatmap_id, 11, 0, 'Metadata', 'Title:' || title || chr(65533) || '(' || chr(65533) || 'x' FROM maps)""",
    extra=TEXT_VIEWS,
)
def q_chart_files(spark, folder):
    """Every kept line of every chart, read from a file a chart with broken bytes in its title."""
    texts = chart_texts(spark, folder).join(tables.maps(spark, folder).select("beatmap_id", "title"), "beatmap_id")
    # A lone high byte, then a three-byte character cut short.
    broken = [F.unhex(F.lit(code)) for code in ("FF", "28E282", "78")]
    content = F.concat(F.concat("text", F.lit("\n[Metadata]\nTitle:"), "title").cast("binary"), *broken)
    path = scratch_path(spark)
    chart_text.write_charts(texts.select("beatmap_id", content.alias("content")), path)
    lines = chart_text.chart_lines(cut_lineage(chart_text.read_charts(spark, path)))  # counted and numbered below
    runs = OrderedRuns.build(lines, ["beatmap_id"], ["line_order"]).indexed("line_no")
    return runs.rows().select("beatmap_id", "section", "line", "line_no")


@query(
    "q_parse_hitobjects",
    "SELECT beatmap_id, time_ms, col, is_ln, ln_length_ms FROM kept_objects",
    extra=TEXT_VIEWS,
)
def q_parse_hitobjects(spark, folder):
    notes = chart_text.hit_objects(chart_line_rows(spark, folder))
    return notes.select("beatmap_id", "time_ms", "col", "is_ln", "ln_length_ms")


@query(
    "q_parsed_charts",
    """SELECT beatmap_id, row_number() OVER (PARTITION BY beatmap_id ORDER BY time_ms, col, i) - 1 AS note_index, time_ms, col, is_ln,
              ln_length_ms, count(*) OVER (PARTITION BY beatmap_id, time_ms) AS chord_size FROM kept_objects""",
    extra=TEXT_VIEWS,
)
def q_parsed_charts(spark, folder):
    # The parsed notes are stored once, then sized and sorted.
    notes = sequences.parsed_notes(cut_lineage(chart_text.hit_objects(chart_line_rows(spark, folder))))
    return notes.select("beatmap_id", "note_index", "time_ms", "col", "is_ln", "ln_length_ms", "chord_size")


META = ["mode", "circle_size", "keys", "hp_drain_rate", "overall_difficulty", "approach_rate"]
META_SQL = ", ".join(f"round({n}, 9) AS {n}" for n in META)


@query("q_chart_metadata", f"SELECT beatmap_id, {META_SQL} FROM chart_meta", extra=TEXT_VIEWS)
def q_chart_metadata(spark, folder):
    return rounded(chart_text.chart_metadata(chart_texts(spark, folder)).select("beatmap_id", *META), *META, digits=9)


@query(
    "q_enrich_metadata",
    f"""SELECT every.beatmap_id, title, bpm, {META_SQL.replace('round(', 'round(m.')} FROM (
            SELECT beatmap_id, title, bpm FROM maps UNION ALL SELECT beatmap_id + 1000000, title, bpm FROM maps) every
        LEFT JOIN chart_meta m USING (beatmap_id)""",
    extra=TEXT_VIEWS,
)
def q_enrich_metadata(spark, folder):
    metadata = chart_text.chart_metadata(chart_texts(spark, folder))
    known = tables.maps(spark, folder)
    unknown = known.withColumn("beatmap_id", F.col("beatmap_id") + UNKNOWN)
    rows = audit.enriched(known.unionByName(unknown), metadata)
    return rounded(rows.select("beatmap_id", "title", "bpm", *META), *META, digits=9)


# --- landed JSON ------------------------------------------------------------

PAGE_SIZE = 50


def search_pages(spark, folder):
    """Pages of 50 consecutive charts, sets by mapper; each tenth chart is repeated on the next page."""
    rows = tables.maps(spark, folder)
    key = F.col("beatmap_id")
    page = F.floor(key / PAGE_SIZE)
    placed = rows.withColumn("page_no", F.explode(F.when(key % 10 == 0, F.array(page, page + 1)).otherwise(F.array(page))))
    chart = F.struct(
        key.alias("id"),
        F.when(key % 3 == 0, "mania").when(key % 6 == 1, F.col("mode").cast("string")).when(key % 6 == 4, F.concat(F.lit("n:"), "mode")).alias("mode"),
        F.col("mode").alias("mode_int"),
        F.when(key % 4 == 0, "ranked").when(key % 4 == 1, "graveyard").when(key % 4 == 2, "").alias("status"),
        F.when(key % 5 == 0, 0).otherwise(1).alias("ranked"),
        F.when(key % 17 == 0, "four").when(key % 13 == 0, "4.9").otherwise(F.col("keys").cast("string")).alias("cs"),
        F.col("version"),
        (F.col("length_ms") / 1000 + 0.75).alias("total_length"),
        F.when(key % 6 == 0, 0.0).when(key % 6 != 1, F.col("bpm")).alias("bpm"),
        F.col("difficulty_rating"),
        F.col("hp_drain_rate").alias("drain"),
        F.col("overall_difficulty").alias("accuracy"),
        F.col("approach_rate").alias("ar"),
    )
    # A page has 50 charts and the repeats of five, so both lists are bounded.
    sets = placed.groupBy("page_no", "beatmapset_id").agg(F.sort_array(F.collect_list(chart)).alias("beatmaps"))
    entry = F.struct(
        F.col("beatmapset_id").alias("id"),
        F.concat(F.lit("Set "), "beatmapset_id").alias("title"),
        F.lit("artist").alias("artist"),
        F.col("beatmapset_id").alias("creator"),
        F.lit(177.5).alias("bpm"),
        F.col("beatmaps"),
    )
    pages = sets.groupBy("page_no").agg(F.sort_array(F.collect_list(entry)).alias("beatmapsets"))
    # Some modes are numbers, others text of digits.
    return pages.select("page_no", F.regexp_replace(F.to_json(F.struct("beatmapsets")), '"n:([0-9]+)"', "$1").alias("page"))


PAGE_VIEWS = {
    "listed": """
        SELECT *, unnest(CASE WHEN beatmap_id % 10 = 0 THEN [beatmap_id // 50, beatmap_id // 50 + 1] ELSE [beatmap_id // 50] END) AS page_no,
               CASE WHEN beatmap_id % 3 = 0 THEN true ELSE mode = 3 AND beatmap_id % 6 <> 1 END AS mode_ok,
               CASE beatmap_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE beatmap_id % 5 <> 0 END AS status_ok,
               CASE WHEN beatmap_id % 17 = 0 THEN NULL WHEN beatmap_id % 13 = 0 THEN 4.9::DOUBLE ELSE keys::DOUBLE END AS cs
        FROM maps""",
    "flat": """
        SELECT page_no, beatmap_id, beatmapset_id, 'Set ' || beatmapset_id AS title, beatmapset_id AS mapper, version, length_ms,
               CASE WHEN beatmap_id % 6 IN (0, 1) THEN 177.5::DOUBLE ELSE bpm END AS bpm, difficulty_rating, cs AS circle_size,
               CAST(floor(cs) AS INT) AS keys, hp_drain_rate, overall_difficulty, approach_rate
        FROM listed WHERE mode_ok AND status_ok AND floor(cs) = 4""",
}
FLAT = [
    "beatmap_id", "beatmapset_id", "title", "mapper", "version", "length_ms", "bpm", "difficulty_rating", "circle_size", "keys",
    "hp_drain_rate", "overall_difficulty", "approach_rate",
]


@query("q_search_pages", f"SELECT page_no, {', '.join(FLAT)} FROM flat", extra=PAGE_VIEWS)
def q_search_pages(spark, folder):
    return landed_json.flatten_pages(search_pages(spark, folder)).select("page_no", *FLAT)


@query(
    "q_dedupe_maps",
    f"""SELECT page_no, {', '.join(FLAT)} FROM (SELECT *, row_number() OVER (PARTITION BY beatmap_id ORDER BY page_no) AS rn FROM flat)
        WHERE rn = 1 ORDER BY page_no, beatmapset_id, beatmap_id LIMIT 500""",
    extra=PAGE_VIEWS,
)
def q_dedupe_maps(spark, folder):
    flat = landed_json.flatten_pages(search_pages(spark, folder))
    return landed_json.first_maps(flat, 500).select("page_no", *FLAT)


@query(
    "q_keymode_filter",
    """SELECT beatmap_id, mode_ok AND status_ok AND coalesce(floor(cs) = 4, false) AS ranked_4k,
              mode_ok AND status_ok AND coalesce(floor(cs) = 7, false) AS ranked_7k FROM listed""",
    extra=PAGE_VIEWS,
)
def q_keymode_filter(spark, folder):
    parsed = search_pages(spark, folder).select(F.from_json("page", landed_json.PAGE_SCHEMA).alias("j"))
    charts = parsed.select(F.explode("j.beatmapsets").alias("s")).select(F.explode("s.beatmaps").alias("m"))
    return charts.select(
        F.col("m.id").alias("beatmap_id"),
        landed_json.is_ranked_keymode("m", 4).alias("ranked_4k"),
        landed_json.is_ranked_keymode("m", 7).alias("ranked_7k"),
    )


@query(
    "q_scores_json",
    "SELECT beatmap_id, round(accuracy, 9) AS accuracy FROM scores",
)
def q_scores_json(spark, folder):
    # A payload holds up to 1000 scores of a chart and one null entry; longer leaderboards come as several payloads.
    scores = tables.table(spark, folder, "lineitem").select(
        F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(1 << 20)).alias("part"), F.col("l_partkey").alias("beatmap_id"), tables.accuracy().alias("accuracy")
    )
    counts = scores.groupBy("beatmap_id").agg(F.ceil(F.count("*") / 500).alias("parts"))
    board = scores.join(counts, "beatmap_id").withColumn("part", F.col("part") % F.col("parts"))
    entries = F.collect_list(F.struct(F.col("accuracy")))
    nothing = F.array(F.struct(F.lit(None).cast("double").alias("accuracy")))
    payloads = board.groupBy("beatmap_id", "part").agg(F.concat(entries, nothing).alias("scores"))
    keep_null = {"ignoreNullFields": "false"}
    payloads = payloads.select("beatmap_id", F.to_json(F.struct("scores"), keep_null).alias("payload"))
    return rounded(landed_json.score_rows(payloads), "accuracy", digits=9)


# --- audit ------------------------------------------------------------------


UNKNOWN = 1_000_000


def audited_labels(spark, folder):
    """All labels, some of them twice, and some more under ids without notes or chart file."""
    rows = stored_labels(spark, folder)
    again = rows.filter(F.col("beatmap_id") % 50 == 7)
    unknown = rows.filter("mode = 0").withColumn("beatmap_id", F.col("beatmap_id") + UNKNOWN)
    return rows.unionByName(again).unionByName(unknown)


AUDIT_VIEWS = {
    **TEXT_VIEWS,
    "audited": """
        SELECT * FROM chart_labels UNION ALL SELECT * FROM chart_labels WHERE beatmap_id % 50 = 7
        UNION ALL SELECT beatmap_id + 1000000 AS beatmap_id, * EXCLUDE beatmap_id FROM chart_labels WHERE mode = 0""",
    "lengths": "SELECT user_id AS beatmap_id, count(*) AS note_count FROM events GROUP BY 1",
    "usable_rows": "SELECT * FROM audited JOIN lengths USING (beatmap_id)",
    "compared": """
        SELECT a.beatmap_id, m.mode AS c_mode, m.keys AS c_keys, concat_ws(',', CASE WHEN a.mode <> m.mode THEN 'mode' END, CASE WHEN a.keys <> m.keys THEN 'keys' END,
               CASE WHEN abs(a.hp_drain_rate - m.hp_drain_rate) > 1e-6 + 1e-5 * abs(m.hp_drain_rate) THEN 'hp_drain_rate' END,
               CASE WHEN m.overall_difficulty IS NOT NULL AND (a.overall_difficulty IS NULL
                    OR abs(a.overall_difficulty - m.overall_difficulty) > 1e-6 + 1e-5 * abs(m.overall_difficulty)) THEN 'overall_difficulty' END) AS columns
        FROM audited a JOIN chart_meta m USING (beatmap_id)""",
}


@query("q_usable_labels", "SELECT beatmap_id, title, score_count FROM chart_labels WHERE beatmap_id IN (SELECT user_id FROM events)")
def q_usable_labels(spark, folder):
    notes = tables.raw_notes(spark, folder)
    return audit.usable_labels(chart_labels(spark, folder), notes).select("beatmap_id", "title", "score_count")


@query(
    "q_missing_sequences",
    "SELECT beatmap_id, title, artist, mapper, version FROM chart_labels WHERE beatmap_id NOT IN (SELECT user_id FROM events)",
)
def q_missing_sequences(spark, folder):
    return audit.missing_sequences(chart_labels(spark, folder), tables.raw_notes(spark, folder))


@query(
    "q_audit_counts",
    """SELECT (SELECT count(*) FROM audited) AS label_rows, (SELECT count(*) FROM usable_rows) AS usable_rows,
              (SELECT count(*) FROM audited WHERE beatmap_id NOT IN (SELECT beatmap_id FROM lengths)) AS missing_sequence_count,
              (SELECT count(*) FROM lengths WHERE beatmap_id NOT IN (SELECT beatmap_id FROM audited)) AS extra_sequence_count,
              (SELECT count(*) - count(DISTINCT beatmap_id) FROM audited) AS duplicate_beatmap_id_count,
              (SELECT count(DISTINCT beatmapset_id) FROM audited) AS group_count""",
    extra=AUDIT_VIEWS,
)
def q_audit_counts(spark, folder):
    return audit.audit_counts(audited_labels(spark, folder), tables.raw_notes(spark, folder))


@query(
    "q_numeric_summary",
    """SELECT count(mean_acc) AS mean_acc_count, round(min(mean_acc), 9) AS mean_acc_min, round(quantile_cont(mean_acc, 0.5), 9) AS mean_acc_median,
              round(avg(mean_acc), 9) AS mean_acc_mean, round(max(mean_acc), 9) AS mean_acc_max, round(stddev_pop(mean_acc), 9) AS mean_acc_std FROM chart_labels""",
)
def q_numeric_summary(spark, folder):
    row = audit.numeric_summary(chart_labels(spark, folder), "mean_acc", "mean_acc")
    return rounded(row, *[n for n in row.columns if n != "mean_acc_count"], digits=9)


@query(
    "q_label_reliability",
    """SELECT count(*) AS usable_score_count_rows, CAST(count_if(score_count < 34) AS BIGINT) AS low_score_count_rows,
              round(avg((score_count < 34)::INT), 9) AS low_score_count_rate, CAST(count_if(score_count >= 100) AS BIGINT) AS full_top100_rows,
              avg((score_count >= 100)::INT) AS full_top100_rate, min(score_count)::DOUBLE AS min_score_count,
              quantile_cont(score_count::DOUBLE, 0.5) AS median_score_count, 34 AS low_score_count_threshold FROM chart_labels""",
)
def q_label_reliability(spark, folder):
    return rounded(audit.label_reliability(chart_labels(spark, folder), low=34), "low_score_count_rate", digits=9)


@query(
    "q_truncation",
    """SELECT CAST(count_if(note_count > 70) AS BIGINT) AS truncated_rows, round(avg((note_count > 70)::INT), 9) AS truncated_rate,
              max(greatest(note_count - 70, 0)) AS max_notes_over_limit, CAST(70 AS BIGINT) AS max_notes FROM usable_rows""",
    extra=AUDIT_VIEWS,
)
def q_truncation(spark, folder):
    """Over the label rows that have notes; a repeated label counts each time."""
    lengths = tables.raw_notes(spark, folder).groupBy("beatmap_id").agg(F.count(F.lit(1)).alias("note_count"))
    usable = audited_labels(spark, folder).select("beatmap_id").join(lengths, "beatmap_id")
    return rounded(audit.truncation(usable, max_notes=70), "truncated_rate", digits=9)


INTEGRITY = [
    "checked_rows", "mode_missing_rows", "mode_mismatch_rows", "keys_missing_rows", "keys_mismatch_rows", "hp_drain_rate_missing_rows",
    "overall_difficulty_missing_rows", "approach_rate_missing_rows", "osu_files_checked", "osu_missing_files",
    "osu_mode_mismatch_rows", "osu_keys_mismatch_rows", "osu_metadata_label_mismatch_rows",
]


@query(
    "q_source_integrity",
    """SELECT count(*) AS checked_rows, CAST(0 AS BIGINT) AS mode_missing_rows, CAST(count_if(mode <> 3) AS BIGINT) AS mode_mismatch_rows,
              CAST(0 AS BIGINT) AS keys_missing_rows, CAST(count_if(keys <> 4) AS BIGINT) AS keys_mismatch_rows, CAST(0 AS BIGINT) AS hp_drain_rate_missing_rows,
              CAST(count_if(overall_difficulty IS NULL) AS BIGINT) AS overall_difficulty_missing_rows, CAST(0 AS BIGINT) AS approach_rate_missing_rows,
              (SELECT count(*) FROM compared) AS osu_files_checked, count(*) - (SELECT count(*) FROM compared) AS osu_missing_files,
              (SELECT CAST(count_if(c_mode <> 3) AS BIGINT) FROM compared) AS osu_mode_mismatch_rows,
              (SELECT CAST(count_if(c_keys <> 4) AS BIGINT) FROM compared) AS osu_keys_mismatch_rows,
              (SELECT CAST(count_if(columns <> '') AS BIGINT) FROM compared) AS osu_metadata_label_mismatch_rows FROM audited""",
    extra=AUDIT_VIEWS,
)
def q_source_integrity(spark, folder):
    metadata = chart_text.chart_metadata(chart_texts(spark, folder))
    return audit.source_integrity(audited_labels(spark, folder), metadata).select(*INTEGRITY)


@query(
    "q_label_chart_mismatch",
    "SELECT beatmap_id, columns FROM compared WHERE columns <> '' ORDER BY beatmap_id LIMIT 10",
    extra=AUDIT_VIEWS,
)
def q_label_chart_mismatch(spark, folder):
    metadata = chart_text.chart_metadata(chart_texts(spark, folder))
    return audit.mismatch_examples(audited_labels(spark, folder), metadata)


@query(
    "q_quality_warnings",
    """SELECT position, code, severity, message FROM (
         SELECT 0 AS position, 'missing_sequences' AS code, 'warning' AS severity,
                CAST(missing AS VARCHAR) || ' labels are missing parsed note sequences and cannot be trained.' AS message, missing > 0 AS broken FROM facts
         UNION ALL SELECT 1, 'missing_targets', 'error', 'Missing target columns: unmeasured.', true FROM facts
         UNION ALL SELECT 2, 'small_usable_dataset', 'warning', 'Only ' || CAST(usable AS VARCHAR) || ' usable maps are available; use this for smoke tests, not final model comparison.', usable < 100 FROM facts
         UNION ALL SELECT 3, 'duplicate_beatmap_ids', 'warning', CAST(dup AS VARCHAR) || ' duplicate beatmap_id rows were found; deduplicate labels before training.', dup > 0 FROM facts
         UNION ALL SELECT 4, 'sequence_truncation', 'warning', printf('%.2f', trunc * 100) || '% of usable maps exceed max_notes 70; raise --max-notes or inspect GPU memory.', trunc > 0.05 FROM facts
         UNION ALL SELECT 5, 'low_full_top100_rate', 'warning', 'Only ' || printf('%.2f', full_rate * 100) || '% of usable maps have full top100 score coverage; keep sample weighting on and verify with human judgments.', full_rate < 0.8 FROM facts
         UNION ALL SELECT 6, 'high_low_score_count_rate', 'warning', printf('%.2f', low_rate * 100) || '% of usable maps are below score_count 80; labels may be noisy.', low_rate > 0.25 FROM facts
         UNION ALL SELECT 8, 'non_mania_rows', 'error', CAST(bad_mode AS VARCHAR) || ' label rows do not match expected osu!mania mode 3.', bad_mode > 0 FROM facts
         UNION ALL SELECT 10, 'wrong_key_mode_rows', 'error', CAST(bad_keys AS VARCHAR) || ' label rows do not match expected 4K mania.', bad_keys > 0 FROM facts
         UNION ALL SELECT 11, 'missing_difficulty_metadata', 'warning', 'Up to ' || CAST(no_od AS VARCHAR) || ' rows are missing HP/OD/AR metadata.', no_od > 0 FROM facts
         UNION ALL SELECT 12, 'missing_osu_files', 'warning', CAST(no_file AS VARCHAR) || ' labels do not have a matching raw .osu file for source verification.', no_file > 0 FROM facts
         UNION ALL SELECT 13, 'osu_non_mania_files', 'error', CAST(f_mode AS VARCHAR) || ' raw .osu files do not declare mode 3.', f_mode > 0 FROM facts
         UNION ALL SELECT 14, 'osu_wrong_key_mode_files', 'error', CAST(f_keys AS VARCHAR) || ' raw .osu files do not declare 4K.', f_keys > 0 FROM facts
         UNION ALL SELECT 15, 'osu_label_metadata_mismatch', 'error', CAST(f_diff AS VARCHAR) || ' raw .osu files disagree with label metadata.', f_diff > 0 FROM facts)
       WHERE broken""",
    extra={
        **AUDIT_VIEWS,
        "facts": """
        SELECT (SELECT count(*) FROM audited WHERE beatmap_id NOT IN (SELECT beatmap_id FROM lengths)) AS missing,
               (SELECT count(*) FROM usable_rows) AS usable, (SELECT count(*) - count(DISTINCT beatmap_id) FROM audited) AS dup,
               (SELECT avg((note_count > 70)::INT) FROM usable_rows) AS trunc, (SELECT avg((score_count >= 100)::INT) FROM usable_rows) AS full_rate,
               (SELECT avg((score_count < 80)::INT) FROM usable_rows) AS low_rate, (SELECT CAST(count_if(mode <> 3) AS BIGINT) FROM audited) AS bad_mode,
               (SELECT CAST(count_if(keys <> 4) AS BIGINT) FROM audited) AS bad_keys,
               (SELECT CAST(count_if(overall_difficulty IS NULL) AS BIGINT) FROM audited) AS no_od,
               (SELECT count(*) FROM audited) - (SELECT count(*) FROM compared) AS no_file,
               (SELECT CAST(count_if(c_mode <> 3) AS BIGINT) FROM compared) AS f_mode, (SELECT CAST(count_if(c_keys <> 4) AS BIGINT) FROM compared) AS f_keys,
               (SELECT CAST(count_if(columns <> '') AS BIGINT) FROM compared) AS f_diff""",
    },
)
def q_quality_warnings(spark, folder):
    metadata = chart_text.chart_metadata(chart_texts(spark, folder))
    summary = audit.audit_summary(
        audited_labels(spark, folder),
        tables.raw_notes(spark, folder),
        metadata,
        targets=["mean_acc", "acc_std", "unmeasured"],
        max_notes=70,
    )
    return audit.quality_warnings(summary)


LABEL_CELLS = {
    "beatmap_id": "CAST(beatmap_id AS VARCHAR)",
    "title": """title || CASE WHEN beatmap_id % 5 = 0 THEN ', "live"' ELSE '' END""",
    "mean_acc": "CAST(CAST(round(mean_acc, 9) AS DECIMAL(12, 9)) AS VARCHAR)",
    "score_count": "CASE WHEN beatmap_id % 31 = 0 THEN 'n/a' WHEN beatmap_id % 7 <> 0 THEN CAST(score_count AS VARCHAR) END",
}


@query(
    "q_label_csv",
    f"""SELECT CASE WHEN beatmap_id % 31 <> 0 THEN beatmap_id END AS beatmap_id, CASE WHEN beatmap_id % 31 <> 0 THEN cell_title END AS title,
               CASE WHEN beatmap_id % 31 <> 0 THEN CAST(cell_mean AS DOUBLE) END AS mean_acc,
               CASE WHEN beatmap_id % 31 <> 0 THEN CAST(cell_count AS BIGINT) END AS score_count,
               CASE WHEN beatmap_id % 31 <> 0 THEN difficulty_rating END AS difficulty_rating,
               CASE WHEN beatmap_id % 31 = 0 THEN cell_id || ',' || CASE WHEN beatmap_id % 5 = 0 THEN '"' || replace(cell_title, '"', '""') || '"' ELSE cell_title END
                    || ',' || cell_mean || ',' || cell_count END AS rejected
        FROM (SELECT beatmap_id, difficulty_rating, {LABEL_CELLS['beatmap_id']} AS cell_id, {LABEL_CELLS['title']} AS cell_title,
                     {LABEL_CELLS['mean_acc']} AS cell_mean, {LABEL_CELLS['score_count']} AS cell_count FROM chart_labels)""",
)
def q_label_csv(spark, folder):
    """Labels written as CSV with unusable cells, read typed and joined with the maps; rejected lines beside them."""
    key = F.col("beatmap_id")
    cells = stored_labels(spark, folder).select(
        key.cast("string").alias("beatmap_id"),
        F.concat("title", F.when(key % 5 == 0, ', "live"').otherwise("")).alias("title"),
        F.round("mean_acc", 9).cast("decimal(12,9)").cast("string").alias("mean_acc"),
        F.when(key % 31 == 0, "n/a").when(key % 7 != 0, F.col("score_count").cast("string")).alias("score_count"),
    )
    path = scratch_path(spark)
    files.write_csv(cells, path)
    labels, rejected = files.read_labels(spark, path, "beatmap_id long, title string, mean_acc double, score_count long")
    known = labels.join(tables.maps(spark, folder).select("beatmap_id", "difficulty_rating"), "beatmap_id")
    return known.unionByName(rejected.withColumnRenamed("line", "rejected"), allowMissingColumns=True)


@query(
    "q_stored_sequences",
    """SELECT beatmap_id, notes, last_time_ms, longest_gap_ms, title FROM (
           SELECT beatmap_id, count(*) AS notes, max(time_ms) AS last_time_ms, max(time_ms - prev_time_ms) AS longest_gap_ms
           FROM notes GROUP BY beatmap_id) JOIN maps USING (beatmap_id)""",
)
def q_stored_sequences(spark, folder):
    """Charts with stored sequences: their size, end and longest gap. Both tables lie in buckets by chart."""
    return sequences.stored_overview(
        files.bucketed(sequences.sequence_rows(tables.raw_notes(spark, folder)), ["note_index"]),
        files.bucketed(tables.maps(spark, folder).select("beatmap_id", "title"), []),
    )
