"""Chart text, note sequences, features."""

import pytest
from pyspark.sql import functions as F

from strainframe.operators import audit, features, sequences
from strainframe.sources import chart_text

TEXT = """osu file format v14

[General]
Mode: 3
[Difficulty]
HPDrainRate:6.5
CircleSize:4
OverallDifficulty:8
ApproachRate:5

[HitObjects]
64,192,1000,1,0,0:0:0:0:
192,192,1000,1,0,0:0:0:0:
320,192,1500,128,0,2100:0:0:0:0:
448,192,2000,1,0,0:0:0:0:
broken,192,2000,1,0
"""


@pytest.fixture(scope="module")
def charts(spark):
    return spark.createDataFrame([(1, TEXT), (2, "[HitObjects]\n\n// nothing\n")], "beatmap_id long, text string")


def test_chart_text_to_notes(spark, charts):
    raw = chart_text.hit_objects(chart_text.chart_lines(charts))
    rows = sequences.feature_sequence(raw).rows().orderBy("note_index").collect()
    assert [r["col"] for r in rows] == [0, 1, 2, 3]
    assert [r["chord_size"] for r in rows] == [2, 2, 1, 1]
    assert [r["ln_length_ms"] for r in rows] == [0, 0, 600, 0]
    assert [r["delta_sec"] for r in rows] == [0.0, 0.0, 0.5, 0.5]
    assert rows[-1]["time_frac"] == 1.0


def test_chart_metadata_keeps_files_without_values(charts):
    rows = {r["beatmap_id"]: r for r in chart_text.chart_metadata(charts).collect()}
    assert rows[1]["mode"] == 3 and rows[1]["keys"] == 4 and rows[1]["hp_drain_rate"] == 6.5
    assert rows[1]["overall_difficulty"] == 8 and rows[1]["approach_rate"] == 5
    assert rows[2]["mode"] is None


def test_read_charts_from_files(spark, tmp_path):
    (tmp_path / "77.osu").write_bytes(b"\xef\xbb\xbf" + TEXT.encode())
    charts = chart_text.read_charts(spark, str(tmp_path))
    rows = chart_text.hit_objects(chart_text.chart_lines(charts)).collect()
    assert {r["beatmap_id"] for r in rows} == {77} and len(rows) == 4


def test_enrich_overwrites_and_blanks(spark, charts):
    labels = spark.createDataFrame([(1, "x", 9.0), (3, "y", 1.0)], "beatmap_id long, title string, mode double")
    rows = {r["beatmap_id"]: r for r in audit.enriched(labels, chart_text.chart_metadata(charts)).collect()}
    assert rows[1]["mode"] == 3 and rows[3]["mode"] is None


def _raw(spark, notes):
    return spark.createDataFrame(
        [(chart, place, time, col, is_ln, length) for place, (chart, time, col, is_ln, length) in enumerate(notes)],
        "beatmap_id long, source_order long, time_ms long, col int, is_ln int, ln_length_ms long",
    )


def test_core_features_are_finite_and_empty_charts_zero(spark):
    raw = _raw(spark, [(1, 0, 0, 0, 0), (1, 100, 1, 0, 0), (1, 200, 2, 1, 300), (1, 400, 3, 0, 0)])
    ids = spark.createDataFrame([(1,), (2,)], "beatmap_id long")
    rows = {r["beatmap_id"]: r for r in features.chart_features(raw, charts=ids).collect()}
    assert len(features.CORE_FEATURES) == 29
    assert all(rows[1][name] == rows[1][name] for name in features.CORE_FEATURES)
    assert all(rows[2][name] == 0.0 for name in features.CORE_FEATURES)
    assert rows[1]["delta_mean"] == pytest.approx(0.4 / 3)


def test_burst_features_see_jacks_and_peaks(spark):
    raw = _raw(spark, [(1, 50 * i, 0, 0, 0) for i in range(20)])
    row = features.chart_features(raw, feature_set="burst").head()
    assert row["peak_notes_per_sec_1s"] > 10 and row["jack_ratio_100ms"] > 0.4


def test_stacked_notes_density_matches_two_pointer(spark):
    import random

    rng = random.Random(5)
    notes = sorted((1, rng.randint(0, 40) * 100, rng.randint(0, 3), 0, 0) for _ in range(120))
    got = sequences.window_density(_raw(spark, notes), 1000).orderBy("note_index").collect()
    times = [n[1] for n in notes]
    expected = [float(sum(1 for t in times[i:] if t - times[i] <= 1000)) for i in range(len(times))]
    assert [r["density"] for r in got] == expected


def test_density_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(sequences, "BLOCK_MS", 300)
    notes = [(1, 70 * i, 0, 0, 0) for i in range(40)]
    rows = sequences.time_density(_raw(spark, notes), {"ahead": 1000}).orderBy("time_ms").collect()
    times = [n[1] for n in notes]
    assert [r["ahead"] for r in rows] == [sum(1 for t in times if 0 <= t - s <= 1000) for s in times]


def test_metadata_values_fall_through(spark):
    frame = spark.createDataFrame(
        [(1, "", "4", "6.5", "8", "x", "120000", "nan")],
        "beatmap_id long, mode string, keys string, hp_drain_rate string, od string, ar string, length_ms string, bpm string",
    )
    row = features.metadata_features(frame).head()
    assert (row["metadata_mode"], row["metadata_keys"], row["metadata_overall_difficulty"]) == (0.0, 4.0, 8.0)
    assert (row["metadata_approach_rate"], row["metadata_length_sec"], row["metadata_bpm"]) == (0.0, 120.0, 0.0)


def test_jack_needs_a_positive_gap(spark):
    raw = _raw(spark, [(1, 0, 0, 0, 0), (1, 0, 0, 0, 0), (1, 220, 0, 0, 0), (1, 441, 0, 0, 0), (1, 441, 1, 0, 0)])
    rows = sequences.jack_notes(sequences.sorted_notes(raw), 220, F.col("time_ms")).rows().orderBy("note_index")
    assert [r["is_jack"] for r in rows.collect()] == [False, False, True, False, False]


def test_chart_files_are_written_by_many_tasks(spark, tmp_path):
    """Few bytes in one partition are still many files (q_chart_files)."""
    path = str(tmp_path / "charts")
    charts = spark.range(40).selectExpr("id AS beatmap_id", "concat('[General]\nMode: ', id) AS content").coalesce(1)
    chart_text.write_charts(charts, path)
    files = list((tmp_path / "charts").glob("beatmap_id=*/part-*"))
    assert len(files) == 40 and len({name.name[:10] for name in files}) > 1
    read = {row["beatmap_id"]: row["text"].strip() for row in chart_text.read_charts(spark, path).collect()}
    assert read == {n: f"[General]\nMode: {n}" for n in range(40)}


def test_chart_files_are_written_without_a_process_a_file(spark, tmp_path):
    """A task makes one file a chart and nothing beside it, in the same layout as Spark's writer (q_chart_files)."""
    own, spark_own = tmp_path / "the charts", tmp_path / "by spark"
    charts = spark.createDataFrame(
        [(1, bytearray(b"a\xff")), (2, bytearray(b"b")), (1, bytearray(b"a\xff")), (None, bytearray(b"c")), (3, None)], "beatmap_id long, content binary"
    )
    charts.select("beatmap_id", F.col("content").cast("string")).write.partitionBy("beatmap_id").text(str(spark_own))
    for _ in range(2):  # the second run replaces the first
        chart_text.write_charts(charts, str(own))
    read = [sorted(map(tuple, chart_text.read_charts(spark, str(path)).collect()), key=str) for path in (own, spark_own)]
    text = {row[0]: row[1] for row in read[0]}
    assert text == {1: "a�\na�\n", 2: "b\n", None: "c\n", 3: "\n"} and len(read[0]) == 4
    assert {row[0] for row in read[1]} == set(text)
    folders = {folder.name for folder in own.iterdir()}
    assert folders == {folder.name for folder in spark_own.iterdir() if folder.is_dir()}
    assert all(len(list(folder.iterdir())) == 1 for folder in own.iterdir())
    assert spark.conf.get(chart_text.LISTING) == "10000"
