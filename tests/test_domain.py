"""Curves, pairs, judgments, audit, runs, sweeps, embeddings, files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainframe.operators import audit, curves, embeddings, judgments, models, pairgen, ranker, run_analytics, sequences, stages, sweeps
from strainframe.sources import chart_text, files, landed_json

RAW = "beatmap_id long, source_order long, time_ms long, col int, is_ln int, ln_length_ms long"
LABELS = "beatmap_id long, title string, artist string, version string, length_ms long, keys int, overall_difficulty double"


def _charts(spark, count=4):
    notes, rows = [], []
    for chart in range(1, count + 1):
        for i in range(4 + chart):
            notes.append((chart, len(notes), 4000 * i // (3 + chart), 0 if i < 3 else i % 4, int(i == 2), 300 if i == 2 else 0))
        notes.append((chart, len(notes), 0, 1, 0, 0))
        rows.append((chart, f"t{chart}", "a", "v", 4000, 4, 5.0 + chart))
    return spark.createDataFrame(notes, RAW), spark.createDataFrame(rows, LABELS)


def test_curve_and_summary(spark):
    raw, labels = _charts(spark, 1)
    curve = curves.feel_curve(raw, labels, window_sec=2.0, step_sec=1.0)
    rows = curve.orderBy("window_index").collect()
    assert [r["start_sec"] for r in rows] == [0.0, 1.0, 2.0]
    assert max(r["chord_load"] for r in rows) > 0 and max(r["ln_density"] for r in rows) > 0
    summary = curves.curve_summary(curve, labels).head()
    assert summary["peak_strain"] > summary["mean_strain"] > 0


def test_window_grid_of_absurd_lengths(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(1, 500_000.0), (2, 0.5 * curves.GRID_BLOCK + 1.5), (3, 0.5 * curves.GRID_BLOCK + 2.0)], "beatmap_id long, duration_sec double")
    rows = curves.window_grid(frame, 2.0, 0.5).groupBy("beatmap_id").agg(F.count("*"), F.countDistinct("window_index"), F.max("window_index")).collect()
    expected = {1: 999_997, 2: curves.GRID_BLOCK, 3: curves.GRID_BLOCK + 1}
    assert {r[0]: (r[1], r[2], r[3] + 1) for r in rows} == {n: (count,) * 3 for n, count in expected.items()}


def test_window_grid_matches_arange(spark):
    durations = [1.0, 2.0, 2.2, 2.5, 4.0, 7.3, 29.95]
    frame = spark.createDataFrame(list(enumerate(durations)), "beatmap_id long, duration_sec double")
    grid = curves.window_grid(frame, 2.0, 0.5).groupBy("beatmap_id").agg(F.count("*").alias("n")).collect()
    expected = {i: 1 if d <= 2 else len(np.arange(0.0, d - 2.0 + 0.5, 0.5)) for i, d in enumerate(durations)}
    assert {r["beatmap_id"]: r["n"] for r in grid} == expected


def test_pair_candidates(spark):
    raw, labels = _charts(spark)
    curve = curves.feel_curve(raw, labels)
    summary = curves.curve_summary(curve, labels)
    rows = pairgen.pair_candidates(summary, curve, labels, ["beginner", "novice"], max_pairs=6).collect()
    assert len(rows) == 6 and {r["scope"] for r in rows} == {"map", "segment"}
    assert {r["player_stage"] for r in rows} == {"beginner", "novice"}
    assert [name for name in rows[0].asDict()] == judgments.ANNOTATION_COLUMNS
    maps = [r for r in rows if r["scope"] == "map"]
    assert len(maps) == 3 and maps[0]["pair_id"] == "map_beginner_0000"


def test_ranker_trains_on_usable_rows(spark):
    raw, labels = _charts(spark)
    curve = curves.feel_curve(raw, labels)
    summary = curves.curve_summary(curve, labels)
    rows = [("p1", "beginner", 4, 1, "A", "2"), ("p2", "novice", 1, 3, "b", ""), ("p3", "novice", 1, 2, "tie", "1"), ("p4", "none", 1, 2, "a", "1")]
    pairs = spark.createDataFrame(rows, "pair_id string, player_stage string, a_beatmap_id long, b_beatmap_id long, harder_choice string, confidence string")
    pairs = pairs.withColumns({f"{s}_{e}": F.lit(None).cast("double") for s in "ab" for e in ("start_sec", "end_sec")})
    frame = ranker.pair_features(pairs, summary, curve, stages.default_stages(spark))
    assert frame.count() == 2 and len(ranker.PAIR_FEATURES) == 36
    _, metrics, coefficients = ranker.fit_ranker(frame)
    row = metrics.head()
    assert row["usable_judgments"] == 2 and row["train_agreement"] >= 0.5 and coefficients.count() == 37


def test_segment_summary_falls_back_to_chart(spark):
    raw, labels = _charts(spark, 1)
    curve = curves.feel_curve(raw, labels)
    summary = curves.curve_summary(curve)
    segments = spark.createDataFrame([(1, 0.0, 2.5), (1, 0.0, 0.1), (1, None, None)], "beatmap_id long, start_sec double, end_sec double")
    rows = {(r["start_sec"], r["end_sec"]): r for r in ranker.segment_summary(segments, curve, summary).collect()}
    inside = [r["feel_strain"] for r in curve.filter("end_sec <= 2.5").collect()]
    assert rows[(0.0, 2.5)]["fatigue_area"] == pytest.approx(sum(inside))
    whole = pytest.approx(summary.head()["fatigue_area"])
    assert rows[(0.0, 0.1)]["fatigue_area"] == whole and rows[(None, None)]["fatigue_area"] == whole


def test_stages(spark):
    assert stages.validated_stages(stages.default_stages(spark)).count() == 6
    with pytest.raises(ValueError):
        stages.validated_stages(stages.default_stages(spark).withColumn("jack", F.lit(1.2)))


def test_judgment_scores(spark):
    frame = spark.createDataFrame(
        [(1, 2, "1", "2"), (3, 4, "4", ""), (5, 6, "tie", "1")],
        "model_harder_beatmap_id long, observed_harder_beatmap_id long, human_harder_beatmap_id string, human_confidence string",
    )
    row = judgments.judgment_scores(frame).head()
    assert (row["judged_count"], row["model_agreement_rate"], row["proxy_agreement_rate"]) == (2, 0.5, 0.5)
    assert row["judgment_coverage_rate"] == pytest.approx(2 / 3)
    assert row["confidence_weighted_judged_count"] == 3.0
    assert row["confidence_weighted_model_vs_proxy_delta"] == pytest.approx(1 / 3)


QUEUE = "pair_id string, scope string, player_stage string, harder_choice string, a_peak_strain double, b_peak_strain double, confidence string, reason_tags string, notes string"


def test_queue_and_upsert(spark):
    pairs = spark.createDataFrame(
        [("p1", "map", "beginner", "", 1.0, 2.0, "", "", ""), ("p2", "map", "novice", "A", 3.0, None, "1", "", "")], QUEUE
    )
    state = judgments.queue_state(pairs, stage="beginner", status="open").head()
    assert (state["total_count"], state["filtered_count"], state["current_pair_id"]) == (2, 1, "p1")
    assert state["judged_count"] == 1 and state["b_strain_percentile"] == pytest.approx(66.7)
    saves = spark.createDataFrame(
        [("p1", "left", None, "speed", 1), ("p1", "b", "3", None, 2)],
        "pair_id string, harder_choice string, confidence string, reason_tags string, at long",
    )
    saved = {r["pair_id"]: r for r in judgments.upsert_judgments(pairs, saves, ["at"]).collect()}
    assert (saved["p1"]["harder_choice"], saved["p1"]["confidence"], saved["p1"]["reason_tags"]) == ("B", "3", "speed")
    assert saved["p2"]["harder_choice"] == "A"
    with pytest.raises(KeyError):
        judgments.upsert_judgments(pairs, saves.withColumn("pair_id", F.lit("nope")), ["at"])
    assert judgments.empty_annotations(spark).columns == judgments.ANNOTATION_COLUMNS


def test_audit_finds_what_is_missing(spark):
    labels = spark.createDataFrame(
        [(1, "s1", 0.9, 100, 3, 4, None), (2, "s1", 0.8, 50, 0, 7, 6.0), (3, "s2", 0.7, 90, 3, 4, 5.0)],
        "beatmap_id long, beatmapset_id string, mean_acc double, score_count long, mode int, keys int, hp_drain_rate double",
    )
    notes = spark.createDataFrame([(1,)] * 5 + [(2,)] * 9, "beatmap_id long")
    files_ = spark.createDataFrame(
        [(1, 3.0, 7.0, 7.0, 5.0, None, None)],
        "beatmap_id long, mode double, keys double, circle_size double, hp_drain_rate double, overall_difficulty double, approach_rate double",
    )
    row = audit.audit_summary(labels, notes, files_, targets=["mean_acc"], max_notes=6)
    got = row.head()
    assert (got["usable_rows"], got["missing_sequence_count"], got["group_count"]) == (2, 1, 2)
    assert (got["truncated_rows"], got["truncated_rate"], got["low_score_count_rows"]) == (1, 0.5, 1)
    assert (got["mode_mismatch_rows"], got["osu_files_checked"], got["osu_missing_files"]) == (1, 1, 2)
    assert got["osu_keys_mismatch_rows"] == 1 and got["osu_metadata_label_mismatch_rows"] == 1
    codes = {r["code"] for r in audit.quality_warnings(row).collect()}
    assert {"missing_sequences", "small_usable_dataset", "sequence_truncation", "low_full_top100_rate", "high_low_score_count_rate"} <= codes
    plain = audit.audit_summary(labels.select("beatmap_id", "mean_acc"), notes, targets=["mean_acc", "acc_std"])
    codes = {r["code"] for r in audit.quality_warnings(plain).collect()}
    assert {"missing_mode_metadata", "missing_key_metadata", "missing_targets"} <= codes


def test_run_rows_from_files(spark, tmp_path):
    run = tmp_path / "r1"
    run.mkdir()
    body = {"mean_acc": {"mae": 0.1, "r2": 0.5}, "_run": {"model_name": "lstm", "seed": 7, "best_epoch": 3}}
    (run / "metrics.json").write_text(json.dumps(body))
    rows = landed_json.run_metric_rows(landed_json.read_run_metrics(spark, f"{tmp_path}/*/metrics.json", "holdout")).collect()
    assert len(rows) == 1 and rows[0]["run"] == "r1" and rows[0]["evaluation"] == "holdout"
    assert rows[0]["mae"] == 0.1 and rows[0]["baseline_mae"] is None and rows[0]["seed"] == "7"


def _history(spark, losses):
    rows = [("r", i + 1, v * 0.5, v) for i, v in enumerate(losses)]
    frame = spark.createDataFrame(rows, "run string, epoch long, train_loss double, val_loss double")
    return frame.withColumns({n: F.lit(None).cast("double") for n in files.HISTORY_COLUMNS[3:]})


def test_health_and_checkpoint(spark):
    history = _history(spark, [0.5, 0.3, 0.3, 0.4, 0.5, 0.2])
    health = run_analytics.training_health(history).head()
    assert (health["best_epoch"], health["final_epoch"], health["overfit_signal"]) == (6, 6, "No obvious")
    picked = run_analytics.checkpoint_pick(history, patience=3).head()
    assert (picked["best_epoch"], picked["epochs_completed"], picked["stop_reason"]) == (2, 5, "early_stopping")
    assert run_analytics.checkpoint_pick(history, patience=9).head()["best_epoch"] == 6
    assert run_analytics.training_performance(history).count() == 0


def test_history_widening(spark):
    old = spark.createDataFrame([(1, 0.5, 0.6)], "epoch long, train_loss double, val_loss double")
    rows = files.widened_history(old, _history(spark, [0.4]).drop("run")).collect()
    assert len(rows) == 2 and list(rows[0].asDict()) == files.HISTORY_COLUMNS and rows[0]["lr"] is None


def test_sweep_choice(spark):
    rows = [("a", 0.1, 0.7, 200, 2), ("b", 0.1, 0.8, 100, 2), ("c", None, 0.9, 50, 1)]
    summary = spark.createDataFrame(rows, "candidate_id string, mean_mae double, mean_pairwise_order_accuracy double, forest_trees long, forest_min_samples_leaf long")
    assert sweeps.best_forest(summary).head()["candidate_id"] == "b"
    assert sweeps.best_forest(summary, "mean_pairwise_order_accuracy").head()["candidate_id"] == "c"


def test_grids(spark):
    grid = sweeps.forest_grid(spark, trees=[100, 200], min_samples_leaf=[1], max_features=["sqrt", 0.5])
    assert {r["candidate_id"] for r in grid.collect()} >= {"core_trees100_leaf1_featsqrt", "core_trees200_leaf1_feat0.5"}
    shared = {"lr": [0.001], "weight_decay": [1e-05], "batch_size": [16], "huber_delta": [0.5]}
    row = sweeps.neural_grid(spark, "summary", {"summary_hidden_dim": [65], "summary_dropout": [0.1]}, shared).head()
    assert row["candidate_id"] == "summary_h65_do0p1_lr0p001_wd1em05_bs16_hd0p5" and row["model_size_score"] == 97


def test_projection_matches_svd(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    frame = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(data)], "vec_id long, embedding array<double>")
    rows = embeddings.projected(frame).orderBy("vec_id").collect()
    z = (data - data.mean(0)) / data.std(0)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    axes = np.array([a if a[np.abs(a).argmax()] > 0 else -a for a in axes])
    assert np.allclose([[r["projection_x"], r["projection_y"]] for r in rows], z @ axes.T, atol=1e-6)
    one = embeddings.projected(frame.limit(1)).head()
    assert (one["projection_x"], one["projection_y"]) == (0.0, 0.0)


def test_forest_saves_and_loads(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), float(i % 3), i / 10) for i in range(40)], "beatmap_id long, x double, y double, t double")
    model = models.fit_forest(rows, ["x", "y"], ["t"], models.ForestOptions(trees=4))
    model.save(str(tmp_path / "m"), spark)
    loaded = models.ForestModel.load(str(tmp_path / "m"), spark)
    left, right = (m.predict(rows).orderBy("beatmap_id").select("pred_t").collect() for m in (model, loaded))
    assert left == right and model.importances(spark).count() == 2


def test_sequence_store_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([(1, i, i * 10) for i in range(20)], "beatmap_id long, note_index long, time_ms long")
    files.write_sequences(notes, str(tmp_path / "s"))
    kept = files.read_sequences(spark, str(tmp_path / "s")).filter("note_index < 5")
    assert kept.count() == 5
    files.write_csv(notes.limit(3), str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c")).count() == 3


def test_bucketed_sequences_need_no_exchange(spark):
    notes = spark.createDataFrame([(c, i, i * i * 10) for c in range(30) for i in range(40 if c else 900)], "beatmap_id long, note_index long, time_ms long")
    charts = spark.createDataFrame([(c, f"t{c}") for c in range(1, 40)], "beatmap_id long, title string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        frame = sequences.stored_overview(files.bucketed(notes, ["note_index"], 4), files.bucketed(charts, [], 4))
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
        rows = {r["beatmap_id"]: r for r in frame.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(rows) == list(range(1, 30))
    assert all((r["notes"], r["last_time_ms"], r["longest_gap_ms"]) == (40, 15210, 770) for r in rows.values())


def test_history_append_leaves_each_epoch_once(spark, tmp_path):
    path = str(tmp_path / "history")
    first = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.4), ("b", 1, 0.9), ("", 1, 0.7), (None, 2, 0.1)], "run string, epoch long, val_loss double")
    files.append_history(first, path)
    files.append_history(first.filter("run = 'b'").drop("val_loss").withColumn("lr", F.lit(0.01)), path)
    for _ in range(2):
        files.append_history(spark.createDataFrame([("a", 2, 0.3, "x"), ("a", 3, 0.2, "y")], "run string, epoch long, val_loss double, other string"), path)
    files.append_history(first.limit(0), path)
    rows = sorted((r["run"] or "-", r["epoch"], r["val_loss"], r["lr"]) for r in files.read_history(spark, path).collect())
    assert rows == [("-", 1, 0.7, None), ("-", 2, 0.1, None), ("a", 1, 0.5, None), ("a", 2, 0.3, None), ("a", 3, 0.2, None), ("b", 1, None, 0.01)]


def test_label_csv_rejects_lines_whole(spark, tmp_path):
    (tmp_path / "l.csv").write_text('beatmap_id,title,mean_acc\n1,"a, ""b""",0.5\n2,,\nx,c,0.5\n3,d\n4,e,high\n')
    labels, rejected = files.read_labels(spark, str(tmp_path / "l.csv"), "beatmap_id long, title string, mean_acc double")
    assert sorted(map(tuple, labels.collect())) == [(1, 'a, "b"', 0.5), (2, None, None)]
    assert sorted(r["line"] for r in rejected.collect()) == ["3,d", "4,e,high", "x,c,0.5"]


def test_chart_files_with_broken_bytes(spark, tmp_path):
    (tmp_path / "12.osu").write_bytes(b"\xef\xbb\xbf[General]\nMode: 3 \xff\xe2\x82!\n")
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "7.osu").write_bytes(b"")
    (tmp_path / "none.osu").write_bytes(b"x")
    rows = {r["beatmap_id"]: r["text"] for r in chart_text.read_charts(spark, str(tmp_path)).collect()}
    assert rows == {12: "[General]\nMode: 3 \ufffd\ufffd!\n", None: "x"}
    text = b"\xef\xbb\xbf[General]\nMode: 3 \xff\xe2\x82!\n".decode("utf-8-sig", errors="replace")
    assert rows[12] == text
