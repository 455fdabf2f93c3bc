"""Labels, metrics, ranks, pairs, splits and baselines."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainframe.operators import labels, metrics, review, splits
from strainframe.plans import ordered
from strainframe.plans.pairs import comparable_pairs, strongest_inversions
from strainframe.plans.quantiles import counted_values, quantile_columns


def test_accuracy_labels(spark):
    frame = spark.createDataFrame([(1, a) for a in (0.90, 0.95, 0.80, 1.0, 0.85)], "beatmap_id long, accuracy double")
    for build in (labels.accuracy_labels, lambda rows: labels.leaderboard_labels(rows, 100)):
        row = build(frame).head()
        assert row["mean_acc"] == pytest.approx(0.9)
        assert row["skill_gap"] == pytest.approx(1.0 - (0.85 + 0.80) / 2)
        assert row["score_count"] == 5


def test_sample_weights(spark):
    frame = spark.createDataFrame([("100",), ("50",), ("10",), ("x",), ("inf",), (None,)], "v string")
    weights = [r[0] for r in frame.select(labels.sample_weight(F.col("v"))).collect()]
    assert weights == [1.0, 0.5, 0.25, 0.25, 0.25, 0.25]
    three = spark.createDataFrame([(100,), (50,), (10,)], "score_count long")
    row = labels.sample_weight_summary(three, "score_count").head()
    assert row["sample_weight_downweighted_count"] == 2 and row["sample_weight_min"] == 0.25


def _predictions(spark, rows, columns="beatmap_id long, actual double, pred double, baseline double"):
    return spark.createDataFrame(rows, columns)


def test_regression_report(spark):
    rows = [(1, 0.0, 0.0, 1.0), (2, 1.0, 1.0, 1.0), (3, 3.0, 2.0, 1.0)]
    frame = _predictions(spark, rows).withColumn("target", F.lit("t"))
    row = metrics.regression_report(frame, ["target"], ["baseline"]).head()
    assert row["mae"] == pytest.approx(1 / 3) and row["baseline_mae"] == pytest.approx(1.0)
    assert row["mae_improvement_vs_baseline"] == pytest.approx(2 / 3)
    assert row["spearman"] == pytest.approx(1.0) and row["pairwise_order_accuracy"] == 1.0


def test_constant_predictions_have_no_rank_signal(spark):
    frame = _predictions(spark, [(i, float(i), 1.0, 0.0) for i in range(4)]).withColumn("target", F.lit("t"))
    row = metrics.regression_report(frame, ["target"]).head()
    assert row["spearman"] == 0.0 and row["pairwise_order_accuracy"] == 0.0


def _random_rows(seed, size):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 12) / 4, rng.randint(0, 15) / 8) for i in range(size)]


@pytest.mark.parametrize("limit", [ordered.KEY_ROWS, 10])
def test_pair_statistics_equal_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(ordered, "KEY_ROWS", limit)
    for seed in (3, 4):
        rows = _random_rows(seed, 90)
        frame = spark.createDataFrame(rows, "id long, actual double, pred double").withColumn("g", F.lit("g"))
        got = metrics.pairwise_order_accuracy(frame, ["g"]).head()
        pairs = [(x, y) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[1] != y[1] and x[2] != y[2]]
        right = sum((x[1] < y[1]) == (x[2] < y[2]) for x, y in pairs)
        assert (got["comparable"], got["correct"]) == (len(pairs), right)
        for gaps in ((0.0, 0.0), (0.5, 1.0)):
            best = strongest_inversions(
                frame, "actual", "pred", "id", top_n=12, min_pred_gap=gaps[0], min_actual_gap=gaps[1]
            )
            expected = sorted(
                (-(abs(x[2] - y[2]) + abs(x[1] - y[1])), x[0], y[0])
                for x in rows
                for y in rows
                if x[2] < y[2] and x[1] > y[1] and y[2] - x[2] >= gaps[0] and x[1] - y[1] >= gaps[1]
            )[:12]
            found = [(-r["strength"], r["i_id"], r["j_id"]) for r in best.collect()]
            assert sorted(found) == expected


@pytest.mark.parametrize("limit", [ordered.KEY_ROWS, 5])
def test_quantiles_and_ranks_equal_numpy(spark, limit, monkeypatch):
    monkeypatch.setattr(ordered, "KEY_ROWS", limit)
    rng = random.Random(9)
    values = [rng.randint(0, 20) / 7 for _ in range(60)]
    frame = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    columns = quantile_columns({"p10": 0.1, "p50": 0.5, "p90": 0.9})
    row = counted_values(frame, ["k"], "v").frame.groupBy("k").agg(*columns).head()
    assert [row["p10"], row["p50"], row["p90"]] == pytest.approx(list(np.percentile(values, [10, 50, 90])))
    ranked = metrics.ranked_values(frame, ["k"], "v", "rank").collect()
    for row in ranked:
        below, same = sum(v < row["v"] for v in values), sum(v == row["v"] for v in values)
        assert row["rank"] == below + (same - 1) / 2


def test_prediction_summary(spark):
    wide = spark.createDataFrame(
        [(1, 0.9, 0.8, 0.1, 0.0), (2, 0.8, 0.9, 0.2, 0.2 - 0.0)],
        "beatmap_id long, actual_mean_acc double, pred_mean_acc double, actual_acc_std double, pred_acc_std double",
    )
    rows = {r["target"]: r for r in metrics.prediction_summary(metrics.long_predictions(wide, ["mean_acc", "acc_std"])).collect()}
    assert rows["mean_acc"]["bias"] == pytest.approx(0.0, abs=1e-12) and rows["mean_acc"]["mae"] == pytest.approx(0.1)
    assert rows["acc_std"]["p90_abs_error"] == pytest.approx(0.09)


def test_huber_loss(spark):
    two = spark.createDataFrame([("t", 0.0, 1.0, 1.0, 1.0), ("t", 0.0, 2.0, 1.0, 0.25)], "target string, actual double, pred double, tw double, rw double")
    # losses .375 and .875 at delta .5
    row = metrics.huber_loss(two, ["target"], delta=0.5, target_weight="tw", row_weight="rw").head()
    assert row["huber_loss"] == pytest.approx((0.375 + 0.875 * 0.25) / 2 / 0.625)


def _groups(spark):
    names = ["a", "a", "b", "c", "d", "e", "f", "f"]
    frame = spark.createDataFrame(list(enumerate(names)), "beatmap_id long, grp string")
    return splits.group_keys(frame, "grp")


def test_group_split_is_disjoint_and_complete(spark):
    rows = splits.split_by_group(_groups(spark), seed=1).collect()
    parts = {}
    for row in rows:
        parts.setdefault(row["split"], set()).add(row["split_group"])
    assert len(rows) == 8 and set(parts) == {"train", "val", "test"}
    assert sum(len(g) for g in parts.values()) == len(set.union(*parts.values())) == 6


def test_folds_cover_all_rows_once(spark):
    rows = splits.cross_validation_folds(_groups(spark), folds=3, seed=1).collect()
    by_group = {}
    for row in rows:
        by_group.setdefault(row["split_group"], set()).add(row["fold"])
    assert len(rows) == 8 and {f for s in by_group.values() for f in s} == {1, 2, 3}
    assert all(len(s) == 1 for s in by_group.values())
    few = splits.cross_validation_folds(_groups(spark).withColumn("split_group", F.lit("one")), folds=3, seed=1)
    assert sorted(r["n"] for r in few.groupBy("fold").agg(F.count("*").alias("n")).collect()) == [2, 3, 3]


def test_folds_are_dealt_to_the_least_loaded(spark):
    draw = random.Random(5)
    for _ in range(200):
        folds = draw.randint(2, 6)
        classes = [(size, draw.randint(1, 20)) for size in sorted(draw.sample(range(1, 30), 5), reverse=True)]
        plan, loads = splits.dealing_plan(classes, folds), [0] * folds
        for size, count in classes:
            entries = [(start, turns) for of, start, turns in plan if of == size]
            assert len(entries) <= folds
            for place in range(count):
                start, turns = [entry for entry in entries if entry[0] <= place][-1]
                fold = turns[(place - start) % len(turns)]
                assert fold == loads.index(min(loads)) + 1
                loads[fold - 1] += size
    # One group with a third of all rows fills a fold alone.
    names = ["big"] * 20 + [f"g{n % 13}" for n in range(40)]
    frame = spark.createDataFrame(list(enumerate(names)), "beatmap_id long, grp string")
    rows = splits.cross_validation_folds(splits.group_keys(frame, "grp"), folds=3, seed=3).collect()
    sizes = sorted(sum(row["fold"] == fold for row in rows) for fold in (1, 2, 3))
    assert sizes[0] >= 18 and len(rows) == 60


def test_blank_groups_stand_alone(spark):
    frame = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "beatmap_id long, grp string")
    grouped = splits.group_keys(frame, "grp")
    assert {r["split_group"] for r in grouped.collect()} == {"__row_1", "__row_2", "x"}
    assert splits.has_groups(grouped)


def test_linear_baseline(spark):
    rows = [(1.0, 0.95, True), (2.0, 0.90, True), (3.0, 0.85, True), (4.0, 0.0, False)]
    frame = spark.createDataFrame(rows, "x double, y double, is_train boolean").withColumn("k", F.lit(1))
    fit = splits.linear_baseline(frame, ["k"], "x", "y", "is_train").head()
    assert fit["intercept"] + 4 * fit["slope"] == pytest.approx(0.80)
    flat = splits.linear_baseline(frame.withColumn("x", F.lit(2.0)), ["k"], "x", "y", "is_train").head()
    assert flat["slope"] is None and flat["intercept"] is None


PRED = "beatmap_id long, actual_mean_acc double, pred_mean_acc double"
NAMES = "beatmap_id long, title string, artist string, mapper string, version string"


def test_rankings_and_review(spark):
    predictions = spark.createDataFrame([(1, 0.9, 0.95), (2, 0.8, 0.6), (3, 0.99, 0.9)], PRED)
    names = spark.createDataFrame([(i, f"t{i}", "a", None, "v") for i in (1, 2, 3)], NAMES)
    rows = {r["ranking_section"]: r for r in review.prediction_rankings(predictions, names, top_n=1).collect()}
    assert rows["predicted_hardest"]["beatmap_id"] == 2 and rows["predicted_easiest"]["beatmap_id"] == 1
    assert rows["largest_abs_error"]["beatmap_id"] == 2 and rows["largest_abs_error"]["mapper"] == ""
    reasons = {r["review_reason"]: r for r in review.human_review(predictions, names, ["mean_acc"], top_n=1).collect()}
    assert reasons["observed_lowest_mean_acc"]["beatmap_id"] == 2
    assert reasons["largest_mean_acc_disagreement"]["error_mean_acc"] == pytest.approx(-0.2)


def test_pair_disagreement(spark):
    predictions = spark.createDataFrame([(1, 0.95, 0.70), (2, 0.80, 0.90), (3, 0.99, 0.99)], PRED)
    names = spark.createDataFrame([(i, f"t{i}", "a", "m", "v") for i in (1, 2, 3)], NAMES)
    rows = review.pairwise_review(predictions, names).collect()
    assert [(r["model_harder_beatmap_id"], r["observed_harder_beatmap_id"]) for r in rows] == [(1, 2)]
    assert rows[0]["disagreement_strength"] == pytest.approx(0.35) and rows[0]["model_harder_title"] == "t1"


def test_error_slices(spark):
    predictions = spark.createDataFrame([(1, 0.9, 0.8), (2, 0.8, 0.9), (3, 0.7, 0.75), (4, 0.6, 0.65)], PRED)
    names = spark.createDataFrame([(1, 10), (2, 50), (3, 90), (4, 100)], "beatmap_id long, score_count long")
    slices = review.error_slices(predictions, names)
    rows = {(r["slice_column"], r["slice_value"]): r for r in slices.collect()}
    assert rows[("overall", "all")]["count"] == 4 and rows[("overall", "all")]["mae"] == pytest.approx(0.075)
    assert {"low", "mid", "high"} == {v for c, v in rows if c == "score_count"}
    assert review.worst_slices(slices, top_n=1).head()["slice"] == "score_count: low"


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 10])
def test_tertiles_equal_pandas(spark, size):
    import pandas as pd

    frame = spark.createDataFrame([("c", i, float(i % 3)) for i in range(size)], "k string, id long, v double")
    got = {r["id"]: r["bin"] for r in review.quantile_bins(frame, ["k"], "v", ["id"]).collect()}
    values = pd.Series([float(i % 3) for i in range(size)])
    if size == 1:
        expected = ["all"]
    else:
        names = ["low", "high"] if size == 2 else ["low", "mid", "high"]
        expected = pd.qcut(values.rank(method="first"), q=len(names), labels=names).tolist()
    assert [got[i] for i in range(size)] == expected


def test_gaps_no_pair_meets(spark):
    rows = [(i, (i * 37 % 101) / 7, (i * 53 % 97) / 5) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, actual double, pred double")
    assert strongest_inversions(frame, "actual", "pred", "id", top_n=5, min_pred_gap=50.0, min_actual_gap=50.0).count() == 0
    tied = spark.createDataFrame([(i, float(i % 2), float(-(i % 2))) for i in range(40)], "id long, actual double, pred double")
    best = strongest_inversions(tied, "actual", "pred", "id", top_n=3, min_pred_gap=1.0, min_actual_gap=1.0).collect()
    assert [(r["i_id"], r["j_id"], r["strength"]) for r in best] == [(1, 0, 2.0), (1, 2, 2.0), (1, 4, 2.0)]


def test_pair_counts_stay_exact_when_large(spark):
    n = 3_000_000_000
    cells = [(n, 0, n, 0, n, 3 * n), (n, n, n, n, n, 3 * n), (n, 2 * n, n, 2 * n, n, 3 * n)]
    frame = spark.createDataFrame(cells, "n long, a_before long, a_ties long, p_before long, p_ties long, total long")
    assert int(frame.agg(comparable_pairs()).first()[0]) == 3 * n * n


@pytest.mark.parametrize("groups", [1, 2, 3])
def test_split_needs_three_groups(spark, groups):
    rows = spark.createDataFrame([(i, f"g{i % groups}") for i in range(12)], "beatmap_id long, split_group string")
    if groups < 3:
        with pytest.raises(ValueError):
            splits.split_by_group(rows, seed=1)
        folds = splits.cross_validation_folds(rows, folds=2, seed=1)  # rows are dealt instead
        assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [6, 6]
        return
    parts = splits.split_by_group(rows, seed=1)
    assert parts.select("split", "split_group").distinct().count() == 3 == parts.select("split").distinct().count()


def test_spread_of_nearly_equal_accuracies(spark):
    values = [0.9999999 + i * 1e-13 for i in range(50)]
    frame = spark.createDataFrame([(1, v) for v in values], "beatmap_id long, accuracy double")
    assert labels.accuracy_labels(frame).head()["acc_std"] == pytest.approx(float(np.std(values)), rel=1e-3)


def test_joins_of_charts_and_groups_are_no_broadcasts(spark):
    """Small files of many rows fill the driver when they are broadcast (q_cv_oof, q_cv_fold_metrics)."""
    dealt = splits.cross_validation_folds(_groups(spark), folds=3, seed=1)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [split_group" in plan
    maps = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "beatmap_id long, title string")
    scores = spark.createDataFrame([(1, 0.9), (1, 0.8), (2, 0.7)], "beatmap_id long, accuracy double")
    labelled = labels.score_labels(scores, maps)
    assert "SortMergeJoin [beatmap_id" in labelled._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["title"] for r in labelled.collect()) == ["a", "b", "c"]
