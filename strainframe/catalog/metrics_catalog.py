"""Prediction metric, rank and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainframe.catalog.registry import query, rounded
from strainframe.operators import labels, metrics, splits
from strainframe.session import cut_lineage
from strainframe.sources import tables

TARGETS = ["mean_acc", "acc_std", "skill_gap"]


def chart_labels(spark, folder):
    return labels.score_labels(tables.scores(spark, folder), tables.maps(spark, folder))


def stored_labels(spark, folder):
    """The label table written once, for queries that read it several times."""
    return cut_lineage(chart_labels(spark, folder))


def predictions(spark, folder, rows=None):
    """Wide predictions, stored with nine decimals: labels against a rule on the chart length."""
    rows = chart_labels(spark, folder) if rows is None else rows
    size = F.floor(F.col("length_ms") / 1000) - 25
    return rows.select(
        "beatmap_id",
        F.round("mean_acc", 9).alias("actual_mean_acc"),
        (F.lit(0.95) + size / F.lit(1000.0)).alias("pred_mean_acc"),
        F.round("acc_std", 9).alias("actual_acc_std"),
        (F.lit(0.02) + size / F.lit(5000.0)).alias("pred_acc_std"),
        F.round("skill_gap", 9).alias("actual_skill_gap"),
        (F.lit(0.045) + size / F.lit(2000.0)).alias("pred_skill_gap"),
    )


def stored_predictions(spark, folder):
    """Predictions over the stored label table, for reports that read them several times."""
    return predictions(spark, folder, stored_labels(spark, folder))


def long_predictions(spark, folder):
    return metrics.long_predictions(stored_predictions(spark, folder), TARGETS)


@query(
    "q_predictions_long",
    """SELECT beatmap_id, target, round(actual, 10) AS actual, round(pred, 10) AS pred, round(pred - actual, 10) AS error
       FROM long_predictions""",
)
def q_predictions_long(spark, folder):
    rows = metrics.long_predictions(predictions(spark, folder), TARGETS).withColumn("error", F.col("pred") - F.col("actual"))
    return rounded(rows, "actual", "pred", "error", digits=10)


@query(
    "q_predictions_wide",
    "SELECT beatmap_id, "
    + ", ".join(
        f"round(actual_{t}, 10) AS actual_{t}, round(pred_{t}, 10) AS pred_{t}, round(pred_{t} - actual_{t}, 10) AS error_{t}"
        for t in TARGETS
    )
    + " FROM predictions",
)
def q_predictions_wide(spark, folder):
    wide = metrics.wide_predictions(metrics.long_predictions(predictions(spark, folder), TARGETS), TARGETS)
    return rounded(wide, *[name for name in wide.columns if name != "beatmap_id"], digits=10)


TRAIN_VIEWS = {
    "row_order": """
        SELECT beatmap_id, row_number() OVER (ORDER BY md5('7|' || CAST(beatmap_id AS VARCHAR)), beatmap_id) - 1 AS place,
               count(*) OVER () AS size FROM chart_labels""",
    "row_split": """
        SELECT beatmap_id, CASE WHEN place < floor(size * 0.8) THEN 'train' WHEN place < floor(size * 0.9) THEN 'val'
               ELSE 'test' END AS split FROM row_order""",
    "train_stats": """
        SELECT target, avg(actual) AS m, CASE WHEN stddev_pop(actual) < 1e-6 THEN 1 ELSE stddev_pop(actual) END AS s
        FROM long_predictions JOIN row_split USING (beatmap_id) WHERE split = 'train' GROUP BY target""",
}


def train_rows(spark, folder):
    """Long predictions, and those of the training rows."""
    rows = stored_labels(spark, folder)
    every = metrics.long_predictions(predictions(spark, folder, rows), TARGETS)
    split = splits.split_by_row(rows.select("beatmap_id"), seed=7)
    return every, every.join(split.filter("split = 'train'"), "beatmap_id", "left_semi")


@query(
    "q_target_stats",
    "SELECT target, round(m, 8) AS target_mean, round(s, 8) AS target_std FROM train_stats",
    extra=TRAIN_VIEWS,
)
def q_target_stats(spark, folder):
    return rounded(metrics.target_stats(train_rows(spark, folder)[1]), "target_mean", "target_std", digits=8)


@query(
    "q_standardize_targets",
    """SELECT beatmap_id, target, round((actual - m) / s, 7) AS scaled, round(actual, 10) AS restored
       FROM long_predictions JOIN train_stats USING (target)""",
    extra=TRAIN_VIEWS,
)
def q_standardize_targets(spark, folder):
    every, train = train_rows(spark, folder)
    scaled = metrics.standardised(every, metrics.target_stats(train)).select("beatmap_id", "target", "scaled", "restored")
    return rounded(rounded(scaled, "scaled", digits=7), "restored", digits=10)


SUMMARY = [
    "actual_mean", "pred_mean", "bias", "mae", "median_abs_error", "p90_abs_error", "max_abs_error",
    "over_prediction_rate", "under_prediction_rate", "actual_std", "pred_std",
]

SUMMARY_SQL = """
    SELECT target, count(*) AS count, avg(actual) AS actual_mean, avg(pred) AS pred_mean, avg(pred - actual) AS bias,
           avg(abs(pred - actual)) AS mae, quantile_cont(abs(pred - actual), 0.5) AS median_abs_error,
           quantile_cont(abs(pred - actual), 0.9) AS p90_abs_error, max(abs(pred - actual)) AS max_abs_error,
           avg((pred > actual)::INT) AS over_prediction_rate, avg((pred < actual)::INT) AS under_prediction_rate,
           stddev_pop(actual) AS actual_std, stddev_pop(pred) AS pred_std
    FROM long_predictions GROUP BY target"""


@query(
    "q_prediction_summary",
    "SELECT target, count, " + ", ".join(f"round({n}, 9) AS {n}" for n in SUMMARY) + " FROM summary",
    extra={"summary": SUMMARY_SQL},
)
def q_prediction_summary(spark, folder):
    return rounded(metrics.prediction_summary(long_predictions(spark, folder)), *SUMMARY, digits=9)


RANK_VIEWS = {
    "ranked": """
        SELECT *, rank() OVER (PARTITION BY target ORDER BY actual) - 1
                  + (count(*) OVER (PARTITION BY target, actual) - 1) / 2.0::DOUBLE AS actual_rank,
               rank() OVER (PARTITION BY target ORDER BY pred) - 1
                  + (count(*) OVER (PARTITION BY target, pred) - 1) / 2.0::DOUBLE AS pred_rank
        FROM long_predictions""",
    "spearmans": """
        SELECT target, CASE WHEN count(*) < 2 OR stddev_pop(actual_rank) = 0 OR stddev_pop(pred_rank) = 0 THEN 0
                            ELSE corr(actual_rank, pred_rank) END AS spearman
        FROM ranked GROUP BY target""",
    "pair_counts": """
        SELECT target, count(*) AS comparable, CAST(count_if((a.actual < b.actual) = (a.pred < b.pred)) AS BIGINT) AS correct
        FROM long_predictions a JOIN long_predictions b USING (target)
        WHERE a.beatmap_id < b.beatmap_id AND a.actual <> b.actual AND a.pred <> b.pred GROUP BY target""",
    "means": "SELECT target, avg(actual) AS m FROM long_predictions GROUP BY target",
    "fits": """
        SELECT target, regr_slope(actual, difficulty_rating) AS slope, regr_intercept(actual, difficulty_rating) AS icept
        FROM long_predictions JOIN maps USING (beatmap_id) GROUP BY target""",
    "errors": """
        SELECT target, count(*) AS count, avg(abs(actual - pred)) AS mae,
               1 - sum((actual - pred) * (actual - pred)) / sum((actual - m) * (actual - m)) AS r2,
               avg(abs(actual - m)) AS baseline_mae,
               avg(abs(actual - (icept + slope * difficulty_rating))) AS difficulty_rating_baseline_mae
        FROM long_predictions JOIN means USING (target) JOIN fits USING (target) JOIN maps USING (beatmap_id)
        GROUP BY target""",
}


@query(
    "q_average_ranks",
    "SELECT beatmap_id, target, actual_rank, pred_rank FROM ranked",
    extra=RANK_VIEWS,
)
def q_average_ranks(spark, folder):
    rows = long_predictions(spark, folder)
    rows = metrics.ranked_values(rows, ["target"], "actual", "actual_rank")
    rows = metrics.ranked_values(rows, ["target"], "pred", "pred_rank")
    return rows.select("beatmap_id", "target", "actual_rank", "pred_rank")


@query("q_spearman", "SELECT target, round(spearman, 8) AS spearman FROM spearmans", extra=RANK_VIEWS)
def q_spearman(spark, folder):
    return rounded(metrics.spearman(long_predictions(spark, folder), ["target"]), "spearman", digits=8)


@query(
    "q_pairwise_order_accuracy",
    """SELECT target, comparable, correct, round(correct / comparable::DOUBLE, 9) AS pairwise_order_accuracy
       FROM pair_counts""",
    extra=RANK_VIEWS,
)
def q_pairwise_order_accuracy(spark, folder):
    result = metrics.pairwise_order_accuracy(long_predictions(spark, folder), ["target"])
    result = result.withColumns({name: F.col(name).cast("long") for name in ("comparable", "correct")})
    return rounded(result, "pairwise_order_accuracy", digits=9)


REPORT = [
    "mae", "r2", "spearman", "pairwise_order_accuracy", "baseline_mae", "mae_improvement_vs_baseline",
    "mae_improvement_pct", "difficulty_rating_baseline_mae", "mae_improvement_vs_difficulty_rating_baseline",
    "mae_improvement_pct_vs_difficulty_rating_baseline",
]

REPORT_SQL = """
    SELECT target, count, mae, r2, spearman, correct / comparable::DOUBLE AS pairwise_order_accuracy, baseline_mae,
           baseline_mae - mae AS mae_improvement_vs_baseline, (baseline_mae - mae) / baseline_mae AS mae_improvement_pct,
           difficulty_rating_baseline_mae,
           difficulty_rating_baseline_mae - mae AS mae_improvement_vs_difficulty_rating_baseline,
           (difficulty_rating_baseline_mae - mae) / difficulty_rating_baseline_mae
               AS mae_improvement_pct_vs_difficulty_rating_baseline
    FROM errors JOIN spearmans USING (target) JOIN pair_counts USING (target)"""


def with_baselines(rows, charts):
    """Train-mean and difficulty-rating baselines fitted on the same rows."""
    joined = rows.join(charts.select("beatmap_id", "difficulty_rating"), "beatmap_id")
    means = rows.groupBy("target").agg(F.avg("actual").alias("baseline"))
    fits = joined.groupBy("target").agg(
        F.regr_slope("actual", "difficulty_rating").alias("slope"),
        F.regr_intercept("actual", "difficulty_rating").alias("intercept"),
    )
    fitted = joined.join(F.broadcast(means), "target").join(F.broadcast(fits), "target")
    return fitted.withColumn(
        "difficulty_rating_baseline", F.col("intercept") + F.col("slope") * F.col("difficulty_rating")
    ).drop("slope", "intercept", "difficulty_rating")


@query(
    "q_regression_report",
    "SELECT target, count, " + ", ".join(f"round({n}, 7) AS {n}" for n in REPORT) + " FROM report",
    extra={**RANK_VIEWS, "report": REPORT_SQL},
)
def q_regression_report(spark, folder):
    rows = with_baselines(long_predictions(spark, folder), tables.maps(spark, folder))
    report = metrics.regression_report(rows, ["target"], ["baseline", "difficulty_rating_baseline"])
    return rounded(report.select("target", "count", *REPORT), *REPORT, digits=7)


@query(
    "q_validation_metrics",
    """SELECT round(avg(mae), 8) AS val_mean_mae,
              round(avg(correct / comparable::DOUBLE), 8) AS val_mean_pairwise_order_accuracy
       FROM errors JOIN pair_counts USING (target)""",
    extra=RANK_VIEWS,
)
def q_validation_metrics(spark, folder):
    report = metrics.regression_report(long_predictions(spark, folder), ["target"])
    return rounded(metrics.validation_metrics(report, []), "val_mean_mae", "val_mean_pairwise_order_accuracy", digits=8)


@query(
    "q_huber_loss",
    """SELECT target, round(avg(loss * tw * rw) / greatest(avg(rw), 1e-6), 9) AS huber_loss FROM (
           SELECT target, CASE target WHEN 'mean_acc' THEN 1.0 ELSE 0.5 END::DOUBLE AS tw,
                  greatest(0.25, least(1.0, score_count / 40.0::DOUBLE)) AS rw,
                  CASE WHEN abs(pred - actual) <= 0.01 THEN 0.5 * (pred - actual) * (pred - actual)
                       ELSE 0.01 * (abs(pred - actual) - 0.005) END AS loss
           FROM long_predictions JOIN chart_labels USING (beatmap_id)) GROUP BY target""",
)
def q_huber_loss(spark, folder):
    charts = chart_labels(spark, folder).select("beatmap_id", "score_count")
    rows = long_predictions(spark, folder).join(charts, "beatmap_id")
    rows = rows.withColumns(
        {
            "tw": F.when(F.col("target") == "mean_acc", 1.0).otherwise(0.5),
            "rw": labels.sample_weight(F.col("score_count"), max_value=40.0),
        }
    )
    loss = metrics.huber_loss(rows, ["target"], delta=0.01, target_weight="tw", row_weight="rw")
    return rounded(loss, "huber_loss", digits=9)


# --- splits -----------------------------------------------------------------

GROUPED_SQL = """
    SELECT beatmap_id, CASE WHEN grp IS NULL OR grp = '' THEN '__row_' || CAST(beatmap_id AS VARCHAR) ELSE grp END AS split_group
    FROM (SELECT beatmap_id, CASE WHEN beatmap_id % 19 = 0 THEN '' WHEN beatmap_id % 23 = 0 THEN NULL
                                  ELSE beatmapset_id || '/' || CAST(length_ms // 10000 AS VARCHAR) END AS grp FROM chart_labels)"""

SPLIT_VIEWS = {
    "grouped": GROUPED_SQL,
    "group_order": """
        SELECT split_group, row_number() OVER (ORDER BY md5('42|' || split_group), split_group) - 1 AS place,
               count(*) OVER () AS size FROM (SELECT DISTINCT split_group FROM grouped)""",
    "group_parts": """
        SELECT *, CASE WHEN 2 * tenth >= size THEN 1 ELSE tenth END AS part
        FROM (SELECT *, greatest(1, CAST(round_even(size * 0.1, 0) AS BIGINT)) AS tenth FROM group_order)""",
    "fold_order": """
        SELECT split_group, rows, row_number() OVER (ORDER BY rows DESC, md5('42|' || split_group), split_group) - 1 AS place
        FROM (SELECT split_group, count(*) AS rows FROM grouped GROUP BY split_group)""",
    "folds": """
        WITH RECURSIVE dealt AS (
            SELECT CAST(-1 AS BIGINT) AS place, [0, 0, 0, 0, 0]::BIGINT[] AS loads, CAST(NULL AS BIGINT) AS fold
            UNION ALL
            SELECT place, list_transform([1, 2, 3, 4, 5], lambda i: loads[i] + CASE WHEN i = fold THEN rows ELSE 0 END), fold
            FROM (SELECT o.place, rows, loads, CAST(list_position(loads, list_min(loads)) AS BIGINT) AS fold
                  FROM dealt JOIN fold_order o ON o.place = dealt.place + 1))
        SELECT beatmap_id, grouped.split_group, fold
        FROM grouped JOIN fold_order USING (split_group) JOIN dealt USING (place)""",
}


def grouped_charts(spark, folder, rows=None):
    rows = stored_labels(spark, folder) if rows is None else rows
    group = (
        F.when(F.col("beatmap_id") % 19 == 0, "")
        .when(F.col("beatmap_id") % 23 == 0, None)
        .otherwise(F.concat_ws("/", "beatmapset_id", F.floor(F.col("length_ms") / 10000).cast("string")))
    )
    return splits.group_keys(rows.withColumn("grp", group), "grp")


@query("q_dataset_groups", "SELECT beatmap_id, split_group FROM grouped", extra=SPLIT_VIEWS)
def q_dataset_groups(spark, folder):
    return grouped_charts(spark, folder).select("beatmap_id", "split_group")


@query(
    "q_group_split",
    """SELECT beatmap_id, split_group, CASE WHEN place < size - 2 * part THEN 'train' WHEN place < size - part THEN 'val'
              ELSE 'test' END AS split FROM grouped JOIN group_parts USING (split_group)""",
    extra=SPLIT_VIEWS,
)
def q_group_split(spark, folder):
    rows = grouped_charts(spark, folder).select("beatmap_id", "split_group")
    return splits.split_by_group(rows, seed=42)


@query("q_row_split", "SELECT beatmap_id, split FROM row_split", extra=TRAIN_VIEWS)
def q_row_split(spark, folder):
    return splits.split_by_row(stored_labels(spark, folder).select("beatmap_id"), seed=7)


@query("q_cv_folds", "SELECT beatmap_id, split_group, fold FROM folds", extra=SPLIT_VIEWS)
def q_cv_folds(spark, folder):
    rows = grouped_charts(spark, folder).select("beatmap_id", "split_group")
    return splits.cross_validation_folds(rows, folds=5, seed=42)


CV_VIEWS = {
    **SPLIT_VIEWS,
    "rounds": """
        SELECT f.beatmap_id, f.fold, r.round, f.fold <> r.round AS is_train, l.difficulty_rating, t.target, t.actual
        FROM folds f CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]::BIGINT[]) AS round) r
        JOIN chart_labels l USING (beatmap_id) JOIN long_predictions t USING (beatmap_id)""",
    "round_fits": """
        SELECT round, target, regr_slope(actual, difficulty_rating) AS slope,
               regr_intercept(actual, difficulty_rating) AS icept, avg(actual) AS baseline
        FROM rounds WHERE is_train GROUP BY round, target""",
    "oof": """
        SELECT beatmap_id, fold, target, round(actual, 9) AS actual, round(icept + slope * difficulty_rating, 7) AS pred, baseline
        FROM rounds JOIN round_fits USING (round, target) WHERE NOT is_train""",
}


def fold_rows(spark, folder, more=()):
    """Labels long by target, stored with nine decimals like the predictions, with their fold and further label columns.

    Fits, means and held-out rows all read them, so they are written once.
    """
    charts = stored_labels(spark, folder)
    rows = grouped_charts(spark, folder, charts)
    folds = splits.cross_validation_folds(rows.select("beatmap_id", "split_group"), folds=5, seed=42)
    targets = F.explode(
        F.array(*[F.struct(F.lit(name).alias("target"), F.round(name, 9).alias("actual")) for name in TARGETS])
    )
    # A row a chart on both sides: no broadcast, and one row for all targets until they have met.
    values = rows.select("beatmap_id", "difficulty_rating", *TARGETS).join(folds.hint("merge"), "beatmap_id")
    if more:
        values = values.join(charts.select("beatmap_id", *more).hint("merge"), "beatmap_id")
    values = values.select("beatmap_id", "difficulty_rating", targets.alias("_t"), "split_group", "fold", *more)
    return cut_lineage(values.select("beatmap_id", "difficulty_rating", "_t.target", "_t.actual", "split_group", "fold", *more))


def linear_oof(rows, folds=5):
    """Out-of-fold predictions of the linear baseline, with the train mean next to them."""
    rounds = splits.fold_rounds(rows, folds)
    keys = ["round", "target"]
    fits = splits.linear_baseline(rounds, keys, "difficulty_rating", "actual", "is_train", together=["round"])
    means = splits.mean_baseline(rounds, keys, "actual", "is_train")
    models = fits.join(means, keys)  # folds x targets rows
    held_out = rows.join(F.broadcast(models.withColumnRenamed("round", "fold")), ["fold", "target"])
    pred = F.col("intercept") + F.col("slope") * F.col("difficulty_rating")
    return held_out.withColumns({"pred": F.round(pred, 7), "actual": F.round("actual", 9)})


@query(
    "q_linear_baseline",
    """SELECT round, target, round(icept, 7) AS intercept, round(slope, 9) AS slope FROM round_fits""",
    extra=CV_VIEWS,
)
def q_linear_baseline(spark, folder):
    rounds = splits.fold_rounds(fold_rows(spark, folder), 5)
    fits = splits.linear_baseline(
        rounds, ["round", "target"], "difficulty_rating", "actual", "is_train", together=["round"]
    )
    return rounded(rounded(fits, "intercept", digits=7), "slope", digits=9)


@query(
    "q_mean_baseline",
    "SELECT round, target, round(baseline, 8) AS baseline FROM round_fits",
    extra=CV_VIEWS,
)
def q_mean_baseline(spark, folder):
    rounds = splits.fold_rounds(fold_rows(spark, folder), 5)
    return rounded(splits.mean_baseline(rounds, ["round", "target"], "actual", "is_train"), "baseline", digits=8)


@query(
    "q_cv_oof",
    """SELECT beatmap_id, fold, target, round(actual, 10) AS actual, round(pred, 10) AS pred, round(baseline, 7) AS baseline
       FROM oof""",
    extra=CV_VIEWS,
)
def q_cv_oof(spark, folder):
    rows = linear_oof(fold_rows(spark, folder))
    names = ["actual", "pred", "baseline"]
    return rounded(rows.select("beatmap_id", "fold", "target", *names), "baseline", digits=7)


FOLD_METRICS = ["mae", "r2", "baseline_mae", "mae_improvement_vs_baseline", "mae_improvement_pct"]


CV_FOLD_METRICS_SQL = (
    """SELECT fold, target, val_size, comparable_accuracy AS pairwise_order_accuracy, spearman, """
    + ", ".join(f"round({n}, 6) AS {n}" for n in FOLD_METRICS)
    + """ FROM (
        SELECT *, baseline_mae - mae AS mae_improvement_vs_baseline, (baseline_mae - mae) / baseline_mae AS mae_improvement_pct
        FROM (SELECT fold, target, count(*) AS val_size, avg(abs(actual - pred)) AS mae,
                     1 - sum((actual - pred) ** 2) / sum((actual - fm) ** 2) AS r2, avg(abs(actual - baseline)) AS baseline_mae
              FROM (SELECT *, avg(actual) OVER (PARTITION BY fold, target) AS fm FROM oof) GROUP BY fold, target)
        JOIN (SELECT fold, target, round(count_if((a.actual < b.actual) = (a.pred < b.pred)) / count(*)::DOUBLE, 8) AS comparable_accuracy
              FROM oof a JOIN oof b USING (fold, target)
              WHERE a.beatmap_id < b.beatmap_id AND a.actual <> b.actual AND a.pred <> b.pred GROUP BY fold, target)
        USING (fold, target)
        JOIN (SELECT fold, target, round(corr(ra, rp), 7) AS spearman FROM (
                SELECT fold, target, rank() OVER (PARTITION BY fold, target ORDER BY actual)
                         + (count(*) OVER (PARTITION BY fold, target, actual) - 1) / 2.0::DOUBLE AS ra,
                       rank() OVER (PARTITION BY fold, target ORDER BY pred)
                         + (count(*) OVER (PARTITION BY fold, target, pred) - 1) / 2.0::DOUBLE AS rp FROM oof)
              GROUP BY fold, target) USING (fold, target))"""
)


def fold_metrics(rows):
    report = metrics.regression_report(rows, ["fold", "target"], ["baseline"]).withColumnRenamed("count", "val_size")
    report = rounded(rounded(report, *FOLD_METRICS), "pairwise_order_accuracy", digits=8)
    return rounded(report, "spearman", digits=7)


@query("q_cv_fold_metrics", CV_FOLD_METRICS_SQL, extra=CV_VIEWS)
def q_cv_fold_metrics(spark, folder):
    return fold_metrics(linear_oof(fold_rows(spark, folder)))
