"""Run comparison queries. A run is a mapper; its evaluations are even and odd charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainframe.catalog.metrics_catalog import RANK_VIEWS, SUMMARY, long_predictions, with_baselines
from strainframe.catalog.registry import query, rounded
from strainframe.catalog.review_catalog import JUDGMENT_VIEWS, judged_pairs
from strainframe.operators import judgments, metrics, run_analytics
from strainframe.session import cut_lineage, scratch_path
from strainframe.sources import files, landed_json, tables

# --- history ----------------------------------------------------------------


def history(spark, folder):
    log = tables.history(spark, folder)
    return run_analytics.numbered_history(log, ["logged_at", "event_id"])


HISTORY = [n for n in files.HISTORY_COLUMNS if n != "epoch"]


@query(
    "q_history_migrate",
    "SELECT run, epoch, "
    + ", ".join(
        f"round({n}, 9) AS {n}" if n in ("train_loss", "val_loss") else f"round(CASE WHEN epoch > 20 THEN {n} END, 9) AS {n}"
        for n in HISTORY
    )
    + " FROM history",
)
def q_history_migrate(spark, folder):
    rows = cut_lineage(history(spark, folder))
    old = rows.filter("epoch <= 20").select("run", "epoch", "train_loss", "val_loss")
    both = files.widened_history(old, rows.filter("epoch > 20"), ["run"])
    return rounded(both, *HISTORY, digits=9)


@query(
    "q_history_append",
    "SELECT run, epoch, "
    + ", ".join(
        f"round({n}, 9) AS {n}" if n in ("train_loss", "val_loss") else f"round(CASE WHEN epoch > 10 THEN {n} END, 9) AS {n}"
        for n in HISTORY
    )
    + " FROM history",
)
def q_history_append(spark, folder):
    """A history of few columns, then a longer one that overlaps it and is appended twice."""
    rows, path = cut_lineage(history(spark, folder)), scratch_path(spark)
    files.append_history(rows.filter("epoch <= 20").select("run", "epoch", "train_loss", "val_loss"), path)
    for _ in range(2):
        files.append_history(rows.filter("epoch > 10"), path)
    return rounded(files.read_history(spark, path).select("run", "epoch", *HISTORY), *HISTORY, digits=9)


HEALTH_SQL = """
    SELECT b.run, best_epoch, best_val_loss, final_epoch, final_train_loss, final_val_loss, best_val_mean_mae_epoch, best_val_mean_mae,
           final_val_mean_mae, best_val_pairwise_order_epoch, best_val_pairwise_order, final_val_pairwise_order,
           final_val_loss - final_train_loss AS generalization_gap, final_val_loss - best_val_loss AS val_loss_regression,
           CASE WHEN final_val_loss - best_val_loss > greatest(0.01, abs(best_val_loss) * 0.05::DOUBLE) AND final_val_loss > final_train_loss
                THEN 'Possible' ELSE 'No obvious' END AS overfit_signal, final_val_mean_mae - best_val_mean_mae AS val_mean_mae_since_best
    FROM (SELECT run, epoch AS best_epoch, val_loss AS best_val_loss FROM
            (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS rn FROM logged) WHERE rn = 1) b
    JOIN (SELECT run, epoch AS final_epoch, train_loss AS final_train_loss, val_loss AS final_val_loss FROM
            (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS rn FROM logged) WHERE rn = 1) f USING (run)
    LEFT JOIN (SELECT run, epoch AS best_val_mean_mae_epoch, val_mean_mae AS best_val_mean_mae FROM
            (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_mean_mae, epoch) AS rn FROM logged WHERE val_mean_mae IS NOT NULL) WHERE rn = 1) m USING (run)
    LEFT JOIN (SELECT run, val_mean_mae AS final_val_mean_mae FROM
            (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS rn FROM logged WHERE val_mean_mae IS NOT NULL) WHERE rn = 1) fm USING (run)
    LEFT JOIN (SELECT run, epoch AS best_val_pairwise_order_epoch, val_mean_pairwise_order_accuracy AS best_val_pairwise_order FROM
            (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_mean_pairwise_order_accuracy DESC, epoch) AS rn FROM logged WHERE val_mean_pairwise_order_accuracy IS NOT NULL) WHERE rn = 1) p USING (run)
    LEFT JOIN (SELECT run, val_mean_pairwise_order_accuracy AS final_val_pairwise_order FROM
            (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch DESC) AS rn FROM logged WHERE val_mean_pairwise_order_accuracy IS NOT NULL) WHERE rn = 1) fp USING (run)"""

RUN_VIEWS = {
    "logged": "SELECT * FROM history WHERE val_loss IS NOT NULL AND train_loss IS NOT NULL",
    "health": HEALTH_SQL,
    "performance": """
        SELECT run, count(epoch_seconds) AS epoch_count, sum(epoch_seconds) AS total_epoch_seconds, avg(epoch_seconds) AS average_epoch_seconds,
               arg_max(lr, epoch) AS final_lr, max(cuda_max_memory_mb) AS peak_cuda_memory_mb FROM history GROUP BY run HAVING count(epoch_seconds) > 0""",
}
HEALTH_NUMBERS = [
    "best_val_loss", "final_train_loss", "final_val_loss", "best_val_mean_mae", "final_val_mean_mae", "best_val_pairwise_order",
    "final_val_pairwise_order", "generalization_gap", "val_loss_regression", "val_mean_mae_since_best",
]


def _sql(names, digits=9):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


@query(
    "q_training_health",
    f"SELECT run, best_epoch, final_epoch, best_val_mean_mae_epoch, best_val_pairwise_order_epoch, overfit_signal, {_sql(HEALTH_NUMBERS)} FROM health",
    extra=RUN_VIEWS,
)
def q_training_health(spark, folder):
    return rounded(run_analytics.training_health(history(spark, folder)), *HEALTH_NUMBERS, digits=9)


@query(
    "q_history_best",
    "SELECT run, best_epoch, round(best_val_loss, 9) AS best_val_loss, final_epoch, round(final_val_loss, 9) AS final_val_loss FROM health",
    extra=RUN_VIEWS,
)
def q_history_best(spark, folder):
    health = run_analytics.training_health(history(spark, folder))
    rows = health.select("run", "best_epoch", "best_val_loss", "final_epoch", "final_val_loss")
    return rounded(rows, "best_val_loss", "final_val_loss", digits=9)


@query(
    "q_training_performance",
    f"SELECT run, epoch_count, total_epoch_seconds, peak_cuda_memory_mb, {_sql(['average_epoch_seconds', 'final_lr'])} FROM performance",
    extra=RUN_VIEWS,
)
def q_training_performance(spark, folder):
    rows = run_analytics.training_performance(history(spark, folder))
    return rounded(rows, "average_epoch_seconds", "final_lr", digits=9)


def _pick_sql(metric, patience, sign):
    return f"""
    SELECT run, arg_max(epoch, epoch) FILTER (WHERE hit) AS best_epoch, round(arg_max({metric}, epoch) FILTER (WHERE hit), 9) AS best_checkpoint_score,
           count(*) AS epochs_completed, CASE WHEN max(stop) IS NOT NULL THEN 'early_stopping' ELSE 'completed' END AS stop_reason
    FROM (SELECT *, min(CASE WHEN epoch - coalesce(last_hit, 0) >= {patience} THEN epoch END) OVER (PARTITION BY run) AS stop
          FROM (SELECT *, max(CASE WHEN hit THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS last_hit
                FROM (SELECT *, s IS NOT NULL AND (best IS NULL OR s < best) AS hit
                      FROM (SELECT *, min(s) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
                            FROM (SELECT *, {sign} {metric} AS s FROM history)))))
    WHERE stop IS NULL OR epoch <= stop GROUP BY run"""


@query("q_checkpoint_pick", _pick_sql("val_loss", 8, ""))
def q_checkpoint_pick(spark, folder):
    picked = run_analytics.checkpoint_pick(history(spark, folder), metric="val_loss", patience=8)
    return rounded(picked, "best_checkpoint_score", digits=9)


@query("q_checkpoint_pick_order", _pick_sql("val_mean_pairwise_order_accuracy", 25, "-"))
def q_checkpoint_pick_order(spark, folder):
    picked = run_analytics.checkpoint_pick(
        history(spark, folder), metric="val_mean_pairwise_order_accuracy", patience=25
    )
    return rounded(picked, "best_checkpoint_score", digits=9)


# --- metrics per run --------------------------------------------------------

RUN_KEYS = ["run", "evaluation", "target"]


def run_predictions(spark, folder):
    charts = tables.maps(spark, folder)
    rows = with_baselines(long_predictions(spark, folder), charts)
    return rows.join(charts.select("beatmap_id", F.col("beatmapset_id").alias("run")), "beatmap_id").withColumn(
        "evaluation", F.when(F.col("beatmap_id") % 2 == 0, "holdout").otherwise("cv_oof")
    )


REPORT = landed_json.TARGET_METRICS


def _number(prefix="run"):
    return F.regexp_extract(prefix, r"(\d+)", 1).cast("int")


# What a run writes about itself, by its number n; the same expressions hold in both engines.
RUN_VALUES = {
    "model_name": "CASE {n} % 3 WHEN 0 THEN 'tabular_forest' WHEN 1 THEN 'lstm' ELSE 'summary' END",
    "seed": "{n}",
    "feature_set": "CASE WHEN {n} % 2 = 0 THEN 'all' ELSE 'sequence' END",
    "split_strategy": "CASE WHEN {n} % 4 = 0 THEN 'row' ELSE 'group' END",
    "group_column": "CASE WHEN {n} % 4 <> 0 THEN 'beatmapset_id' END",
    "group_count": "{n} * 7 + 3",
    "device": "CASE WHEN {n} % 2 = 0 THEN 'cpu' ELSE 'cuda' END",
    "requested_device": "CASE WHEN {n} % 5 = 0 THEN 'auto' WHEN {n} % 2 = 0 THEN 'cpu' ELSE 'cuda' END",
    "amp_enabled": "{n} % 2 = 1",
    "effective_batch_size": "8 * ({n} % 4 + 1)",
    "grad_accum_steps": "{n} % 4 + 1",
    "grad_clip_norm": "CASE WHEN {n} % 6 <> 0 THEN CAST({n} AS DOUBLE) / 4 END",
    "loss": "'huber'",
    "huber_delta": "CAST({n} % 8 AS DOUBLE) / 8",
    "sample_weight_column": "CASE WHEN {n} % 3 <> 1 THEN 'score_count' ELSE '' END",
    "sample_weight_train_mean": "CAST({n} AS DOUBLE) / 16",
    "sample_weight_train_downweighted_rate": "CAST({n} AS DOUBLE) / 40",
    "checkpoint_metric": "CASE WHEN {n} % 2 = 0 THEN 'val_loss' ELSE 'val_mean_mae' END",
    "best_checkpoint_score": "CAST({n} AS DOUBLE) / 32",
    "best_epoch": "{n} * 2 - 1",
    "epochs_completed": "{n} * 2",
    "stop_reason": "CASE WHEN {n} % 3 = 0 THEN 'early_stopping' ELSE 'max_epochs' END",
    "early_stopped": "{n} % 3 = 0",
    "git_commit": "md5(CAST({n} AS VARCHAR(10)))",
    "git_branch": "CASE WHEN {n} % 2 = 0 THEN 'main' ELSE 'try \"new\" heads' END",
    "git_dirty": "{n} % 5 = 0",
    "git_status_entries": "CASE WHEN {n} % 5 = 0 THEN {n} ELSE 0 END",
    "best_val_loss": "CAST({n} AS DOUBLE) / 64",
    "test_loss": "CASE WHEN {n} % 7 <> 0 THEN CAST({n} AS DOUBLE) / 128 END",
    "cv_folds": "CASE WHEN {n} % 2 = 1 THEN 5 END",
    "train_size": "{n} * 80",
    "val_size": "{n} * 10",
    "test_size": "{n} * 10",
    "sample_size": "{n} * 100",
}
RUN_TEXTS = {name: f"CAST({value.replace('{n}', 'n')} AS VARCHAR)" for name, value in RUN_VALUES.items()}


def run_documents(spark, folder, rows=None):
    """metrics JSON per run and evaluation, built from the report."""
    rows = run_predictions(spark, folder) if rows is None else rows
    report = metrics.regression_report(rows, RUN_KEYS, ["baseline", "difficulty_rating_baseline"])
    report = report.select(*RUN_KEYS, *REPORT)
    body = F.struct(*[F.col(n) for n in REPORT])
    n = _number()
    info = F.struct(
        F.when(n % 4 != 0, F.col("evaluation")).alias("evaluation"),
        *[F.expr(value.replace("{n}", "cast(regexp_extract(run, '([0-9]+)', 1) as int)")).alias(name) for name, value in RUN_VALUES.items()],
    )
    # Three targets per document.
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("target"), F.to_json(body))))
    grouped = report.groupBy("run", "evaluation").agg(entries.alias("targets"))
    document = F.map_concat("targets", F.create_map(F.lit("_run"), F.to_json(info)))
    folder_name = F.concat(F.lit("/runs/"), F.col("run"), F.when(F.col("evaluation") == "holdout", "/metrics.json").otherwise("/cv_metrics.json"))
    # Values are JSON texts already, so the object is put together from them.
    members = F.transform(F.map_entries(document), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return grouped.select(
        folder_name.alias("path"),
        F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}")).alias("json"),
        F.col("evaluation").alias("default_evaluation"),
    )


def run_metrics(spark, folder, rows=None):
    return landed_json.run_metric_rows(run_documents(spark, folder, rows))


METRIC_VIEWS = {
    **RANK_VIEWS,
    "run_rows": """
        SELECT *, CASE WHEN beatmap_id % 2 = 0 THEN 'holdout' ELSE 'cv_oof' END AS evaluation, beatmapset_id AS run
        FROM long_predictions JOIN maps USING (beatmap_id)""",
    "run_errors": """
        SELECT run, evaluation, target, count(*) AS count, avg(abs(actual - pred)) AS mae,
               CASE WHEN max(actual) > min(actual) THEN 1 - sum((actual - pred) ** 2) / sum((actual - rm) ** 2) ELSE 0 END AS r2,
               avg(abs(actual - m)) AS baseline_mae, avg(abs(actual - (icept + slope * difficulty_rating))) AS difficulty_rating_baseline_mae
        FROM (SELECT *, avg(actual) OVER (PARTITION BY run, evaluation, target) AS rm FROM run_rows)
        JOIN means USING (target) JOIN fits USING (target) GROUP BY run, evaluation, target""",
    "run_pairs": """
        SELECT run, evaluation, target, count_if((a.actual < b.actual) = (a.pred < b.pred)) / count(*)::DOUBLE AS pairwise
        FROM run_rows a JOIN run_rows b USING (run, evaluation, target)
        WHERE a.beatmap_id < b.beatmap_id AND a.actual <> b.actual AND a.pred <> b.pred GROUP BY run, evaluation, target""",
    "run_ranks": """
        SELECT run, evaluation, target, CASE WHEN stddev_pop(ra) = 0 OR stddev_pop(rp) = 0 THEN 0 ELSE corr(ra, rp) END AS spearman FROM (
            SELECT run, evaluation, target,
                   rank() OVER (PARTITION BY run, evaluation, target ORDER BY actual) + (count(*) OVER (PARTITION BY run, evaluation, target, actual) - 1) / 2.0::DOUBLE AS ra,
                   rank() OVER (PARTITION BY run, evaluation, target ORDER BY pred) + (count(*) OVER (PARTITION BY run, evaluation, target, pred) - 1) / 2.0::DOUBLE AS rp
            FROM run_rows) GROUP BY run, evaluation, target""",
    "run_metrics": """
        SELECT run, evaluation, target, mae, r2, coalesce(spearman, 0) AS spearman,
               coalesce(pairwise, 0) AS pairwise_order_accuracy, baseline_mae,
               baseline_mae - mae AS mae_improvement_vs_baseline, (baseline_mae - mae) / baseline_mae AS mae_improvement_pct,
               difficulty_rating_baseline_mae,
               difficulty_rating_baseline_mae - mae AS mae_improvement_vs_difficulty_rating_baseline,
               (difficulty_rating_baseline_mae - mae) / difficulty_rating_baseline_mae AS mae_improvement_pct_vs_difficulty_rating_baseline,
               CAST(regexp_extract(run, '[0-9]+') AS INT) AS n
        FROM run_errors LEFT JOIN run_pairs USING (run, evaluation, target) LEFT JOIN run_ranks USING (run, evaluation, target)""",
    "verdict_values": """
        SELECT run, evaluation, count(*) AS target_count, count(mae_improvement_pct) AS baseline_target_count,
               CAST(count_if(mae_improvement_pct > 0) AS BIGINT) AS targets_beating_baseline,
               count(mae_improvement_pct_vs_difficulty_rating_baseline) AS difficulty_baseline_target_count,
               CAST(count_if(mae_improvement_pct_vs_difficulty_rating_baseline > 0) AS BIGINT) AS targets_beating_difficulty_rating_baseline,
               arg_max(target, mae) AS weakest_target, avg(mae) AS mean_mae, avg(pairwise_order_accuracy) AS mean_pairwise_order_accuracy,
               avg(spearman) AS mean_spearman, avg(mae_improvement_pct) AS mean_improvement_pct,
               avg(mae_improvement_pct_vs_difficulty_rating_baseline) AS mean_difficulty_rating_improvement_pct
        FROM run_metrics GROUP BY run, evaluation""",
    "verdicts": """
        SELECT *, CASE WHEN targets_beating_difficulty_rating_baseline < difficulty_baseline_target_count
                       THEN 'Inspect labels/features before longer GPU training; the model is not beating difficulty_rating for every target.'
                       WHEN targets_beating_baseline < baseline_target_count
                       THEN 'Fix ' || weakest_target || ' before longer training: inspect error slices and human review, then try feature or model tuning.'
                       WHEN mean_pairwise_order_accuracy < 0.55 THEN 'Prioritize more labels or human judgments before longer GPU training; ranking signal is weak.'
                       WHEN mean_pairwise_order_accuracy < 0.70 THEN 'Run a small feature/model sweep and compare pairwise ordering before a long final run.'
                       ELSE 'Keep this run as a baseline and compare the next sweep or human judgments against it.' END AS next_action
        FROM verdict_values""",
    "run_summary": """
        SELECT run, evaluation, target, avg(pred - actual) AS bias, avg(abs(pred - actual)) AS mae, quantile_cont(abs(pred - actual), 0.9) AS p90,
               stddev_pop(actual) AS actual_std, stddev_pop(pred) AS pred_std FROM run_rows GROUP BY run, evaluation, target""",
    "calibration_values": """
        SELECT run, evaluation, avg(abs(bias)) AS calibration_mean_abs_bias, arg_max(target, abs(bias)) AS calibration_worst_bias_target,
               arg_max(bias, abs(bias)) AS calibration_worst_bias, arg_max(abs(bias) / mae, abs(bias)) AS calibration_worst_bias_to_mae,
               arg_max(target, p90) AS calibration_worst_p90_target, max(p90) AS calibration_worst_p90_abs_error,
               arg_max(p90 / mae, p90) AS calibration_worst_p90_to_mae,
               avg(CASE WHEN actual_std > 1e-9 THEN pred_std / actual_std END) AS calibration_mean_pred_std_ratio,
               arg_min(target, CASE WHEN actual_std > 1e-9 THEN pred_std / actual_std END) AS calibration_low_spread_target,
               min(CASE WHEN actual_std > 1e-9 THEN pred_std / actual_std END) AS calibration_low_spread_ratio
        FROM run_summary GROUP BY run, evaluation""",
    "calibrated": """
        SELECT *, concat_ws(' ',
            CASE WHEN calibration_mean_pred_std_ratio < 0.35 THEN 'Predictions are too compressed toward the mean; inspect '
                 || coalesce(calibration_low_spread_target, calibration_worst_bias_target) || ' features, train longer, or raise model capacity.' END,
            CASE WHEN calibration_worst_p90_to_mae >= 2.0 THEN 'Tail errors are high on ' || calibration_worst_p90_target
                 || '; inspect largest-error maps and human review before a longer run.' END,
            CASE WHEN calibration_worst_bias_to_mae >= 0.75 THEN calibration_worst_bias_target || ' predictions are biased '
                 || CASE WHEN calibration_worst_bias > 0 THEN 'high' ELSE 'low' END
                 || '; check label quality and feature coverage before a longer run.' END) AS calibration_warning FROM calibration_values""",
}

INFO_SQL = ", ".join(f"{RUN_TEXTS[name]} AS {name}" for name in landed_json.RUN_COLUMNS)


@query(
    "q_run_metrics",
    f"SELECT run, target, evaluation, {INFO_SQL}, {_sql(REPORT, 7)} FROM run_metrics",
    extra=METRIC_VIEWS,
)
def q_run_metrics(spark, folder):
    names = ["run", "target", "evaluation", *landed_json.RUN_COLUMNS]
    return rounded(run_metrics(spark, folder).select(*names, *REPORT), *REPORT, digits=7)


@query(
    "q_run_compare_sorted",
    "SELECT evaluation, target, round(mae, 7) AS mae, run FROM run_metrics ORDER BY evaluation, target, run_metrics.mae, run",
    extra=METRIC_VIEWS,
)
def q_run_compare_sorted(spark, folder):
    rows = run_metrics(spark, folder).orderBy("evaluation", "target", "mae", "run")
    return rounded(rows.select("evaluation", "target", "mae", "run"), "mae", digits=7)


VERDICT = ["mean_mae", "mean_pairwise_order_accuracy", "mean_spearman", "mean_improvement_pct", "mean_difficulty_rating_improvement_pct"]
VERDICT_COUNTS = [
    "target_count", "baseline_target_count", "targets_beating_baseline", "difficulty_baseline_target_count",
    "targets_beating_difficulty_rating_baseline", "weakest_target", "next_action",
]


@query(
    "q_model_verdict",
    f"SELECT run, evaluation, {', '.join(VERDICT_COUNTS)}, {_sql(VERDICT, 7)} FROM verdicts",
    extra=METRIC_VIEWS,
)
def q_model_verdict(spark, folder):
    return rounded(run_analytics.model_verdict(run_metrics(spark, folder)), *VERDICT, digits=7)


CALIBRATION = [
    "calibration_mean_abs_bias", "calibration_worst_bias", "calibration_worst_bias_to_mae", "calibration_worst_p90_abs_error",
    "calibration_worst_p90_to_mae", "calibration_mean_pred_std_ratio", "calibration_low_spread_ratio",
]
CALIBRATION_TEXT = ["calibration_worst_bias_target", "calibration_worst_p90_target", "calibration_low_spread_target", "calibration_warning"]


def calibration(spark, folder, rows=None):
    rows = run_predictions(spark, folder) if rows is None else rows
    return run_analytics.calibration(metrics.prediction_summary(rows, RUN_KEYS))


@query(
    "q_calibration",
    f"SELECT run, evaluation, {', '.join(CALIBRATION_TEXT)}, {_sql(CALIBRATION, 7)} FROM calibrated",
    extra=METRIC_VIEWS,
)
def q_calibration(spark, folder):
    return rounded(calibration(spark, folder), *CALIBRATION, digits=7)


def decisions(spark, folder):
    # Health and speed read the history, the report and the calibration the predictions: both are written once.
    rows, predicted = cut_lineage(history(spark, folder)), cut_lineage(run_predictions(spark, folder))
    scores = judgments.judgment_scores(
        judged_pairs(spark, folder).withColumn("run", F.concat(F.lit("Brand#"), (F.col("run") + 1).cast("string"))),
        ["run", "evaluation"],
    )
    return run_analytics.run_decisions(
        cut_lineage(run_metrics(spark, folder, predicted)),
        run_analytics.training_health(rows),
        run_analytics.training_performance(rows),
        calibration(spark, folder, predicted),
        scores,
    )


DECISION_VIEWS = {
    **METRIC_VIEWS,
    **RUN_VIEWS,
    **JUDGMENT_VIEWS,
    "judgment_counts": JUDGMENT_VIEWS["judgment_counts"].format(
        keys="'Brand#' || CAST(run + 1 AS VARCHAR) AS run, evaluation,", group="GROUP BY run, evaluation"
    ),
    "decisions": """
        SELECT *, CASE WHEN notes <> '' THEN notes ELSE 'Keep these settings as a baseline and compare the next run against it.' END AS training_adjustment
        FROM (SELECT *, concat_ws(' ',
            CASE WHEN overfit_signal = 'Possible' THEN 'Increase regularization or reduce patience/epochs before a longer run.' END,
            CASE WHEN calibration_warning <> '' THEN calibration_warning END,
            CASE WHEN mean_pairwise_order_accuracy < 0.55 THEN 'Improve labels/human judgments before spending more GPU time.'
                 WHEN mean_pairwise_order_accuracy < 0.70 THEN 'Run a small LR/dropout/hidden-size sweep before final training.' END,
            CASE WHEN n % 2 = 0 AND n % 3 <> 0 THEN 'Move neural training to CUDA/Colab for the next real run.' END,
            CASE WHEN peak_cuda_memory_mb >= 14000 THEN 'Lower batch size or raise grad_accum_steps to protect CUDA memory.' END,
            CASE WHEN average_epoch_seconds >= 120 THEN 'Limit sweep candidates or lower max-notes if iteration is too slow.' END,
            CASE WHEN n / 40.0 >= 0.5 THEN 'Review low score-count labels before trusting a long weighted run.' END) AS notes
        FROM (SELECT *, CAST(regexp_extract(run, '[0-9]+') AS INT) AS n FROM verdicts) LEFT JOIN health USING (run)
        LEFT JOIN performance USING (run) LEFT JOIN calibrated USING (run, evaluation) LEFT JOIN judgment_counts USING (run, evaluation))""",
}


@query("q_training_adjustment", "SELECT run, evaluation, training_adjustment FROM decisions", extra=DECISION_VIEWS)
def q_training_adjustment(spark, folder):
    return decisions(spark, folder).select("run", "evaluation", "training_adjustment")


DECISION_NUMBERS = {
    "human_judgment_coverage_rate": "judged_count / row_count::DOUBLE",
    "human_model_agreement_rate": "model_agree_count / judged_count::DOUBLE",
    "human_proxy_agreement_rate": "proxy_agree_count / judged_count::DOUBLE",
    "human_model_vs_proxy_delta": "model_agree_count / judged_count::DOUBLE - proxy_agree_count / judged_count::DOUBLE",
    "curve_best_val_loss": "best_val_loss",
    "curve_best_val_mean_mae": "best_val_mean_mae",
    "curve_best_val_pairwise_order": "best_val_pairwise_order",
    "curve_final_val_mean_mae": "final_val_mean_mae",
    "curve_final_val_pairwise_order": "final_val_pairwise_order",
    "avg_epoch_seconds": "average_epoch_seconds",
    "peak_cuda_memory_mb": "peak_cuda_memory_mb",
    "mean_mae": "mean_mae",
    "mean_pairwise_order_accuracy": "mean_pairwise_order_accuracy",
    "calibration_mean_abs_bias": "calibration_mean_abs_bias",
    "calibration_worst_bias": "calibration_worst_bias",
    "calibration_worst_p90_abs_error": "calibration_worst_p90_abs_error",
    "calibration_mean_pred_std_ratio": "calibration_mean_pred_std_ratio",
}
DECISION_TEXTS = {
    **{name: RUN_TEXTS[name] for name in run_analytics.RUN_FIELDS},
    "human_judged_pairs": "CAST(judged_count AS VARCHAR) || ' / ' || CAST(row_count AS VARCHAR)",
    "curve_best_epoch": "best_epoch",
    "curve_overfit_signal": "overfit_signal",
    "targets": "target_count",
    "targets_beating_baseline": "CAST(targets_beating_baseline AS VARCHAR) || ' / ' || CAST(baseline_target_count AS VARCHAR)",
    "targets_beating_difficulty_rating": "CAST(targets_beating_difficulty_rating_baseline AS VARCHAR) || ' / ' || CAST(difficulty_baseline_target_count AS VARCHAR)",
    "weakest_target": "weakest_target",
    "calibration_worst_bias_target": "calibration_worst_bias_target",
    "calibration_warning": "calibration_warning",
    "training_adjustment": "training_adjustment",
    "next_action": "next_action",
    "calibration_worst_p90_target": "calibration_worst_p90_target",
}


@query(
    "q_run_decision",
    "SELECT run, evaluation, "
    + ", ".join(f"{value} AS {name}" for name, value in DECISION_TEXTS.items())
    + ", "
    + ", ".join(f"round({value}, 7) AS {name}" for name, value in DECISION_NUMBERS.items())
    + " FROM decisions",
    extra=DECISION_VIEWS,
)
def q_run_decision(spark, folder):
    return rounded(decisions(spark, folder), *DECISION_NUMBERS, digits=7)
