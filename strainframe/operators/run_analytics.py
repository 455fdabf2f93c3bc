"""Comparing training runs: health, speed, verdicts, calibration, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainframe.functions.casts import finite
from strainframe.plans.ordered import OrderedRuns

RUN = ["run"]
EVALUATION = ["run", "evaluation"]


def _c(name: str) -> Column:
    return F.col(name)


def numbered_history(log: DataFrame, order: Sequence[str]) -> DataFrame:
    """Epochs 1.. per run in log order."""
    runs = OrderedRuns.build(log, RUN, order).indexed("_place")
    return runs.rows().withColumn("epoch", _c("_place") + 1).drop("_place")


def training_health(history: DataFrame) -> DataFrame:
    """Best and last epoch per run, gaps, and the overfit signal.

    Rows without epoch or a loss do not count. Best is the first optimum, last
    the highest epoch that has the value.
    """
    rows = history.filter("epoch is not null and train_loss is not null and val_loss is not null")
    first_low = lambda value, picked: F.min_by(picked, F.when(value.isNotNull(), F.struct(value, _c("epoch"))))
    first_high = lambda value, picked: F.min_by(picked, F.when(value.isNotNull(), F.struct(-value, _c("epoch"))))
    latest = lambda value: F.max_by(value, F.when(value.isNotNull(), _c("epoch")))
    mae = _c("val_mean_mae").try_cast("double")
    order = _c("val_mean_pairwise_order_accuracy").try_cast("double")
    summary = rows.groupBy(*RUN).agg(
        first_low(_c("val_loss"), _c("epoch")).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.max("epoch").alias("final_epoch"),
        F.max_by("train_loss", "epoch").alias("final_train_loss"),
        F.max_by("val_loss", "epoch").alias("final_val_loss"),
        first_low(mae, _c("epoch")).alias("best_val_mean_mae_epoch"),
        F.min(mae).alias("best_val_mean_mae"),
        latest(mae).alias("final_val_mean_mae"),
        first_high(order, _c("epoch")).alias("best_val_pairwise_order_epoch"),
        F.max(order).alias("best_val_pairwise_order"),
        latest(order).alias("final_val_pairwise_order"),
    )
    regression = _c("final_val_loss") - _c("best_val_loss")
    gap = _c("final_val_loss") - _c("final_train_loss")
    limit = F.greatest(F.lit(0.01), F.abs(_c("best_val_loss")) * 0.05)
    return summary.withColumns(
        {
            "generalization_gap": gap,
            "val_loss_regression": regression,
            "overfit_signal": F.when((regression > limit) & (gap > 0), "Possible").otherwise("No obvious"),
            "val_mean_mae_since_best": _c("final_val_mean_mae") - _c("best_val_mean_mae"),
        }
    )


def training_performance(history: DataFrame) -> DataFrame:
    """Epoch count and seconds, last learning rate, peak memory; runs without timings drop out."""
    number = lambda name: _c(name).try_cast("double")
    lr = number("lr")
    return (
        history.groupBy(*RUN)
        .agg(
            F.count(number("epoch_seconds")).alias("epoch_count"),
            F.sum(number("epoch_seconds")).alias("total_epoch_seconds"),
            F.avg(number("epoch_seconds")).alias("average_epoch_seconds"),
            F.max_by(lr, F.when(lr.isNotNull(), _c("epoch"))).alias("final_lr"),
            F.max(number("cuda_max_memory_mb")).alias("peak_cuda_memory_mb"),
        )
        .filter("epoch_count > 0")
    )


# Checkpoint metrics and their direction.
CHECKPOINT_METRICS = {"val_loss": "min", "val_mean_mae": "min", "val_mean_pairwise_order_accuracy": "max"}


def checkpoint_pick(history: DataFrame, *, metric: str = "val_loss", patience: int = 8) -> DataFrame:
    """Per run: best epoch by strict improvement, and where patience ends the run.

    An epoch that is not finite never improves. The run stops at the first epoch
    with ``patience`` epochs since the last improvement.
    """
    falling = CHECKPOINT_METRICS[metric] == "min"
    score = finite(_c(metric)) if falling else -finite(_c(metric))
    runs = OrderedRuns.build(history.select(*RUN, "epoch", metric).withColumn("_score", score), RUN, ["epoch"])
    runs = runs.indexed("_place").running({"_best": ("min", _c("_score"))}, inclusive=False)
    improved = _c("_score").isNotNull() & (_c("_best").isNull() | (_c("_score") < _c("_best")))
    runs = runs.with_columns({"_hit": F.when(improved, _c("_place"))}).settled()
    runs = runs.running({"_last_hit": ("max", _c("_hit"))})
    waited = _c("_place") - F.coalesce(_c("_last_hit"), F.lit(-1))
    stop = F.when(waited >= patience, _c("_place"))
    runs = runs.group_totals(RUN, {"_stop": ("min", stop)}) if runs.whole else _with_stop(runs, stop)
    seen = runs.rows().filter(_c("_stop").isNull() | (_c("_place") <= _c("_stop")))
    return seen.groupBy(*RUN).agg(
        F.max_by(_c("epoch"), _c("_hit")).alias("best_epoch"),
        F.max_by(_c(metric), _c("_hit")).alias("best_checkpoint_score"),
        F.count(F.lit(1)).alias("epochs_completed"),
        F.when(F.max("_stop").isNotNull(), "early_stopping").otherwise("completed").alias("stop_reason"),
    )


def _with_stop(runs: OrderedRuns, stop: Column) -> OrderedRuns:
    return runs.settled().group_totals(RUN, {"_stop": ("min", stop)})


# Target order used for ties.
def model_verdict(metrics: DataFrame, target_order: Sequence[str] = ("mean_acc", "acc_std", "skill_gap")) -> DataFrame:
    """Per run and evaluation: means over targets, wins over both baselines, weakest target, next action."""
    value = lambda name: finite(_c(name))
    gain = value("mae_improvement_pct")
    rated = value("mae_improvement_pct_vs_difficulty_rating_baseline")
    places = F.create_map(*[F.lit(x) for place, name in enumerate(target_order) for x in (name, place)])
    place = F.coalesce(F.try_element_at(places, _c("target")), F.lit(len(target_order)))
    mae = value("mae")
    summary = metrics.groupBy(*EVALUATION).agg(
        F.count(F.lit(1)).alias("target_count"),
        F.count(gain).alias("baseline_target_count"),
        F.count_if(gain > 0).alias("targets_beating_baseline"),
        F.count(rated).alias("difficulty_baseline_target_count"),
        F.count_if(rated > 0).alias("targets_beating_difficulty_rating_baseline"),
        F.coalesce(F.max_by("target", F.when(mae.isNotNull(), F.struct(mae, -place))), F.lit("")).alias("weakest_target"),
        F.avg(mae).alias("mean_mae"),
        F.avg(value("pairwise_order_accuracy")).alias("mean_pairwise_order_accuracy"),
        F.avg(value("spearman")).alias("mean_spearman"),
        F.avg(gain).alias("mean_improvement_pct"),
        F.avg(rated).alias("mean_difficulty_rating_improvement_pct"),
    )
    return summary.withColumn("next_action", next_action())


def next_action() -> Column:
    # Advice texts and cut-offs.
    order = _c("mean_pairwise_order_accuracy")
    behind_rating = _c("targets_beating_difficulty_rating_baseline") < _c("difficulty_baseline_target_count")
    behind_mean = _c("targets_beating_baseline") < _c("baseline_target_count")
    return (
        F.when(
            behind_rating,
            "Inspect labels/features before longer GPU training; "
            "the model is not beating difficulty_rating for every target.",
        )
        .when(
            behind_mean,
            F.concat(
                F.lit("Fix "),
                _c("weakest_target"),
                F.lit(
                    " before longer training: inspect error slices "
                    "and human review, then try feature or model tuning."
                ),
            ),
        )
        .when(
            order < 0.55,
            "Prioritize more labels or human judgments before longer GPU training; ranking signal is weak.",
        )
        .when(
            order < 0.70,
            "Run a small feature/model sweep and compare pairwise ordering before a long final run.",
        )
        .otherwise("Keep this run as a baseline and compare the next sweep or human judgments against it.")
    )


def calibration(summary: DataFrame) -> DataFrame:
    """Per run and evaluation, from prediction summaries per target: bias, tail and spread, with a warning."""
    number = lambda name: F.when(~F.isnan(_c(name).try_cast("double")), _c(name).try_cast("double"))
    rows = summary.withColumns({n: number(n) for n in ("bias", "mae", "p90_abs_error", "actual_std", "pred_std")})
    rows = rows.filter("bias is not null")
    ratio = F.when(_c("actual_std") > 1e-9, _c("pred_std") / _c("actual_std"))
    rows = rows.withColumns({"_ratio": ratio, "_size": F.abs("bias")})
    # Equal extremes: the first target by name wins.
    highest = lambda picked, by: F.min_by(picked, F.when(by.isNotNull(), F.struct(-by, _c("target"))))
    lowest = lambda picked, by: F.min_by(picked, F.when(by.isNotNull(), F.struct(by, _c("target"))))
    to_mae = lambda value: F.when(_c("mae") > 1e-9, value / _c("mae"))
    worst_tail = _c("p90_abs_error")
    result = rows.groupBy(*EVALUATION).agg(
        F.avg("_size").alias("calibration_mean_abs_bias"),
        highest(_c("target"), _c("_size")).alias("calibration_worst_bias_target"),
        highest(_c("bias"), _c("_size")).alias("calibration_worst_bias"),
        highest(to_mae(_c("_size")), _c("_size")).alias("calibration_worst_bias_to_mae"),
        highest(_c("target"), worst_tail).alias("calibration_worst_p90_target"),
        F.max(worst_tail).alias("calibration_worst_p90_abs_error"),
        highest(to_mae(worst_tail), worst_tail).alias("calibration_worst_p90_to_mae"),
        F.avg("_ratio").alias("calibration_mean_pred_std_ratio"),
        lowest(_c("target"), _c("_ratio")).alias("calibration_low_spread_target"),
        F.min("_ratio").alias("calibration_low_spread_ratio"),
    )
    return result.withColumn("calibration_warning", calibration_warning())


def calibration_warning() -> Column:
    # Warning texts and cut-offs.
    weakest = "the weakest target"
    named = lambda *names: F.coalesce(*[F.when(_c(n) != "", _c(n)) for n in names], F.lit(weakest))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    bias_target = "calibration_worst_bias_target"
    notes = [
        F.when(
            _c("calibration_mean_pred_std_ratio") < 0.35,
            text(
                "Predictions are too compressed toward the mean; inspect ",
                named("calibration_low_spread_target", bias_target),
                " features, train longer, or raise model capacity.",
            ),
        ),
        F.when(
            _c("calibration_worst_p90_to_mae") >= 2.0,
            text(
                "Tail errors are high on ",
                named("calibration_worst_p90_target"),
                "; inspect largest-error maps and human review before a longer run.",
            ),
        ),
        F.when(
            _c("calibration_worst_bias_to_mae") >= 0.75,
            text(
                named(bias_target),
                " predictions are biased ",
                F.when(_c("calibration_worst_bias") > 0, "high").otherwise("low"),
                "; check label quality and feature coverage before a longer run.",
            ),
        ),
    ]
    return F.concat_ws(" ", *notes)


def training_adjustment() -> Column:
    """Advice from verdict, health, performance, run and calibration columns of one row."""
    # Advice texts and cut-offs.
    order = finite(_c("mean_pairwise_order_accuracy"))
    lower = lambda name: F.lower(F.coalesce(_c(name).cast("string"), F.lit("")))
    warning = F.trim(F.coalesce(_c("calibration_warning"), F.lit("")))
    number = lambda name: finite(_c(name))
    notes = [
        F.when(lower("overfit_signal") == "possible", "Increase regularization or reduce patience/epochs before a longer run."),
        F.when(warning != "", warning),
        F.when(order < 0.55, "Improve labels/human judgments before spending more GPU time.").when(
            order < 0.70, "Run a small LR/dropout/hidden-size sweep before final training."
        ),
        F.when(
            (lower("device") == "cpu") & ~lower("model_name").isin("tabular_forest", "forest"),
            "Move neural training to CUDA/Colab for the next real run.",
        ),
        F.when(number("peak_cuda_memory_mb") >= 14000, "Lower batch size or raise grad_accum_steps to protect CUDA memory."),
        F.when(
            number("average_epoch_seconds") >= 120, "Limit sweep candidates or lower max-notes if iteration is too slow."
        ),
        F.when(
            number("sample_weight_train_downweighted_rate") >= 0.50,
            "Review low score-count labels before trusting a long weighted run.",
        ),
    ]
    joined = F.concat_ws(" ", *notes)
    return F.when(joined != "", joined).otherwise(
        "Keep these settings as a baseline and compare the next run against it."
    )


# Decision columns in order.
DECISION_COLUMNS = [
    "run", "model_name", "evaluation", "device", "git_commit", "git_branch", "git_dirty", "git_status_entries",
    "loss", "huber_delta", "amp_enabled", "effective_batch_size", "grad_clip_norm", "sample_weight_column",
    "sample_weight_train_mean", "sample_weight_train_downweighted_rate", "human_judged_pairs",
    "human_judgment_coverage_rate", "human_model_agreement_rate", "human_proxy_agreement_rate",
    "human_model_vs_proxy_delta", "epochs_completed", "stop_reason", "early_stopped", "curve_best_epoch",
    "curve_best_val_loss", "curve_best_val_mean_mae", "curve_best_val_pairwise_order", "curve_final_val_mean_mae",
    "curve_final_val_pairwise_order", "curve_overfit_signal", "avg_epoch_seconds", "peak_cuda_memory_mb", "targets",
    "mean_mae", "mean_pairwise_order_accuracy", "targets_beating_baseline", "targets_beating_difficulty_rating",
    "weakest_target", "calibration_mean_abs_bias", "calibration_worst_bias_target", "calibration_worst_bias",
    "calibration_worst_p90_target", "calibration_worst_p90_abs_error", "calibration_mean_pred_std_ratio",
    "calibration_warning", "training_adjustment", "next_action",
]
# Decision columns that come from the run itself.
RUN_FIELDS = [
    "model_name", "device", "git_commit", "git_branch", "git_dirty", "git_status_entries", "loss", "huber_delta",
    "amp_enabled", "effective_batch_size", "grad_clip_norm", "sample_weight_column", "sample_weight_train_mean",
    "sample_weight_train_downweighted_rate", "epochs_completed", "stop_reason", "early_stopped",
]


def run_decisions(
    metrics: DataFrame, health: DataFrame, performance: DataFrame, calibrated: DataFrame, judgments: DataFrame
) -> DataFrame:
    """One row per run and evaluation with everything needed to decide what to do next.

    ``metrics`` are run comparison rows; judgments are scores per run and
    evaluation. Absent parts stay NULL.
    """
    info = metrics.groupBy(*EVALUATION).agg(*[F.max(_c(name)).alias(name) for name in RUN_FIELDS])
    judged = judgments.select(
        *EVALUATION,
        F.concat(_c("judged_count").cast("string"), F.lit(" / "), _c("row_count").cast("string")).alias("human_judged_pairs"),
        _c("judgment_coverage_rate").alias("human_judgment_coverage_rate"),
        _c("model_agreement_rate").alias("human_model_agreement_rate"),
        _c("proxy_agreement_rate").alias("human_proxy_agreement_rate"),
        _c("model_vs_proxy_agreement_delta").alias("human_model_vs_proxy_delta"),
    )
    rows = (
        model_verdict(metrics)
        .join(info, EVALUATION)
        .join(health, RUN, "left")
        .join(performance, RUN, "left")
        .join(calibrated, EVALUATION, "left")
        .join(judged, EVALUATION, "left")
    )
    score = lambda wins, of: F.when(
        _c(of) > 0, F.concat(_c(wins).cast("string"), F.lit(" / "), _c(of).cast("string"))
    ).otherwise("")
    named = {
        "curve_best_epoch": _c("best_epoch"),
        "curve_best_val_loss": _c("best_val_loss"),
        "curve_best_val_mean_mae": _c("best_val_mean_mae"),
        "curve_best_val_pairwise_order": _c("best_val_pairwise_order"),
        "curve_final_val_mean_mae": _c("final_val_mean_mae"),
        "curve_final_val_pairwise_order": _c("final_val_pairwise_order"),
        "curve_overfit_signal": _c("overfit_signal"),
        "avg_epoch_seconds": _c("average_epoch_seconds"),
        "targets": _c("target_count"),
        "targets_beating_baseline": score("targets_beating_baseline", "baseline_target_count"),
        "targets_beating_difficulty_rating": score(
            "targets_beating_difficulty_rating_baseline", "difficulty_baseline_target_count"
        ),
        "training_adjustment": training_adjustment(),
    }
    return rows.withColumns(named).select(*DECISION_COLUMNS)
