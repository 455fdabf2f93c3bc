"""Parameter grids, candidate evaluation and selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainframe.operators.metrics import regression_report, usable_rows

# Metric directions and id layouts.
LOWER_IS_BETTER = ["mean_mae", "best_val_loss", "test_loss"]
HIGHER_IS_BETTER = ["mean_r2", "mean_spearman", "mean_pairwise_order_accuracy", "mean_improvement_pct"]
FOREST_ID = "{feature_set}_trees{forest_trees}_leaf{forest_min_samples_leaf}_feat{forest_max_features}"
NEURAL_IDS = {
    "summary": "summary_h{summary_hidden_dim}_do{summary_dropout}",
    "lstm": "lstm_e{lstm_embed_dim}_h{lstm_hidden_dim}_l{lstm_layers}_do{lstm_dropout}_head{lstm_head_dropout}",
    "transformer": (
        "transformer_e{transformer_embed_dim}_h{transformer_heads}_l{transformer_layers}_ff{transformer_ff_dim}"
        "_do{transformer_dropout}_head{transformer_head_dropout}"
    ),
}
SHARED_ID = "_lr{lr}_wd{weight_decay}_bs{batch_size}_hd{huber_delta}"


def _token(value: object) -> str:
    return str(value).replace("-", "m").replace(".", "p")


def option_grid(spark: SparkSession, options: Mapping[str, Sequence[object]], layout: str, *, tokens: bool) -> DataFrame:
    """All combinations of a few option lists, with an id built from ``layout``."""
    grid = None
    for name, values in options.items():
        kind = "string" if any(isinstance(v, str) for v in values) else ("double" if any(isinstance(v, float) for v in values) else "long")
        cast = {"string": str, "double": float, "long": int}[kind]
        rows = [(cast(v), _token(v) if tokens else str(v)) for v in values]
        one = spark.createDataFrame(rows, f"{name} {kind}, _t_{name} string")
        grid = one if grid is None else grid.crossJoin(F.broadcast(one))
    parts: list[Column] = []
    rest = layout
    while "{" in rest:
        text, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(text), F.col(f"_t_{name}")]
    return grid.withColumn("candidate_id", F.concat(*parts, F.lit(rest))).drop(*[f"_t_{n}" for n in options])


def forest_grid(spark: SparkSession, *, trees, min_samples_leaf, max_features, feature_sets=("core",)) -> DataFrame:
    options = {
        "feature_set": feature_sets,
        "forest_trees": trees,
        "forest_min_samples_leaf": min_samples_leaf,
        "forest_max_features": [str(value) for value in max_features],
    }
    return option_grid(spark, options, FOREST_ID, tokens=False)


def with_forest_id(rows: DataFrame) -> DataFrame:
    """Adds ``candidate_id`` to rows that carry a candidate's options."""
    parts = F.concat(
        F.col("feature_set"), F.lit("_trees"), F.col("forest_trees"), F.lit("_leaf"), F.col("forest_min_samples_leaf"), F.lit("_feat"), F.col("forest_max_features")
    )
    return rows.withColumn("candidate_id", parts)


def neural_grid(spark: SparkSession, model: str, own: Mapping[str, Sequence[object]], shared: Mapping[str, Sequence[object]]) -> DataFrame:
    """``own`` holds the model's lists, ``shared`` lr, weight_decay, batch_size, huber_delta."""
    if model not in NEURAL_IDS:
        raise ValueError(f"Unknown model: {model}")
    grid = option_grid(spark, {**shared, **own}, NEURAL_IDS[model] + SHARED_ID, tokens=True)
    return grid.withColumn("model", F.lit(model)).withColumn("model_size_score", model_size(model))


def model_size(model: str) -> Column:
    c = F.col
    if model == "summary":
        return c("summary_hidden_dim") + F.floor(c("summary_hidden_dim") / 2)
    if model == "transformer":
        layers = F.greatest(F.lit(1), c("transformer_layers"))
        return (c("transformer_embed_dim") + c("transformer_ff_dim")) * layers
    return c("lstm_embed_dim") * c("lstm_hidden_dim") * F.greatest(F.lit(1), c("lstm_layers"))


def evaluated(oof: DataFrame, candidate: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Out-of-fold rows of all candidates -> (summary, metrics per target, metrics per fold)."""
    keys, rows = list(candidate), usable_rows(oof)
    targets = regression_report(rows, [*keys, "target"], ["baseline"], stored=True)
    folds = regression_report(rows, [*keys, "target", "fold"], ["baseline"], stored=True)
    return summarised(targets, keys), targets, folds


def summarised(targets: DataFrame, candidate: Sequence[str]) -> DataFrame:
    """Means over targets, one row per candidate."""
    means = {
        "mean_mae": "mae",
        "mean_r2": "r2",
        "mean_spearman": "spearman",
        "mean_pairwise_order_accuracy": "pairwise_order_accuracy",
        "mean_baseline_mae": "baseline_mae",
        "mean_improvement_pct": "mae_improvement_pct",
    }
    return targets.groupBy(*candidate).agg(*[F.avg(source).alias(name) for name, source in means.items()])


def selection_value(metric: str) -> Column:
    """Smaller is better; unusable values come last."""
    if metric not in LOWER_IS_BETTER + HIGHER_IS_BETTER:
        raise ValueError(f"Unknown selection metric: {metric}")
    number = F.col(metric).try_cast("double")
    usable = ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(usable, -number if metric in HIGHER_IS_BETTER else number).otherwise(F.lit(float("inf")))


def best_forest(summary: DataFrame, metric: str = "mean_mae") -> DataFrame:
    """Best candidate; ties go to fewer trees, larger leaves, then feature set and max features."""
    order = [selection_value(metric), F.col("forest_trees"), -F.col("forest_min_samples_leaf")]
    text = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ("feature_set", "forest_max_features") if n in summary.columns]
    return summary.orderBy(*order, *text).limit(1)


def best_neural(summary: DataFrame, metric: str = "mean_mae") -> DataFrame:
    """Best candidate; ties go to the smaller model, lower validation loss, then id."""
    loss = F.coalesce(F.col("best_val_loss").cast("double"), F.lit(float("inf")))
    return summary.orderBy(selection_value(metric), F.coalesce("model_size_score", F.lit(0)), loss, "candidate_id").limit(1)
