"""Model, sweep and embedding queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainframe.catalog.forest_views import forest_views, rows_view
from strainframe.catalog.metrics_catalog import CV_FOLD_METRICS_SQL, CV_VIEWS, TARGETS, fold_metrics, fold_rows, grouped_charts, predictions
from strainframe.catalog.registry import query, rounded
from strainframe.catalog.sequences_catalog import FEATURE_VIEWS
from strainframe.operators import embeddings, features, labels, models, splits, sweeps
from strainframe.session import cut_lineage, scratch_path
from strainframe.sources import tables

FOLDS = 5


def training_rows(spark, folder, folds=FOLDS):
    """Features, targets, weight and fold of every labelled chart with notes."""
    charts = grouped_charts(spark, folder)
    values = features.chart_features(tables.raw_notes(spark, folder))
    weight = labels.sample_weight(F.col("score_count"))
    rows = charts.select("beatmap_id", "split_group", *TARGETS, weight.alias("weight")).join(values.hint("merge"), "beatmap_id")
    return cut_lineage(splits.cross_validation_folds(rows, folds=folds, seed=42))


FOREST = models.ForestOptions()
WIDTH = len(features.CORE_FEATURES)
FOREST_PLAN = f"SELECT 'forest' AS model, 42 AS seed, {FOREST.trees} AS trees, {FOREST.min_leaf} AS min_leaf, {WIDTH} AS width, {FOREST.drawn(WIDTH)} AS drawn"


def forest_sql(source: str, plans: str = FOREST_PLAN, names=features.CORE_FEATURES) -> dict[str, str]:
    """Folds and forests are made of the charts that have notes."""
    grouped = f"SELECT * FROM ({CV_VIEWS['grouped']}) WHERE beatmap_id IN (SELECT beatmap_id FROM core)"
    return {**CV_VIEWS, **FEATURE_VIEWS, "grouped": grouped, **forest_views(rows_view(source, names), plans)}


@query(
    "q_forest_regression",
    f"""SELECT id AS beatmap_id, {", ".join(f"round({t}, 9) AS {t}, round(v{n}, 7) AS pred_{t}" for n, t in enumerate(TARGETS, 1))}
        FROM forest_values JOIN chart_labels ON beatmap_id = id""",
    extra=forest_sql("SELECT beatmap_id, fold <> 1 AS train, 'forest' AS model FROM folds"),
)
def q_forest_regression(spark, folder):
    rows = training_rows(spark, folder)
    model = models.fit_forest(rows.filter("fold <> 1"), features.CORE_FEATURES, TARGETS, FOREST, weight="weight")
    scored = model.predict(rows.filter("fold = 1"))
    scored = rounded(scored.select("beatmap_id", *[n for t in TARGETS for n in (t, f"pred_{t}")]), *TARGETS, digits=9)
    return rounded(scored, *[f"pred_{t}" for t in TARGETS], digits=7)


CV_FOREST_VIEWS = {
    **forest_sql(
        "SELECT beatmap_id, fold <> r.round AS train, 'fold' || r.round AS model FROM folds CROSS JOIN (SELECT unnest(range(1, 6)) AS round) r",
        f"SELECT 'fold' || r AS model, 42 + r AS seed, {FOREST.trees} AS trees, {FOREST.min_leaf} AS min_leaf, {WIDTH} AS width, {FOREST.drawn(WIDTH)} AS drawn"
        " FROM (SELECT unnest(range(1, 6)) AS r)",
    ),
    "forest_oof": """
        SELECT id AS beatmap_id, f.fold, t.target, round(l.actual, 9) AS actual, round(CASE t.target WHEN 'mean_acc' THEN v1 WHEN 'acc_std' THEN v2 ELSE v3 END, 7) AS pred,
               b.baseline
        FROM forest_values JOIN folds f ON f.beatmap_id = id CROSS JOIN (SELECT unnest(['mean_acc', 'acc_std', 'skill_gap']) AS target) t
        JOIN (SELECT beatmap_id, unnest(['mean_acc', 'acc_std', 'skill_gap']) AS target, unnest([mean_acc, acc_std, skill_gap]) AS actual FROM chart_labels) l
          ON l.beatmap_id = id AND l.target = t.target
        JOIN (SELECT round, target, avg(actual) AS baseline FROM rounds WHERE is_train GROUP BY ALL) b ON b.round = f.fold AND b.target = t.target""",
}


def forest_oof(spark, folder):
    rows = models.out_of_fold(training_rows(spark, folder), features.CORE_FEATURES, TARGETS, FOREST, folds=FOLDS, weight="weight")
    return rounded(rounded(rows, "actual", digits=9), "pred", digits=7)


@query(
    "q_cv_oof_forest",
    "SELECT beatmap_id, fold, target, actual, pred, round(baseline, 7) AS baseline FROM forest_oof",
    extra=CV_FOREST_VIEWS,
)
def q_cv_oof_forest(spark, folder):
    return rounded(forest_oof(spark, folder), "baseline", digits=7)


@query(
    "q_cv_fold_metrics_forest",
    CV_FOLD_METRICS_SQL.replace("FROM oof", "FROM forest_oof").replace("JOIN oof", "JOIN forest_oof"),
    extra=CV_FOREST_VIEWS,
)
def q_cv_fold_metrics_forest(spark, folder):
    """Metrics of each fold and target, and their gain over the mean of the fold's train rows."""
    return fold_metrics(forest_oof(spark, folder))


ALL_CHARTS = "SELECT beatmap_id, true AS train, 'forest' AS model FROM folds"


@query(
    "q_feature_importance",
    f"""SELECT feature, round(coalesce(importance, 0), 7) AS importance
        FROM (SELECT unnest(range(0, {WIDTH})) AS f, unnest({list(features.CORE_FEATURES)}) AS feature) LEFT JOIN forest_importances USING (f)""",
    extra=forest_sql(ALL_CHARTS),
)
def q_feature_importance(spark, folder):
    rows = training_rows(spark, folder)
    model = models.fit_forest(rows, features.CORE_FEATURES, TARGETS, FOREST, weight="weight")
    return rounded(model.importances(spark), "importance", digits=7).orderBy(F.col("importance").desc(), "feature")


@query(
    "q_batch_predict",
    f"SELECT id AS beatmap_id, {', '.join(f'round(v{n}, 7) AS pred_{t}' for n, t in enumerate(TARGETS, 1))} FROM forest_values",
    extra=forest_sql(f"{ALL_CHARTS} UNION ALL SELECT beatmap_id, false, 'forest' FROM core"),
)
def q_batch_predict(spark, folder):
    rows = training_rows(spark, folder)
    model = models.fit_forest(rows, features.CORE_FEATURES, TARGETS, FOREST, weight="weight")
    path = scratch_path(spark)
    model.save(path, spark)
    loaded = models.ForestModel.load(path, spark)
    every = features.chart_features(tables.raw_notes(spark, folder))
    names = [f"pred_{t}" for t in TARGETS]
    return rounded(loaded.predict(every).select("beatmap_id", *names), *names, digits=7)


# --- sweeps -----------------------------------------------------------------

GRID_SQL = """
    SELECT f.feature_set, t.trees AS forest_trees, l.leaf AS forest_min_samples_leaf, m.feat AS forest_max_features,
           f.feature_set || '_trees' || t.trees || '_leaf' || l.leaf || '_feat' || m.feat AS candidate_id
    FROM (SELECT unnest(['core', 'burst']) AS feature_set) f, (SELECT unnest([100, 200]) AS trees) t,
         (SELECT unnest([1, 2, 4]) AS leaf) l, (SELECT unnest(['sqrt', '0.5']) AS feat) m"""


def fold_sizes(charts):
    """(fold, val_size, train_size) of grouped charts."""
    rows = charts.select("beatmap_id", "split_group")
    sizes = splits.cross_validation_folds(rows, folds=FOLDS, seed=42).groupBy("fold").agg(F.count(F.lit(1)).alias("val_size"))
    total = sizes.agg(F.sum("val_size").alias("total"))
    return sizes.crossJoin(F.broadcast(total)).withColumn("train_size", F.col("total") - F.col("val_size")).drop("total")


@query(
    "q_param_grid",
    """SELECT candidate_id, feature_set, CAST(forest_trees AS BIGINT) AS forest_trees, CAST(forest_min_samples_leaf AS BIGINT) AS forest_min_samples_leaf,
              forest_max_features, fold, train_size, val_size FROM grid CROSS JOIN (
           SELECT fold, (SELECT count(*) FROM folds) - count(*) AS train_size, count(*) AS val_size FROM folds GROUP BY fold)""",
    extra={**CV_VIEWS, "grid": GRID_SQL},
)
def q_param_grid(spark, folder):
    """Every candidate on every fold of the labelled charts: the work a sweep does."""
    grid = sweeps.forest_grid(
        spark, trees=[100, 200], min_samples_leaf=[1, 2, 4], max_features=["sqrt", 0.5], feature_sets=["core", "burst"]
    )
    return fold_sizes(grouped_charts(spark, folder)).crossJoin(F.broadcast(grid))  # folds x candidates, both a handful


SHARED_OPTIONS = {"lr": [0.001, 0.0003], "weight_decay": [0.0001, 0.00001], "batch_size": [32], "huber_delta": [1.0, 0.5]}
NEURAL_OPTIONS = {
    "summary": {"summary_hidden_dim": [96, 128, 192], "summary_dropout": [0.1, 0.2, 0.35]},
    "lstm": {
        "lstm_embed_dim": [32, 64], "lstm_hidden_dim": [64, 128], "lstm_layers": [1, 2], "lstm_dropout": [0.1, 0.2], "lstm_head_dropout": [0.2, 0.3],
    },
    "transformer": {
        "transformer_embed_dim": [32, 64], "transformer_heads": [4], "transformer_layers": [1, 2], "transformer_ff_dim": [128, 256],
        "transformer_dropout": [0.1], "transformer_head_dropout": [0.2],
    },
}

NEURAL_GRID_SQL = """
    WITH shared AS (
        SELECT lr, weight_decay, 32::BIGINT AS batch_size, huber_delta,
               '_lr' || CASE lr WHEN 0.001 THEN '0p001' ELSE '0p0003' END || '_wd' || CASE weight_decay WHEN 0.0001 THEN '0p0001' ELSE '1em05' END || '_bs32_hd'
               || CASE huber_delta WHEN 1 THEN '1p0' ELSE '0p5' END AS suffix
        FROM (SELECT unnest([0.001, 0.0003]::DOUBLE[]) AS lr), (SELECT unnest([0.0001, 0.00001]::DOUBLE[]) AS weight_decay), (SELECT unnest([1.0, 0.5]::DOUBLE[]) AS huber_delta)),
    own AS (
        SELECT 'summary' AS model, 'summary_h' || h || '_do' || d AS prefix, h + h // 2 AS score
        FROM (SELECT unnest([96, 128, 192]) AS h), (SELECT unnest(['0p1', '0p2', '0p35']) AS d)
        UNION ALL
        SELECT 'lstm', 'lstm_e' || e || '_h' || h || '_l' || l || '_do' || d || '_head' || o, e * h * l
        FROM (SELECT unnest([32, 64]) AS e), (SELECT unnest([64, 128]) AS h), (SELECT unnest([1, 2]) AS l), (SELECT unnest(['0p1', '0p2']) AS d), (SELECT unnest(['0p2', '0p3']) AS o)
        UNION ALL
        SELECT 'transformer', 'transformer_e' || e || '_h4_l' || l || '_ff' || f || '_do0p1_head0p2', (e + f) * l
        FROM (SELECT unnest([32, 64]) AS e), (SELECT unnest([1, 2]) AS l), (SELECT unnest([128, 256]) AS f))
    SELECT prefix || suffix AS candidate_id, model, lr, weight_decay, batch_size, huber_delta, CAST(score AS BIGINT) AS model_size_score FROM own CROSS JOIN shared"""


@query(
    "q_neural_grid",
    """SELECT g.*, fold, train_size, val_size, train_size * model_size_score AS train_load,
              row_number() OVER (PARTITION BY fold, model ORDER BY model_size_score, candidate_id) AS size_place
       FROM neural_grid g CROSS JOIN (SELECT fold, (SELECT count(*) FROM folds) - count(*) AS train_size, count(*) AS val_size FROM folds GROUP BY fold)""",
    extra={**CV_VIEWS, "neural_grid": NEURAL_GRID_SQL},
)
def q_neural_grid(spark, folder):
    """Every neural candidate on every fold of the labelled charts, with its size score, load and place among those of its kind."""
    columns = ["candidate_id", "model", "lr", "weight_decay", "batch_size", "huber_delta", "model_size_score"]
    grids = [sweeps.neural_grid(spark, model, own, SHARED_OPTIONS).select(*columns) for model, own in NEURAL_OPTIONS.items()]
    grid = reduce(DataFrame.unionByName, grids).withColumn("model_size_score", F.col("model_size_score").cast("long"))
    sizes = fold_sizes(grouped_charts(spark, folder))
    by_size = Window.partitionBy("fold", "model").orderBy("model_size_score", "candidate_id")  # a few hundred candidates
    return sizes.crossJoin(F.broadcast(grid)).withColumns(
        {"train_load": F.col("train_size") * F.col("model_size_score"), "size_place": F.row_number().over(by_size).cast("long")}
    )


CANDIDATES = {"difficulty_rating": [1.0, 0.5], "bpm": [1.0, 0.5]}

SWEEP_VIEWS = {
    **CV_VIEWS,
    "sweep_rounds": """
        SELECT f.beatmap_id, f.fold, r.round, f.fold <> r.round AS is_train, t.target, t.actual, c.col_name,
               CASE c.col_name WHEN 'bpm' THEN l.bpm ELSE l.difficulty_rating END AS x
        FROM folds f CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]::BIGINT[]) AS round) r CROSS JOIN (SELECT unnest(['difficulty_rating', 'bpm']) AS col_name) c
        JOIN chart_labels l USING (beatmap_id) JOIN long_predictions t USING (beatmap_id)""",
    "sweep_fits": """
        SELECT col_name, round, target, regr_slope(actual, x) AS slope, regr_intercept(actual, x) AS icept, avg(actual) AS baseline
        FROM sweep_rounds WHERE is_train GROUP BY ALL""",
    "sweep_oof": """
        SELECT col_name || '_shrink' || s.shrink AS candidate_id, beatmap_id, fold, target, round(actual, 9) AS actual, baseline,
               round(baseline + s.shrink::DOUBLE * (icept + slope * x - baseline), 7) AS pred
        FROM sweep_rounds JOIN sweep_fits USING (col_name, round, target) CROSS JOIN (SELECT unnest(['1.0', '0.5']) AS shrink) s WHERE NOT is_train""",
    "sweep_targets": """
        SELECT candidate_id, target, count(*) AS n, avg(abs(actual - pred)) AS mae, 1 - sum((actual - pred) ** 2) / sum((actual - m) ** 2) AS r2,
               avg(abs(actual - baseline)) AS baseline_mae
        FROM (SELECT *, avg(actual) OVER (PARTITION BY candidate_id, target) AS m FROM sweep_oof) GROUP BY ALL""",
    "sweep_pairs": """
        SELECT candidate_id, target, count_if((a.actual < b.actual) = (a.pred < b.pred)) / count(*)::DOUBLE AS pairwise
        FROM sweep_oof a JOIN sweep_oof b USING (candidate_id, target)
        WHERE a.beatmap_id < b.beatmap_id AND a.actual <> b.actual AND a.pred <> b.pred GROUP BY ALL""",
    "sweep_ranks": """
        SELECT candidate_id, target, corr(ra, rp) AS spearman FROM (
            SELECT candidate_id, target,
                   rank() OVER (PARTITION BY candidate_id, target ORDER BY actual) + (count(*) OVER (PARTITION BY candidate_id, target, actual) - 1) / 2.0::DOUBLE AS ra,
                   rank() OVER (PARTITION BY candidate_id, target ORDER BY pred) + (count(*) OVER (PARTITION BY candidate_id, target, pred) - 1) / 2.0::DOUBLE AS rp
            FROM sweep_oof) GROUP BY ALL""",
    "sweep_summary": """
        SELECT candidate_id, round(avg(mae), 7) AS mean_mae, round(avg(r2), 6) AS mean_r2, round(avg(spearman), 6) AS mean_spearman,
               round(avg(pairwise), 7) AS mean_pairwise_order_accuracy, round(avg(baseline_mae), 7) AS mean_baseline_mae,
               round(avg((baseline_mae - mae) / baseline_mae), 6) AS mean_improvement_pct
        FROM sweep_targets JOIN sweep_pairs USING (candidate_id, target) JOIN sweep_ranks USING (candidate_id, target) GROUP BY candidate_id""",
}


def linear_candidates(spark, folder):
    """Out-of-fold rows of shrunken linear fits on several metadata columns."""
    base = fold_rows(spark, folder, ["bpm"])
    columns = F.explode(
        F.array(*[F.struct(F.lit(n).alias("col_name"), F.col(n).cast("double").alias("x")) for n in CANDIDATES])
    )
    rows = base.select("beatmap_id", "fold", "target", "actual", columns.alias("c")).select(
        "beatmap_id", "fold", "target", "actual", "c.col_name", "c.x"
    )
    rounds = splits.fold_rounds(rows, 5)
    keys = ["col_name", "round", "target"]
    fits = splits.linear_baseline(rounds, keys, "x", "actual", "is_train").join(
        splits.mean_baseline(rounds, keys, "actual", "is_train"), keys
    )
    held_out = rows.join(F.broadcast(fits.withColumnRenamed("round", "fold")), ["col_name", "fold", "target"])
    shrink = F.explode(F.array(F.lit(1.0), F.lit(0.5)))
    held_out = held_out.withColumn("shrink", shrink)
    linear = F.col("intercept") + F.col("slope") * F.col("x")
    return held_out.select(
        F.concat(F.col("col_name"), F.lit("_shrink"), F.col("shrink").cast("string")).alias("candidate_id"),
        "beatmap_id", "fold", "target", "baseline", F.round("actual", 9).alias("actual"),
        F.round(F.col("baseline") + F.col("shrink") * (linear - F.col("baseline")), 7).alias("pred"),
    )


SUMMARY = ["mean_mae", "mean_r2", "mean_spearman", "mean_pairwise_order_accuracy", "mean_baseline_mae", "mean_improvement_pct"]


def _summary(spark, folder):
    report = sweeps.evaluated(linear_candidates(spark, folder), ["candidate_id"])[0]
    report = rounded(report, "mean_mae", "mean_pairwise_order_accuracy", "mean_baseline_mae", digits=7)
    return rounded(report, "mean_r2", "mean_spearman", "mean_improvement_pct")


@query("q_sweep_eval", "SELECT * FROM sweep_summary", extra=SWEEP_VIEWS)
def q_sweep_eval(spark, folder):
    return _summary(spark, folder)


@query(
    "q_best_candidate",
    """SELECT * FROM (SELECT 'mean_pairwise_order_accuracy' AS chosen_by, * FROM sweep_summary ORDER BY mean_pairwise_order_accuracy DESC, candidate_id LIMIT 1)
       UNION ALL SELECT * FROM (SELECT 'mean_mae' AS chosen_by, * FROM sweep_summary ORDER BY mean_mae, candidate_id LIMIT 1)""",
    extra=SWEEP_VIEWS,
)
def q_best_candidate(spark, folder):
    summary = cut_lineage(_summary(spark, folder))
    sized = summary.withColumns({"model_size_score": F.lit(1), "best_val_loss": F.lit(None).cast("double")})
    best = [
        sweeps.best_neural(sized, metric).select(F.lit(metric).alias("chosen_by"), *summary.columns)
        for metric in ("mean_pairwise_order_accuracy", "mean_mae")
    ]
    return best[0].unionByName(best[1])


SWEEP_TREES, SWEEP_LEAVES, SWEEP_SHARES = (100, 200), (1, 2, 4), ("sqrt", "0.5")
SWEEP_SETS = {"core": features.CORE_FEATURES, "burst": features.feature_names("burst")}
SWEEP_KEYS = ["candidate_id", "feature_set", "forest_trees", "forest_min_samples_leaf", "forest_max_features"]
SWEEP_METRICS = ["mae", "r2", "spearman", "pairwise_order_accuracy", "baseline_mae", "mae_improvement_pct"]


def sweep_plans_sql() -> str:
    """Candidates that differ in the number of trees share the largest forest."""
    rows = [
        f"SELECT '{name}|{leaf}|{share}|' || r AS model, 42 + r AS seed, {max(SWEEP_TREES)} AS trees, {leaf} AS min_leaf, {len(names)} AS width, "
        f"{models.ForestOptions(max_features=share).drawn(len(names))} AS drawn FROM (SELECT unnest(range(1, 6)) AS r)"
        for name, names in SWEEP_SETS.items()
        for leaf in SWEEP_LEAVES
        for share in SWEEP_SHARES
    ]
    return " UNION ALL ".join(rows)


def metrics_sql(source: str, keys: str) -> str:
    """The report of out-of-fold rows by some keys."""
    return f"""
        SELECT *, (baseline_mae - mae) / baseline_mae AS mae_improvement_pct FROM (
            SELECT {keys}, avg(abs(actual - pred)) AS mae, 1 - sum((actual - pred) ** 2) / sum((actual - m) ** 2) AS r2, avg(abs(actual - baseline)) AS baseline_mae,
                   coalesce(corr(ra, rp), 0) AS spearman
            FROM (SELECT *, avg(actual) OVER w AS m,
                         rank() OVER (PARTITION BY {keys} ORDER BY actual) + (count(*) OVER (PARTITION BY {keys}, actual) - 1) / 2.0::DOUBLE AS ra,
                         rank() OVER (PARTITION BY {keys} ORDER BY pred) + (count(*) OVER (PARTITION BY {keys}, pred) - 1) / 2.0::DOUBLE AS rp
                  FROM {source} WINDOW w AS (PARTITION BY {keys})) GROUP BY {keys})
        JOIN (SELECT {keys}, count_if((a.actual < b.actual) = (a.pred < b.pred)) / count(*)::DOUBLE AS pairwise_order_accuracy
              FROM {source} a JOIN {source} b USING ({keys}) WHERE a.beatmap_id < b.beatmap_id AND a.actual <> b.actual AND a.pred <> b.pred GROUP BY {keys}) USING ({keys})"""


_KEYS_SQL = ", ".join(SWEEP_KEYS)
_MODEL_SQL = "f.name || '|' || l.leaf || '|' || m.share || '|' || r.round"
SWEEP_FOREST_VIEWS = {
    **forest_sql(
        f"""SELECT beatmap_id, fold <> r.round AS train, {_MODEL_SQL} AS model FROM folds
            CROSS JOIN (SELECT unnest({list(SWEEP_SETS)}) AS name) f CROSS JOIN (SELECT unnest({list(SWEEP_LEAVES)}) AS leaf) l
            CROSS JOIN (SELECT unnest({list(SWEEP_SHARES)}) AS share) m CROSS JOIN (SELECT unnest(range(1, 6)) AS round) r""",
        sweep_plans_sql(),
        SWEEP_SETS["burst"],
    ),
    "sweep_values": f"""
        SELECT model, id, trees, avg(v1) / 1000000 AS v1, avg(v2) / 1000000 AS v2, avg(v3) / 1000000 AS v3
        FROM forest_leaves JOIN leaf_means USING (model, tree, node) JOIN (SELECT unnest({list(SWEEP_TREES)}) AS trees) t ON tree <= trees WHERE NOT train GROUP BY ALL""",
    "sweep_forest_oof": """
        SELECT p.name || '_trees' || p.trees || '_leaf' || p.leaf || '_feat' || p.share AS candidate_id, p.name AS feature_set, CAST(p.trees AS BIGINT) AS forest_trees,
               CAST(p.leaf AS BIGINT) AS forest_min_samples_leaf, p.share AS forest_max_features, id AS beatmap_id, f.fold, t.target, round(l.actual, 9) AS actual,
               round(CASE t.target WHEN 'mean_acc' THEN v1 WHEN 'acc_std' THEN v2 ELSE v3 END, 9) AS pred, b.baseline
        FROM (SELECT *, split_part(model, '|', 1) AS name, split_part(model, '|', 2) AS leaf, split_part(model, '|', 3) AS share FROM sweep_values) p
        JOIN folds f ON f.beatmap_id = id CROSS JOIN (SELECT unnest(['mean_acc', 'acc_std', 'skill_gap']) AS target) t
        JOIN (SELECT beatmap_id, unnest(['mean_acc', 'acc_std', 'skill_gap']) AS target, unnest([mean_acc, acc_std, skill_gap]) AS actual FROM chart_labels) l
          ON l.beatmap_id = id AND l.target = t.target
        JOIN (SELECT round, target, avg(actual) AS baseline FROM rounds WHERE is_train GROUP BY ALL) b ON b.round = f.fold AND b.target = t.target""",
    "sweep_by_target": metrics_sql("sweep_forest_oof", f"{_KEYS_SQL}, target"),
    "sweep_by_fold": metrics_sql("sweep_forest_oof", f"{_KEYS_SQL}, target, fold"),
    "sweep_by_candidate": f"SELECT {_KEYS_SQL}, {', '.join(f'round(avg({n}), 9) AS {n}' for n in SWEEP_METRICS)} FROM sweep_by_target GROUP BY {_KEYS_SQL}",
}


def training_sweep_rows(spark, folder):
    charts = grouped_charts(spark, folder)
    values = features.chart_features(tables.raw_notes(spark, folder), feature_set="burst")
    weight = labels.sample_weight(F.col("score_count"))
    rows = charts.select("beatmap_id", "split_group", *TARGETS, weight.alias("weight")).join(values.hint("merge"), "beatmap_id")
    return cut_lineage(splits.cross_validation_folds(rows, folds=FOLDS, seed=42))


@query(
    "q_sweep_forest",
    f"""SELECT {_KEYS_SQL}, 'candidate' AS scope, NULL AS target, CAST(NULL AS BIGINT) AS fold, {", ".join(f"round({n}, 5) AS {n}" for n in SWEEP_METRICS)},
               row_number() OVER (ORDER BY mae, forest_trees, forest_min_samples_leaf DESC, feature_set, forest_max_features) = 1 AS is_best FROM sweep_by_candidate
        UNION ALL SELECT {_KEYS_SQL}, 'target', target, NULL, {", ".join(f"round({n}, 5)" for n in SWEEP_METRICS)}, false FROM sweep_by_target
        UNION ALL SELECT {_KEYS_SQL}, 'fold', target, fold, {", ".join(f"round({n}, 5)" for n in SWEEP_METRICS)}, false FROM sweep_by_fold""",
    extra=SWEEP_FOREST_VIEWS,
)
def q_sweep_forest(spark, folder):
    """Every candidate of the grid on all folds: means, rows by target, rows by target and fold, and the one chosen."""
    candidates = [
        (name, models.ForestOptions(trees=count, min_leaf=leaf, max_features=share))
        for name in SWEEP_SETS
        for count in SWEEP_TREES
        for leaf in SWEEP_LEAVES
        for share in SWEEP_SHARES
    ]
    oof = models.forest_candidates(training_sweep_rows(spark, folder), SWEEP_SETS, TARGETS, candidates, folds=FOLDS, weight="weight")
    oof = cut_lineage(sweeps.with_forest_id(rounded(oof, "actual", "pred", digits=9)))
    summary, targets, folds = sweeps.evaluated(oof, SWEEP_KEYS)
    names = {"mae": "mean_mae", "r2": "mean_r2", "spearman": "mean_spearman", "pairwise_order_accuracy": "mean_pairwise_order_accuracy",
             "baseline_mae": "mean_baseline_mae", "mae_improvement_pct": "mean_improvement_pct"}
    summary = cut_lineage(rounded(summary, *names.values(), digits=9))
    best = sweeps.best_forest(summary).select("candidate_id", F.lit(True).alias("chosen"))
    none = F.lit(None)
    means = summary.join(F.broadcast(best), "candidate_id", "left").select(
        *SWEEP_KEYS, F.lit("candidate").alias("scope"), none.cast("string").alias("target"), none.cast("long").alias("fold"),
        *[F.col(source).alias(name) for name, source in names.items()], F.coalesce("chosen", F.lit(False)).alias("is_best"),
    )
    by_target = targets.select(*SWEEP_KEYS, F.lit("target").alias("scope"), "target", none.cast("long").alias("fold"), *SWEEP_METRICS, F.lit(False).alias("is_best"))
    by_fold = folds.select(*SWEEP_KEYS, F.lit("fold").alias("scope"), "target", "fold", *SWEEP_METRICS, F.lit(False).alias("is_best"))
    return rounded(means.unionByName(by_target).unionByName(by_fold), *SWEEP_METRICS, digits=5)


# --- embeddings -------------------------------------------------------------

NORM_SQL = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(
    "q_embedding_scale",
    """SELECT vec_id, dim, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS scaled FROM (
         SELECT *, avg(x) OVER (PARTITION BY dim) AS m, stddev_pop(x) OVER (PARTITION BY dim) AS s FROM (
           SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings))""",
)
def q_embedding_scale(spark, folder):
    rows = embeddings.scaled(tables.table(spark, folder, "embeddings"))
    return rounded(rows.select("vec_id", F.posexplode("scaled").alias("dim", "scaled")), "scaled")


def _component_sql(matrix: str) -> str:
    """The leading eigenvector of a one-row table (m): power steps on lists, many enough for close eigenvalues."""
    return f"""
        WITH RECURSIVE steps AS (
            SELECT 0 AS step, m, list_transform(range(1, len(m) + 1), lambda i: 1.0::DOUBLE / i + (i % 3)) AS v FROM {matrix}
            UNION ALL
            SELECT step + 1, m, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))
            FROM (SELECT step, m, list_transform(m, lambda r: list_dot_product(r, v)) AS w FROM steps WHERE step < {POWER_STEPS})),
        last_step AS (SELECT m, v FROM steps WHERE step = {POWER_STEPS}),
        largest AS (SELECT m, v, list_aggregate(list_transform(v, lambda x: abs(x)), 'max') AS top FROM last_step)
        SELECT m, CASE WHEN list_contains(v, top) THEN v ELSE list_transform(v, lambda x: -x) END AS v FROM largest"""


POWER_STEPS = 20_000
PCA_VIEWS = {
    "pca_z": """
        SELECT vec_id, dim, (x - avg(x) OVER w) / CASE WHEN stddev_pop(x) OVER w > 0 THEN stddev_pop(x) OVER w ELSE 1 END AS z FROM (
            SELECT vec_id, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) WINDOW w AS (PARTITION BY dim)""",
    "pca_rows": "SELECT vec_id, list(z ORDER BY dim) AS z FROM pca_z GROUP BY vec_id",
    "pca_covariance": """
        SELECT list(r ORDER BY i) AS m FROM (
            SELECT i, list(c ORDER BY j) AS r FROM (
                SELECT a.dim AS i, b.dim AS j, sum(a.z * b.z) / (count(*) - 1) AS c FROM pca_z a JOIN pca_z b USING (vec_id) GROUP BY ALL) GROUP BY i)""",
    "pca_first": _component_sql("pca_covariance"),
    "pca_rest": """
        SELECT list_transform(m, lambda r, i: list_transform(r, lambda c, j: c - size * v[i] * v[j])) AS m
        FROM (SELECT m, v, list_dot_product(list_transform(m, lambda r: list_dot_product(r, v)), v) AS size FROM pca_first)""",
    "pca_second": _component_sql("pca_rest"),
}


@query(
    "q_embedding_pca",
    f"""SELECT vec_id, label, round(list_dot_product(z, a.v), 5) AS projection_x, round(list_dot_product(z, b.v), 5) AS projection_y, round({NORM_SQL}, 6) AS embedding_norm
        FROM embeddings JOIN pca_rows USING (vec_id) CROSS JOIN pca_first a CROSS JOIN pca_second b""",
    extra=PCA_VIEWS,
)
def q_embedding_pca(spark, folder):
    rows = embeddings.projected(tables.table(spark, folder, "embeddings"))
    rows = rows.select("vec_id", "label", "projection_x", "projection_y", "embedding_norm")
    return rounded(rounded(rows, "projection_x", "projection_y", digits=5), "embedding_norm")


@query(
    "q_embedding_collect",
    f"""SELECT vec_id AS beatmap_id, label, title, artist, round({NORM_SQL}, 6) AS embedding_norm, round(pred_mean_acc, 9) AS pred_mean_acc,
               round(pred_acc_std, 9) AS pred_acc_std, round(pred_skill_gap, 9) AS pred_skill_gap
        FROM embeddings JOIN maps ON vec_id = maps.beatmap_id LEFT JOIN predictions USING (beatmap_id)""",
)
def q_embedding_collect(spark, folder):
    charts = tables.maps(spark, folder).select("beatmap_id", "title", "artist")
    rows = embeddings.labelled(tables.table(spark, folder, "embeddings"), charts, predictions(spark, folder), "vec_id")
    rows = rows.select("beatmap_id", "label", "title", "artist", "embedding_norm", *[f"pred_{t}" for t in TARGETS])
    return rounded(rounded(rows, "embedding_norm"), *[f"pred_{t}" for t in TARGETS], digits=9)
