"""Tree-ensemble regression on chart features: one forest of extremely randomised trees for all targets."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainframe.operators import trees
from strainframe.operators.trees import ForestOptions, Trees
from strainframe.session import cut_lineage

__all__ = ["ForestModel", "ForestOptions", "fit_forest", "forest_candidates", "out_of_fold"]


@dataclass(frozen=True)
class ForestModel:
    """A fitted forest: the mean of its trees' leaf means for every target."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    count: int
    trees: Trees

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds ``pred_<target>`` columns."""
        numbered = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
        asked = trees.sample(numbered, self.features, keep=["_row"]).withColumn("model", F.lit("forest"))
        count = rows.sparkSession.createDataFrame([("forest", self.count)], "model string, trees int")
        found = self.trees.values(asked, ["_row"], count, len(self.targets)).drop("model")
        predicted = numbered.join(found, "_row").withColumns({f"pred_{t}": F.col("values")[n] for n, t in enumerate(self.targets)})
        return predicted.drop("_row", "values")

    def importances(self, spark: SparkSession) -> DataFrame:
        """(feature, importance), zero for features that no tree uses."""
        names = spark.createDataFrame(list(enumerate(self.features)), "f int, feature string")
        found = names.join(self.trees.importances().drop("model"), "f", "left")
        return found.select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))

    def save(self, path: str, spark: SparkSession) -> None:
        for name in ("splits", "leaves"):
            getattr(self.trees, name).write.mode("overwrite").parquet(f"{path}/{name}")
        note = json.dumps({"features": self.features, "targets": self.targets, "trees": self.count})
        spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(path: str, spark: SparkSession) -> ForestModel:
        note = json.loads(spark.read.text(f"{path}/about").head()[0])
        parts = (spark.read.parquet(f"{path}/{name}") for name in ("splits", "leaves"))
        return ForestModel(tuple(note["features"]), tuple(note["targets"]), note["trees"], Trees(*parts))


def fit_forest(train: DataFrame, features: Sequence[str], targets: Sequence[str], options: ForestOptions, *, weight: str | None = None) -> ForestModel:
    """Targets count alike: their errors are scaled by the train rows' population deviation."""
    rows = trees.sample(train, features, targets, weight).withColumn("model", F.lit("forest"))
    plans = trees.plan_rows(train.sparkSession, [("forest", options, len(features))])
    return ForestModel(tuple(features), tuple(targets), options.trees, trees.grow(cut_lineage(rows), plans, len(features), len(targets)))


def out_of_fold(rows: DataFrame, features: Sequence[str], targets: Sequence[str], options: ForestOptions, *, folds: int, weight: str | None = None) -> DataFrame:
    """Long out-of-fold predictions (beatmap_id, fold, target, actual, pred, baseline).

    ``rows`` carries ``fold``; each row is predicted by the forest not trained on it, whose seed grows with the
    fold. The forests of all folds grow together.
    """
    found = forest_candidates(rows, {"": features}, targets, [("", options)], folds=folds, weight=weight)
    return found.drop("feature_set", "forest_trees", "forest_min_samples_leaf", "forest_max_features")


def forest_candidates(
    rows: DataFrame,
    feature_sets: dict[str, Sequence[str]],
    targets: Sequence[str],
    candidates: Sequence[tuple[str, ForestOptions]],
    *,
    folds: int,
    weight: str | None = None,
) -> DataFrame:
    """Out-of-fold predictions of many candidates (feature set, options) in one growth.

    All candidates read one table of features: each set has to begin like the longest one. Candidates that differ in
    the number of trees alone share a forest, of which the smaller ones take the first trees.
    """
    spark, longest = rows.sparkSession, max(feature_sets.values(), key=len)
    if any(list(names) != list(longest[: len(names)]) for names in feature_sets.values()):
        raise ValueError("feature sets have to begin like the longest one")
    shared: dict[tuple, list[ForestOptions]] = {}
    for name, options in candidates:
        shared.setdefault((name, options.min_leaf, str(options.max_features), options.seed), []).append(options)
    plans, about = [], []
    for place, ((name, leaf, share, _), members) in enumerate(shared.items()):
        largest = max(members, key=lambda o: o.trees)
        for fold in range(1, folds + 1):
            model = f"{place}|{fold}"
            plans.append((model, largest.seeded(fold), len(feature_sets[name])))
            about.append((model, fold, largest.trees, [o.trees for o in members], name, leaf, share))
    kind = "model string, of long, trees int, limits array<int>, feature_set string, forest_min_samples_leaf long, forest_max_features string"
    base = trees.sample(rows, longest, targets, weight, keep=["beatmap_id", "fold", *targets])
    base = cut_lineage(base.withColumn("row", F.monotonically_increasing_id()))
    keys = ["beatmap_id", "fold", *targets]
    if base.count() <= trees.LOCAL_ROWS:
        found = _held_out(base, spark, plans, about, keys, len(longest), len(targets))
    else:
        found = _by_tables(base, spark, plans, about, keys, len(longest), len(targets))
    about = cut_lineage(spark.createDataFrame(about, kind))
    found = found.withColumnRenamed("trees", "forest_trees").join(F.broadcast(about.drop("of", "trees")), "model").filter(F.array_contains("limits", F.col("forest_trees")))
    rounds = base.join(F.broadcast(spark.range(1, folds + 1).select(F.col("id").alias("of"))), F.col("fold") != F.col("of"))
    means = rounds.groupBy(F.col("of").alias("fold")).agg(F.array(*map(F.avg, targets)).alias("means"))
    entries = [
        F.struct(F.lit(t).alias("target"), F.col(t).alias("actual"), F.col("values")[n].alias("pred"), F.col("means")[n].alias("baseline"))
        for n, t in enumerate(targets)
    ]
    long = found.join(F.broadcast(means), "fold").withColumn("e", F.explode(F.array(*entries)))
    return long.select(
        "feature_set", F.col("forest_trees").cast("long").alias("forest_trees"), "forest_min_samples_leaf", "forest_max_features", "beatmap_id", "fold", "e.*"
    )


def _held_out(base: DataFrame, spark: SparkSession, plans: list, about: list, keys: Sequence[str], features: int, targets: int) -> DataFrame:
    """(keys, model, trees, values) of held-out rows, which are scored by the tasks that grow the trees."""
    of = spark.createDataFrame([(name, fold) for name, fold, *_ in about], "model string, of long")
    train = base.join(F.broadcast(of.select("of").distinct()), F.col("fold") != F.col("of")).select(F.col("of").cast("string").alias("model"), "y")
    scales = trees.target_scales(train, targets).withColumnRenamed("model", "_of")
    sized = trees.plan_rows(spark, plans).join(of, "model").join(scales, F.col("of").cast("string") == F.col("_of")).drop("of", "_of")
    limits = {name: members for name, _, _, members, *_ in about}
    rows = base.select("row", "fold", "x", "y", "w")
    sums = trees.held_out_values(rows, cut_lineage(sized), {name: fold for name, fold, *_ in about}, limits, features, targets)
    # The sums are small beside the work on them, which is not done again.
    total = F.array(*[F.sum(F.col("total")[t]) for t in range(targets)])
    sums = cut_lineage(sums).groupBy("row", "model", "trees").agg(total.alias("total"), F.sum("count").alias("count"))
    found = sums.join(base.select("row", *keys).hint("merge"), "row")
    mean = [F.sum(F.col("total")[t]) / F.sum("count") / trees.STEPS for t in range(targets)]
    return found.groupBy(*keys, "trees", "model").agg(F.array(*mean).alias("values"))


def _by_tables(base: DataFrame, spark: SparkSession, plans: list, about: list, keys: Sequence[str], features: int, targets: int) -> DataFrame:
    """The same with tables of trees, for more rows than a task takes."""
    limits = sorted({limit for _, _, _, members, *_ in about for limit in members})
    about = cut_lineage(spark.createDataFrame([row[:3] for row in about], "model string, of long, trees int"))
    train = base.join(F.broadcast(about.select("model", "of")), F.col("fold") != F.col("of")).select("model", "x", "y", "w")
    forest = trees.grow(cut_lineage(train), trees.plan_rows(spark, plans), features, targets)
    held_out = base.join(F.broadcast(about.select("model", "of")), F.col("fold") == F.col("of")).select("model", *keys, "x")
    return forest.values(held_out, keys, about.select("model", "trees"), targets, limits)
