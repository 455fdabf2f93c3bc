import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainframe.operators import models, trees
from strainframe.operators.trees import ForestOptions


def sample_rows(spark, count=300, seed=1):
    dice = random.Random(seed)
    rows = []
    for n in range(count):
        x = [dice.random(), dice.choice([0.0, 1.0]), 0.5, dice.gauss(0, 1)]
        rows.append((n, *x, 3 * x[0] + x[1] + dice.gauss(0, 0.05), dice.choice([0.25, 1.0]), x[3] * 0.1))
    return spark.createDataFrame(rows, "beatmap_id long, a double, b double, c double, d double, t double, weight double, u double")


NAMES = ["a", "b", "c", "d"]


def grown(spark, local_rows, options, rows):
    given = trees.sample(rows, NAMES, ["t", "u"], "weight").withColumn("model", F.lit("m"))
    forest = trees.grow(given, trees.plan_rows(spark, [("m", options, 4)]), 4, 2, local_rows)
    return (sorted(map(tuple, part.collect())) for part in (forest.splits, forest.leaves))


@pytest.mark.parametrize(("options", "limit"), [(ForestOptions(3, 6, "sqrt"), 0), (ForestOptions(2, 2, 1.0, seed=7), 20)])
def test_small_nodes_and_levels_give_the_same_trees(spark, options, limit):
    rows = sample_rows(spark, 80)
    splits, leaves = grown(spark, 100_000, options, rows)
    again, other = grown(spark, limit, options, rows)
    assert again == splits and other == leaves
    assert len(leaves) == len(splits) + options.trees
    assert all(row[5] >= -1e-9 for row in splits)


def test_leaves_hold_all_rows(spark):
    rows = sample_rows(spark, 100)
    _, leaves = grown(spark, 60, ForestOptions(3, 4), rows)
    weight = rows.agg(F.sum("weight")).first()[0] * trees.WEIGHT_STEPS
    for tree in (1, 2, 3):
        assert sum(row[3] for row in leaves if row[1] == tree) == weight


def test_forest_learns_and_scores(spark):
    rows = sample_rows(spark, 300)
    model = models.fit_forest(rows.filter("beatmap_id < 250"), NAMES, ["t", "u"], ForestOptions(20), weight="weight")
    scored = model.predict(rows.filter("beatmap_id >= 250"))
    assert scored.count() == 50
    assert scored.agg(F.corr("t", "pred_t")).first()[0] > 0.9
    found = {row["feature"]: row["importance"] for row in model.importances(spark).collect()}
    assert abs(sum(found.values()) - 1) < 1e-9 and found["c"] == 0 and found["a"] > found["b"]


def test_candidates_share_forests(spark):
    rows = sample_rows(spark, 40).withColumn("fold", F.col("beatmap_id") % 4 + 1)
    sets = {"two": NAMES[:2], "all": NAMES}
    candidates = [(name, ForestOptions(count, 2)) for name in sets for count in (3, 6)]
    found = models.forest_candidates(rows, sets, ["t", "u"], candidates, folds=4, weight="weight")
    assert found.count() == 40 * 2 * len(candidates)
    alone = models.out_of_fold(rows, NAMES, ["t", "u"], ForestOptions(3, 2), folds=4, weight="weight")
    part = found.filter("feature_set = 'all' and forest_trees = 3").select(*alone.columns)
    rounded = [frame.withColumn("pred", F.round("pred", 9)).withColumn("baseline", F.round("baseline", 9)) for frame in (alone, part)]
    assert rounded[0].exceptAll(rounded[1]).count() == 0 and part.count() == alone.count()
    with pytest.raises(ValueError):
        models.forest_candidates(rows, {"x": ["b", "a"], "all": NAMES}, ["t"], [("x", ForestOptions(2))], folds=4)


def test_options():
    assert ForestOptions(max_features="sqrt").drawn(29) == 5 and ForestOptions(max_features="log2").drawn(29) == 4
    assert ForestOptions(max_features="0.5").drawn(29) == 14 and ForestOptions(max_features=0.01).drawn(29) == 1
    with pytest.raises(ValueError):
        ForestOptions(max_features=1.5).drawn(3)


def test_one_row_and_constant_targets(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 2.0, 1.0, 3.0)], sample_rows(spark, 1).schema)
    model = models.fit_forest(rows, NAMES, ["t", "u"], ForestOptions(3))
    assert [tuple(r) for r in model.predict(rows).select("pred_t", "pred_u").collect()] == [(2.0, 3.0)]
    assert {row["importance"] for row in model.importances(spark).collect()} == {0.0}


def test_models_in_blocks_split_nodes_and_levels_agree(spark, monkeypatch):
    """Trees of a small model are grown and walked in blocks: shuffled rows no longer grow with the trees (q_forest_regression)."""
    rows = sample_rows(spark, 60)
    given = trees.sample(rows, NAMES, ["t", "u"], "weight", keep=["beatmap_id"]).withColumn("model", F.lit("m"))
    options = ForestOptions(12, 1, 0.5)
    whole = trees.grow(given, trees.plan_rows(spark, [("m", options, 4)]), 4, 2)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 5 * 60)
    monkeypatch.setattr(trees, "ROWS_AT_ONCE", 7)
    blocks = trees._blocked(spark.createDataFrame([("m", 12, 60)], "model string, trees int, n long")).first()
    assert (blocks["per"], blocks["blocks"]) == (5, 3)
    parted = trees.grow(given, trees.plan_rows(spark, [("m", options, 4)]), 4, 2)
    for name in ("splits", "leaves"):
        assert sorted(map(tuple, getattr(whole, name).collect())) == sorted(map(tuple, getattr(parted, name).collect()))
    count = spark.createDataFrame([("m", 12)], "model string, trees int")
    asked = given.select("model", "beatmap_id", "x")
    results = []
    for nodes, largest in ((1 << 20, 1 << 20), (300, 1 << 20), (300, 0)):  # one block, several blocks, joins
        monkeypatch.setattr(trees, "BLOCK_NODES", nodes)
        monkeypatch.setattr(trees, "TREE_NODES", largest)
        found = whole.values(asked, ["beatmap_id"], count, 2, [3, 12])
        results.append(sorted((r["beatmap_id"], r["trees"], *[round(v, 9) for v in r["values"]]) for r in found.collect()))
    assert results[0] == results[1] == results[2] and len(results[0]) == 120


def test_hashes_of_long_paths():
    """Draws are md5 of (seed, tree, node, feature), also where the path needs more than one block."""
    dice = random.Random(3)
    for depth in (0, 1, 40, 47, 48, 70, 130):
        path = "".join(dice.choice("LR") for _ in range(depth)).encode()
        order, place = trees._hashes([b"42|7|", b"42|150|"], np.array([0, 1]), np.tile(np.frombuffer(path, np.uint8), (2, 1)), 12)
        for n, head in enumerate((b"42|7|", b"42|150|")):
            for f in range(12):
                text = md5(head + path + f"|{f}".encode()).hexdigest()
                assert int(order[n, f]) == int(text[:16], 16) and place[n, f] == int(text[16:24], 16) / 2**32


def candidate_rows(spark, monkeypatch, local_rows, rows):
    monkeypatch.setattr(trees, "LOCAL_ROWS", local_rows)
    sets = {"two": NAMES[:2], "all": NAMES}
    candidates = [(name, ForestOptions(count, 2)) for name in sets for count in (2, 5)]
    found = models.forest_candidates(rows, sets, ["t", "u"], candidates, folds=2, weight="weight")
    columns = ["feature_set", "forest_trees", "beatmap_id", "fold", "target"]
    return sorted((*[r[name] for name in columns], round(r["pred"], 9), round(r["baseline"], 9)) for r in found.collect())


def test_held_out_rows_are_scored_where_trees_grow(spark, monkeypatch):
    """Trees of candidates are neither stored nor sent, and give the values that tables of trees give (q_sweep_forest, q_cv_oof_forest, q_cv_fold_metrics_forest)."""
    rows = sample_rows(spark, 24).withColumn("fold", F.col("beatmap_id") % 2 + 1)
    rows = rows.unionByName(rows.filter("beatmap_id < 3"))  # rows may come twice
    monkeypatch.setattr(trees, "BLOCK_ROWS", 2 * 13)
    by_tables = candidate_rows(spark, monkeypatch, 10, rows)
    monkeypatch.setattr(trees, "grow", lambda *_, **__: pytest.fail("trees are stored"))
    assert candidate_rows(spark, monkeypatch, 1 << 20, rows) == by_tables and len(by_tables) == 24 * 2 * 4


def test_blocks_do_not_grow_with_the_rows(spark):
    """Every block of trees is sent all rows of its model, so large models have few blocks (q_feature_importance)."""
    plans = spark.createDataFrame([("m", 200, 540_000), ("s", 200, 100)], "model string, trees int, n long")
    blocks = {row["model"]: (row["per"], row["blocks"]) for row in trees._blocked(plans, 40, 8).collect()}
    assert blocks == {"m": (5, 40), "s": (25, 8)}


def test_packed_rows_come_back(spark):
    """Chunks hold the rows as they were; NULL is kept, and a feature that has one in a node is not drawn there."""
    rows = spark.createDataFrame(
        [("a", [1, -(1 << 40)], 7), ("b", [3, None], 8), ("a", [5, 6], 9)], "model string, x array<long>, w long"
    )
    chunks = trees._packed(rows, [("x", 2), ("w", 1)], model=True).collect()
    found = {name: trees._unpacked([(r["n"], bytes(r["data"])) for r in chunks if r["model"] == name], 3) for name in "ab"}
    assert sorted(map(tuple, found["a"].T.tolist())) == [(1, -(1 << 40), 7), (5, 6, 9)]
    assert found["b"].T.tolist() == [[3, trees.NOTHING, 8]]
    assert trees._features(found["a"][:2]).dtype == np.int64 and trees._features(found["a"][2:]).dtype == np.int32
    x = trees._features(np.array([[1, 2, 3, 4], [trees.NOTHING, 1, 2, 3]]))
    y, w = np.array([[1], [2], [3], [4]]), np.full(4, 1000)
    plan = {"model": "m", "seed": 1, "min_leaf": 1, "width": 2, "drawn": 2, "scale": [1]}
    assert np.isnan(x[0, 1]) and trees._grown(x, y, w, plan, [1]).slice(0, 1)["f"].to_pylist() == [0]
    with pytest.raises(ValueError):
        trees._asked_rows(np.array([[1, trees.NOTHING], [1, 1]]), 1)
