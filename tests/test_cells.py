"""Pair counts in bounded runs, and tables that are computed once."""

import random

import pytest

from strainframe.catalog import models_catalog, runs_catalog
from strainframe.plans import ordered, pairs
from strainframe.sources import tables


@pytest.mark.parametrize("limit", [ordered.KEY_ROWS, 5])
@pytest.mark.parametrize("spread", [(7, 9), (1, 5), (1000, 1000)])
def test_pair_counts_of_keys_whole_and_in_runs(spark, limit, spread, monkeypatch):
    monkeypatch.setattr(ordered, "KEY_ROWS", limit)
    rng = random.Random(sum(spread))
    rows = [(rng.choice(["k", "l", None]), float(rng.randint(-spread[0], spread[0])), float(rng.randint(0, spread[1]))) for _ in range(200)]
    frame = spark.createDataFrame(rows, "k string, actual double, pred double")
    found = pairs.order_statistics(pairs.rank_cells(frame, ["k"], "actual", "pred")).collect()
    expected = {}
    for key in ("k", "l", None):
        own = [row for row in rows if row[0] == key]
        met = [(x, y) for n, x in enumerate(own) for y in own[:n] if x[1] != y[1] and x[2] != y[2]]
        expected[key] = (len(met), sum((x[1] < y[1]) == (x[2] < y[2]) for x, y in met))
    assert {r["k"]: (int(r["comparable"]), int(r["correct"])) for r in found} == expected


@pytest.mark.parametrize("limit", [ordered.KEY_ROWS, 5])
def test_pair_counts_write_no_row_per_digit(spark, limit, monkeypatch):
    monkeypatch.setattr(ordered, "KEY_ROWS", limit)
    frame = spark.createDataFrame([("k", float(i), float(i * 7 % 50)) for i in range(50)], "k string, actual double, pred double")
    counts = pairs.concordance(pairs.rank_cells(frame, ["k"], "actual", "pred"))
    assert "Generate" not in counts._jdf.queryExecution().optimizedPlan().toString()
    # The cells of a run carry their count: nothing is joined or dealt again to get it.
    assert "own" in pairs.rank_cells(frame, ["k"], "actual", "pred").frame.columns


def _tables(spark, monkeypatch):
    """Tables of a few charts; returns the names that are read."""
    rng, read = random.Random(3), []
    made = {
        "part": spark.createDataFrame(
            [(k, f"n{k}", f"Brand#{k % 3 + 1}", "t", k % 40 + 1, 900.0 + k % 17) for k in range(60)],
            "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        ),
        "lineitem": spark.createDataFrame(
            [(n % 60, float(rng.randint(1, 50)), rng.randint(0, 10) / 100) for n in range(900)], "l_partkey long, l_quantity double, l_discount double"
        ),
        "orders": spark.createDataFrame([(k, k % 9, "1-URGENT" if k % 2 else "2-HIGH") for k in range(100)], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "events": spark.createDataFrame([(k, f"2024-01-{k % 28 + 1:02} 00:00:00", k % 30, "view", float(k % 13), "{}") for k in range(300)],
                                        "event_id long, ts string, user_id long, event_type string, value double, props string"),
    }

    def table(spark, folder, name):
        read.append(name)
        return made[name]

    monkeypatch.setattr(tables, "table", table)
    monkeypatch.setattr(runs_catalog.judged_pairs.__globals__["tables"], "table", table)
    return read


def test_sweep_computes_labels_once(spark, monkeypatch):
    read = _tables(spark, monkeypatch)
    rows = models_catalog.linear_candidates(spark, "")
    assert read.count("lineitem") == 1
    assert rows.count() == 60 * 3 * 4


def test_decisions_compute_predictions_once(spark, monkeypatch):
    read = _tables(spark, monkeypatch)
    rows = runs_catalog.decisions(spark, "")
    assert read.count("lineitem") == 1
    assert rows.count() == 6
