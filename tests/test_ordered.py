"""Windows over runs must equal plain windows, also when one key holds most rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from strainframe.plans.ordered import OrderedRuns


def _rows(seed, size=400):
    rng = random.Random(seed)
    return [
        (1 if rng.random() < 0.6 else rng.randint(2, 9), rng.randint(0, 30), rng.randint(0, 3), i, rng.random())
        for i in range(size)
    ]


def _runs(spark, seed):
    frame = spark.createDataFrame(_rows(seed), "k long, t long, c int, id long, v double")
    return frame, OrderedRuns.build(frame, ["k"], ["t", "c", "id"], runs=7)


def _same(left, right):
    key = lambda row: row["id"]
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))


def test_index_lag_running_match_plain_windows(spark):
    for seed in (1, 2):
        frame, runs = _runs(spark, seed)
        w = Window.partitionBy("k").orderBy("t", "c", "id")
        wc = Window.partitionBy("k", "c").orderBy("t", "id")
        expected = frame.select(
            "id",
            (F.row_number().over(w) - 1).cast("long").alias("i"),
            F.lag("t", 1).over(w).alias("p1"),
            F.lag("t", 2).over(w).alias("p2"),
            F.lag("t", 1).over(wc).alias("pc"),
            F.min("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
            F.count(F.lit(1)).over(Window.partitionBy("k", "t")).alias("n"),
        )
        got = (
            runs.indexed("i")
            .lagged({"p1": ("t", 1), "p2": ("t", 2)})
            .lagged({"pc": ("t", 1)}, within=["c"])
            .running({"m": ("min", F.col("v"))}, inclusive=False)
            .group_totals(["k", "t"], {"n": ("sum", F.lit(1).cast("long"))})
            .rows()
            .select("id", "i", "p1", "p2", "pc", "m", "n")
        )
        _same(got, expected)


def test_global_order_without_keys(spark):
    frame = spark.createDataFrame([(i, float((i * 37) % 11)) for i in range(90)], "id long, v double")
    got = OrderedRuns.build(frame, [], ["v", "id"], runs=5).indexed("i").lagged({"p": ("id", 1)}).rows()
    w = Window.partitionBy(F.lit(1)).orderBy("v", "id")
    expected = frame.select(
        "id", "v", (F.row_number().over(w) - 1).cast("long").alias("i"), F.lag("id", 1).over(w).alias("p")
    )
    _same(got.select("id", "v", "i", "p"), expected)
