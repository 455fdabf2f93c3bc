import json

from pyspark.sql import functions as F

from strainframe.sources import landed_json

GOOD = {"id": 1, "mode": 3, "status": "ranked", "cs": 4}
CASES = [
    ({}, True),
    ({"mode": "3"}, False),
    ({"mode": 3.0}, True),
    ({"mode": "mania"}, True),
    ({"mode": 0, "mode_int": 3}, True),
    ({"mode": "0", "mode_int": 3}, False),
    ({"mode": "", "mode_int": 3}, True),
    ({"mode": None, "mode_int": "mania"}, True),
    ({"mode": False, "mode_int": 3}, True),
    ({"mode": True}, False),
    ({"status": None, "ranked": 1}, True),
    ({"status": "", "ranked": "1"}, False),
    ({"status": "graveyard", "ranked": 1}, False),
    ({"status": 1}, True),
    ({"status": True}, True),
    ({"mode": {"a": 3}}, False),
]


def plain(chart):
    mode, status = chart.get("mode") or chart.get("mode_int"), chart.get("status") or chart.get("ranked")
    return (mode == "mania" or mode == 3) and (status == "ranked" or status == 1)


def test_json_types_decide(spark):
    charts = [GOOD | change | {"id": n} for n, (change, _) in enumerate(CASES)]
    assert [plain(chart) for chart in charts] == [good for _, good in CASES]
    pages = spark.createDataFrame([(0, json.dumps({"beatmapsets": [{"id": 9, "bpm": 120, "beatmaps": charts}]}))], "page_no long, page string")
    parsed = pages.select(F.from_json("page", landed_json.PAGE_SCHEMA).alias("j"))
    found = parsed.select(F.explode("j.beatmapsets").alias("s")).select(F.explode("s.beatmaps").alias("m"))
    got = found.select("m.id", landed_json.is_ranked_keymode("m").alias("ok")).collect()
    assert [row["ok"] for row in sorted(got, key=lambda r: r["id"])] == [good for _, good in CASES]
    flat = landed_json.flatten_pages(pages).collect()
    assert {row["bpm"] for row in flat} == {120.0} and len(flat) == sum(good for _, good in CASES)
