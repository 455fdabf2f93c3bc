import random

import pytest
from pyspark.sql import functions as F

from strainframe.llm import warc_revisits as warc


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://WWW.Example.com:443/a/?utm_source=x#top", "example.com/a"),
        ("http://example.com/a?b=2&a=1&ref=z", "example.com/a?a=1&b=2"),
        ("example.com", "example.com"),
        ("http://example.com:8080/A/B//", "example.com:8080/A/B"),
        ("http://example.com?q", "example.com?q"),
        ("", ""),
    ],
)
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == key


def record(number, url, ts, status, payload=None, **headers):
    return (number, url, ts, status, {k.replace("_", "-"): v for k, v in headers.items()}, payload)


def test_outcomes_and_headers(spark):
    records = [
        record(1, "http://a.org/x", 10, 200, "old", ETag='"1"', Content_Type="text/html", Connection="close"),
        record(2, "https://a.org/x/", 20, 200, "new", ETag='"2"', Content_Type="text/html", Content_Length="3", Age="1"),
        record(3, "http://A.org/x#y", 30, 304, None, etag='W/"2"', Content_Length="0", Content_Type="other", Age="9", Connection="close", X="n"),
        record(4, "http://a.org/x", 15, 304, None, ETag='"2"'),
        record(5, "http://a.org/x", 5, 304, None, ETag='"1"'),
        record(6, "http://a.org/x", 40, 304, None),
        record(7, "http://b.org/", 40, 304, None, Last_Modified="d"),
        record(8, "http://b.org/", 30, 404, "gone"),
        record(9, None, 30, 304, None),
        (10, "http://a.org/x", None, 304, None, None),
        record(11, "http://a.org/x", 20, 304, None, ETag='"2"'),
    ]
    frame = spark.createDataFrame(records, warc.RECORDS).withColumn("outcome", F.lit("mine"))
    found = {r["record_id"]: r for r in warc.resolve_revisits(frame, blocks=4).collect()}
    assert {n: (r["response_id"], r["outcome"]) for n, r in found.items()} == {
        3: (2, "resolved"), 4: (1, "mismatch"), 5: (None, "no_response"), 6: (2, "unverified"), 7: (None, "no_response"),
        9: (None, "no_response"), 10: (None, "no_response"), 11: (2, "resolved"),
    }
    assert found[3]["headers"] == {"etag": 'W/"2"', "content-type": "text/html", "content-length": "3", "age": "9", "x": "n"}
    assert (found[3]["payload"], found[3]["status"], found[4]["payload"], found[4]["headers"]) == ("new", 200, None, None)
    assert warc.resolve_revisits(frame.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    response, revisit = record(1, "http://a.org", 10, 200, "p", ETag="1"), record(2, "http://a.org", 20, 304, None, ETag="1")
    unnamed = [record(None, "http://b.org", 10, 200, "q"), record(None, "http://b.org", 20, 304), record(None, "http://b.org", 30, 304)]
    twice = [record(5, "http://c.org", 10, 200, "old"), record(5, "http://c.org", 15, 200, "new"), record(6, "http://c.org", 12, 304), record(6, "http://c.org", 16, 304)]
    frame = spark.createDataFrame([response, revisit] * 2 + unnamed + twice, warc.RECORDS)
    for blocks in (1, 5):
        found = sorted((r["url"], r["ts"], r["response_id"] or 0, r["outcome"], r["status"], r["payload"]) for r in warc.resolve_revisits(frame, blocks).collect())
        assert found == [
            ("http://a.org", 20, 1, "resolved", 200, "p"), ("http://a.org", 20, 1, "resolved", 200, "p"),
            ("http://b.org", 20, 0, "unverified", 200, "q"), ("http://b.org", 30, 0, "unverified", 200, "q"),
            ("http://c.org", 12, 5, "unverified", 200, "old"), ("http://c.org", 16, 5, "unverified", 200, "new"),
        ]


@pytest.mark.parametrize("blocks", [1, 7])
def test_as_of_equals_brute_force(spark, blocks):
    dice = random.Random(6)
    rows = [(f"k{min(dice.randint(0, 6), 2)}", dice.randint(0, 60), n, dice.random() < 0.3) for n in range(400)]  # one key has most rows, times tie
    found = {r["revisit"]: r["response"] for r in warc.latest_responses(spark.createDataFrame(rows, "key string, ts long, record_id long, full boolean"), blocks).collect()}
    for key, ts, number, full in rows:
        if not full:
            earlier = [(t, n) for k, t, n, f in rows if f and k == key and (t, n) < (ts, number)]
            assert found[number] == (max(earlier)[1] if earlier else None)
