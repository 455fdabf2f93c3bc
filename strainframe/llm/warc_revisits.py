"""Not-modified revisits of a web archive resolved to the full responses they stand for.

A revisit (status 304, no payload) belongs to the latest earlier full response of
its canonical URL. The as-of join runs on keys and validators alone: time is cut
into blocks of about equal size, so even one URL with a third of all captures is
spread over many groups; the last response of every (URL, block) is carried into
the later blocks. Payloads are fetched at the end, once the pairs are known. Rows are
told apart by a hash of all their columns, so record ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainframe.llm.common import scan_width
from strainframe.llm.ranges import with_range

#: Query parameters that do not change what a URL shows (fixed values).
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid"]
#: Fields that a 304 response may not change in the stored response (fixed values, RFC 9111 section 3.2).
KEPT_FIELDS = ["content-length", "content-encoding", "content-type", "content-range"]
#: Fields that concern one connection and are never stored (fixed values, RFC 9110 section 7.6.1 and RFC 9111 section 3.1).
HOP_FIELDS = [
    "connection",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authentication-info",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
]

RECORDS = "record_id long, url string, ts long, status int, headers map<string,string>, payload string"


def canonical_url(url: Column) -> Column:
    """Host in lower case, no scheme, default port, leading www, fragment, tracking parameter or trailing slash; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "(?i)^https?://", "")
    before = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.lower(F.regexp_extract(before, "^([^/]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(before, "^[^/]*(.*)$", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda part: (part != "") & ~F.regexp_extract(part, "^([^=]*)", 1).isin(TRACKING))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def field(headers: Column, name: str) -> Column:
    """A header's value; names are stored in lower case."""
    return F.trim(F.try_element_at(headers, F.lit(name)))


def _tag(value: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(value, "^W/", "")


def verdict(revisit: Column, response: Column) -> Column:
    """How the validators that both sides carry compare: the entity tag decides, then the date, then the payload digest."""
    sides = [
        (_tag(field(revisit, "etag")), _tag(field(response, "etag"))),
        (field(revisit, "last-modified"), field(response, "last-modified")),
        (field(revisit, "warc-payload-digest"), field(response, "warc-payload-digest")),
    ]
    outcome = F.lit("unverified")
    for a, b in reversed(sides):
        outcome = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("mismatch")).otherwise(outcome)
    return outcome


def lower_names(headers: Column) -> Column:
    """Header map with names in lower case; of names that differ in case only, the first by name stays."""
    return F.aggregate(
        F.array_sort(F.map_entries(headers)),
        F.from_json(F.lit("{}"), "map<string,string>"),
        lambda held, e: F.when(F.map_contains_key(held, F.lower(e["key"])), held).otherwise(F.map_concat(held, F.create_map(F.lower(e["key"]), e["value"]))),
    )


def merged_headers(stored: Column, revisit: Column) -> Column:
    """The stored response's fields, those that a 304 may update replaced or added."""
    permitted = F.map_filter(revisit, lambda name, _: ~name.isin(KEPT_FIELDS + HOP_FIELDS))
    rest = F.map_filter(stored, lambda name, _: ~F.map_contains_key(permitted, name) & ~name.isin(HOP_FIELDS))
    return F.map_concat(rest, permitted)


def latest_responses(records: DataFrame, blocks: int) -> DataFrame:
    """(revisit, response): record ids of every revisit and of the latest earlier full response of its URL, or null.

    ``records`` has key, ts, record_id and full (boolean). Earlier means a smaller
    (ts, record_id).
    """
    placed = with_range(records, "ts", blocks, "block")
    moment = F.struct("ts", "record_id")
    # One row for each key and block that has captures; the carry comes from earlier blocks only.
    present = placed.groupBy("key", "block").agg(F.max(F.when(F.col("full"), moment)).alias("last"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carries = present.withColumn("carry", F.last("last", ignorenulls=True).over(before)).select("key", "block", F.col("carry.record_id").alias("carry"))
    inside = Window.partitionBy("key", "block").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("seen", F.last(F.when(F.col("full"), F.col("record_id")), ignorenulls=True).over(inside))
    seen = seen.filter(~F.col("full")).select("key", "block", F.col("record_id").alias("revisit"), "seen")
    return seen.join(carries, ["key", "block"]).select("revisit", F.coalesce("seen", "carry").alias("response"))


def row_hash(*columns: Column) -> Column:
    """128 bits over the columns as hex digits."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit(" "), F.hex(F.xxhash64(F.lit("second"), *columns)))


def resolve_revisits(records: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row a revisit: record_id, url, ts, response_id, outcome, status, headers, payload.

    ``records`` has the columns of RECORDS; other columns are ignored. Status 304 is a
    revisit, 200 a full response, all other records are passed over. Outcomes:
    ``resolved`` (validators agree), ``unverified`` (none in common; merged as well),
    ``mismatch`` and ``no_response`` (status, headers and payload null). A null URL or
    time matches nothing; null headers count as none. Repeated revisits give a row
    each, repeated responses count as one, and a response with a null record id
    resolves its revisits like any other.
    """
    headers = lower_names(F.coalesce("headers", F.from_json(F.lit("{}"), "map<string,string>")))
    known = records.filter(F.col("status").isin(200, 304)).select("record_id", "url", "ts", "status", headers.alias("headers"), "payload")
    known = known.withColumn("row", row_hash(F.col("record_id"), F.col("url"), F.col("ts"), F.col("status"), F.array_sort(F.map_entries("headers")), F.col("payload")))
    timed = known.filter(F.col("url").isNotNull() & F.col("ts").isNotNull())
    light = timed.select(canonical_url(F.col("url")).alias("key"), "ts", F.struct("record_id", "row").alias("record_id"), (F.col("status") == 200).alias("full"))
    pairs = latest_responses(light, blocks or scan_width(records))
    # Equal revisits have the same response before them.
    pairs = pairs.select(F.col("revisit.row").alias("row"), F.col("response.row").alias("response"), F.col("response.record_id").alias("response_id"))
    revisits = known.filter("status = 304").select("record_id", "url", "ts", F.col("headers").alias("asked"), "row")
    revisits = revisits.join(pairs.dropDuplicates(["row"]), "row", "left")
    stored = known.filter("status = 200").select(F.col("row").alias("response"), F.col("headers").alias("stored"), "payload")
    met = revisits.join(stored.dropDuplicates(["response"]), "response", "left")
    outcome = F.when(F.col("response").isNull(), "no_response").otherwise(verdict(F.col("asked"), F.col("stored")))
    met = met.withColumn("outcome", outcome)
    good = F.col("outcome").isin("resolved", "unverified")
    return met.select(
        "record_id",
        "url",
        "ts",
        "response_id",
        "outcome",
        F.when(good, F.lit(200)).alias("status"),
        F.when(good, merged_headers(F.col("stored"), F.col("asked"))).alias("headers"),
        F.when(good, F.col("payload")).alias("payload"),
    )
