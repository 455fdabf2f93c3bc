"""Registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainframe.llm import decontaminate, katz, language_id, merkle, minhash_join, near_dedup, page_templates, piece_sampling, preferences, syncmers, token_files, turn_repair, warc_revisits
from strainframe.llm.common import table
from strainframe.session import scratch_path

WORD_MODEL = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def remainder(divisor: int):
    """crc32 of the id as text, modulo a number of folds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(divisor))


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(table(spark, sf_dir, "documents"), remainder(5) != 1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))
    content = language_id.learn(documents.filter(~F.col("held_out")))
    found = language_id.predict(documents.select("doc_id", "held_out", "text"), content)
    return found.select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), (~language_id.accepted()).alias("rejected")
    )


def op3_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_next(table(spark, sf_dir, "documents"))


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = piece_sampling.encode(documents, public_tokenizers.path(PIECE_MODEL))
    decoded = piece_sampling.decode(encoded, public_tokenizers.path(PIECE_MODEL))
    return decoded.select(
        "doc_id",
        F.coalesce(F.size("pieces"), F.lit(0)).cast("long").alias("n_pieces"),
        F.xxhash64("pieces").alias("pieces_hash"),
        F.col("text").eqNullSafe(F.col("decoded")).alias("lossless"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_MODEL))
    return token_files.read_token_files(spark, path, digest=True)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), near_dedup.hexadecimal(F.col("print")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_hits(documents, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        F.col("hit_words").alias("n_words"),
        decontaminate.hit_count().alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


OP7_SQL = r"""
WITH words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
items AS (
    SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM words WHERE len(w) > 0)),
docs AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
lengths AS (SELECT DISTINCT n FROM items),
starts AS (
    SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT s.rid, s.n, s.i, x.item_id FROM starts s JOIN items x ON x.win = s.win AND x.n = s.n),
covered AS (
    SELECT rid, count(DISTINCT p) AS n_hit
    FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
named AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.listed, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c ON c.rid = d.rid LEFT JOIN named m ON m.rid = d.rid
"""


def page_captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a full response, and a revisit of another spelling of its URL.

    Revisits carry the right entity tag, a wrong one, a date or nothing; one in
    seven precedes its response.
    """
    number = F.col("page_id")
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    day = F.concat(F.lit("day "), (number % 11).cast("string"))
    response = pages.select(
        (number * 2).alias("record_id"),
        "url",
        (number * 10).alias("ts"),
        F.lit(200).alias("status"),
        F.create_map(
            *map(F.lit, ("Content-Type", "text/html", "Connection", "keep-alive")),
            F.lit("Content-Length"),
            F.length("html").cast("string"),
            F.lit("ETag"),
            tag,
            F.lit("Last-Modified"),
            day,
        ).alias("headers"),
        F.col("html").alias("payload"),
    )
    always = F.create_map(*map(F.lit, ("Cache-Control", "max-age=60", "Content-Length", "0", "Connection", "close")))
    validator = (
        F.when(number % 5 == 0, F.create_map(F.lit("ETag"), F.lit('"other"')))
        .when(number % 5 == 2, F.create_map(F.lit("Last-Modified"), day))
        .when(number % 5 != 1, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), tag)))
        .otherwise(F.create_map(F.lit("X-Seen"), F.lit("1")))
    )
    revisit = pages.select(
        (number * 2 + 1).alias("record_id"),
        F.concat("url", F.lit("#later")).alias("url"),
        (number * 10 + F.when(number % 7 == 0, -5).otherwise((number % 4) * 20000 + 5)).alias("ts"),
        F.lit(304).alias("status"),
        F.map_concat(always, validator).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return response.unionByName(revisit)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_revisits.resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    listed = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select(
        "record_id",
        "response_id",
        "outcome",
        "status",
        F.array_join(listed, ";").alias("headers"),
        F.length("payload").cast("long").alias("payload_chars"),
        F.sha2("payload", 256).alias("payload_sha256"),
    )


OP8_SQL = r"""
WITH spelt AS (
    SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^https?://', '', 'i') AS bare FROM pages),
parts AS (
    SELECT *, lower(regexp_extract(bare, '^([^/?]*)', 1)) AS host, regexp_extract(regexp_extract(bare, '^([^?]*)', 1), '^[^/]*(.*)$', 1) AS path,
           list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_source|utm_medium|utm_campaign|utm_term|utm_content|ref|fbclid|gclid)(=|$)'))) AS args
    FROM spelt),
keyed AS (
    SELECT page_id, html, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS key
    FROM parts),
full_ AS (SELECT page_id * 2 AS record_id, page_id * 10 AS ts, key, html, page_id, '"' || md5(html) || '"' AS tag, 'day ' || (page_id % 11) AS day FROM keyed),
asked AS (
    SELECT page_id * 2 + 1 AS record_id, key, page_id,
           page_id * 10 + CASE WHEN page_id % 7 = 0 THEN -5 ELSE (page_id % 4) * 20000 + 5 END AS ts,
           CASE WHEN page_id % 5 = 0 THEN '"other"' WHEN page_id % 5 IN (1, 2) THEN NULL ELSE '"' || md5(html) || '"' END AS tag,
           CASE WHEN page_id % 5 = 2 THEN 'day ' || (page_id % 11) END AS day
    FROM keyed),
met AS (
    SELECT a.record_id, a.page_id, a.tag AS asked_tag, a.day AS asked_day, f.record_id AS response_id, f.tag, f.day, f.html,
           row_number() OVER (PARTITION BY a.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) AS place
    FROM asked a LEFT JOIN full_ f ON f.key = a.key AND (f.ts < a.ts OR (f.ts = a.ts AND f.record_id < a.record_id))),
judged AS (
    SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN asked_tag IS NOT NULL THEN CASE WHEN asked_tag = tag THEN 'resolved' ELSE 'mismatch' END
                   WHEN asked_day IS NOT NULL THEN CASE WHEN asked_day = day THEN 'resolved' ELSE 'mismatch' END ELSE 'unverified' END AS outcome
    FROM met WHERE place = 1)
SELECT record_id, response_id, outcome, CASE WHEN outcome IN ('resolved', 'unverified') THEN 200 END AS status,
       CASE WHEN outcome IN ('resolved', 'unverified') THEN
           'cache-control=max-age=60;content-length=' || length(html) || ';content-type=text/html;etag=' || CASE WHEN asked_tag IS NULL THEN tag ELSE 'W/' || asked_tag END
           || ';last-modified=' || day || CASE WHEN page_id % 5 = 1 THEN ';x-seen=1' ELSE '' END END AS headers,
       CASE WHEN outcome IN ('resolved', 'unverified') THEN CAST(length(html) AS BIGINT) END AS payload_chars,
       CASE WHEN outcome IN ('resolved', 'unverified') THEN sha256(html) END AS payload_sha256
FROM judged
"""


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = preferences.with_swapped_answer(table(spark, sf_dir, "conversations"))
    return preferences.format_preferences(pairs).select(
        "conv_id",
        "prompt_turns",
        "prompt",
        preferences.text_of(F.col("chosen_completion")).alias("chosen"),
        preferences.text_of(F.col("rejected_completion")).alias("rejected"),
        preferences.text_of(F.col("chosen_completion"), trained_only=True).alias("chosen_trained"),
        preferences.text_of(F.col("rejected_completion"), trained_only=True).alias("rejected_trained"),
    )


OP9_SQL = """
WITH turns AS (
    SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations WHERE conv_id IS NOT NULL),
answers AS (SELECT conv_id, max(n) AS at, max_by(text, n) AS text FROM turns WHERE role = 'assistant' GROUP BY conv_id),
other AS (
    SELECT t.conv_id, t.n, t.role, CASE WHEN t.n = a.at THEN b.text ELSE t.text END AS text
    FROM turns t LEFT JOIN answers a ON a.conv_id = t.conv_id
    LEFT JOIN answers b ON b.conv_id = t.conv_id + CASE WHEN t.conv_id % 2 = 0 THEN 1 ELSE -1 END
    WHERE a.at IS NULL OR b.conv_id IS NOT NULL OR t.n < a.at),
ends AS (
    SELECT conv_id, min(n) AS n FROM (
        SELECT coalesce(t.conv_id, o.conv_id) AS conv_id, coalesce(t.n, o.n) AS n
        FROM turns t FULL JOIN other o ON o.conv_id = t.conv_id AND o.n = t.n
        WHERE t.n IS NULL OR o.n IS NULL OR t.role IS DISTINCT FROM o.role OR t.text IS DISTINCT FROM o.text) GROUP BY conv_id),
sides AS (SELECT 'c' AS side, conv_id, n, role, text FROM turns UNION ALL SELECT 'r', conv_id, n, role, text FROM other),
pieces AS (
    SELECT s.side, s.conv_id, s.n, coalesce(s.n < e.n, true) AS shared, '<|im_start|>' || s.role || chr(10) AS head, s.text || '<|im_end|>' || chr(10) AS body,
           s.role = 'assistant' AS trained
    FROM sides s LEFT JOIN ends e ON e.conv_id = s.conv_id)
SELECT conv_id, CAST(count(*) FILTER (shared AND side = 'c') AS INTEGER) AS prompt_turns,
       coalesce(string_agg(head || body, '' ORDER BY n) FILTER (shared AND side = 'c'), '') AS prompt,
       coalesce(string_agg(head || body, '' ORDER BY n) FILTER (NOT shared AND side = 'c'), '') AS chosen,
       coalesce(string_agg(head || body, '' ORDER BY n) FILTER (NOT shared AND side = 'r'), '') AS rejected,
       coalesce(string_agg(body, '' ORDER BY n) FILTER (NOT shared AND trained AND side = 'c'), '') AS chosen_trained,
       coalesce(string_agg(body, '' ORDER BY n) FILTER (NOT shared AND trained AND side = 'r'), '') AS rejected_trained
FROM pieces GROUP BY conv_id
UNION ALL
SELECT conv_id, CASE WHEN role = 'assistant' THEN 0 ELSE 1 END,
       CASE WHEN role = 'assistant' THEN '' ELSE '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) END,
       CASE WHEN role = 'assistant' THEN '<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) ELSE '' END, '',
       CASE WHEN role = 'assistant' THEN coalesce(text, '') || '<|im_end|>' || chr(10) ELSE '' END, ''
FROM conversations WHERE conv_id IS NULL
"""


def op10_page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_templates.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Conversations after damage by the crc32 of ``conv_id:turn``: dropped, emptied, unpunctuated, repeated or user turns."""
    cell = {name: F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")}
    fault = F.pmod(F.crc32(F.concat(cell["conv_id"], F.lit(":"), cell["turn"]).cast("binary")), F.lit(20))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(cell["text"], "[.!?]", "")).otherwise(cell["text"])
    rows = conversations.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(cell["role"]).alias("role"), text.alias("text"),
        F.when(fault == 3, F.array(F.lit(0), F.lit(1))).when(fault != 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")).alias("copies"),
    )
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return turn_repair.repair(damaged_turns(conversations), conversations.select("conv_id"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text: its bits one after another through the reflected polynomial."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * strlen({text})), lambda i: "
        f"CASE WHEN i % 8 = 0 THEN ord(substring({text}, CAST(i // 8 + 1 AS INTEGER), 1))::BIGINT ELSE 0::BIGINT END)), "
        "lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384::BIGINT) ELSE xor(c, b) >> 1 END), 4294967295::BIGINT)"
    )


def _repair_step() -> str:
    """Cheapest ways b0 (nothing), b1 (system), b2 (user), b3 (assistant) after one more row.

    A way is its cost in nine digits, its letters (as many as rows) and the repaired text, so that the least string is
    the cheapest way and the first one in ASCII. Inserted turns cost more than deleting their partners and never occur.
    """

    def way(of: str, cost: str, letter: str, said: str) -> str:
        added = f"lpad(CAST(CAST({of}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0')"
        return f"{added} || {of}[10:8 + i] || '{letter}' || {of}[9 + i:] || {said}"

    def turn(of: str, initial: str, role: str) -> str:
        kept = f"CASE WHEN NOT gone AND initial = '{initial}' THEN {way(of, 'extra', 'K', 'chr(10) || role || chr(58) || text')} END"
        if not role:
            return kept
        return kept + f", CASE WHEN NOT gone THEN {way(of, '1 + extra', 'R', f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"

    gone = {n: way(f"b{n}", "2", "D", "''") for n in range(4)}
    return f"""{gone[0]} AS b0,
               least({gone[1]}, {turn("b0", "s", "")}) AS b1,
               least({gone[2]}, {turn("b0", "u", "user")}, {turn("b1", "u", "user")}, {turn("b3", "u", "user")}) AS b2,
               least({gone[3]}, {turn("b2", "a", "assistant")}) AS b3"""


OP11_SQL = rf"""
WITH RECURSIVE cells AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations),
faults AS (SELECT *, {crc32_sql("name")} % 20 AS fault FROM cells),
hurt AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS again
    FROM faults),
ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i, left(role, 1) AS initial,
           rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM hurt),
judged AS (
    SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM ordered),
ready AS (
    SELECT *, blank OR seen AS gone, CASE WHEN NOT blank AND NOT seen AND right(bare, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM judged),
ways AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS b0, CAST(NULL AS VARCHAR) AS b1, CAST(NULL AS VARCHAR) AS b2, CAST(NULL AS VARCHAR) AS b3
    FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL
    SELECT conv_id, i, b0, b1, b2, b3 FROM (
        SELECT r.conv_id, r.i, {_repair_step()}
        FROM (SELECT w.conv_id, r.i, r.role, r.text, r.initial, r.gone, r.extra, w.b0, w.b1, w.b2, w.b3
              FROM ways w JOIN ready r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1) r)),
ends AS (SELECT conv_id, i, least(b0, b3) AS best FROM ways QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
           count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (extra > 0) AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM ready GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best[1:9] AS BIGINT) AS cost, best[10:9 + i] AS audit,
       sha256(best[11 + i:]) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def op12_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept")
    )


#: Pairs are found over their shared shingles, components by carrying the least id along links.
OP12_SQL = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS rid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
sets AS (
    SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
alike AS (SELECT md5(array_to_string(list_sort(s), chr(10))) AS node, min(doc_id) AS least, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY 1),
shingles AS (SELECT node, len(s) AS n, unnest(s) AS x FROM alike),
ranked AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY df, x) AS place FROM (SELECT *, count(*) OVER (PARTITION BY x) AS df FROM shingles)),
prefix AS (SELECT node, n, x FROM ranked WHERE 5 * (place - 1) <= n),
pairs AS (
    SELECT DISTINCT a.node AS a, b.node AS b FROM prefix a JOIN prefix b ON b.x = a.x AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
links AS (
    SELECT a, b FROM (SELECT a, b, x.s AS s, y.s AS t FROM pairs JOIN alike x ON x.node = a JOIN alike y ON y.node = b)
    WHERE 100 * len(list_intersect(s, t)) >= 80 * (len(s) + len(t) - len(list_intersect(s, t)))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT node, node AS other FROM alike
    UNION
    SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
named AS (SELECT r.node, min(a.least) AS component FROM reach r JOIN alike a ON a.node = r.other GROUP BY r.node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE n.component END AS component_id,
       s.doc_id IS NOT DISTINCT FROM CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE n.component END AS kept
FROM sets s LEFT JOIN named n ON n.node = md5(array_to_string(list_sort(s.s), chr(10)))
"""


MANIFEST_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fields = [lower if name == "text" else F.col(name) for name in MANIFEST_FIELDS]
    tampered = F.when(remainder(3) == 0, merkle.leaf_digest(fields))
    manifest = merkle.build_manifest(documents, MANIFEST_FIELDS, "lang", "doc_id", {"tampered": tampered})
    found = merkle.verify(manifest, "tampered")
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


#: Levels that the SQL for the manifest unrolls: 8 ** 8 documents of a language.
MANIFEST_LEVELS = 8


def _manifest_sql() -> str:
    """Every level of both trees, then siblings and folded digests of each leaf level by level."""

    def field(name: str, value: str) -> str:
        return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(name, text if name == "text" else name) for name in MANIFEST_FIELDS) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""base AS (
    SELECT doc_id, coalesce('=' || lang, '-') AS tree, {leaf("text")} AS leaf,
           CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lower)} END AS other FROM documents),
a0 AS (SELECT doc_id, tree, leaf, other, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base)"""
    ]

    def levels(name: str) -> None:
        """name0 has (tree, pos, digest); a tree with one node stays as it is."""
        for n in range(MANIFEST_LEVELS):
            parts.append(
                f"""{name}{n + 1} AS (
    SELECT tree, CASE WHEN top = 0 THEN pos ELSE pos // 8 END AS pos,
           CASE WHEN any_value(top) = 0 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest
    FROM (SELECT tree, pos, digest, max(pos) OVER (PARTITION BY tree) AS top FROM {name}{n}) GROUP BY tree, 2)"""
            )

    def climb(rows: str, name: str) -> str:
        """rows have (tree, pos, told, own, ...); the siblings of each level are told and folded into own."""
        for n in range(MANIFEST_LEVELS):
            parts.append(f"{name}s{n} AS (SELECT tree, pos, digest, max(pos) OVER (PARTITION BY tree) AS top FROM {name}{n})")
            parts.append(
                f"""{name}r{n} AS (SELECT tree, pos // 8 AS run, any_value(top) AS top, list(digest ORDER BY pos) AS run_digests FROM {name}s{n} GROUP BY tree, 2)"""
            )
            at = "CAST(r.pos % 8 AS INTEGER)"
            before, after = (f"array_to_string(x.run_digests[{cut}], '')" for cut in (f"1:{at}", f"{at} + 2:8"))
            parts.append(
                f"""{name}c{n} AS (
    SELECT r.* EXCLUDE (pos, told, own), CASE WHEN x.top = 0 THEN r.pos ELSE r.pos // 8 END AS pos,
           CASE WHEN x.top = 0 THEN r.told ELSE r.told || {before} || {after} END AS told,
           CASE WHEN x.top = 0 THEN r.own ELSE sha256({before} || r.own || {after}) END AS own
    FROM {rows} r JOIN {name}r{n} x ON x.tree = r.tree AND x.run = r.pos // 8)"""
            )
            rows = f"{name}c{n}"
        return rows

    levels("a")
    parts.append("begun AS (SELECT doc_id, tree, leaf, pos, '' AS told, coalesce(other, leaf) AS own FROM a0)")
    climbed = climb("begun", "a")
    parts.append(f"b0 AS (SELECT 'top' AS tree, tree AS name, digest, row_number() OVER (ORDER BY tree) - 1 AS pos FROM a{MANIFEST_LEVELS})")
    levels("b")
    parts.append(f"above AS (SELECT c.doc_id, c.leaf, b.digest AS subroot, b.tree, b.pos, c.told, c.own FROM {climbed} c JOIN b0 b ON b.name = c.tree)")
    ended = climb("above", "b")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(told) AS proof_sha256, own AS folded_root, own = root AS verified\n"
        f"FROM {ended} CROSS JOIN (SELECT digest AS root FROM b{MANIFEST_LEVELS})"
    )


QUERIES = {
    "op1_katz": op1_katz,
    "op2_language_id": op2_language_id,
    "op3_syncmers": op3_syncmers,
    "op4_piece_sampling": op4_piece_sampling,
    "op5_token_files": op5_token_files,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_decontamination": op7_decontamination,
    "op8_revisits": op8_revisits,
    "op9_preferences": op9_preferences,
    "op10_page_templates": op10_page_templates,
    "op11_turn_repair": op11_turn_repair,
    "op12_minhash_join": op12_minhash_join,
    "op13_merkle": op13_merkle,
}

ORACLES = {
    "op7_decontamination": OP7_SQL,
    "op8_revisits": OP8_SQL,
    "op9_preferences": OP9_SQL,
    "op11_turn_repair": OP11_SQL,
    "op12_minhash_join": OP12_SQL,
    "op13_merkle": _manifest_sql(),
}
