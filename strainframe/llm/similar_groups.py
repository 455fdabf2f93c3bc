"""One document of each group of similar texts: SimHash links, completed and confirmed on whole shingle sets.

Fingerprints of at most four differing bits link texts through the Gray-order
index of ``near_dedup``. Such a link says little about similarity near 0.8 (a
pair at exactly 0.8 differs in ten bits on average), so every link is confirmed
by the Jaccard similarity of the whole sets, and the pairs that four bits miss
are found by the signatures of ``set_links``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainframe.llm import near_dedup, set_links
from strainframe.llm.common import free_name
from strainframe.session import cut_lineage

SHINGLE_WORDS = 5


def fingerprint_links(nodes: DataFrame, distance: int = near_dedup.MAX_DISTANCE) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal or linked; nodes: (node, print)."""
    lows = cut_lineage(nodes.groupBy("print").agg(F.min("node").alias("low")))
    equal = nodes.join(lows, "print").filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    linked = near_dedup.links(lows.select("print"), distance).distinct()
    ends = [lows.select(F.col("print").alias(end), F.col("low").alias(f"low_{end}")) for end in "ab"]
    linked = linked.join(ends[0], "a").join(ends[1], "b").select(F.col("low_a").alias("a"), F.col("low_b").alias("b"))
    return cut_lineage(equal.unionByName(linked))


def _rows_of(docs: DataFrame, chosen: DataFrame, id_column: str) -> DataFrame:
    """The rows of docs that are named by chosen (row), copies of one row included.

    The same join at every size: both sides are dealt by id and hash and merged, so the list is never broadcast.
    """
    wanted = chosen.select(F.col("row.id").alias("i"), F.col("row.hash").alias("h"))
    same = docs[id_column].eqNullSafe(wanted["i"]) & (set_links.row_hash(docs) == wanted["h"])
    return docs.join(wanted.hint("merge"), same, "left_semi")


def first_of_each_group(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """One row of every group, all columns kept: that with the smallest id, null ids last, then by the hash of the row.

    Rows are told apart by their content, not by their id: different texts under a repeated or null id are documents of their own.
    Groups are the components over pairs of texts whose sets of ``size``-word shingles have a Jaccard similarity of 0.8 or more;
    texts without words (empty, null) are one group. No rows, no result.
    """
    marks = cut_lineage(set_links.marked(set_links.rows_with_text(docs, id_column, text_column), size, prints=True))
    rows = marks.groupBy("node", "row").agg(F.count("*").alias("copies"))
    firsts = cut_lineage(rows.groupBy("node").agg(F.min(F.struct("row", "copies")).alias("first")))
    sets = marks.filter("size > 0").groupBy("node").agg(*(F.first(name).alias(name) for name in ("size", "keys", "print")))
    sets = cut_lineage(sets)

    def fetch(wanted: DataFrame) -> DataFrame:
        chosen = firsts.join(wanted, "node", "left_semi").select("node", F.col("first.row").alias("row"))
        return set_links.texts_of(docs, chosen, id_column, text_column)

    links = set_links.similar_links(sets.select("node", "size", "keys"), fetch, size, fingerprint_links(sets.select("node", "print")))
    roots = near_dedup.components(links)
    grouped = firsts.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    kept = cut_lineage(grouped.agg(F.min("first").alias("first")).select("first.row", "first.copies"))
    once = _rows_of(docs, kept.filter("copies = 1"), id_column)
    if kept.filter("copies > 1").isEmpty():
        return once
    named = _rows_of(docs, kept.filter("copies > 1"), id_column)
    own = free_name(named, "row_of")  # a row that occurs several times stays once
    return once.unionByName(named.withColumn(own, set_links.row_hash(docs)).dropDuplicates([id_column, own]).drop(own))
