"""MinHash near-duplicates by an inverted join over signature coordinates.

Documents are posted under every (coordinate, value) pair of their signature;
collisions are counted by merging lists, short ones in full and long ones by
probing, and a pair is retained above a number of matches. Retained pairs are
confirmed on the whole shingle sets, whose components are the result. The lists,
their prefixes and the merging are those of ``set_links``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainframe.llm import set_links
from strainframe.llm.near_dedup import components
from strainframe.session import cut_lineage

SHINGLE_WORDS = 4


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE_WORDS) -> DataFrame:
    """(id, n_shingles, component): the smallest id reachable over links of a Jaccard similarity of 0.8 or more, itself included.

    Sets hold the distinct shingles of ``size`` words, lower-cased A-Z; shorter texts are one shingle. Texts without
    words, null ones too, have no shingles and are linked with nothing: their component is their own id. Rows that repeat
    an id or a whole row are rows of the result each; null ids belong to groups but name none, unless no member has an id. Other columns
    only tell rows apart. No rows, no result.
    """
    marks = cut_lineage(set_links.marked(set_links.rows_with_text(docs, id_column, text_column), size))
    sets = marks.filter("size > 0")
    nodes = cut_lineage(sets.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.min("row").alias("row")))

    def fetch(wanted: DataFrame) -> DataFrame:
        chosen = nodes.select("node", "row").join(wanted, "node", "left_semi")
        return set_links.texts_of(docs, chosen, id_column, text_column)

    links = set_links.similar_links(nodes.select("node", "size", "keys"), fetch, size)
    roots = components(links)
    rooted = nodes.select("node", F.col("row.id").alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = cut_lineage(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(named, "root").select("node", "component")
    grouped = sets.select(F.col("row.id").alias("id"), "size", "node").join(named, "node").select("id", F.col("size").alias("n_shingles"), "component")
    alone = marks.filter("size = 0").select(F.col("row.id").alias("id"), F.col("size").alias("n_shingles"), F.col("row.id").alias("component"))
    return grouped.unionByName(alone)
