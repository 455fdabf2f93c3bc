"""From raw documents to sampled token pieces: language, near-duplicates, benchmark passages, segmentation.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strainframe.llm import decontaminate, language_id, piece_sampling, similar_groups
from strainframe.llm.common import bounded_batches, table
from strainframe.session import cut_lineage

PIECE_MODEL = "piece_bpe_32k.model"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and narrow decisions go."""
    bounded_batches(spark)
    content = language_id.learn(docs)
    return language_id.predict(docs, content).filter(language_id.accepted()).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of texts linked by a five-word Jaccard similarity of 0.8 or more."""
    bounded_batches(spark, 250)
    return similar_groups.first_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    bounded_batches(spark)
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the pieces drawn for them and whether those decode to the text."""
    bounded_batches(spark)
    model = public_tokenizers.path(PIECE_MODEL)
    decoded = piece_sampling.decode(piece_sampling.encode(docs, model), model)
    return decoded.withColumn("lossless", decoded["text"].eqNullSafe(decoded["decoded"])).drop("decoded")


STAGES = [
    ("language identification", known_language),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("piece sampling", sampled_pieces),
]

#: Compression and sampling have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if place == 0 else cut_lineage(docs), sf_dir)
    return docs
