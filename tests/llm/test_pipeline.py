import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from strainframe.llm import decontaminate, language_id
from strainframe.session import cut_lineage
from test_similar_groups import brute_groups

SF = "/root/testdata/sf0.001"


def test_stages_keep_and_drop_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, docs, SF))
        gone = docs.join(out.select("doc_id"), "doc_id", "left_anti")
        if name == "language identification":
            again = language_id.predict(docs, language_id.learn(docs))
            assert sorted(r["doc_id"] for r in gone.collect()) == sorted(r["doc_id"] for r in again.filter(~language_id.accepted()).collect())
        elif name == "near-duplicates":
            rows = sorted((row["doc_id"], row["text"]) for row in docs.collect())
            label = brute_groups([text for _, text in rows])
            assert sorted(row["doc_id"] for row in out.collect()) == sorted({rows[x][0] for x in (label.index(x) for x in label)})
        elif name == "benchmark decontamination":
            marked = decontaminate.mark_hits(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert gone.count() == marked.filter(decontaminate.contaminated()).count() > 0
        else:
            assert out.filter(~F.col("lossless")).count() == 0 and gone.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    assert corpus_pipeline.run(spark, SF).select("doc_id").exceptAll(docs.select("doc_id")).count() == 0


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_one_query_for_each_operator():
    names = [name for name in queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert {"op7_decontamination", "op8_revisits", "op9_preferences"} <= set(oracle_sql())


@pytest.mark.parametrize("name", ["op7_decontamination", "op8_revisits", "op9_preferences"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    base = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = queries()[name](spark, SF)
    columns = sorted(frame.columns)
    expected = base.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in frame.select(columns).collect()))) == sorted(map(repr, expected))
