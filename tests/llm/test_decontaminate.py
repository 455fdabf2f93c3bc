import random
import re

from pyspark.sql import functions as F

from strainframe.llm import decontaminate


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_force(text, items, size):
    own, hit, found = words(text), set(), set()
    for item, content in items:
        asked = words(content)
        n = min(size, len(asked))
        windows = {tuple(asked[k : k + n]) for k in range(len(asked) - n + 1)} if n else set()
        for k in range(len(own) - n + 1):
            if n and tuple(own[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found |= {str(item)} if item is not None else set()
    return len(own), len(hit), sorted(found)


def sample(seed):
    dice = random.Random(seed)
    pool = ["Alpha", "beta", "gámma", "d1", "e"]

    def text(low, high):
        return "".join(dice.choice(pool) + dice.choice([" ", ", ", "\n", "--"]) for _ in range(dice.randint(low, high)))

    items = [(n, text(1, 12)) for n in range(6)] + [(6, None), (7, "..."), (None, "beta e beta e beta"), (2, "e e e e e")]
    return items, [(n, text(0, 60)) for n in range(40)] + [(90, None), (91, ""), (91, ""), (92, "beta " * 20_000), (None, "e e e e e e")]


def test_hits_equal_brute_force(spark):
    items, docs = sample(1)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hit_spans", F.lit("mine")).withColumns({"extra": F.lit(1), "key": F.lit(2), "Spans": F.lit(3)})
    for block_rows in (10, decontaminate.BLOCK_ROWS):
        marked = decontaminate.mark_hits(frame, benchmark, size=5, block_rows=block_rows).withColumn("n", decontaminate.hit_count())
        found = sorted((repr(r["doc_id"]), r["hit_words"], r["n"], r["hit_items"]) for r in marked.collect())
        assert found == sorted((repr(doc), *brute_force(text, items, 5)) for doc, text in docs)
        assert marked.columns.count("hit_spans") == 1 and {"extra", "key", "Spans"} <= set(marked.columns)
        # Each block is gone before the next: the plan holds one step however many blocks there are.
        assert marked._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_documents_and_spans_go(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = [(1, f"Start, {passage.upper()}! end"), (2, "nothing of it"), (3, None), (4, "w " * 500 + passage)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(frame, benchmark).collect()) == [2, 3, 4]  # 14 of 514 words is below the share
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_hit_spans(frame, benchmark).collect()}
    assert cut == {1: "Start, ! end", 2: "nothing of it", 3: None, 4: "w " * 500}


def test_empty_tables(spark, awkward):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean_documents(awkward, benchmark).count() == awkward.count()
    assert decontaminate.mark_hits(awkward.limit(0), benchmark).count() == 0
