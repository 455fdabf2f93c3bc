import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainframe.llm import katz


def brute_force(docs, train):
    """(model probability function, scores) with plain dictionaries."""
    texts = [(text or "").encode().lower().split() + ["end"] for text in docs]
    words, pairs, contexts = Counter(), Counter(), Counter()
    for text, used in zip(texts, train, strict=True):
        if used:
            words.update(text)
            before = ["begin", *text[:-1]]
            pairs.update(zip(before, text, strict=True))
            contexts.update(before)

    def of(counts):
        return [0] + [sum(n == r for n in counts.values()) for r in range(1, katz.DISCOUNTED + 2)]

    model, factor = katz.Words.of(sum(words.values()), len(words), of(words)), katz.discounts(of(pairs))

    def unigram(word):
        return float(model.probability(np.array([words[word]]))[0])

    def lowered(n):
        return 1.0 if n > katz.DISCOUNTED else factor[n]

    followers = defaultdict(list)
    for (context, word), n in pairs.items():
        followers[context].append((word, n))

    def probability(context, word):
        if context not in followers:
            return unigram(word)
        freed = sum((1 - lowered(n)) * n for _, n in followers[context])
        total = contexts[context] + (0 if freed > 0 else 1)
        if n := pairs[context, word]:
            return lowered(n) * n / total
        return (freed or 1) / total / (1 - sum(unigram(w) for w, _ in followers[context])) * unigram(word)

    scores = [sum(math.log10(probability(a, b)) for a, b in zip(["begin", *t[:-1]], t, strict=True)) for t in texts]
    return probability, words, scores


TEXTS = ["a b a c", "a b b", "c a b A", "", None, "d d d d d d d a b", "e f a", "a  b\ta\nb", "g h", "a b a c"]


@pytest.mark.parametrize("hot", [katz.HOT, 2])
def test_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    monkeypatch.setattr(katz, "SLICE_TEXT", 16)
    train = [n % 4 != 2 for n in range(len(TEXTS))]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = {r["doc_id"]: r for r in katz.score_documents(docs, F.col("doc_id") % 4 != 2, buckets=3).collect()}
    probability, words, scores = brute_force(TEXTS, train)
    assert len(rows) == len(TEXTS)
    for n, score in enumerate(scores):
        assert rows[n]["score"] == pytest.approx(score, rel=1e-9)
        assert rows[n]["held_out"] != train[n]
        tokens = (TEXTS[n] or "").lower().encode().split() + ["end"]
        assert (rows[n]["n_tokens"], rows[n]["n_known"]) == (len(tokens), sum(words[w] > 0 for w in tokens))
    for context in ("begin", b"a", b"d", b"zz"):
        assert sum(probability(context, w) for w in [*words, "unknown"]) == pytest.approx(1)


def test_awkward_rows(spark, awkward):
    rows = katz.score_documents(awkward, F.col("doc_id") > 1).collect()
    assert len(rows) == awkward.count()
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]  # a null condition trains nothing


def test_no_rows_and_no_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert katz.score_documents(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = katz.score_documents(one, F.lit(False)).first()
    assert (row["n_known"], row["train_tokens"]) == (0, 0) and math.isfinite(row["score"])


def test_packing():
    for values in ([], [0], [5, 0, 2**40], list(range(300))):
        assert katz.unpack(katz.pack(np.array(values, np.uint64))).tolist() == values
    rising = np.sort(np.random.default_rng(1).integers(0, 2**63, 100)).astype(np.uint64)
    assert (katz.unsteps(katz.steps(rising)) == rising).all()
