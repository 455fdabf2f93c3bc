import random

from strainframe.llm import similar_groups


def test_repeated_ids_stay_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "another text of some words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in similar_groups.first_of_each_group(docs).collect()) == [1, 2]


def brute_groups(texts):
    """Components over five-word Jaccard >= 0.8."""
    words = [(text or "").lower().split() for text in texts]
    sets = [{tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(texts)))
    for n, a in enumerate(sets):
        for m in range(n):
            b = sets[m]
            if label[n] != label[m] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                old, new = max(label[n], label[m]), min(label[n], label[m])
                label = [new if x == old else x for x in label]
    return label


def test_kept_rows_equal_brute_force_jaccard(spark):
    dice, texts = random.Random(5), []
    for _ in range(60):
        text = [f"w{dice.randrange(3000)}" for _ in range(dice.choice([4, 6, 9, 40, 200]))]
        for _ in range(dice.choice([1, 2, 6])):
            texts.append(" ".join(text))
            text = text[:]
            for _ in range(dice.randint(0, max(1, len(text) // 40))):
                text[dice.randrange(len(text))] = f"w{dice.randrange(3000)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in similar_groups.first_of_each_group(docs).collect())
    label = brute_groups(texts)
    assert kept == sorted({label.index(x) for x in label})
    assert 60 < len(kept) < len(texts)


def test_different_texts_under_one_id_stay(spark):
    near = "one two three four five six seven eight nine ten"
    rows = [(None, "a b c d e f"), (None, "g h i j k l"), (None, near), (3, near), (7, "m n o p q r"), (7, "s t u v w x"), (7, "s t u v w x"), (8, "y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(map(repr, map(tuple, similar_groups.first_of_each_group(docs).collect())))
    assert kept == sorted(map(repr, {(i, t) for i, t in rows} - {(None, near)}))


def test_awkward_rows(spark, awkward):
    kept = similar_groups.first_of_each_group(awkward)
    assert kept.columns == awkward.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == ["1", "3", "6", "7", "8", "None"]


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, "x"), (1, "a b c", 1, 2, "x"), (2, "d e f", 1, 2, "y")], "doc_id long, text string, row_of int, node int, first string")
    kept = similar_groups.first_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_no_rows(spark, awkward):
    assert similar_groups.first_of_each_group(awkward.limit(0)).count() == 0
