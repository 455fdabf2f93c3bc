import random

import numpy as np
import pytest

from strainframe.llm import minhash_join, set_links


def plain_set(text, size=4):
    words = (text or "").lower().split()
    return {" ".join(words[n : n + size]) for n in range(max(1, len(words) - size + 1))} if words else set()


def plain_components(rows):
    """Smallest id reachable over 100 * intersection >= 80 * union."""
    sets = [plain_set(text) for _, text in rows]
    label = list(range(len(rows)))
    for n, a in enumerate(sets):
        for m in range(n):
            b = sets[m]
            if a and b and label[n] != label[m] and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[n], label[m]
                label = [new if x == old else x for x in label]
    least = {}
    for (id_, _), x, s in zip(rows, label, sets, strict=True):
        if s and id_ is not None:
            least[x] = min(least.get(x, id_), id_)
    return [(id_, len(s), least.get(x) if s else id_) for (id_, _), x, s in zip(rows, label, sets, strict=True)]


def some_texts(seed, words=3000, groups=60):
    """Texts with near copies, chains of them, and one passage that many share."""
    dice, texts = random.Random(seed), []
    common = [f"c{n}" for n in range(40)]
    for _ in range(groups):
        text = [f"w{dice.randrange(words)}" for _ in range(dice.choice([1, 3, 4, 6, 9, 40, 200]))]
        if dice.random() < 0.4:
            text += common
        for _ in range(dice.choice([1, 2, 6])):
            texts.append(" ".join(text))
            text = text[:]
            for _ in range(dice.randint(0, max(1, len(text) // 40))):
                text[dice.randrange(len(text))] = f"w{dice.randrange(words)}"
    for n in range(60):  # a group of copies at any similarity
        text = [f"h{k}" for k in range(80)]
        for _ in range(dice.randint(0, 6)):
            text[dice.randrange(80)] = f"x{n}"
        texts.append(" ".join(text))
    return texts


@pytest.mark.parametrize(("nodes", "size"), [(set_links.CELL_NODES, set_links.CELL_BYTES), (6, 1 << 30), (1000, 6000)])
def test_components_equal_brute_force(spark, monkeypatch, nodes, size):
    monkeypatch.setattr(set_links, "CELL_NODES", nodes)  # small limits take cells apart into lists and blocks
    monkeypatch.setattr(set_links, "CELL_BYTES", size)
    rows = [(n, text) for n, text in enumerate(some_texts(1))] + [(900, None), (901, ""), (902, " \t"), (None, "w1 w2 w3 w4 w5"), (7, "a b"), (7, "a b")]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(row) for row in minhash_join.similar_documents(docs).collect()]
    assert sorted(got, key=repr) == sorted(plain_components(rows), key=repr)


def test_cells_equal_brute_force():
    dice = np.random.default_rng(3)
    base = dice.integers(0, 1 << 60, 120).astype(np.uint64)
    sets = []
    for _ in range(150):
        own = base.copy()
        places = dice.integers(0, 120, dice.integers(0, 20))
        own[places] = dice.integers(0, 1 << 60, len(places))
        sets.append(np.unique(own))
    names, keys = np.arange(1000, 1150), [set_links.postings(x) for x in sets]
    links = set_links.cell_links(names, names, keys, [[] for _ in sets], sets)
    label = {n: n for n in range(150)}

    def joined(pairs):
        label = list(range(150))
        for a, b in pairs:
            old, new = label[a], label[b]
            label = [new if x == old else x for x in label]
        return {tuple(n for n in range(150) if label[n] == x) for x in set(label)}

    similar = []
    for n in label:
        for m in range(n):
            both = len(np.intersect1d(sets[n], sets[m]))
            if both * 5 >= 4 * (len(sets[n]) + len(sets[m]) - both):
                similar.append((n, m))
    assert joined([(a - 1000, b - 1000) for a, b in links]) == joined(similar)
    assert len(links) == 150 - len(joined(similar))  # a forest
    assert all((n, m) in set(similar) for n, m in ((max(a, b) - 1000, min(a, b) - 1000) for a, b in links))


def test_collisions_estimate_similarity():
    dice = np.random.default_rng(4)
    pool = dice.integers(0, 1 << 63, 1000).astype(np.uint64)
    hits = [np.count_nonzero(set_links.postings(np.unique(pool[n : n + 90])) == set_links.postings(np.unique(pool[n + 10 : n + 100]))) for n in range(0, 900, 9)]
    assert abs(np.mean(hits) / set_links.COORDINATES - 0.8) < 0.02 and min(hits) >= set_links.MATCHES


def test_awkward_rows(spark, awkward):
    rows = [(row["doc_id"], row["text"]) for row in awkward.collect()]
    got = [tuple(row) for row in minhash_join.similar_documents(awkward).collect()]
    assert sorted(got, key=repr) == sorted(plain_components(rows), key=repr)


def test_no_rows(spark, awkward):
    assert minhash_join.similar_documents(awkward.limit(0)).count() == 0
