import hashlib
import random

import numpy as np
import pytest

from strainframe.llm import syncmers


def closed(text: bytes) -> list[int]:
    """Places of the closed syncmers, run by run."""

    def rank(at):
        value = int.from_bytes(text[at : at + syncmers.S], "little")
        value = value * 0x9E3779B1 & 0xFFFFFFFF
        value ^= value >> 15
        value = value * 0x85EBCA77 & 0xFFFFFFFF
        return value ^ value >> 13

    out = []
    for at in range(len(text) - syncmers.K + 1):
        inner = [rank(n) for n in range(at, at + syncmers.K - syncmers.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(at)
    return out


def test_anchors_are_closed_syncmers_and_context_free(spark):
    dice = random.Random(3)
    text = bytes(dice.choices(b"abcde ", k=400))
    places, hashes = syncmers.syncmers(text)
    assert places.tolist() == closed(text)
    around = syncmers.syncmers(b"before " + text + b" after")
    assert set(hashes.tolist()) <= set(around[1].tolist())
    docs = spark.createDataFrame([(1, text.decode()), (2, None)], "doc_id long, text string")
    rows = syncmers.anchors(docs).orderBy("place").collect()
    assert [r["place"] for r in rows] == places.tolist() and {r["id"] for r in rows} == {1}


def test_likeness_estimates_the_common_share():
    dice, errors = random.Random(4), []
    for _ in range(40):
        a = bytes(dice.choices(b"abcdefgh ", k=3000))
        b = a[: dice.randint(0, 3000)] + bytes(dice.choices(b"abcdefgh ", k=1500))
        x, y = (set(syncmers.syncmers(t)[1].tolist()) for t in (a, b))
        errors.append(syncmers.likeness(syncmers.fingerprint(a), syncmers.fingerprint(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    empty, short = syncmers.fingerprint(b""), syncmers.fingerprint(b"ab")
    assert syncmers.likeness(empty, empty) == 1 and syncmers.likeness(empty, short) == 0 and syncmers.likeness(short, short) == 1


def anchored(text: bytes) -> list[int]:
    return closed(text) if len(text) < 5000 else syncmers.syncmers(text)[0].tolist()


def plain_likeness(a: str, b: str) -> float:
    """Anchors matched and aligned one by one."""
    a, b = a.encode(), b.encode()
    if a == b:
        return 1.0
    x, y = anchored(a), anchored(b)
    met, seen, found = [], {}, {}
    for p in y:
        found.setdefault(b[p : p + syncmers.K], []).append(p)
    for at in x:
        run = a[at : at + syncmers.K]
        seen[run] = seen.get(run, 0) + 1
        there = found.get(run, [])
        if len(there) >= seen[run]:
            met.append(at - there[seen[run] - 1])
    good = sum(met[n] in (met[n - 1] if n else None, met[n + 1] if n + 1 < len(met) else None) for n in range(len(met)))
    if min(len(x), len(y)) == 1:
        good = len(met)
    every = len(x) + len(y) - good
    return good / every if every else 0.0


def test_positional_likeness_equals_brute_force():
    dice = random.Random(9)
    words = ["".join(dice.choices("abcdefg", k=dice.randint(2, 9))) for _ in range(40)]
    for n in range(60):
        a = " ".join(dice.choices(words, k=dice.randint(0, 60)))
        pieces = [a[dice.randint(0, len(a)) :] for _ in range(2)] + [" ".join(dice.choices(words, k=dice.randint(0, 30)))]
        dice.shuffle(pieces)
        b = a if n % 10 == 0 else "".join(pieces)
        found = syncmers.positional_likeness(syncmers.syncmers(a.encode()), syncmers.syncmers(b.encode()), a == b)
        assert abs(found - plain_likeness(a, b)) < 1e-12


def test_matches_need_a_common_shift():
    dice = random.Random(10)
    passages = ["".join(dice.choices("abcdefghijkl ", k=60)) for _ in range(2000)]
    a, b = "".join(passages), "".join(["".join(dice.choices("mnopqr ", k=70))] + passages[:30]).encode()
    a = a.encode()
    inside = syncmers.positional_likeness(syncmers.syncmers(a), syncmers.syncmers(b), False)
    assert 0.01 < inside < 0.03  # a small part of a long text is seen, at its shift
    runs = sorted({a[p : p + syncmers.K] for p in syncmers.syncmers(a)[0].tolist()[:400]}, key=lambda run: run[::-1])
    scattered = b"".join(run + bytes([48 + n % 10]) * (n % 23 + 5) for n, run in enumerate(runs))
    assert syncmers.positional_likeness(syncmers.syncmers(a), syncmers.syncmers(scattered), False) < 0.003  # common runs out of order


@pytest.mark.parametrize("parts", [1, 5])
def test_pairs_equal_brute_force(spark, awkward, parts):
    rows = [(r["doc_id"], r["text"] or "") for r in awkward.collect()]
    rows.sort(key=lambda r: (-(r[0] if r[0] is not None else -1), r[1]))
    found = syncmers.compare_with_next(awkward.repartition(parts)).collect()
    expected = []
    for n, (doc, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        count = len(text) // 3
        new = text[: len(text) - count] + following[:count]
        a, b = (syncmers.fingerprint(t.encode()) for t in (text, new))
        sha = hashlib.sha256(new.encode()).hexdigest()
        near = plain_likeness(text, new), plain_likeness(text, following)
        expected.append((doc, len(text), sha, syncmers.hexadecimal(a), syncmers.hexadecimal(b), *near))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_one_row_and_none(spark, awkward):
    assert syncmers.compare_with_next(awkward.limit(0)).count() == 0
    one = syncmers.compare_with_next(spark.createDataFrame([(1, "a text that is its own next one")], "doc_id long, text string")).first()
    assert one["near_next"] == 1
    again = syncmers.with_fingerprint(awkward)
    assert again.columns.count("fingerprint") == 1 and again.filter("doc_id <= 2").select("fingerprint").distinct().count() == 1
