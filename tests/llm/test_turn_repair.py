import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from strainframe.llm import turn_repair
from strainframe.llm.turn_repair import Walk

COSTS = (0, 1, 2, 5, 5)


def brute(rows, costs=COSTS, inserts=2):
    """(cost, audit, digest) over every way to edit rows (role, text, fault) and to insert up to some turns."""
    keep, rerole, delete, insert, truncated = costs
    slots = []
    for role, text, fault in rows:
        extra = truncated if fault == "truncated" else 0
        ways = [(delete, "D", None)]
        if fault not in ("blank", "duplicate"):
            ways += [(keep + extra, "K", (role, text)), *((rerole + extra, "R", (other, text)) for other in ("user", "assistant"))]
        slots.append(ways)
    gaps = [[()] for _ in range(len(rows) + 1)]
    for place in range(len(rows) + 1):
        for count in range(1, inserts + 1):
            gaps[place] += itertools.product([(insert, "I", (role, "")) for role in ("user", "assistant")], repeat=count)
    best = None
    for added in itertools.product(*gaps):
        if sum(map(len, added)) > inserts:
            continue
        for chosen in itertools.product(*slots):
            steps = [step for n in range(len(rows) + 1) for step in (*added[n], *chosen[n : n + 1])]
            kept = [said for _, _, said in steps if said]
            if not re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "?" for role, _ in kept)):
                continue
            text = "\n".join(f"{role}:{text}" for role, text in kept)
            found = (sum(cost for cost, _, _ in steps), "".join(letter for _, letter, _ in steps), hashlib.sha256(text.encode()).hexdigest())
            best = min(best or found, found)
    return best


def some_rows(dice, count):
    roles, faults = ["user", "assistant", "system", "tool", "", "sup"], [None, None, None, "truncated", "blank", "duplicate"]
    return [(dice.choice(roles), f"t{n}", dice.choice(faults)) for n in range(count)]


def walked(rows, **options):
    walk = Walk(**options)
    for row in rows:
        walk.row(*row)
    return walk.result()


@pytest.mark.parametrize("costs", [COSTS, (0, 1, 2, 1, 5), (1, 1, 1, 1, 1), (0, 3, 7, 2, 4)])
def test_cheapest_edits_equal_brute_force(costs):
    dice = random.Random(3)
    for _ in range(60):
        rows = some_rows(dice, dice.randint(0, 4))
        assert walked(rows, inserts=2, costs=costs) == brute(rows, costs)


def test_blocks_change_nothing():
    dice = random.Random(4)
    for _ in range(40):
        rows = some_rows(dice, dice.randint(0, 60))
        whole = walked(rows, block=100)
        assert walked(rows, block=1) == walked(rows, block=7) == walked(rows, block=60, inserts=0) == whole


def test_long_conversations_take_their_time_in_proportion():
    rows = some_rows(random.Random(5), 5000)
    cost, audit, _ = walked(rows)
    assert len(audit) == 5000 and cost > 0


def report(rows):
    """Plain report of rows (turn, role, text) of one conversation."""
    rows = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, judged, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
        if fault:
            counts[fault] += 1
    turns = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *counts.values(), illegal, *walked(judged, inserts=0, block=10_000))


def test_reports_and_repaired_turns(spark):
    dice, rows = random.Random(6), []
    texts = ["Hello.", "Why?", "no end", " \n", "", None, "Fine!  ", "Hello."]
    for conversation in [None, *range(60)]:
        for _ in range(dice.randint(1, 12)):
            row = (conversation, dice.choice([None, *range(8)]), dice.choice(["user", "assistant", "system", None, "tool"]), dice.choice(texts))
            rows += [row] * dice.choice([1, 1, 1, 2])
    frame = spark.createDataFrame([(*row, "x", 1) for row in rows], "conv_id long, turn long, role string, text string, audit string, place int").repartition(5)
    ids = spark.createDataFrame([(1,), (77,), (77,), (None,)], "conv_id long")
    found = turn_repair.repair(frame, ids)
    got = {row["conv_id"]: tuple(row)[1:] for row in found.collect()}
    expected = {c: report([row[1:] for row in rows if row[0] == c]) for c in {row[0] for row in rows}}
    assert got == expected | {77: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    turns = turn_repair.repaired_turns(frame, found)
    joined = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("t"))
    digests = {row["conv_id"]: hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in row["t"]).encode()).hexdigest() for row in joined.collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(digests.get(name, empty) == row[-1] for name, row in got.items())


def test_inserted_turns_are_written():
    batches = [[(1, 0, None, "", "IKKI", ""), (1, 2, 4, "assistant", "x", ""), (1, 2, 5, "user", "y", "")]]
    import pyarrow as pa

    names = ["conversation", "kind", "turn", "role", "text", "digest"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
    given = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names) for rows in batches)
    (out,) = turn_repair._repaired_batches(given)
    assert [(r["role"], r["text"], r["edit"]) for r in out.to_pylist()] == [("user", "", "I"), ("assistant", "x", "K"), ("user", "y", "K"), ("assistant", "", "I")]


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert turn_repair.repair(empty).count() == 0
    assert turn_repair.repair(empty, spark.createDataFrame([("a",)], "c string")).first()["audit"] == ""
