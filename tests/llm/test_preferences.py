from pyspark.sql import functions as F

from strainframe.llm import preferences

U, A = "<|im_start|>user\n", "<|im_start|>assistant\n"
E = "<|im_end|>\n"


def turn(number, role, text):
    return {"turn": number, "role": role, "text": text}


def test_prompt_and_masks(spark):
    chosen = [turn(0, "user", "hi"), turn(1, "assistant", "yes"), turn(2, "user", "more")]
    rejected = [turn(0, "user", "hi"), turn(1, "assistant", "no")]
    schema = f"id int, chosen array<{preferences.TURN}>, rejected array<{preferences.TURN}>, prompt string"
    rows = [(1, chosen, rejected, "x"), (2, chosen, chosen, "x"), (3, chosen, rejected[:1], "x"), (4, None, rejected, "x"), (5, [], [], "x"), (6, [turn(0, None, None)], [turn(5, None, None)], "x")]
    found = {r["id"]: r for r in preferences.format_preferences(spark.createDataFrame(rows, schema)).collect()}
    assert found[1]["prompt"] == f"{U}hi{E}" and found[1]["prompt_turns"] == 1
    assert [tuple(p) for p in found[1]["chosen_completion"]] == [(A, False), (f"yes{E}", True), (U, False), (f"more{E}", False)]
    assert [tuple(p) for p in found[1]["rejected_completion"]] == [(A, False), (f"no{E}", True)]
    assert found[2]["prompt_turns"] == 3 and found[2]["chosen_completion"] == [] == found[2]["rejected_completion"]
    assert found[3]["prompt_turns"] == 1 and found[3]["rejected_completion"] == []
    assert found[4]["prompt"] == "" and found[4]["chosen_completion"] == []
    assert found[5]["prompt"] == "" and found[6]["prompt_turns"] == 1


def test_swapped_answers(spark):
    rows = [
        (0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "thanks"),
        (1, 1, "assistant", "a1"), (1, 0, "user", "q1"),
        (2, 0, "user", "alone"), (2, 1, "assistant", "a2"),
        (4, 0, "user", "no answer"), (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", None),
        (None, 0, "user", "no id"), (-1, 0, "assistant", "m"), (-2, 0, "assistant", "n"),
    ]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, couple string")
    found = {r["conv_id"]: r for r in preferences.with_swapped_answer(turns).collect()}
    texts = {n: ([t["text"] for t in r["chosen"]], [t["text"] for t in r["rejected"]]) for n, r in found.items()}
    assert texts == {
        0: (["q", "a0", "thanks"], ["q", "a1", "thanks"]), 1: (["q1", "a1"], ["q1", "a0"]), 2: (["alone", "a2"], ["alone"]),
        4: (["no answer"], ["no answer"]), 5: (["same", "same", None], ["same", "same"]), None: (["no id"], ["no id"]),
        -1: (["m"], ["n"]), -2: (["n"], ["m"]),
    }
    assert preferences.format_preferences(preferences.with_swapped_answer(turns.limit(0))).count() == 0
    plan = preferences.format_preferences(preferences.with_swapped_answer(turns))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_long_conversation(spark):
    turns = spark.range(5000).select(F.lit(0).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    row = preferences.format_preferences(preferences.with_swapped_answer(turns)).first()
    assert row["prompt_turns"] == 4999 and len(row["chosen_completion"]) == 2 and row["rejected_completion"] == []


def test_turns_without_conversation_stay_apart(spark):
    rows = [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (None, 1, "assistant", "a"), (None, None, None, None), (0, 0, "user", "q"), (0, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = preferences.format_preferences(preferences.with_swapped_answer(turns)).collect()
    assert len(found) == 5
    alone = sorted((r["prompt"], len(r["chosen_completion"]), len(r["rejected_completion"])) for r in found if r["conv_id"] is None)
    assert alone == [("", 2, 0), ("", 2, 0), (f"<|im_start|>\n{E}", 0, 0), (f"{U}q{E}", 0, 0)]
