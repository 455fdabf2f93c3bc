"""Preference pairs: the common beginning of two conversations once, and two completions with their loss masks.

Only DataFrame functions: turns are gathered by one shuffle, the common prefix is
the place of the first unequal pair of turns, and texts are joined from arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn (fixed values of the chat markup).
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"
TRAINED_ROLE = "assistant"

TURN = "struct<turn:bigint,role:string,text:string>"


def gathered(turns: DataFrame, keys: list[str], turn: str = "turn", role: str = "role", text: str = "text", **more: Column) -> DataFrame:
    """One row a key with ``turns``: its turns in the order of turn, role and text, null turn numbers first.

    Nulls stay nulls and repeated rows stay repeated. ``more`` goes into every
    element behind the three fields. The array of a key is the conversation that
    becomes one output row; tasks merge their parts of it before the shuffle.
    """
    fields = [F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")]
    element = F.struct(*fields, *[value.alias(name) for name, value in more.items()])
    return turns.groupBy(*keys).agg(F.sort_array(F.collect_list(element)).alias("turns"))


def common_turns(chosen: Column, rejected: Column) -> Column:
    """Turns in which both begin alike: same role and same text, nulls equal to nulls."""
    same = F.zip_with(chosen, rejected, lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    shorter = F.least(F.size(chosen), F.size(rejected))
    first_other = F.array_position(F.slice(same, 1, shorter), False)
    return F.when(shorter == 0, F.lit(0)).when(first_other == 0, shorter).otherwise((first_other - 1).cast("int"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(TURN_START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(TURN_END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda turn: F.concat(_head(turn), _body(turn))), "")


def masked(turns: Column) -> Column:
    """array<struct<text, trained>>: of a turn, only what the assistant says and its end mark is trained."""
    parts = F.transform(
        turns,
        lambda turn: F.array(
            F.struct(_head(turn).alias("text"), F.lit(False).alias("trained")),
            F.struct(_body(turn).alias("text"), F.coalesce(turn["role"] == TRAINED_ROLE, F.lit(False)).alias("trained")),
        ),
    )
    return F.flatten(parts)


def text_of(parts: Column, trained_only: bool = False) -> Column:
    kept = F.filter(parts, lambda part: part["trained"]) if trained_only else parts
    return F.array_join(F.transform(kept, lambda part: part["text"]), "")


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Pairs of turn arrays -> ``prompt_turns``, ``prompt``, ``chosen_completion``, ``rejected_completion``.

    A null conversation counts as one without turns. Two equal conversations have
    empty completions. The two input columns are dropped, columns with the names of
    the results are replaced, all others stay.
    """
    results = ("prompt_turns", "prompt", "chosen_completion", "rejected_completion")
    others = [F.col(f"`{name}`") for name in pairs.columns if name not in (chosen, rejected, *results)]
    empty = F.from_json(F.lit("[]"), f"array<{TURN}>")

    def plain_turns(name: str) -> Column:
        turns = F.transform(F.col(name), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
        return F.coalesce(turns, empty)

    plain = pairs.select(*others, plain_turns(chosen).alias("pair a"), plain_turns(rejected).alias("pair b"))
    a, b = F.col("pair a"), F.col("pair b")
    counted = plain.withColumn("prompt_turns", common_turns(a, b))
    n = F.col("prompt_turns")
    rest = lambda turns: masked(F.slice(turns, n + 1, F.size(turns)))
    return counted.withColumns(
        {"prompt": rendered(F.slice(a, 1, n)), "chosen_completion": rest(a), "rejected_completion": rest(b)}
    ).drop("pair a", "pair b")


def with_swapped_answer(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, chosen, rejected): a conversation, and the same with its last assistant turn as the neighbour gave it.

    Neighbours are the conversations 2k and 2k + 1, gathered together. Without a
    neighbour that answers, the rejected side ends before the last answer; a
    conversation without an answer has equal sides. A turn without a conversation id
    is a conversation of its own and needs no shuffle, however many there are.
    """
    alone = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kind = turns.schema[conv].dataType
    lost = turns.filter(F.col(conv).isNull()).select(F.lit(None).cast(kind).alias(conv), F.array(alone).alias("chosen"))
    silent = F.slice("chosen", 1, F.when(F.col("chosen")[0]["role"].eqNullSafe(TRAINED_ROLE), 0).otherwise(1))
    lost = lost.withColumn("rejected", silent)
    keyed = turns.filter(F.col(conv).isNotNull()).select(F.col(conv).alias("conv"), "turn", "role", "text")
    keyed = keyed.withColumn("couple", F.shiftright("conv", 1))
    both = gathered(keyed, ["couple"], conv=F.col("conv"))
    convs = F.array_distinct(F.transform("turns", lambda t: t["conv"]))
    each = both.select(F.explode(convs).alias("conv"), "turns")
    own = F.filter("turns", lambda t: t["conv"].eqNullSafe(F.col("conv")))
    other = F.filter("turns", lambda t: ~t["conv"].eqNullSafe(F.col("conv")) & (t["role"] == TRAINED_ROLE))
    each = each.select("conv", own.alias("own"), F.get(F.reverse(other), F.lit(0)).alias("answer"))
    flags = F.transform("own", lambda t: F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False)))
    # Place of the last answer from the end, 0 if there is none.
    each = each.withColumn("at", F.array_position(F.reverse(flags), True))
    last = F.size("own") - F.col("at") + 1
    swapped = F.transform(
        "own",
        lambda t, i: F.struct(
            t["turn"].alias("turn"), t["role"].alias("role"), F.when(i + 1 == last, F.col("answer")["text"]).otherwise(t["text"]).alias("text"), t["conv"].alias("conv")
        ),
    )
    rejected = F.when(F.col("at") == 0, F.col("own")).when(F.col("answer").isNull(), F.slice("own", 1, (last - 1).cast("int"))).otherwise(swapped)
    plain = lambda side: F.transform(side, lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    return each.select(F.col("conv").alias(conv), plain("own").alias("chosen"), plain(rejected).alias("rejected")).unionByName(lost)
