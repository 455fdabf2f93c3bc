"""Free-text judgments -> canonical values. The accepted words differ per use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strainframe.functions.casts import present_text

# Accepted words.
CHOICE_A = ["a", "left", "first", "1"]
CHOICE_B = ["b", "right", "second", "2"]
UNDECIDED = ["tie", "same", "equal", "skip", "unknown"]
LABELER_WORDS = {
    "a": "A",
    "left": "A",
    "1": "A",
    "b": "B",
    "right": "B",
    "2": "B",
    "tie": "tie",
    "same": "tie",
    "equal": "tie",
    "uncertain": "uncertain",
    "unknown": "uncertain",
    "out_of_range": "out_of_range",
    "range": "out_of_range",
    "skip": "skip",
    "": "",
}
SOFT_STATUSES = ["tie", "uncertain", "out_of_range", "skip"]


def harder_side(value: Column) -> Column:
    """'a', 'b' or NULL."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(word.isin(CHOICE_A), "a").when(word.isin(CHOICE_B), "b")


def annotation_confidence(value: Column) -> Column:
    """Blank or text -> 1, otherwise clipped to 0..5."""
    number = present_text(value).try_cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.least(number, F.lit(5.0))), F.lit(1.0))


def judged_chart(value: Column) -> Column:
    """Chart id chosen by a person, NULL for ties, skips and text."""
    word = F.lower(present_text(value))
    return F.when(~word.isin(UNDECIDED), word.try_cast("double").try_cast("long"))


def judgment_confidence(value: Column) -> Column:
    """Blank, text or not positive -> 1; no upper limit."""
    number = present_text(value).try_cast("double")
    return F.when(number > 0, number).otherwise(F.lit(1.0))


def labeler_choice(value: Column) -> Column:
    """Canonical labeler word; an unknown word is kept as typed."""
    typed = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    words = F.create_map(*[F.lit(item) for pair in LABELER_WORDS.items() for item in pair])
    return F.coalesce(F.try_element_at(words, F.lower(typed)), typed)


def labeler_status(value: Column) -> Column:
    choice = labeler_choice(value)
    return F.when(choice.isin("A", "B"), "judged").when(choice.isin(SOFT_STATUSES), choice).otherwise("open")
