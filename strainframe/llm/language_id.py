"""Language identification by compression with per-language zstandard dictionaries.

A raw-content dictionary of a language holds text of it, so a text of that
language finds longer matches there than in any other. Each text is cut into
blocks, each block is compressed once with every dictionary by the same coder, and
the language with the smallest sum wins. A text is rejected if it has no letter or if the
second best language compresses it nearly as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainframe.llm.common import with_fields
from strainframe.session import cut_lineage

UNKNOWN = "und"
#: The dictionaries are fitted on a bounded sample: documents and characters of each for a language, and bytes kept.
SAMPLE_DOCUMENTS = 400
SAMPLE_CHARS = 2000
DICTIONARY_BYTES = 448 << 10
#: Languages measured in one pass over the documents, which bounds a broadcast to 45 MB; further ones take further passes.
BLOCK_LANGUAGES = 100
BLOCK_BYTES = 8 << 10
#: Shorter texts are repeated up to this size: below it the coder stores them as they are and shows no difference.
SHORT_BYTES = 160
FINDER = {"strategy": zstandard.STRATEGY_LAZY, "hash_log": 18, "chain_log": 18, "search_log": 2}
#: Smallest relative gap to the second best language that is not narrow.
NARROW = 0.01
#: Bits of evidence that a byte of difference counts for in the score.
BITS_PER_BYTE = 2.0

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def letters(text: str) -> bytes:
    """Lower-case words separated by single blanks; digits, marks and signs say nothing about a language."""
    return (" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode()


def sample(labelled: DataFrame, counts: dict[str, int], documents: int, chars: int) -> DataFrame:
    """(lang, place, slice): at most ``documents`` slices of ``chars`` characters a language, at places chosen by the row's hash.

    A row is drawn if the hash of its id and text lies below a share of the hash range
    that holds about twice as many different rows as wanted; rows that repeat one are
    merged before the shuffle, so no language is gathered in one task.
    """
    limits = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2.0 * documents / max(1, n))))])
    keyed = labelled.filter("text is not null").withColumn("key", F.xxhash64("id", "text"))
    drawn = keyed.filter(F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 53)) < limits[F.col("lang")] * float(1 << 53))
    room = F.greatest(F.length("text") - chars + 1, F.lit(1))
    start = (F.pmod(F.xxhash64("key", F.lit("slice")), room) + 1).cast("int")
    slices = drawn.groupBy("lang", "key").agg(F.min(F.substring("text", start, F.lit(chars))).alias("slice"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("key"), "key"))
    return slices.withColumn("place", place).filter(F.col("place") <= documents)


def learn(
    labelled: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    id_column: str = "doc_id",
    documents: int = SAMPLE_DOCUMENTS,
    chars: int = SAMPLE_CHARS,
) -> dict[str, bytes]:
    """Dictionary content of every language; rows without a label or a text with letters teach nothing.

    The driver holds at most DICTIONARY_BYTES a language.
    """
    names = {id_column: "id", lang_column: "lang", text_column: "text"}
    rows = labelled.select(*[F.col(old).alias(new) for old, new in names.items()])
    rows = rows.withColumns({"lang": F.col("lang").cast("string"), "text": F.col("text").cast("string")})
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # One row a language; repeated rows count once.
    different = rows.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("id", "text")).alias("n"))
    counts = {row["lang"]: row["n"] for row in different.toLocalIterator()}
    if not counts:
        return {}
    content: dict[str, bytearray] = {}
    for row in sample(rows, counts, documents, chars).orderBy("lang", "place").toLocalIterator():
        whole = content.setdefault(row["lang"], bytearray())
        if len(whole) < DICTIONARY_BYTES:
            whole += letters(row["slice"])
    return {lang: bytes(whole[:DICTIONARY_BYTES]) for lang, whole in content.items() if whole.strip()}


def coder(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=20, min_match=3, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False, **FINDER
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


class Measure:
    """What is known of a text after some languages: the best, its size, the second best size, and the weight of the others.

    The weight adds 2 to the power of BITS_PER_BYTE * (best size - other size) over all
    others, so measures of two blocks of languages add up to the measure of both.
    """

    __slots__ = ("best", "size", "second", "weight")

    def __init__(self, best: str | None = None, size: float = np.inf, second: float = np.inf, weight: float = 0.0):
        self.best, self.size, self.second, self.weight = best, size, second, weight

    def joined(self, other: Measure) -> Measure:
        """Equal sizes go to the first by name, which ``self`` holds."""
        if other.best is None or self.best is None:
            return self if other.best is None else other
        low, high = (other, self) if other.size < self.size else (self, other)
        weight = low.weight + (1 + high.weight) * 2.0 ** (BITS_PER_BYTE * (low.size - high.size))
        return Measure(low.best, low.size, min(low.second, high.size), weight)

    def margin(self) -> float:
        return 0.0 if self.best is None else 1 - self.size / self.second

    def score(self) -> float:
        return 0.0 if self.best is None else 1 / (1 + self.weight)


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.languages = sorted(content)
        self.coders = [coder(content[lang]) for lang in self.languages]

    def measure(self, text: str | None) -> Measure:
        """Compressed bytes of the whole text under each dictionary."""
        found = Measure()
        if not text or not _LETTER.search(text):
            return found
        plain = letters(text)
        plain *= -(-SHORT_BYTES // len(plain))
        blocks = [plain[at : at + BLOCK_BYTES] for at in range(0, len(plain), BLOCK_BYTES)]
        for lang, one in zip(self.languages, self.coders, strict=True):
            found = found.joined(Measure(lang, float(sum(len(one.compress(block)) for block in blocks))))
        return found

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, relative gap to the second best)."""
        found = self.measure(text)
        return found.best or UNKNOWN, found.score(), found.margin()


STATE = ["lang_pred", "lang_size", "lang_second", "lang_weight"]


def _measure_batches(batches: Iterator[pa.RecordBatch], content: dict[str, bytes], text: int, known: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches with the state of each text behind their other columns; ``known`` are the places of an earlier state."""
    model = Classifier(content)
    for batch in batches:
        found = [model.measure(value.as_py()) for value in batch.column(text)]
        if known:
            earlier = zip(*(batch.column(n).to_pylist() for n in known), strict=True)
            found = [Measure(*old).joined(new) for old, new in zip(earlier, found, strict=True)]
        kept = [n for n in range(batch.num_columns) if n not in known]
        columns = [batch.column(n) for n in kept]
        columns += [pa.array([one.best for one in found], pa.string())]
        columns += [pa.array([getattr(one, name) for one in found], pa.float64()) for name in ("size", "second", "weight")]
        yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[n] for n in kept), *STATE])


RESULT_COLUMNS = ("lang_pred", "lang_score", "lang_margin")


def predict(docs: DataFrame, content: dict[str, bytes], text_column: str = "text", block_languages: int = BLOCK_LANGUAGES) -> DataFrame:
    """Documents with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_margin``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was
    learned. Columns with one of the three names (or of the state, STATE) are
    replaced, all others stay. Languages beyond ``block_languages`` are measured in
    further passes over the stored documents, one block of dictionaries at a time;
    the result is the same as with one block.
    """
    docs = docs.drop(*[name for name in docs.columns if name.lower() in (*RESULT_COLUMNS, *STATE)])
    schema = with_fields(docs, "lang_pred string, lang_size double, lang_second double, lang_weight double")
    languages = sorted(content)
    found, known, text = docs, [], docs.columns.index(text_column)
    for at in range(0, max(1, len(languages)), block_languages):
        block = {lang: content[lang] for lang in languages[at : at + block_languages]}
        found = (cut_lineage(found) if known else found).mapInArrow(partial(_measure_batches, content=block, text=text, known=known), schema)
        known = list(range(len(docs.columns), len(docs.columns) + len(STATE)))
    unknown = F.col("lang_pred").isNull()
    return found.withColumns(
        {
            "lang_score": F.when(unknown, 0.0).otherwise(1 / (1 + F.col("lang_weight"))),
            # An only language has no second best: infinitely far.
            "lang_margin": F.when(unknown, 0.0).otherwise(1 - F.col("lang_size") / F.col("lang_second")),
            "lang_pred": F.coalesce("lang_pred", F.lit(UNKNOWN)),
        }
    ).drop(*STATE[1:])


def accepted():
    """Neither unknown nor narrow."""
    return (F.col("lang_pred") != UNKNOWN) & (F.col("lang_margin") >= NARROW)
