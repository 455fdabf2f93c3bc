"""Document fingerprints from closed syncmers.

A run of K bytes is a closed syncmer if the smallest (by hash) of its inner runs
of S bytes is the first or the last of them. Whether it is one depends on its own
bytes alone, so a passage has the same anchors in every text that holds it, at
shifted places.

Two texts are compared by position: equal anchors are matched in the order of
their places, a match counts if the match before or after it is shifted by as many
bytes, and the likeness is the share of such matches in all anchors of both. A
fingerprint's digest is a sketch: the anchors' hashes are dealt to BINS bins by
their upper bits and each bin keeps its smallest; the share of bins on which two
digests agree estimates the share of common anchors without the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainframe.llm.common import byte_slices, scan_width, with_fields
from strainframe.llm.ranges import with_range

K = 16
S = 4
BINS = 128
EMPTY = 0xFFFF
#: Id ranges for each task of a shuffle, so that the ranges even out.
RANGES_A_TASK = 4


def syncmers(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte places, hashes) of a text's closed syncmers."""
    if len(text) < K:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    plain = np.frombuffer(text, np.uint8)
    pairs = plain[:-1] | (plain[1:].astype(np.uint16) << np.uint16(8))
    inner = pairs[:-2] | (pairs[2:].astype(np.uint32) << np.uint32(16))
    inner *= np.uint32(0x9E3779B1)
    inner ^= inner >> np.uint32(15)
    inner *= np.uint32(0x85EBCA77)
    inner ^= inner >> np.uint32(13)
    width, least, reach = K - S + 1, inner, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    runs = len(text) - K + 1
    places = np.flatnonzero((inner[:runs] == least) | (inner[K - S : K - S + runs] == least))
    words = plain[places[:, None] + np.arange(K)].view(np.uint64)
    hashes = words[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    hashes = (hashes ^ (hashes >> np.uint64(29)) ^ words[:, 1]) * np.uint64(0xBF58476D1CE4E5B9)
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return places, hashes ^ (hashes >> np.uint64(31))


def sketch(hashes: np.ndarray, text: bytes) -> np.ndarray:
    """Smallest hash of each bin, 16 bits; a text without anchors has one, its own hash, and an empty text none."""
    bins = np.full(BINS, EMPTY, np.uint16)
    if not len(hashes):
        if not text:
            return bins
        hashes = np.array([xxhash.xxh64_intdigest(text, 7)], np.uint64)
    hashes = np.sort(hashes)
    owner = (hashes >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    # The smallest of a bin's 57-bit rests; their top bits fall near zero in long texts, so all bits are mixed again.
    rest = hashes[first] * np.uint64(0xD6E8FEB86659FD93)
    bins[owner[first]] = np.minimum(rest >> np.uint64(48), np.uint64(EMPTY - 1)).astype(np.uint16)
    return bins


def hexadecimal(bins: np.ndarray) -> str:
    return bins.astype(">u2").tobytes().hex()


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal hashes come before each one."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, np.int64)
    out = np.empty(len(hashes), np.int64)
    out[order] = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    return out


def matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places in both texts of equal anchors, by the place in the first; the n-th of equal ones meets the n-th."""

    def keys(hashes):
        mixed = (hashes ^ occurrences(hashes).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(31))

    _, left, right = np.intersect1d(keys(a[1]), keys(b[1]), return_indices=True)
    order = np.argsort(left)
    return a[0][left[order]], b[0][right[order]]


def aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which matches share their shift with the one before or after them."""
    same = np.diff(a - b) == 0
    out = np.zeros(len(a), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def positional_likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], same: bool) -> float:
    """Matches at consistent shifts as a share of all anchors of two texts, given as (places, hashes); ``same`` texts are alike.

    Where a text has just one anchor, its match has no neighbour and counts alone.
    """
    if same:
        return 1.0
    left, right = matches(a, b)
    found = len(left) if min(len(a[0]), len(b[0])) == 1 else int(aligned(left, right).sum())
    every = len(a[0]) + len(b[0]) - found
    return found / every if every else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the bins used by either on which both agree; two empty fingerprints are alike."""
    used = int(((a != EMPTY) | (b != EMPTY)).sum())
    return float(((a == b) & (a != EMPTY)).sum() / used) if used else 1.0


def fingerprint(text: bytes) -> np.ndarray:
    return sketch(syncmers(text)[1], text)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in byte_slices(batch, 1):
            found = [syncmers(text or b"") for text in texts]
            owner = np.repeat(np.arange(first, first + len(texts)), [len(places) for places, _ in found])
            places, hashes = (np.concatenate(part) if found else np.empty(0) for part in zip(*found, strict=True))
            ids = batch.column(0).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([ids, pa.array(places), pa.array(hashes.view(np.int64))], names=["id", "place", "anchor"])


def anchors(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, place, anchor): every closed syncmer of every text, with its byte place, for positional matching."""
    kind = docs.schema[id_column].dataType.simpleString()
    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(_anchor_batches, f"id {kind}, place long, anchor long")


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in byte_slices(batch, text):
            part = batch.slice(first, len(texts))
            prints = pa.array([hexadecimal(fingerprint(x or b"")) for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, prints], names=[*part.schema.names, "fingerprint"])


def with_fingerprint(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """Documents with their fingerprint; null counts as empty, a column named ``fingerprint`` is replaced."""
    docs = docs.drop(*[name for name in docs.columns if name.lower() == "fingerprint"])
    return docs.mapInArrow(partial(_fingerprint_batches, text=docs.columns.index(text_column)), with_fields(docs, "fingerprint string"))


class _Read:
    """A text with its anchors."""

    def __init__(self, id_, text: bytes):
        self.id, self.text, self.chars = id_, text, text.decode()
        self.anchors = syncmers(text)
        self.bins = sketch(self.anchors[1], text)


def edited(doc: _Read, follower: _Read) -> tuple[bytes, tuple[np.ndarray, np.ndarray]]:
    """The text with its last third replaced by the beginning of the next one, and its anchors.

    Anchors in front of the cut are kept; only the new end is read.
    """
    count = len(doc.chars) // 3
    head = doc.chars[: len(doc.chars) - count].encode()
    text = head + follower.chars[:count].encode()
    at = max(0, len(head) - K + 1)
    places, hashes = doc.anchors
    kept = places + K <= len(head)
    new_places, new_hashes = syncmers(text[at:])
    return text, (np.concatenate((places[kept], new_places + at)), np.concatenate((hashes[kept], new_hashes)))


RESULT = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pair_batches(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (range, guard, id, text) sorted; each row meets the one after it, the last of a range its guard."""
    held, place = None, None
    for batch in batches:
        rows = []
        for first, texts in byte_slices(batch, 3):
            part = batch.slice(first, len(texts))
            for at, guard, id_, text in zip(*(part.column(n).to_pylist() for n in range(3)), texts, strict=True):
                if at != place:
                    held, place = None, at
                elif guard and held is None:
                    continue  # further rows with the id of the guard
                read = _Read(id_, text or b"")
                if held is not None:
                    new, new_anchors = edited(held, read)
                    rows.append((
                        held.id, len(held.chars), hashlib.sha256(new).hexdigest(), hexadecimal(held.bins), hexadecimal(sketch(new_anchors[1], new)),
                        positional_likeness(held.anchors, new_anchors, held.text == new),
                        positional_likeness(held.anchors, read.anchors, held.text == read.text),
                    ))
                held = None if guard else read
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [field.split()[0] for field in RESULT.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every document's anchors against its edited text's and the next document's, by descending id.

    After the last document comes the first. A null text counts as empty, null ids
    come last, rows that repeat an id follow each other by text; one row alone is its
    own next. The texts are shuffled once, by id range, and the first document of a
    range is copied to the range before it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    width = scan_width(docs)
    picked = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    placed = with_range(picked, "id", RANGES_A_TASK * width, "range")
    # One row a range.
    heads = placed.groupBy("range").agg(F.max("id").alias("head")).orderBy(F.desc("range")).collect()
    targets = [heads[n - 1]["range"] for n in range(len(heads))]
    kind = docs.schema[id_column].dataType
    guards = docs.sparkSession.createDataFrame(
        [(row["head"], row["range"], target) for row, target in zip(heads, targets, strict=True)], f"head {kind.simpleString()}, `of range` int, target int"
    )
    met = placed.join(F.broadcast(guards), F.col("id").eqNullSafe(F.col("head")) & (F.col("range") == F.col("of range")), "left")
    own = F.struct(F.col("range"), F.lit(False).alias("guard"))
    copy = F.struct(F.col("target").alias("range"), F.lit(True).alias("guard"))
    rows = met.select(F.explode(F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("to"), "id", "text")
    rows = rows.select("to.range", "to.guard", "id", "text").repartition(width, "range")
    rows = rows.sortWithinPartitions("range", "guard", F.col("id").desc(), "text")
    return rows.mapInArrow(partial(_pair_batches, kind=to_arrow_type(kind)), RESULT.format(kind=kind.simpleString()))
