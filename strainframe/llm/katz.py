"""Katz backoff over word pairs: Good-Turing discounts, exactly normalised backoff weights, tables dealt by hash.

P(w | h) is the discounted share of the pair if it was seen, else the context's
backoff weight times P(w); P(w) is the discounted share of the word, and what all
discounts leave is the probability of the one unknown word. The weights make the
sum over all words and the unknown one exactly one.

The corpus is read once, into slices of some megabytes: the documents as numbers
of a slice's own words. Words, then pairs of words, go as sorted arrays (few bytes
an entry, each once a slice) to the buckets of the count tables; a bucket adds up
the slices' counts and answers every slice with the totals, in the order asked. So
what travels are distinct words and pairs, for counting and for scoring at once,
and the evaluation of a token is a lookup in its slice's arrays: pair, else
weight and word, else unknown. Contexts above HOT tokens are spread over several
buckets and their sums added up at the end.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from strainframe.llm.common import byte_slices, scan_width
from strainframe.session import scratch_path

#: Counts up to this are discounted.
DISCOUNTED = 5
#: Text bytes and words of a slice.
SLICE_TEXT = 12 << 20
#: Tokens of a context that one bucket takes.
HOT = 1 << 22
#: Words of a text never hold a blank, so these two are no words.
END, BEGIN = xxhash.xxh64_intdigest(b" end", 0), xxhash.xxh64_intdigest(b" begin", 0)


# --- arrays as bytes -----------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Non-negative integers: as many byte planes as the largest needs, compressed."""
    values = np.ascontiguousarray(values, np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return len(values).to_bytes(6, "little") + bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    size, width = int.from_bytes(data[:6], "little"), data[6]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[7:], max_output_size=size * width), np.uint8) if size * width else np.empty(0, np.uint8)
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = planes.reshape(width, size).T
    return out.view(np.uint64).ravel()


def steps(values: np.ndarray) -> bytes:
    """A non-decreasing sequence."""
    values = np.asarray(values, np.uint64)
    return pack(np.diff(values, prepend=np.uint64(0)))


def unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


# --- the model -----------------------------------------------------------------------------------------------------


def discounts(of: list[int]) -> np.ndarray:
    """Factor of each count from 0 to DISCOUNTED; ``of[r]``: how many have count r, up to DISCOUNTED + 1.

    Good-Turing with Katz' correction, so that counts above DISCOUNTED stay as they
    are. Where the counts of counts give no factor between 0 and 1, the count is
    lowered by the share n1 / (n1 + 2 n2) instead.
    """
    k, out = DISCOUNTED, np.ones(DISCOUNTED + 1)
    lowered = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.0
    rest = (k + 1) * of[k + 1] / of[1] if of[1] else 1.0
    for r in range(1, k + 1):
        factor = ((r + 1) * of[r + 1] / (r * of[r]) - rest) / (1 - rest) if of[r] and rest < 1 else 0.0
        out[r] = factor if 0 < factor < 1 else 1 - min(lowered, 0.99) / r
    return out


@dataclass
class Words:
    """The word model: N tokens, V words, factors, and the unknown word's probability."""

    tokens: int
    words: int
    factor: np.ndarray
    unknown: float
    scale: float

    @classmethod
    def of(cls, tokens: int, words: int, of: list[int]) -> Words:
        factor = discounts(of)
        left = sum((1 - factor[r]) * r * of[r] for r in range(1, DISCOUNTED + 1))
        # Nothing left by the discounts: one more token, the unknown word's.
        return cls(tokens, words, factor, left / tokens, 1.0) if left > 0 else cls(tokens, words, factor, 1 / (tokens + 1), tokens / (tokens + 1))

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """P(w) by training count; zero: the unknown word."""
        counts = counts.astype(np.int64)
        known = self.factor[np.minimum(counts, DISCOUNTED)] * counts
        known = np.where(counts > DISCOUNTED, counts, known) * self.scale / max(self.tokens, 1)
        return np.where(counts > 0, known, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts.astype(float) + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def backoff(context: np.ndarray, seen: np.ndarray, mass: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, total to divide pair counts by) of contexts.

    ``seen[:, r - 1]``: followers with count r; ``mass``: summed P(w) of all
    followers. A context whose followers all keep their counts gets one more token,
    so that its weight is not zero.
    """
    r = np.arange(1, DISCOUNTED + 1)
    freed = (seen * ((1 - factor[1:]) * r)).sum(axis=1)
    total = np.where(freed > 0, context, context + 1.0)
    left = np.where(freed > 0, freed, 1.0) / total
    return left / (1 - mass), total


def pair_probability(counts: np.ndarray, total: np.ndarray, factor: np.ndarray) -> np.ndarray:
    return np.where(counts > DISCOUNTED, 1.0, factor[np.minimum(counts, DISCOUNTED)]) * counts / total


# --- step 1: slices ------------------------------------------------------------------------------------------------

SLICE_FIELDS = "kind int, bucket int, slice long, a binary, b binary, c binary, d binary, e binary, held array<boolean>"


def _slice_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, train, text) -> one payload row a slice and one row for each bucket of its words."""
    number: dict[bytes, int] = {}
    ids, train, sizes, tokens, size, made = [], [], [], [], 0, 0
    first = TaskContext.get().partitionId() << 24

    def closed() -> pa.RecordBatch:
        nonlocal made
        words = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        words = np.concatenate((words, np.array([END, BEGIN], np.uint64)))
        order = np.lexsort((words, words % np.uint64(buckets)))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        words = words[order]
        stream = np.concatenate(tokens)
        stream = place[np.where(stream < 0, len(number), stream)]
        flags = np.array(train, bool)
        counted = np.bincount(stream[np.repeat(flags, sizes)], minlength=len(words))
        counted[place[-1]] = flags.sum()
        rows = [{"kind": 0, "slice": first + made, "a": pack(stream), "b": pack(np.array(sizes)), "c": pack(place[-2:]), "held": (~flags).tolist(), "ids": ids}]
        cuts = np.searchsorted(words % np.uint64(buckets), np.arange(buckets + 1).astype(np.uint64))
        for bucket, (low, high) in enumerate(itertools.pairwise(cuts.tolist())):
            if low < high:
                rows.append({"kind": 1, "bucket": bucket, "slice": first + made, "a": steps(words[low:high]), "b": pack(counted[low:high])})
        made += 1
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for start, texts in byte_slices(batch, 2, SLICE_TEXT // 4):
            part = batch.slice(start, len(texts))
            ids += part.column(0).to_pylist()
            train += part.column(1).to_pylist()
            for text in texts:
                words = (text or b"").lower().split()
                tokens.append(np.array([number.setdefault(word, len(number)) for word in words] + [-1], np.int32))
                sizes.append(len(words) + 1)
                size += len(text or b"")
            if size >= SLICE_TEXT:
                yield closed()
                number = {}
                ids, train, sizes, tokens, size = [], [], [], [], 0
    if ids:
        yield closed()


# --- step 2: words -------------------------------------------------------------------------------------------------


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one key after another; the rows come sorted."""
    rows = (row for batch in batches for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist())
    for value, group in itertools.groupby(rows, lambda row: row[key]):
        yield value, list(group)


COUNT_FIELDS = "kind int, bucket int, slice long, a binary, b binary, c binary, d binary, e binary, stats array<long>"


def _word_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A bucket of the word table: totals to every slice, the table itself, and its counts of counts."""
    for bucket, rows in _groups(batches, "bucket"):
        parts = [unsteps(row["a"]) for row in rows]
        words, where = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(where, weights=np.concatenate([unpack(row["b"]) for row in rows]), minlength=len(words)).astype(np.int64)
        out, at = [], 0
        for row, part in zip(rows, parts, strict=True):
            mine = where[at : at + len(part)]
            at += len(part)
            out.append({"kind": 2, "bucket": bucket, "slice": row["slice"], "a": steps(mine), "b": pack(totals[mine])})
        known = totals > 0
        out.append({"kind": 3, "bucket": bucket, "a": steps(words[known]), "b": pack(totals[known])})
        own = totals[known & (words != np.uint64(BEGIN))]
        of = np.bincount(np.minimum(own, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
        out.append({"kind": 4, "bucket": bucket, "stats": [int(own.sum()), len(own), *of[1 : DISCOUNTED + 2].tolist()]})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


# --- step 3: pairs -------------------------------------------------------------------------------------------------


class Slice:
    """A slice with the totals of its words; pairs of known contexts in the order of their buckets."""

    def __init__(self, payload: dict, answers: list[dict], buckets: int):
        self.ids, self.held = payload["ids"], np.array(payload["held"], bool)
        self.sizes = unpack(payload["b"]).astype(np.int64)
        self.stream = unpack(payload["a"]).astype(np.int32)
        begin = int(unpack(payload["c"])[1])
        answers = sorted(answers, key=lambda row: row["bucket"])
        self.code = np.concatenate([(unsteps(row["a"]) | np.uint64(row["bucket"] << 40)) for row in answers]).astype(np.int64)
        self.count = np.concatenate([unpack(row["b"]) for row in answers]).astype(np.int64)
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        self.starts = np.cumsum(self.sizes) - self.sizes
        before[self.starts] = begin
        width = len(self.code)
        pairs, where = np.unique(before.astype(np.int64) * width + self.stream, return_inverse=True)
        self.where = where.astype(np.int32)
        del where, before
        training = np.bincount(self.where[np.repeat(~self.held, self.sizes)], minlength=len(pairs)).astype(np.int32)
        self.context, self.word = (pairs // width).astype(np.int32), (pairs % width).astype(np.int32)
        del pairs
        asked = np.flatnonzero(self.count[self.context] > 0).astype(np.int32)
        context, word = self.context[asked], self.word[asked]
        spread = 1 + self.count[context] // HOT
        mixed = self.code[context] * 1_000_003 + (self.code[word] * 0x9E3779B1 >> 7) % spread
        bucket = ((mixed * 0x2545F4914F6CDD1D) >> 20 & 0x7FFFFFFF) % buckets
        order = np.lexsort((self.code[word], self.code[context], bucket))
        self.asked = asked[order]
        self.training = training[self.asked]
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))

    def contexts(self, low: int, high: int) -> np.ndarray:
        """Starts of the runs of a context among the pairs of a bucket."""
        context = self.context[self.asked[low:high]]
        return np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))


def _by_slice(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, Slice, list[dict]]]:
    for number, rows in _groups(batches, "slice"):
        payload = next(row for row in rows if row["kind"] == 0)
        found = Slice(payload, [row for row in rows if row["kind"] == 2], buckets)
        yield number, found, [row for row in rows if row["kind"] == 5]


def _pair_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, buckets: int) -> Iterator[pa.RecordBatch]:
    """What a slice asks each bucket: its contexts with their followers, and the counts it adds."""
    for number, found, _ in _by_slice(batches, buckets):
        for bucket, (low, high) in enumerate(itertools.pairwise(found.cuts.tolist())):
            if low == high:
                continue
            runs = found.contexts(low, high)
            pairs = found.asked[low:high]
            context, word = found.context[pairs], found.word[pairs]
            followers, place = np.unique(word, return_inverse=True)
            row = {
                "kind": 1,
                "bucket": bucket,
                "slice": number,
                "a": steps(found.code[context[runs]]),
                "b": pack(np.diff(np.append(runs, high - low))),
                "c": pack(place),
                "d": pack(found.training[low:high]),
                "e": _joined(steps(found.code[followers]), pack(found.count[followers]), pack(found.count[context[runs]])),
            }
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def _joined(*parts: bytes) -> bytes:
    return b"".join(len(part).to_bytes(5, "little") + part for part in parts)


def _parted(data: bytes) -> list[bytes]:
    parts = []
    while data:
        size = int.from_bytes(data[:5], "little")
        parts.append(data[5 : 5 + size])
        data = data[5 + size :]
    return parts


def _count_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, words: Words) -> Iterator[pa.RecordBatch]:
    """A bucket of the pair table: totals of pairs and sums of contexts to every slice, and the table itself."""
    for bucket, rows in _groups(batches, "bucket"):
        contexts, followers, counts, heads, context_counts, word_counts = [], [], [], [], [], []
        for row in rows:
            own, (codes, totals, of_context) = unsteps(row["a"]), _parted(row["e"])
            place = unpack(row["c"]).astype(np.int64)
            heads.append(own)
            contexts.append(np.repeat(own, unpack(row["b"]).astype(np.int64)))
            followers.append(unsteps(codes)[place])
            word_counts.append(unpack(totals)[place])
            counts.append(unpack(row["d"]))
            context_counts.append(unpack(of_context))
        head, context = np.unique(np.concatenate(contexts), return_inverse=True)
        follower, word = np.unique(np.concatenate(followers), return_inverse=True)
        pairs, first, where = np.unique(context * len(follower) + word, return_index=True, return_inverse=True)
        totals = np.bincount(where, weights=np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
        owner, seen = pairs // len(follower), totals > 0
        share = words.probability(np.concatenate(word_counts)[first])
        mass = np.bincount(owner[seen], weights=share[seen], minlength=len(head))
        by_count = np.stack([np.bincount(owner[totals == r], minlength=len(head)) for r in range(1, DISCOUNTED + 1)], axis=1)
        context_count = np.empty(len(head), np.int64)
        context_count[np.searchsorted(head, np.concatenate(heads))] = np.concatenate(context_counts).astype(np.int64)
        at, out = 0, []
        for row, own, part in zip(rows, heads, contexts, strict=True):
            mine = where[at : at + len(part)]
            at += len(part)
            place = np.searchsorted(head, own)
            out.append({
                "kind": 5, "bucket": bucket, "slice": row["slice"], "a": pack(totals[mine]),
                "b": _joined(*(pack(by_count[place, r]) for r in range(DISCOUNTED))), "c": pack(mass[place].view(np.uint64)),
            })
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
        owners = np.bincount(owner[seen], minlength=len(head))
        kept = owners > 0
        out.append({
            "kind": 6, "bucket": bucket, "a": steps(head[kept]), "b": pack(owners[kept]), "c": pack(follower[(pairs % len(follower))[seen]]),
            "d": pack(totals[seen]), "e": _joined(pack(mass[kept].view(np.uint64)), pack(context_count[kept])),
        })
        of = np.bincount(np.minimum(totals, DISCOUNTED + 2), minlength=DISCOUNTED + 3)
        out.append({"kind": 7, "bucket": bucket, "stats": [int(totals.sum()), int(seen.sum()), *of[1 : DISCOUNTED + 2].tolist()]})
        for place in np.flatnonzero(context_count >= HOT).tolist():
            # The sums of a spread context are added up over its buckets.
            out.append({"kind": 8, "bucket": bucket, "slice": int(head[place]), "stats": by_count[place].tolist(), "a": mass[place : place + 1].tobytes()})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


# --- step 4: scores ------------------------------------------------------------------------------------------------


def _score_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, buckets: int, words: Words, factor: np.ndarray, hot: dict) -> Iterator[pa.RecordBatch]:
    for _, found, answers in _by_slice(batches, buckets):
        share = np.log10(words.probability(found.count))
        value = share[found.word]  # contexts never seen in training: the word alone
        for row in answers:
            low, high = found.cuts[row["bucket"]], found.cuts[row["bucket"] + 1]
            runs, pairs, counts = found.contexts(low, high), found.asked[low:high], unpack(row["a"]).astype(np.int64)
            seen = np.stack([unpack(part) for part in _parted(row["b"])], axis=1).astype(float)
            mass = unpack(row["c"]).view(np.float64).copy()
            own = found.context[pairs[runs]]
            for place in np.flatnonzero(found.count[own] >= HOT).tolist():
                seen[place], mass[place] = hot[int(found.code[own[place]])]
            weight, total = backoff(found.count[own].astype(float), seen, mass, factor)
            spread = np.diff(np.append(runs, high - low))
            with np.errstate(divide="ignore"):
                direct = np.log10(pair_probability(counts, np.repeat(total, spread), factor))
            value[pairs] = np.where(counts > 0, direct, np.repeat(np.log10(weight), spread) + share[found.word[pairs]])
        known = found.count[found.stream] > 0
        columns = [
            pa.array(found.ids, schema.field(0).type),
            pa.array(found.held),
            pa.array(found.sizes),
            pa.array(np.add.reduceat(known.astype(np.int64), found.starts)),
            pa.array(np.full(len(found.sizes), words.tokens)),
            pa.array(np.add.reduceat(words.base(found.count)[found.stream], found.starts)),
            pa.array(np.add.reduceat(value[found.where], found.starts)),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)


def _total(table: DataFrame, kind: int) -> list[int]:
    """Sums of the statistics of all buckets."""
    size = DISCOUNTED + 3
    row = table.filter(F.col("kind") == kind).agg(*[F.coalesce(F.sum(F.get("stats", F.lit(n))), F.lit(0)).alias(f"s{n}") for n in range(size)]).first()
    return list(row or Row(*[0] * size))


def score_documents(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None) -> DataFrame:
    """Scores of every row's whole text by a model of the rows where ``train`` holds.

    (id, held_out, n_tokens, n_known, train_tokens, base_score, score): A-Z in lower
    case, words between white space, one end token a document. A null text is an
    empty one, a null ``train`` is not trained on. Rows that repeat count each time.
    Without any training row every token is the unknown word. An empty table gives
    no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    buckets = buckets or scan_width(docs)
    kind = docs.schema[id_column].dataType
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_column).cast("string").alias("text"))

    def stored(frame: DataFrame) -> DataFrame:
        path = scratch_path(spark)
        frame.write.parquet(path, partitionBy="kind")
        return spark.read.schema(frame.schema).parquet(path)

    slices = StructType([*StructType.fromDDL(SLICE_FIELDS).fields, StructField("ids", ArrayType(kind))])
    counts = StructType.fromDDL(COUNT_FIELDS)
    arrow = to_arrow_schema(counts)
    cut = stored(rows.mapInArrow(partial(_slice_batches, schema=to_arrow_schema(slices), buckets=buckets), slices))

    asked = cut.filter("kind = 1").select("bucket", "slice", "a", "b").repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice")
    answered = stored(asked.mapInArrow(partial(_word_batches, schema=arrow), counts))
    tokens, distinct, *of = _total(answered, 4)
    words = Words.of(max(tokens, 0), distinct, [0, *of])

    def by_slice(*frames: DataFrame) -> DataFrame:
        whole = cut.filter("kind = 0").select(*slices.names)
        for frame in frames:
            whole = whole.unionByName(frame, allowMissingColumns=True)
        return whole.repartition(buckets, "slice").sortWithinPartitions("slice", "kind", "bucket")

    replies = answered.filter("kind = 2").select("kind", "bucket", "slice", "a", "b")
    pairs = by_slice(replies).mapInArrow(partial(_pair_batches, schema=arrow, buckets=buckets), counts)
    pairs = pairs.repartition(buckets, "bucket").sortWithinPartitions("bucket", "slice")
    paired = stored(pairs.mapInArrow(partial(_count_batches, schema=arrow, words=words), counts))
    factor = discounts([0, *_total(paired, 7)[2:]])
    # At most one row for HOT training tokens and bucket.
    hot: dict[int, tuple[np.ndarray, float]] = {}
    for row in paired.filter("kind = 8").collect():
        seen, mass = hot.get(row["slice"], (np.zeros(DISCOUNTED), 0.0))
        hot[row["slice"]] = (seen + np.array(row["stats"], float), mass + float(np.frombuffer(row["a"], float)[0]))

    replies_to_pairs = paired.filter("kind = 5").select("kind", "bucket", "slice", "a", "b", "c")
    out = StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    out = StructType([StructField(id_column, kind), *out.fields])
    step = partial(_score_batches, schema=to_arrow_schema(out), buckets=buckets, words=words, factor=factor, hot=hot)
    return by_slice(replies, replies_to_pairs).mapInArrow(step, out)
