"""Token-id files with Elias-Fano document boundaries.

A file set is a folder of Parquet files whose rows are segments: the ids of
consecutive documents in ascending id order, concatenated with two or four bytes
an id, and two Elias-Fano sequences, the end of every document and its id. A
segment closes at SEGMENT_IDS ids or SEGMENT_DOCS documents, never within a
document, so reading one needs no other. Shards are the ranges of document ids
that one task has written; a segment knows how many ids of its shard precede it,
and one total a shard gives every document its place in the whole array.
"""

from __future__ import annotations

import collections
import itertools
import json
import os
import re
import sys
import types
import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainframe.llm.common import byte_slices, scan_width

SEGMENT_IDS = 1 << 20
SEGMENT_DOCS = 1 << 16
#: Words whose ids a task remembers.
CACHE_WORDS = 600_000
#: Ones between two stored positions of the select structure.
SELECT_STEP = 256
END_ID = 2
#: How such a tokenizer splits a text (fixed value of the tokenizer file).
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: ASCII punctuation.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words in a text that is encoded for all of them.
JOINED = 500

_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

SEGMENT_FIELDS = (
    "shard int, segment int, before long, n_docs int, n_nameless int, n_ids long, id_bytes int, "
    "first_doc long, doc_span long, doc_low binary, doc_high binary, doc_select binary, "
    "end_low binary, end_high binary, end_select binary, ids binary"
)
NAMES = [field.split()[0] for field in SEGMENT_FIELDS.split(", ")]


class EliasFano:
    """A non-decreasing sequence of ``size`` numbers from 0 to ``top`` in about 2 + log2(top / size) bits a number.

    The low bits are packed; the high parts are ones in a bit string, the i-th at
    position (high part + i). Every SELECT_STEP-th one's position is stored, so
    ``select`` reads a bounded stretch of bits.
    """

    def __init__(self, size: int, top: int, low: bytes, high: bytes, samples: bytes):
        self.size, self.bits = size, self.low_bits(size, top)
        self.low, self.high, self.samples = (np.frombuffer(x, kind) for x, kind in ((low, np.uint8), (high, np.uint8), (samples, np.uint32)))

    @staticmethod
    def low_bits(size: int, top: int) -> int:
        return max(0, (top // size).bit_length() - 1) if size else 0

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> tuple[bytes, bytes, bytes]:
        size, bits = len(values), cls.low_bits(len(values), top)
        values = values.astype(np.uint64)
        places = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(size)
        flags = np.zeros(int(ones[-1]) + 1 if size else 0, np.uint8)
        flags[ones] = 1
        packed = (np.packbits(x, bitorder="little").tobytes() for x in (places.astype(np.uint8).ravel(), flags))
        return (*packed, ones[::SELECT_STEP].astype(np.uint32).tobytes())

    def select(self, index: int) -> int:
        """The number at an index."""
        at = int(self.samples[index // SELECT_STEP])
        left = index % SELECT_STEP
        byte, stretch = at >> 3, 64
        while len(ones := np.flatnonzero(np.unpackbits(self.high[byte : byte + stretch], bitorder="little")[at & 7 :])) <= left:
            stretch *= 2
        high = at + int(ones[left]) - index
        low = np.arange(index * self.bits, (index + 1) * self.bits)
        value = sum(int(self.low[place >> 3] >> (place & 7) & 1) << n for n, place in enumerate(low.tolist()))
        return (high << self.bits) | value

    def select_many(self, first: int, count: int) -> np.ndarray:
        """The numbers at neighbouring indexes; each stored position opens the stretch of bits up to the next one."""
        if not count:
            return np.empty(0, np.int64)
        start, stop = first // SELECT_STEP, (first + count - 1) // SELECT_STEP + 1
        begin = int(self.samples[start]) >> 3
        end = (int(self.samples[stop]) >> 3) + 1 if stop < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + 8 * begin
        ones = ones[ones >= int(self.samples[start])][first - start * SELECT_STEP :][:count]
        high = (ones - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.bits)
        byte = first * self.bits >> 3
        low = np.unpackbits(self.low[byte : ((first + count) * self.bits >> 3) + 1], bitorder="little")[first * self.bits - 8 * byte :]
        low = low[: count * self.bits].reshape(count, self.bits)
        return (high | (low.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)).astype(np.int64)

    def search(self, value: int) -> int:
        """The first index whose number is not below a value; size if there is none."""
        low, high = 0, self.size
        while low < high:
            middle = (low + high) // 2
            if self.select(middle) < value:
                low = middle + 1
            else:
                high = middle
        return low


class TextEncoder:
    """Ids of texts, an end id after each.

    A tokenizer that lowers case and splits at white space and between letters and
    punctuation gives a text the ids of its words in a row; a word's end of ASCII
    punctuation is a word of its own. Each is then encoded once and remembered.
    Other tokenizers encode every text as a whole.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4")
        self.end_id = end_id
        with open(tokenizer_path) as file:
            settings = json.load(file)
        normal = [part["type"] for part in (settings["normalizer"] or {}).get("normalizers", ())]
        split = ((settings["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.by_word = normal == ["NFC", "Replace", "Lowercase"] and split.get("pattern", {}).get("Regex") == WORD_SPLIT and split["invert"]
        self.special = [part["content"].encode() for part in settings["added_tokens"]]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        suffix = settings["model"].get("end_of_word_suffix")
        if suffix:
            self.ends[[number for piece, number in self.tokenizer.get_vocab().items() if piece.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        #: Numbers of words, of which 0 is the end of a text, and of their parts.
        self.number, self.part = _numbers(), _numbers()
        self.number[b"\n"]
        self.flat, self.size = np.array([self.end_id], self.kind), np.ones(1, np.int64)
        self.part_flat, self.part_size = np.empty(0, self.kind), np.empty(0, np.int64)

    def words(self, text: bytes) -> list[bytes]:
        # Lower case would turn other spellings into special tokens.
        return (text if any(token[:2] in text for token in self.special) else text.lower()).split()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [found.ids for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), self.kind, int(sizes.sum())), sizes

    def _part_ids(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts; those of letters alone are encoded many in a text, for each ends with one word-end token."""
        texts = [part.decode() for part in parts]
        plain = np.fromiter((_LETTERS.fullmatch(text) is not None for text in texts), bool, len(texts))
        lettered = list(itertools.compress(texts, plain))
        joined, _ = self._ids([" ".join(lettered[n : n + JOINED]) for n in range(0, len(lettered), JOINED)])
        ends = np.flatnonzero(self.ends[joined])
        if len(ends) != len(lettered):
            return self._ids(texts)
        other, other_size = self._ids(list(itertools.compress(texts, ~plain)))
        sizes = np.empty(len(texts), np.int64)
        sizes[plain], sizes[~plain] = np.diff(ends, prepend=-1), other_size
        flat = np.empty(int(sizes.sum()), self.kind)
        owner = np.repeat(plain, sizes)
        flat[owner], flat[~owner] = joined, other
        return flat, sizes

    def _learn(self, words: list[bytes]) -> None:
        known, parts, counts = len(self.part), [], []
        for word in words:
            core = word.rstrip(PUNCTUATION)
            # The tokenizer cuts between a letter or digit and punctuation.
            if len(core) < len(word) and core[-1:].isalnum() and not any(token[:2] in word for token in self.special):
                parts += (self.part[core], self.part[word[len(core) :]])
                counts.append(2)
            else:
                parts.append(self.part[word])
                counts.append(1)
        if len(self.part) > known:
            flat, sizes = self._part_ids(list(itertools.islice(self.part, known, None)))
            self.part_flat, self.part_size = np.concatenate((self.part_flat, flat)), np.concatenate((self.part_size, sizes))
        parts = np.array(parts, np.int64)
        flat, sizes = _gathered(self.part_flat, self.part_size, parts)
        self.flat = np.concatenate((self.flat, flat))
        last = np.cumsum(counts) - 1
        self.size = np.concatenate((self.size, np.diff(np.cumsum(sizes)[last], prepend=0)))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text)."""
        if not self.by_word:
            flat, sizes = self._ids([text.decode() for text in texts])
            return np.insert(flat, np.cumsum(sizes), self.end_id).astype(self.kind), sizes + 1
        if len(self.number) > CACHE_WORDS:
            self.forget()
        known, places = len(self.number), []
        for text in texts:
            words = self.words(text)
            words.append(b"\n")
            places.append(np.fromiter(map(self.number.__getitem__, words), np.int32, len(words)))
        if len(self.number) > known:
            self._learn(list(itertools.islice(self.number, known, None)))
        last = np.cumsum([len(x) for x in places]) - 1
        out, sizes = _gathered(self.flat, self.size, np.concatenate(places))
        return out, np.diff(np.cumsum(sizes)[last], prepend=0)


def _numbers() -> dict[bytes, int]:
    """A dictionary that numbers its keys as they come."""
    numbers = collections.defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def _gathered(flat: np.ndarray, size: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs at the places, one after another, and their sizes."""
    sizes = size[places]
    ends = np.cumsum(sizes)
    shift = np.repeat((np.cumsum(size) - size)[places] - ends + sizes, sizes)
    return flat[shift + np.arange(len(shift))], sizes


def _segment(shard: int, number: int, before: int, docs: list, sizes: np.ndarray, ids: np.ndarray) -> dict:
    named = np.array([x for x in docs if x is not None], np.int64)
    first, span = (int(named[0]), int(named[-1]) - int(named[0])) if len(named) else (0, 0)
    doc_parts = EliasFano.encode((named - first) if len(named) else named, span)
    end_parts = EliasFano.encode(np.cumsum(sizes), len(ids))
    values = (shard, number, before, len(docs), len(docs) - len(named), len(ids), ids.dtype.itemsize, first, span, *doc_parts, *end_parts, ids.tobytes())
    return dict(zip(NAMES, values, strict=True))


def kept_encoder(tokenizer_path: str, end_id: int) -> TextEncoder:
    """The encoder of this Python worker, which serves all of its tasks: words learned in one are known in the next."""
    held = sys.modules.setdefault("strainframe_kept_encoder", types.ModuleType("strainframe_kept_encoder"))
    if getattr(held, "key", None) != (tokenizer_path, end_id):
        held.key, held.encoder = (tokenizer_path, end_id), TextEncoder(tokenizer_path, end_id)
    return held.encoder


def _write_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema, tokenizer_path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in ascending id order, one segment a batch."""
    encoder, shard, number, before = kept_encoder(tokenizer_path, end_id), TaskContext.get().partitionId(), 0, 0
    docs: list = []
    sizes: list[np.ndarray] = []
    ids: list[np.ndarray] = []

    def closed() -> pa.RecordBatch:
        nonlocal docs, sizes, ids, number, before
        row = _segment(shard, number, before, docs, np.concatenate(sizes), np.concatenate(ids))
        docs, sizes, ids, number, before = [], [], [], number + 1, before + row["n_ids"]
        return pa.RecordBatch.from_pylist([row], schema=schema)

    for batch in batches:
        for first, texts in byte_slices(batch, 1, SEGMENT_IDS):
            names = batch.column(0).slice(first, len(texts)).to_pylist()
            for at in range(0, len(texts), SEGMENT_DOCS):
                flat, each = encoder.encode([x or b"" for x in texts[at : at + SEGMENT_DOCS]])
                if docs and (len(docs) + len(each) > SEGMENT_DOCS or sum(map(len, ids)) + len(flat) > SEGMENT_IDS):
                    yield closed()
                docs += names[at : at + SEGMENT_DOCS]
                sizes.append(each)
                ids.append(flat)
    if docs:
        yield closed()


def write_token_files(
    docs: DataFrame, path: str, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = END_ID
) -> None:
    """Encode every row's whole text, append ``end_id`` and write the ids in ascending id order.

    The id column is integral; rows without an id come first, rows that repeat one
    stand side by side in the order of their texts. A null text is written as empty.
    Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    picked = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    placed = picked.repartitionByRange(scan_width(docs), "id").sortWithinPartitions("id", "text")
    schema = StructType.fromDDL(SEGMENT_FIELDS)
    step = partial(_write_batches, schema=to_arrow_schema(schema), tokenizer_path=tokenizer_path, end_id=end_id)
    placed.mapInArrow(step, schema).write.parquet(path)


def _sequences(row: dict) -> tuple[EliasFano, EliasFano]:
    """Document ids, less the first one, and ends of the documents of a segment."""
    named = row["n_docs"] - row["n_nameless"]
    return (
        EliasFano(named, row["doc_span"], row["doc_low"], row["doc_high"], row["doc_select"]),
        EliasFano(row["n_docs"], row["n_ids"], row["end_low"], row["end_high"], row["end_select"]),
    )


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list, np.ndarray, np.ndarray]]:
    """(shard, ids before, document ids, ends, ids) of every segment."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(n)[at].as_py() for n, name in enumerate(batch.schema.names)}
            docs, ends = _sequences(row)
            ids = docs.select_many(0, docs.size) + row["first_doc"]
            yield row["shard"], row["before"], [None] * row["n_nameless"] + ids.tolist(), ends.select_many(0, ends.size), np.frombuffer(row["ids"], f"<u{row['id_bytes']}")


def _wanted_batches(batches: Iterator[pa.RecordBatch], wanted: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of the wanted documents of each segment, through selects alone."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = {name: batch.column(n)[at].as_py() for n, name in enumerate(batch.schema.names)}
            (docs, ends), found = _sequences(row), []
            ids = np.frombuffer(row["ids"], f"<u{row['id_bytes']}")
            for name in wanted:
                place = docs.search(name - row["first_doc"]) if name >= row["first_doc"] else docs.size
                while place < docs.size and docs.select(place) == name - row["first_doc"]:
                    index = row["n_nameless"] + place
                    start = ends.select(index - 1) if index else 0
                    found.append((name, ids[start : ends.select(index)].tolist()))
                    place += 1
            if found:
                columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.list_(pa.int32())), strict=True)], names=["doc_id", "ids"])


def read_documents(spark: SparkSession, path: str, doc_ids: Sequence[int]) -> DataFrame:
    """(doc_id, ids) of a few documents, named by a list; segments that cannot hold any of them are not opened.

    In a segment the id is found by binary search and its offsets by select, a few stretches of bits each. Documents that
    share an id all come back, unknown ids give no row.
    """
    files = spark.read.schema(SEGMENT_FIELDS).parquet(path)
    wanted = sorted(set(doc_ids))
    if not wanted:
        return spark.createDataFrame([], "doc_id long, ids array<int>")
    near = files.filter((F.col("first_doc") <= wanted[-1]) & (F.col("first_doc") + F.col("doc_span") >= wanted[0]))
    return near.mapInArrow(partial(_wanted_batches, wanted=wanted), "doc_id long, ids array<int>")


def _read_batches(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for shard, before, docs, ends, ids in _documents(batches):
        starts = np.concatenate(([0], ends[:-1]))
        if digest:
            wide = ids.astype("<u4").tobytes()
            last = pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.int64())
        else:
            last = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)), pa.int32()), pa.array(ids.astype(np.int32)))
        columns = [pa.array([shard] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(before + starts), pa.array(ends - starts), last]
        yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; with ``digest`` the crc32 of its ids instead of the ids."""
    files = spark.read.schema(SEGMENT_FIELDS).parquet(path)
    # One total a shard, that is, a task of the write.
    totals = files.groupBy("shard").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).orderBy("shard").collect()
    base = np.cumsum([0] + [row["n"] for row in totals]).tolist()
    bases = spark.createDataFrame([(row["shard"], start) for row, start in zip(totals, base, strict=False)], "shard int, base long")
    last = "ids_crc32 long" if digest else "ids array<int>"
    rows = files.mapInArrow(partial(_read_batches, digest=digest), f"shard int, doc_id long, start long, n_tokens long, {last}")
    rows = rows.join(F.broadcast(bases), "shard")
    return rows.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", last.split()[0])
