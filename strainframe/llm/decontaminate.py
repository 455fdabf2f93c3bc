"""Benchmark decontamination: a broadcast hash set of test n-grams against every training text.

Words of an item and of a document are normalised alike; each run of ``size``
words of an item (all of a shorter one) is a window. A document position can only
start a window if all its words occur in the benchmark, which leaves few
candidates; those are looked up in the hash set and compared word by word.

The set is broadcast in blocks of a fixed size, so a benchmark of any size works and
none is cut. With several blocks one is alive at a time: its hits are written by
text before the next is gathered, and at the end all hits of a text are merged.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strainframe.llm.common import byte_slices, free_name, with_fields
from strainframe.session import cut_lineage, scratch_path

WINDOW_WORDS = 13
#: A document is contaminated if at least one in so many of its words is hit.
HIT_SHARE = 20
#: Bounds of one broadcast block of (window, item) rows.
BLOCK_ROWS = 200_000
BLOCK_BYTES = 32 << 20

#: Lower case, digits and everything beyond ASCII stay; the rest separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

HIT_COLUMNS = ("hit_words", "hit_spans", "hit_items")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _window_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in byte_slices(batch, 1):
            at, windows, lengths = [], [], []
            for place, text in enumerate(texts):
                words = words_of(text)
                n = min(size, len(words))
                for start in range(len(words) - n + 1) if n else ():
                    at.append(first + place)
                    windows.append(b" ".join(words[start : start + n]))
                    lengths.append(n)
            items = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([items, pa.array(windows, pa.binary()), pa.array(lengths, pa.int32())], names=["item", "window", "n"])


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """Distinct (item, window, n) rows; ``item`` is the id as text."""
    picked = benchmark.select(F.col(id_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text"))
    return picked.mapInArrow(partial(_window_batches, size=size), "item string, window binary, n int").distinct()


class WindowSet:
    """One block of windows: its words, and the items of each window by length."""

    def __init__(self, rows):
        self.items: dict[int, dict[bytes, list]] = {}
        for item, window, n in rows:
            self.items.setdefault(n, {}).setdefault(bytes(window), []).append(item)
        self.known = {word: 1 for windows in self.items.values() for window in windows for word in window.split(b" ")}

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        known = np.fromiter(map(self.known.get, words, [0] * len(words)), np.int32, len(words))
        spans, found = [], set()
        for n, windows in self.items.items():
            if len(words) < n:
                continue
            total = np.concatenate(([0], np.cumsum(known)))
            for start in np.flatnonzero(total[n:] - total[:-n] == n).tolist():
                items = windows.get(b" ".join(words[start : start + n]))
                if items is not None:
                    spans.append((start, start + n))
                    found.update(items)
        return spans, found


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat [start, end, start, end, ...] of the union of the spans."""
    flat: list[int] = []
    for start, end in sorted(spans):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += (start, end)
    return flat


def _marked(part: pa.RecordBatch, columns: list, sizes: list, spans: list, items: list) -> pa.RecordBatch:
    added = [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*columns, *added], names=[*part.schema.names[: len(columns)], *HIT_COLUMNS])


def _mark_batches(batches: Iterator[pa.RecordBatch], block: WindowSet, text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in byte_slices(batch, text):
            sizes, spans, items = [], [], []
            for text_ in texts:
                words = words_of(text_)
                new, found = block.hits(words)
                sizes.append(len(words))
                spans.append(merged(new))
                items.append(sorted(found - {None}))
            part = batch.slice(first, len(texts))
            yield _marked(part, part.columns, sizes, spans, items)


def _hit_batches(batches: Iterator[pa.RecordBatch], block: WindowSet) -> Iterator[pa.RecordBatch]:
    """(key, spans, items) of the texts that the block hits."""
    for batch in batches:
        for first, texts in byte_slices(batch, 1):
            at, spans, items = [], [], []
            for place, text in enumerate(texts):
                new, found = block.hits(words_of(text))
                if new:
                    at.append(first + place)
                    spans.append(merged(new))
                    items.append(sorted(found - {None}))
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["key", "spans", "items"]
            )


def _merge_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The spans and items of all blocks, the last two columns, made one."""
    for batch in batches:
        for first, texts in byte_slices(batch, text):
            part = batch.slice(first, len(texts))
            sizes, spans, items = [], [], []
            for text_, flat, found in zip(texts, *[column.to_pylist() for column in part.columns[-2:]], strict=True):
                sizes.append(len(words_of(text_)))
                spans.append(merged(list(zip(flat[::2], flat[1::2], strict=True))) if flat else [])
                items.append(sorted(set(found or ())))
            yield _marked(part, part.columns[:-2], sizes, spans, items)


def _mark_by_blocks(docs: DataFrame, windows: DataFrame, blocks: int, place: int, schema: StructType) -> DataFrame:
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession)
    text = F.col(docs.columns[place])
    key = F.concat(F.hex(F.xxhash64(text)), F.lit(" "), F.hex(F.xxhash64(F.lit("second"), text)))
    keyed = docs.select(key.alias("key"), text.cast("string").alias("text"))
    layout = "key string, spans array<int>, items array<string>"
    for number in range(blocks):
        block = WindowSet(windows.filter(F.pmod(F.xxhash64("item", "window"), F.lit(blocks)) == number).collect())
        keyed.mapInArrow(partial(_hit_batches, block=block), layout).write.mode("append").parquet(path)
    # Equal texts have equal hits; a text has at most one row a block then.
    hits = spark.read.schema(layout).parquet(path).distinct()
    hits = hits.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    own, spans, items = (free_name(docs, name) for name in ("hit_key", "spans", "items"))
    hits = hits.select(F.col("key").alias(own), F.col("spans").alias(spans), F.col("items").alias(items))
    met = docs.join(hits, key == F.col(own), "left").select(*[F.col(f"`{name}`") for name in (*docs.columns, spans, items)])
    return met.mapInArrow(partial(_merge_batches, text=place), schema)


def mark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW_WORDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Documents with ``hit_words`` (their words), ``hit_spans`` (flat word ranges) and ``hit_items`` (ids as text, sorted).

    A null text has no words. Items without words hit nothing; an item with a null
    id hits words but is not named. Columns with one of the three names are
    replaced, all others stay; an empty benchmark marks nothing.
    """
    docs = docs.drop(*[name for name in docs.columns if name.lower() in HIT_COLUMNS])
    windows = cut_lineage(benchmark_windows(benchmark, item_column, item_text, size))
    total = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("window") + 64), F.lit(0))).first()
    blocks = max(1, math.ceil(total[0] / block_rows), math.ceil(total[1] / BLOCK_BYTES))
    schema = with_fields(docs, "hit_words long, hit_spans array<int>, hit_items array<string>")
    place = docs.columns.index(text_column)
    if blocks > 1:
        return _mark_by_blocks(docs, windows, blocks, place, schema)
    return docs.mapInArrow(partial(_mark_batches, block=WindowSet(windows.collect()), text=place), schema)


def hit_count() -> Column:
    """Words inside a hit span."""
    places = F.sequence(F.lit(0), F.size("hit_spans") - 2, F.lit(2))
    widths = F.transform(places, lambda at: F.get("hit_spans", at + 1) - F.get("hit_spans", at))
    return F.when(F.size("hit_spans") == 0, F.lit(0)).otherwise(F.aggregate(widths, F.lit(0), lambda a, b: a + b)).cast("long")


def contaminated(share: int = HIT_SHARE) -> Column:
    return (hit_count() > 0) & (share * hit_count() >= F.col("hit_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that are not contaminated, with their own columns."""
    return mark_hits(docs, benchmark, **options).filter(~contaminated()).drop(*HIT_COLUMNS)


def without_spans(text: bytes, spans: list[int]) -> bytes:
    """The text without its hit word ranges (from the first to the last word of each)."""
    places = [match.span() for match in _WORD.finditer(text)]
    kept, at = [], 0
    for start, end in zip(spans[::2], spans[1::2], strict=True):
        kept.append(text[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]])


def _cut_batches(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in byte_slices(batch, text):
            part = batch.slice(first, len(texts))
            spans = part.column(part.schema.names.index("hit_spans")).to_pylist()
            cut = [without_spans(x, flat) if flat else x for x, flat in zip(texts, spans, strict=True)]
            columns = list(part.columns)
            columns[text] = pa.array(cut, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)


def remove_hit_spans(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", **options) -> DataFrame:
    """All documents; the hit word ranges are cut out of their texts."""
    marked = mark_hits(docs, benchmark, text_column=text_column, **options)
    step = partial(_cut_batches, text=marked.columns.index(text_column))
    return marked.mapInArrow(step, marked.schema).drop(*HIT_COLUMNS)
