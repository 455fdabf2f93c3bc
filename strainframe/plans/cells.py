"""Ranks and counts of ordered pairs inside one task: rows of bounded runs as arrays."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# The task functions travel with the query; a cluster needs no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def smaller_before(rank: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each place the weight of earlier places with a smaller rank: one pass a binary digit of the ranks.

    Two ranks differ first at one digit. Places with equal leading digits lie together, in their order; those with a 1
    at the next digit have all before them with a 0 as smaller ones.
    """
    total, at = np.zeros(len(rank), np.int64), np.arange(len(rank))
    lanes, start = np.arange(len(rank)), np.zeros(len(rank), np.int64)
    for digit in reversed(range(int(rank.max()).bit_length() if len(rank) else 0)):
        one = (rank >> digit) & 1 == 1
        low = np.where(one, 0, weight[at])
        seen = np.cumsum(low) - low
        total[at[one]] += (seen - seen[start])[one]
        first = np.flatnonzero(start == lanes)
        sizes = np.diff(np.append(first, len(rank)))
        zeros = np.repeat(np.add.reduceat(~one, first, dtype=np.int64), sizes)
        before = np.cumsum(~one) - ~one
        before = before - before[start]
        place = np.where(one, start + zeros + (lanes - start - before), start + before)
        dealt = [np.empty_like(value) for value in (rank, at, start)]
        for new, old in zip(dealt, (rank, at, np.where(one, start + zeros, start)), strict=True):
            new[place] = old
        rank, at, start = dealt
    return total


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Places of rows among the distinct rows, the first column leading."""
    order = np.lexsort(columns[::-1])
    fresh = np.zeros(len(order), bool)
    for column in columns:
        ordered = column[order]
        fresh[1:] |= ordered[1:] != ordered[:-1]
    places = np.empty(len(order), np.int64)
    places[order] = np.cumsum(fresh)
    return places


def _codes(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """A number for each combination of keys."""
    code = np.zeros(table.num_rows, np.int64)
    for name in keys:
        own = table[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = _dense(code, own.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    return code


def _tied(code: np.ndarray, value: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a smaller value, rows with an equal one) of rows sorted by (code, value), within the code."""
    first = np.ones(len(code), bool)
    first[1:] = code[1:] != code[:-1]
    group = first.copy()
    group[1:] |= value[1:] != value[:-1]
    starts, before = np.flatnonzero(group), np.cumsum(n) - n
    sizes = np.diff(np.append(starts, len(code)))
    ties = np.repeat(np.add.reduceat(n, starts), sizes)
    of_code = np.repeat(before[np.flatnonzero(first)], np.diff(np.append(np.flatnonzero(first), len(code))))
    return np.repeat(before[starts], sizes) - of_code, ties


def _array(table: pa.Table, name: str) -> np.ndarray:
    return np.array(table[name].combine_chunks().to_numpy(zero_copy_only=False))


def _whole_table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [batch for batch in batches if batch.num_rows]
    return pa.Table.from_batches(held) if held else None


def placed(rows: DataFrame, keys: Sequence[str], side: str, other: str, asked: str) -> DataFrame:
    """Adds ``<side>_before``, ``<side>_ties`` and what a partition adds to ``own``.

    A partition has rows (keys, a, p, n, ..) of some keys. They are ordered by side, falling by the other one, so that a
    row meets before it no row that shares a value and has a smaller other one. ``own`` grows by the rows of the key
    before it with a smaller ``asked``.
    """
    added = [f"{side}_before", f"{side}_ties"]
    kinds = StructType([*rows.drop("own").schema.fields, *StructType.fromDDL(f"{added[0]} long, {added[1]} long, own long").fields])
    carried = "own" in rows.columns

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole_table(batches)
        if table is None:
            return
        code = _codes(table, keys)
        order = np.lexsort((-_array(table, other), _array(table, side), code))
        table, code = table.take(pa.array(order)), code[order]
        n = _array(table, "n")
        before, ties = _tied(code, _array(table, side), n)
        # Falling codes: no row of an earlier key has a smaller rank.
        own = smaller_before(_dense(-code, _array(table, asked)), n) + (_array(table, "own") if carried else 0)
        found = table.drop_columns(["own"]) if carried else table
        for name, value in zip([*added, "own"], (before, ties, own), strict=True):
            found = found.append_column(name, pa.array(value, pa.int64()))
        yield from found.to_batches()

    return rows.mapInArrow(counted, kinds)


def whole_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank cells of rows (keys, a, p), all rows of a key in one partition."""
    kinds = StructType([*rows.schema.fields, *StructType.fromDDL("n long, total long, a_before long, a_ties long, p_before long, p_ties long, own long").fields])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole_table(batches)
        if table is None:
            return
        code, a, p = _codes(table, keys), _array(table, "a"), _array(table, "p")
        order = np.lexsort((-p, a, code))
        code, a, p = code[order], a[order], p[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (code[1:] != code[:-1]) | (a[1:] != a[:-1]) | (p[1:] != p[:-1])
        starts = np.flatnonzero(fresh)
        n = np.diff(np.append(starts, len(order)))
        table, code, a, p = table.take(pa.array(order[starts])), code[starts], a[starts], p[starts]
        a_before, a_ties = _tied(code, a, n)
        across = np.lexsort((p, code))
        p_before, p_ties = np.empty_like(n), np.empty_like(n)
        p_before[across], p_ties[across] = _tied(code[across], p[across], n[across])
        total = np.bincount(code, weights=n)[code].astype(np.int64)
        own = smaller_before(_dense(-code, p), n)
        for name, value in (("n", n), ("total", total), ("a_before", a_before), ("a_ties", a_ties), ("p_before", p_before), ("p_ties", p_ties), ("own", own)):
            table = table.append_column(name, pa.array(value, pa.int64()))
        yield from table.to_batches()

    return rows.mapInArrow(counted, kinds)


def grid_counts(grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``smaller`` to (keys, a_run, p_run, n): rows of the key in runs before on both sides; a key in one partition."""
    kinds = StructType([*grid.schema.fields, *StructType.fromDDL("smaller long").fields])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _whole_table(batches)
        if table is None:
            return
        code = _codes(table, keys)
        order = np.lexsort((-_array(table, "p_run"), _array(table, "a_run"), code))
        table, code = table.take(pa.array(order)), code[order]
        smaller = smaller_before(_dense(-code, _array(table, "p_run")), _array(table, "n"))
        yield from table.append_column("smaller", pa.array(smaller, pa.int64())).to_batches()

    return grid.mapInArrow(counted, kinds)
