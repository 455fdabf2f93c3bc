"""Sampled SentencePiece segmentations: forward filtering, backward sampling over the piece lattice.

No piece of a model crosses from a word into the blank that starts the next one,
so the lattice of a text falls apart at those places and each word has a lattice
of its own. For the distinct words of a slice of rows the forward pass sums path
weights node by node; the backward pass then draws, for every occurrence, one
incoming edge at a time with its exact conditional probability. The draws are
hashes of (seed, row key, word number, step), so a row gets the same pieces in
any partitioning. Characters without a piece become byte pieces, so decoding
gives back every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainframe.llm.common import byte_slices, give_back, with_fields

#: Text bytes whose lattices are in memory at a time (a longer text is a slice of its own).
SLICE = 3 << 20
#: Bytes of distinct words whose lattices are built at a time.
LATTICE_BYTES = 200_000
#: Pieces that are decoded at a time.
DECODED = 1 << 18
#: Exponent on path weights: 0 draws uniformly over paths, large values approach the best path.
ALPHA = 1.0
SEED = 17

_BLANK = "▁"
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Byte strings and log weights of a model's pieces, and the trie over them as sorted (state, byte) keys."""

    def __init__(self, model_path: str, alpha: float = ALPHA):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.content = [b""] * size
        self.bytes_ = np.full(256, -1, np.int32)
        normal, whole = [], True
        for piece in range(size):
            text = model.id_to_piece(piece)
            if model.is_byte(piece):
                self.content[piece] = bytes([int(text[3:5], 16)])
                self.bytes_[self.content[piece][0]] = piece
            elif not (model.is_control(piece) or model.is_unknown(piece) or model.is_unused(piece)):
                self.content[piece] = text.replace(_BLANK, " ").encode()
                whole = whole and " " not in text.replace(_BLANK, " ").lstrip(" ")
                normal.append(piece)
        if (self.bytes_ < 0).any():
            raise ValueError("the model has no byte pieces, so it cannot encode every text")
        #: Whether a word always ends where the next blank begins.
        self.by_word = whole
        scores = np.array([model.get_score(piece) for piece in range(size)])
        order = sorted(normal, key=lambda piece: (-scores[piece], piece))
        weight = np.full(size, -np.log(2.0 + len(normal)))
        if len(normal) and np.array_equal(scores[normal], np.floor(scores[normal])):
            # Merge ranks: weights by rank, as frequencies of ranked words fall.
            weight[order] = -np.log(2.0 + np.arange(len(order)))
        else:
            weight[normal] = scores[normal]
            weight[self.bytes_] = scores[normal].min() - 10.0
        self.weight = alpha * weight
        self.single = {self.content[piece] for piece in normal if len(self.content[piece].decode()) == 1}
        states = {b"": 0}
        ends: list[int] = [-1]
        keys: list[tuple[int, int]] = []
        for piece in normal:
            text = self.content[piece]
            for n in range(1, len(text) + 1):
                if text[:n] not in states:
                    states[text[:n]] = len(ends)
                    ends.append(-1)
                    keys.append((states[text[: n - 1]] * 256 + text[n - 1], states[text[:n]]))
            ends[states[text]] = piece
        keys.sort()
        self.key = np.array([key for key, _ in keys], np.int64)
        self.next = np.array([state for _, state in keys], np.int64)
        self.end = np.array(ends, np.int64)
        self.blob = np.frombuffer(b"".join(self.content), np.uint8)
        self.length = np.array([len(x) for x in self.content], np.int64)
        self.offset = np.cumsum(self.length) - self.length

    def words(self, text: bytes) -> list[bytes]:
        """The text with its leading blank, cut before every blank that follows another character."""
        text = b" " + text
        return re.findall(rb" +[^ ]*", text) if self.by_word else [text]

    def edges(self, buffer: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of every piece at every byte; ``room``: bytes to the end of the word."""
        starts, lengths, pieces = [], [], []
        at, state, depth = np.arange(len(buffer)), np.zeros(len(buffer), np.int64), 0
        while len(at):
            wanted = state * 256 + buffer[at + depth]
            found = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[found] == wanted
            at, state, depth = at[hit], self.next[found[hit]], depth + 1
            piece = self.end[state]
            ends = piece >= 0
            starts.append(at[ends])
            lengths.append(np.full(int(ends.sum()), depth))
            pieces.append(piece[ends])
            more = room[at] > depth
            at, state = at[more], state[more]
        # Bytes of characters that are no piece.
        lead = np.flatnonzero((buffer & 0xC0) != 0x80)
        width = np.diff(np.append(lead, len(buffer)))
        alone = np.zeros(len(buffer), bool)
        one = np.concatenate([s[k == 1] for s, k in zip(starts, lengths, strict=True)]) if starts else np.empty(0, np.int64)
        alone[one] = True
        wide = np.flatnonzero(width > 1)
        for n in np.unique(width[wide]):
            for place in lead[wide[width[wide] == n]]:
                alone[place] = buffer[place : place + n].tobytes() in self.single
        spelt = np.flatnonzero(np.repeat(~alone[lead], width)) + (lead[0] if len(lead) else 0)
        return (
            np.concatenate([*starts, spelt]),
            np.concatenate([*lengths, np.ones(len(spelt), np.int64)]),
            np.concatenate([*pieces, self.bytes_[buffer[spelt]].astype(np.int64)]),
        )


def mix(values: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Lattice:
    """Lattices of distinct words: nodes are byte places, one more than bytes for each word."""

    def __init__(self, pieces: Pieces, words: list[bytes]):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        buffer = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(buffer)) - begin[word]
        start, length, piece = pieces.edges(buffer, sizes[word] - place)
        self.first = begin + np.arange(len(words))
        self.last = self.first + sizes
        source = start + word[start]
        target = source + length
        order = np.lexsort((source, target, place[start] + length))
        source, target, piece = source[order], target[order], piece[order]
        step = place[start[order]] + length[order]
        total = np.full(len(buffer) + len(words), -np.inf)
        total[self.first] = 0.0
        weight = pieces.weight[piece]
        cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.empty(0, np.int64)
        steps = np.searchsorted(step[cuts], np.arange(1, (int(step[-1]) if len(step) else 0) + 2))
        borders = np.append(cuts, len(target))
        for low, high in zip(steps, steps[1:], strict=False):
            if low < high:
                a, b = borders[low], borders[high]
                total[target[cuts[low:high]]] = np.logaddexp.reduceat(total[source[a:b]] + weight[a:b], cuts[low:high] - a)
        #: log of the summed weight of all paths of each word
        self.total = total[self.last]
        order = np.argsort(target, kind="stable")
        self.source, self.piece, target = source[order], piece[order], target[order]
        with np.errstate(invalid="ignore"):
            share = np.exp(total[self.source] + weight[order] - total[target])
        share = np.nan_to_num(share)
        run = np.cumsum(share)
        cuts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else np.empty(0, np.int64)
        counts = np.diff(np.append(cuts, len(target)))
        run -= np.repeat(run[cuts] - share[cuts], counts)
        run = np.minimum(run / np.repeat(run[cuts + counts - 1], counts), 1.0)
        run[cuts + counts - 1] = 1.0
        # Upper ends of the edges' shares, after the node's number: one sorted array for all nodes.
        self.upper = target + run

    def draw(self, words: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces in order, number of pieces) for occurrences of words with one random key each."""
        node, active = self.last[words], np.arange(len(words))
        count = np.zeros(len(words), np.int64)
        drawn = []
        state = keys.copy()
        active = active[self.last[words] > self.first[words]]
        while len(active):
            state[active] += _GOLDEN
            chance = (mix(state[active]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = np.searchsorted(self.upper, node[active] + chance, side="right")
            drawn.append((active, self.piece[edge]))
            count[active] += 1
            node[active] = self.source[edge]
            active = active[node[active] > self.first[words[active]]]
        last = np.cumsum(count) - 1
        out = np.empty(int(count.sum()), np.int32)
        for step, (who, piece) in enumerate(drawn):
            out[last[who] - step] = piece
        return out, count


def row_keys(ids: list, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(str(x).encode(), seed) for x in ids), np.uint64, len(ids))


def sample_slice(pieces: Pieces, texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all pieces, pieces of each text) of a slice of texts; an empty text has none."""
    number: dict[bytes, int] = {}
    seen, sizes = [], []
    for text in texts:
        words = pieces.words(text) if text else []
        sizes.append(len(words))
        seen += [number.setdefault(word, len(number)) for word in words]
    if not seen:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    sizes, seen = np.array(sizes), np.array(seen, np.int32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(seen)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys = mix(keys[owner] + mix((place.astype(np.uint64) + np.uint64(1)) * _GOLDEN))
    # Lattices of some of the distinct words at a time; their occurrences are drawn and put in their places.
    words = list(number)
    order = np.argsort(seen, kind="stable")
    block = np.cumsum([len(word) for word in words]) // LATTICE_BYTES
    starts = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(words))
    parts, count = [], np.empty(len(seen), np.int64)
    cuts = np.searchsorted(seen[order], starts)
    for low, high, a, b in zip(starts, starts[1:], cuts, cuts[1:], strict=False):
        who = order[a:b]
        drawn, count[who] = Lattice(pieces, words[low:high]).draw(seen[who] - low, keys[who])
        parts.append((who, drawn))
    begin = np.cumsum(count) - count
    chosen = np.empty(int(count.sum()), np.int32)
    for who, drawn in parts:
        own = count[who]
        chosen[np.repeat(begin[who] - np.cumsum(own) + own, own) + np.arange(len(drawn))] = drawn
    return chosen, np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)


def _encode_batches(batches: Iterator[pa.RecordBatch], pieces: Pieces, id_: int, text: int, seed: int) -> Iterator[pa.RecordBatch]:
    give_back()  # what earlier stages left in this worker
    for batch in batches:
        for first, texts in byte_slices(batch, text, SLICE):
            part = batch.slice(first, len(texts))
            chosen, sizes = sample_slice(pieces, [x or b"" for x in texts], row_keys(part.column(id_).to_pylist(), seed))
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            missing = pa.array([x is None for x in texts])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chosen, pa.int32()), mask=missing)
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "pieces"])
    give_back()


def encode(
    docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", alpha: float = ALPHA, seed: int = SEED
) -> DataFrame:
    """Documents with ``pieces``, a segmentation drawn for each row by its key.

    A null text has null pieces, an empty one none. Rows with the same key and text
    get the same pieces. A column named ``pieces`` is replaced, all others stay.
    """
    docs = docs.drop(*[name for name in docs.columns if name.lower() == "pieces"])
    step = partial(
        _encode_batches, pieces=Pieces(model_path, alpha), id_=docs.columns.index(id_column), text=docs.columns.index(text_column), seed=seed
    )
    return docs.mapInArrow(step, with_fields(docs, "pieces array<int>"))


def decode_slice(blob: np.ndarray, offset: np.ndarray, length: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """The bytes of a run of pieces."""
    sizes = length[pieces]
    ends = np.cumsum(sizes)
    shift = np.repeat((offset[pieces] - ends + sizes).astype(np.int32), sizes)
    return blob[shift + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]


def _decode_batches(batches: Iterator[pa.RecordBatch], blob, offset, length, column: int, name: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(column)
        first = 0
        while first < batch.num_rows:
            # Rows of about that many pieces at a time.
            limit = lists.offsets[first].as_py() + DECODED
            last = int(np.searchsorted(lists.offsets.to_numpy(), limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            part = batch.slice(first, last - first)
            some = part.column(column)
            borders = some.offsets.to_numpy().astype(np.int64)
            ids = some.values.to_numpy()[borders[0] : borders[-1]]
            plain = decode_slice(blob, offset, length, ids).tobytes()
            ends = np.concatenate(([0], np.cumsum(length[ids])))[borders - borders[0]].tolist()
            texts = [None if gone else plain[a + 1 : b] for a, b, gone in zip(ends, ends[1:], some.is_null().to_pylist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, name])
            first = last
    give_back()


def decode(encoded: DataFrame, model_path: str, pieces_column: str = "pieces", name: str = "decoded") -> DataFrame:
    """Rows with the text of their pieces in a new column; null pieces give a null text."""
    pieces = Pieces(model_path)
    encoded = encoded.drop(*[column for column in encoded.columns if column.lower() == name.lower()])
    step = partial(
        _decode_batches, blob=pieces.blob, offset=pieces.offset, length=pieces.length, column=encoded.columns.index(pieces_column), name=name
    )
    return encoded.mapInArrow(step, with_fields(encoded, f"{name} string"))
