import collections

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from strainframe.llm import piece_sampling

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.Pieces(MODEL)


def paths(pieces, word):
    """Every segmentation of a word into normal pieces with its weight."""
    if not word:
        return [((), 0.0)]
    out = []
    for piece in range(len(pieces.content)):
        text = pieces.content[piece]
        if text and word.startswith(text) and piece not in pieces.bytes_:
            out += [((piece, *rest), pieces.weight[piece] + more) for rest, more in paths(pieces, word[len(text) :])]
    return out


def test_draws_follow_the_exact_distribution(pieces):
    word, count = b" than", 100_000
    every = paths(pieces, word)
    total = np.logaddexp.reduce([weight for _, weight in every])
    lattice = piece_sampling.Lattice(pieces, [b" other", word])
    assert lattice.total[1] == pytest.approx(total)
    keys = piece_sampling.mix(np.arange(count, dtype=np.uint64) * piece_sampling._GOLDEN)
    drawn, sizes = lattice.draw(np.ones(count, np.int64), keys)
    ends = np.cumsum(sizes)
    seen = collections.Counter(tuple(drawn[b - n : b].tolist()) for b, n in zip(ends, sizes, strict=True))
    assert set(seen) <= {path for path, _ in every}
    for path, weight in every:
        share = np.exp(weight - total)
        assert abs(seen[path] / count - share) < 5 * np.sqrt(share * (1 - share) / count) + 1e-4


def test_high_alpha_takes_the_best_path(pieces):
    sharp = piece_sampling.Pieces(MODEL, alpha=60.0)
    word = b" thing"
    best = max(paths(pieces, word), key=lambda x: x[1])[0]
    drawn, _ = piece_sampling.Lattice(sharp, [word]).draw(np.zeros(1, np.int64), np.array([5], np.uint64))
    assert tuple(drawn.tolist()) == best


def test_lossless_and_reproducible(spark, awkward):
    encoded = piece_sampling.encode(awkward.repartition(4), MODEL)
    decoded = piece_sampling.decode(encoded, MODEL)
    assert decoded.filter(~F.col("text").eqNullSafe(F.col("decoded"))).count() == 0
    assert [r["pieces"] for r in decoded.filter("text is null").collect()] == [None]
    assert [r["pieces"] for r in decoded.filter("text = ''").collect()] == [[]]
    again = {(r["doc_id"], r["text"]): r["pieces"] for r in piece_sampling.encode(awkward.coalesce(1), MODEL).collect()}
    assert all(again[r["doc_id"], r["text"]] == r["pieces"] for r in encoded.collect())
    other = piece_sampling.encode(awkward.filter("doc_id = 7"), MODEL, seed=1).first()
    assert other["pieces"] != again[7, other["text"]]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert model.decode(again[1, "the cat sat on the mat and looked at the dog"]) == "the cat sat on the mat and looked at the dog"


def test_no_rows(spark, awkward):
    assert piece_sampling.decode(piece_sampling.encode(awkward.limit(0), MODEL), MODEL).count() == 0


def test_few_pieces_are_decoded_at_a_time(monkeypatch):
    """A task holds the bytes of few rows' pieces, and gives memory back when it ends (pipeline: piece sampling)."""
    pieces = piece_sampling.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["one two three", None, "", "four five six seven", "x"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5)), "text": pa.array(texts)})
    encoded = list(piece_sampling._encode_batches(iter([batch]), pieces, 0, 1, 3))
    calls = []
    monkeypatch.setattr(piece_sampling, "DECODED", 2)
    monkeypatch.setattr(piece_sampling, "give_back", lambda: calls.append(1))
    decoded = list(piece_sampling._decode_batches(iter(encoded), pieces.blob, pieces.offset, pieces.length, 2, "decoded"))
    assert [x for part in decoded for x in part.column("decoded").to_pylist()] == texts
    assert len(decoded) > len(encoded) and len(calls) == 1
