import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strainframe.llm import token_files
from strainframe.session import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize(("size", "top"), [(0, 0), (1, 0), (1, 99), (5, 3), (1000, 10**6), (3000, 3000), (600, 2**61)])
def test_elias_fano(size, top):
    values = np.sort(np.random.default_rng(size).integers(0, top + 1, size))
    parts = token_files.EliasFano.encode(values, top)
    read = token_files.EliasFano(size, top, *parts)
    assert (read.select_many(0, size) == values).all()
    for first, count in ((0, size // 2), (size // 3, size // 3), (size - size // 5, size // 5), (min(size, 256), max(0, min(size - 256, 256)))):
        assert (read.select_many(first, count) == values[first : first + count]).all()
    assert all(read.search(int(values[n])) == np.searchsorted(values, values[n]) for n in range(0, size, 37))
    assert read.search(top + 1) == size
    assert all(read.select(n) == values[n] for n in range(0, size, 11))
    if size >= 600:
        assert 8 * (len(parts[0]) + len(parts[1])) <= size * (2 + np.log2(max(top / size, 1)) + 1) + 64


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    dice = random.Random(5)
    letters = [*"ab'stmedlv19.,!? \n\té´Σσ<|>́\xa0　ß字—", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL"]
    texts = ["".join(dice.choices(letters, k=dice.randint(0, 40))) for _ in range(1500)]
    encoder = token_files.TextEncoder(public_tokenizers.path(name), 2)
    flat, sizes = encoder.encode([text.encode() for text in texts])
    expected = [found.ids + [2] for found in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(x) for x in expected] and flat.tolist() == [x for ids in expected for x in ids]


@pytest.mark.parametrize("small", [False, True])
def test_round_trip(spark, awkward, monkeypatch, small):
    if small:
        monkeypatch.setattr(token_files, "SEGMENT_IDS", 40)
        monkeypatch.setattr(token_files, "SEGMENT_DOCS", 2)
    path = scratch_path(spark)
    token_files.write_token_files(awkward.repartition(3), path, PATH)
    rows = token_files.read_token_files(spark, path).collect()
    tokenizer = Tokenizer.from_file(PATH)
    source = sorted(((r["doc_id"], r["text"] or "") for r in awkward.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for (doc, text), row in zip(source, sorted(rows, key=lambda r: r["start"]), strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (doc, start, len(ids), ids)
        start += len(ids)
    digests = {r["start"]: r["ids_crc32"] for r in token_files.read_token_files(spark, path, digest=True).collect()}
    assert digests == {r["start"]: zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in rows}


@pytest.mark.parametrize("small", [False, True])
def test_chosen_documents(spark, awkward, monkeypatch, small):
    if small:
        monkeypatch.setattr(token_files, "SEGMENT_DOCS", 2)
    path = scratch_path(spark)
    token_files.write_token_files(awkward.repartition(3), path, PATH)
    every = token_files.read_token_files(spark, path).collect()
    found = token_files.read_documents(spark, path, [2, 7, 5, 999, -3]).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in found) == sorted((r["doc_id"], r["ids"]) for r in every if r["doc_id"] in (2, 7, 5))
    assert token_files.read_documents(spark, path, []).count() == 0


def test_no_rows(spark, awkward):
    path = scratch_path(spark)
    token_files.write_token_files(awkward.limit(0), path, PATH)
    assert token_files.read_token_files(spark, path).count() == 0
