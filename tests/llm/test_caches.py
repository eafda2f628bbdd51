"""What a worker remembers stays within its bytes."""

from __future__ import annotations

import random
import sys

import numpy as np
import pytest
import xxhash

from duebook.llm import caches, quality, tokens, words
from duebook.llm.caches import remembered
from duebook.llm.queries import tokenizer_file
from tests.llm.conftest import sentence


@pytest.fixture
def texts():
    rng = random.Random(5)
    return [sentence(rng, 400, 10**6) for _ in range(200)]


def test_one_memory_at_a_time():
    first = remembered("one", dict)
    assert remembered("one", dict) is first
    remembered("two", dict)
    assert list(caches._HELD) == ["two"] and remembered("one", dict) is not first


def test_word_hashes_are_the_library_s_and_none_is_remembered(texts):
    caches._HELD.clear()
    for text in [*texts, None, "", " É one\x0b東京 One"]:
        split = words.words_of(text)
        hashes = words.hashes_of(split)
        assert hashes.dtype == np.uint64 and hashes.tolist() == [xxhash.xxh3_64_intdigest(w) for w in split]
    assert not caches._HELD


def test_word_shapes_are_bounded(texts, monkeypatch):
    whole = [quality.passages_of(t) for t in texts]
    monkeypatch.setattr(quality, "CACHED_BYTES", 1 << 18)
    caches._HELD.clear()
    for text, passages in zip(texts, whole):
        assert np.array_equal(quality.passages_of(text), passages)
        table = remembered("word shapes", quality._Words)
        taken = sys.getsizeof(dict(table)) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in table.items())
        # What is left over is the last text's: it is never forgotten in the middle of one.
        assert taken + table.shapes.nbytes + table.cells.nbytes <= (1 << 18) + 2 * 400 * 500


@pytest.mark.parametrize("name, cut", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "space")])
def test_encoders_are_bounded(texts, monkeypatch, name, cut):
    whole = list(tokens.TextEncoder(tokenizer_file(name), cut).encode(texts))
    monkeypatch.setattr(tokens, "PART_BYTES", 1 << 14)
    monkeypatch.setattr(tokens, "BATCH_PARTS", 100)
    monkeypatch.setattr(tokens, "CHUNK_CHARS", 10_000)
    encoder = tokens.TextEncoder(tokenizer_file(name), cut)
    assert list(encoder.encode(texts)) == whole
    known = encoder._known
    assert 0 < known.bytes <= 1 << 14
    assert len(known.parts) == len(known.sizes) and known.sizes.sum() == len(known.flat)
    assert sum(x.nbytes for x in (known.parts, known.flat, known.sizes)) <= (1 << 14) + 64


def test_columns_leave_in_pieces(spark, odd, monkeypatch):
    """Rows of op1 cut into many small pieces give the same answer."""
    from duebook.llm import ngram_join

    whole = sorted(map(tuple, ngram_join.jaccard_join(odd).collect()), key=str)
    monkeypatch.setattr(ngram_join, "HELD_COLUMNS", 5)
    assert sorted(map(tuple, ngram_join.jaccard_join(odd).collect()), key=str) == whole
