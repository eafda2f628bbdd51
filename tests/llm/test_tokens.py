"""Token ids, their files and the packing of sequences."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from duebook.llm import token_files
from duebook.llm.common import new_folder
from duebook.llm.packing import CAPACITY, cuts, differencing, pack_documents, pack_pieces
from duebook.llm.queries import tokenizer_file
from duebook.llm.token_files import pack_blocks, read_segments, read_token_files, unpack_blocks, write_segment, write_token_files
from duebook.llm.tokens import TextEncoder, encoder as encoder_of
from tests.llm.conftest import odd_documents

FILES = {"word": "word_bpe_49k.json", "space": "byte_bpe_50k.json"}


@pytest.fixture(scope="module", params=sorted(FILES))
def encoder(request):
    return TextEncoder(tokenizer_file(FILES[request.param]), request.param)


def plain(encoder, texts):
    done = encoder._tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(d.ids, dtype="<u4").tobytes() for d in done]


ALPHABET = list("aAbZéÉñßΣσİı'’.,!?;:|_-() \n\t\r\x0b\x1c\x85\xa0　​019²½中") + [
    "'s", "'ll", "<|endoftext|>", "  ", " the", "é", "क़", "ing."]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join))
def test_cutting_keeps_the_ids(encoder, text):
    assert list(encoder.encode([text])) == plain(encoder, [text])


@lru_cache
def fresh_tokenizer(cut):
    return Tokenizer.from_file(tokenizer_file(FILES[cut]))


@pytest.mark.parametrize("cut, ends", [("word", {49406, 49407}), ("space", {50256})])
@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(
    ALPHABET + ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>"]), max_size=15).map("".join), max_size=4))
@example(texts=["a <|endoftext|>  b<|startoftext|>", "<|endoftext|><|endoftext|>", "plain", "é<|endoftext|>\u0301 "])
def test_added_tokens_are_one_id(cut, ends, texts):
    """Against a tokenizer as the library loads it."""
    fresh = fresh_tokenizer(cut)
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder_of(tokenizer_file(FILES[cut]), cut).encode(texts)]
    assert got == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    if texts[2:3] == ["plain"]:
        assert ends <= set(got[0])


def test_a_full_memory_keeps_the_ids(encoder, monkeypatch):
    monkeypatch.setattr("duebook.llm.tokens.PART_BYTES", 60)
    monkeypatch.setattr("duebook.llm.tokens.CHUNK_CHARS", 50)
    texts = [t for _, t in odd_documents()]
    assert list(encoder.encode(texts)) == plain(encoder, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET + list("#$%&*+/<=>@[\\]^`{}~\"") + ["###", "\u0338", "\u0301", "<|ENDOFTEXT|>", "\x0b", "\x0c", "\x1f"]),
                max_size=30).map("".join))
@example("<\u0338a=\u0338b'#s$'s é#\u0301e`\u0300a^b~")
def test_every_mark_keeps_the_ids(encoder, text):
    assert list(encoder.encode([text])) == plain(encoder, [text])


def test_a_word_is_one_part_whatever_marks_it_has(encoder):
    """Before, each of these words was a part of its own."""
    fresh = TextEncoder(tokenizer_file(FILES["word"]), "word")
    list(fresh.encode(["abcde### abcde$$$ abcde%%%", "(abcde) abcde&&& *abcde*"]))
    assert [p for p in fresh._known.parts.to_pylist() if "abcde" in p] == ["abcde"]


def test_many_parts_are_one_string_for_the_library(encoder):
    """Before, each part was a string of its own."""
    class Counting:
        def __init__(self, of):
            self.of, self.given = of, 0

        def encode_batch_fast(self, texts, **how):
            self.given += len(texts)
            return self.of.encode_batch_fast(texts, **how)

    texts = [" ".join(f"w{i}x" for i in range(1000))]
    wanted, real = plain(encoder, texts), encoder._tokenizer
    encoder._tokenizer = counting = Counting(real)
    try:
        assert list(encoder.encode(texts)) == wanted
    finally:
        encoder._tokenizer = real
    assert 0 < counting.given < 100


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=900))
def test_blocks_round_trip(values):
    ids = np.array(values, dtype=np.uint32)
    starts, body = pack_blocks(ids)
    assert (unpack_blocks(body, starts, len(ids)) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(token_files.BLOCK, 1000, dtype=np.uint32)
    ids[::2] += 3
    narrow = len(pack_blocks(ids)[1])
    ids[5] = 2**31
    assert len(pack_blocks(ids)[1]) == narrow + 5  # one position and one value


def test_segments_round_trip():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 1, 700)]
    content = write_segment([None, -5, 2**40], ids) + b"\n" + write_segment([7], ids[:1]) + b"\n"
    got = [(d, x.astype("<u4").tobytes()) for names, xs in read_segments(content) for d, x in zip(names, xs)]
    assert got == [(None, ids[0]), (-5, ids[1]), (2**40, ids[2]), (7, ids[0])]


def test_token_files(spark, odd, none, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 300)
    encoder = TextEncoder(tokenizer_file(FILES["word"]), "word")
    path = new_folder(spark, "test-tokens")
    write_token_files(odd, path, tokenizer_file(FILES["word"]), end_id=2)
    got = read_token_files(spark, path, with_ids=True).orderBy("start").collect()
    end = np.array([2], dtype="<u4").tobytes()
    docs = sorted(odd_documents(), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in docs]
    raw = {}
    for (d, t), x in zip(docs, plain(encoder, [t for _, t in docs])):
        raw.setdefault(d, []).append(x + end)
    at = 0
    for r in got:
        ids = np.array(r.ids, dtype="<u4").tobytes()
        raw[r.doc_id].remove(ids)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(ids))
        at += r.n_tokens
    empty = new_folder(spark, "test-tokens")
    write_token_files(none, empty, tokenizer_file(FILES["word"]), end_id=2)
    assert read_token_files(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 300), min_size=1, max_size=60), st.integers(1, 12))
def test_differencing_puts_each_item_in_a_window(sizes, windows):
    own, loads = differencing(np.array(sizes), windows)
    assert (np.bincount(own, weights=sizes, minlength=len(loads))[: len(loads)] == loads).all()
    assert len(loads) <= windows and own.min() >= 0


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 256, 2000)
    _, loads = differencing(sizes, 100)
    assert loads.max() - loads.min() <= 2


def test_windows_rise_until_nothing_exceeds_the_capacity():
    assert len(set(pack_pieces(np.array([6, 6, 6]), 10).tolist())) == 3  # two would do by the sum
    assert pack_pieces(np.array([], dtype=np.int64), 10).tolist() == []


@pytest.mark.parametrize("tokens", [1, 255, 256, 257, 1024, 1025, 5000])
def test_cuts_cover_a_document(tokens):
    at = cuts(tokens, 1024, 256)
    sizes = np.diff(at)
    assert at[0] == 0 and at[-1] == tokens and sizes.min() > 0
    assert all(s == 1024 or s <= 256 for s in sizes.tolist())


def test_packing(spark, odd, none):
    encoder = TextEncoder(tokenizer_file(FILES["space"]), "space")
    got = pack_documents(odd, tokenizer_file(FILES["space"]), end_id=0, with_ids=True).toPandas()
    for _, piece in got.iterrows():
        ids = np.array(piece["ids"], dtype="<u4")
        assert len(ids) == piece["length"] and zlib.crc32(ids.tobytes()) == piece["ids_crc32"]
    docs = odd_documents()
    end = np.array([0], dtype="<u4").tobytes()
    wanted = sorted(((d is None, d or 0), x + end) for (d, _), x in zip(docs, plain(encoder, [t for _, t in docs])))
    unique = {k for k, _ in wanted if sum(k == o for o, _ in wanted) == 1}
    joined = {}
    for _, piece in got.sort_values("start").iterrows():
        missing = bool(np.isnan(piece["doc_id"]))
        k = (missing, 0 if missing else int(piece["doc_id"]))
        joined[k] = joined.get(k, b"") + np.array(piece["ids"], dtype="<u4").tobytes()
    assert {k: joined[k] for k in unique} == {k: x for k, x in wanted if k in unique}
    assert got["length"].sum() == sum(len(x) // 4 for _, x in wanted)
    ordered = got.sort_values(["sequence_id", "offset"])
    loads = ordered.groupby("sequence_id")["length"]
    assert (loads.cumsum() - ordered["length"] == ordered["offset"]).all()
    assert loads.sum().max() <= CAPACITY
    assert 1 - got["length"].sum() / (CAPACITY * got["sequence_id"].nunique()) < 0.05
    assert pack_documents(none, tokenizer_file(FILES["space"]), end_id=0).count() == 0


def test_packing_holds_few_texts_at_a_time(spark, monkeypatch):
    """Before, a worker encoded 4,000,000 characters together and loaded pandas."""
    plan = pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"),
                          tokenizer_file(FILES["space"]), end_id=0)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Pandas" not in plan
    fresh, given = TextEncoder(tokenizer_file(FILES["space"]), "space"), []
    encoded = fresh._encoded
    monkeypatch.setattr(fresh, "_encoded", lambda texts: given.append(len(texts)) or encoded(texts))
    texts = ["some words"] * 25
    assert list(fresh.encode(texts, 100)) == plain(fresh, texts) and max(given) == 11
