"""Benchmark items in documents against comparing every window."""

from __future__ import annotations

import pickle
import random
from collections import Counter

import numpy as np
import pytest

from duebook.llm import decontamination
from duebook.llm.decontamination import CHAR_BYTES, ITEM_BYTES, RADIUS, ItemIndex, contaminated
from duebook.llm.words import words_of
from tests.llm.conftest import frame, odd_documents, sentence


def shingles(words):
    n = min(5, len(words))
    return Counter(tuple(words[i: i + n]) for i in range(len(words) - n + 1)) if n else Counter()


def similarity(a, b):
    both = sum((a & b).values())
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def plain(docs, items):
    out = []
    for doc_id, text in docs:
        words = words_of(text)
        for item_id, item in items:
            wanted = words_of(item)
            best = (0.0, 0)
            for first in range(max(0, len(words) - len(wanted)) + 1 if wanted and words else 0):
                score = similarity(shingles(words[first: first + len(wanted)]), shingles(wanted))
                if score >= 0.8 and score > best[0]:
                    best = (score, first)
            if best[0]:
                out.append((doc_id, item_id, best[1], min(len(words), len(wanted)), round(best[0], 9)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(21)
    return [(i, sentence(rng, rng.randrange(6, 60), 500)) for i in range(25)] + [
        (100, "alpha beta gamma"), (101, None), (102, ""), (103, "one"), (None, "p q r s t u v w"), (104, "z " * 12)]


def texts(items, seed=22):
    rng = random.Random(seed)
    rows = list(odd_documents())
    for i in range(200):
        words = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            if words:
                at = rng.randrange(len(words))
                words[at: at + rng.randrange(2)] = rng.choice([[], ["qq"], ["qq", "rr"]])
        around = [sentence(rng, rng.randrange(0, 30), 500) for _ in range(2)]
        rows.append((1000 + i, " ".join([around[0], *words, around[1]])))
    return rows


@pytest.mark.parametrize("block_chars", [8_000_000, 600])
def test_every_window_is_found(spark, items, block_chars):
    """Also where the benchmark goes out in many blocks."""
    docs = texts(items)
    got = contaminated(frame(spark, docs), frame(spark, items, "item_id long, text string"), block_chars=block_chars)
    found = sorted(((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9)) for r in got.collect()), key=str)
    assert found == plain(docs, items) and len(found) > 50


def test_few_items_at_a_time(spark, items):
    docs = texts(items)[:120]
    benchmark = frame(spark, items, "item_id long, text string")
    whole, parts = (sorted(map(tuple, contaminated(frame(spark, docs), benchmark, block_items=n).collect()), key=str)
                    for n in (100_000, 7))
    assert whole == parts and whole


def test_all_fingerprints_within_the_radius(monkeypatch):
    rng = random.Random(4)
    index = ItemIndex([(i, sentence(rng, 6 + i % 3, 300)) for i in range(600)])
    some = np.array([rng.getrandbits(64) for _ in range(40)], dtype=np.uint64)
    for step in (1_000_000, 100):
        monkeypatch.setattr(decontamination, "LOOKED_AT", step)
        for size in (6, 7, 8):
            expected = [(place, item) for place, fingerprint in enumerate(some.tolist())
                        for item in np.flatnonzero(index.sizes == size).tolist()
                        if (int(index.prints[item]) ^ fingerprint).bit_count() <= RADIUS]
            assert list(index.near(size, some)) == expected and expected


@pytest.mark.parametrize("count, words", [(50_000, 6), (500, 1500)])
def test_an_index_keeps_to_its_bytes(count, words):
    """What is broadcast is bounded by items and characters, also for many short items."""
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=words)) for _ in range(count)]
    index = ItemIndex(enumerate(texts))
    bound = ITEM_BYTES * count + CHAR_BYTES * sum(map(len, texts)) + 100_000
    assert index.nbytes() <= bound and len(pickle.dumps(index, protocol=5)) <= bound


def test_nothing_in_nothing(spark, odd, none, items):
    benchmark = frame(spark, items, "item_id long, text string")
    assert contaminated(none, benchmark).count() == 0
    assert contaminated(odd, benchmark.limit(0)).count() == 0
