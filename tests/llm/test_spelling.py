"""Spelling variants against a plain version that compares all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duebook.llm import spelling
from tests.llm.conftest import frame


def plain_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def plain(rows):
    words, forms, result = plain_words(rows), {}, []
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= 5 * n else None, len(near)
    for w, n in words.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        result.append((w, forms[w][0], root, n, forms[w][1], words[forms[w][0]] if forms[w][0] else None))
    return sorted(result)


def found(spark, rows):
    got = spelling.spelling_variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in got.collect())


def variants(seed=1):
    """Words with misspellings of misspellings, in texts with every kind of row."""
    rng = random.Random(seed)
    letters = "abcdeéß×"
    rows = [(None, "Nonsense nonsense"), (None, None), (1, None), (2, ""), (3, " 東京 nonsense nonsensé Nonsense, nonsense"),
            (4, "wordĀnonsense " * 7), (4, "wordĀnonsense " * 7), (5, "nonsense " * 3000), (6, "Ünsense ünsense")]
    for key in range(10, 70):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 9)))
        words = [base] * rng.choice([5, 40, 200])
        for _ in range(6):
            at, kind = rng.randrange(len(base) + 1), rng.randrange(3)
            base = base[:at] + ("" if kind == 0 else rng.choice(letters)) + base[at + (kind != 2):]
            words += [base] * rng.choice([1, 5, 8, 30])
        rows.append((key, " ".join(words)))
    return rows


def test_as_by_comparing_all(spark):
    rows = variants()
    want = plain(rows)
    assert found(spark, rows) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[2] not in (w[0], w[1]) for w in want)


def test_long_grams(spark, monkeypatch):
    """With every gram in the dictionary all grams are as long as they may be."""
    monkeypatch.setattr(spelling, "GRAM_SHARE", -1.0)
    rows = variants(2)
    assert found(spark, rows) == plain(rows)


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "seldom")]) == []


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=6, max_size=9), st.integers(0, 9), st.sampled_from("abc"), st.integers(0, 2),
       st.frozensets(st.text("abc$", min_size=2, max_size=3)))
def test_words_with_one_edit_share_a_list(word, at, letter, kind, dictionary):
    at = min(at, len(word) - 1)
    other = word[:at] + ("" if kind == 0 else letter) + word[at + (kind != 2):]
    if len(other) < spelling.LEAST_LENGTH or other == word:
        return
    a, b = (word, other) if len(word) >= len(other) else (other, word)
    loses, gains = spelling.lists_of(a, dictionary)[0], spelling.lists_of(b, dictionary)[len(a) > len(b)]
    assert loses & gains


def test_an_edit_affects_only_grams_that_hold_it():
    dictionary = frozenset(("th", "thi", "in", "ng$"))
    kept = {"thingy"[s:e] for s, e in spelling.grams_of("thingy", dictionary) if s > 2}
    assert kept <= {"thongy"[s:e] for s, e in spelling.grams_of("thongy", dictionary)}


@pytest.mark.parametrize("share", [1 / 800, 1 / 3])
def test_the_dictionary_is_bounded(spark, monkeypatch, share):
    monkeypatch.setattr(spelling, "GRAM_SHARE", share)
    rng = random.Random(3)
    words = spark.createDataFrame([("".join(rng.choice("abcdefghij") for _ in range(8)), 5) for _ in range(3000)],
                                  "word string, n long")
    assert len(spelling.frequent_grams(words)) <= 2 / share
