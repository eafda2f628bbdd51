"""Exact copies, near copies and repeated strings against plain versions of the same."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time

import numpy as np
import pytest

from duebook.llm import common, ngram_join, suffix_dedup
from duebook.llm.components import components
from duebook.llm.exact_dedup import exact_dedup
from duebook.llm.ngram_join import jaccard_join
from duebook.llm.suffix_dedup import remove_repeats
from duebook.llm.words import words_of
from tests.llm.conftest import frame, odd_documents, sentence


def key(row):
    return tuple((v is None, str(v)) for v in row)


def same(rows, wanted):
    assert sorted(map(tuple, rows), key=key) == sorted(wanted, key=key)


def test_exact_dedup(odd):
    groups = {}
    for doc_id, text in odd_documents():
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups.setdefault(norm, []).append((-len(text or ""), doc_id is not None, doc_id or 0, doc_id))
    wanted = []
    for norm, rows in groups.items():
        keep = min(rows)[3]
        wanted += [(r[3], keep, len(rows), r[3] == keep, hashlib.sha256(norm.encode()).hexdigest()) for r in rows]
    same(exact_dedup(odd).collect(), wanted)


def test_exact_dedup_sorts_by_content_with_one_exchange_of_the_text(spark, odd, capsys):
    exact_dedup(odd).explain()
    assert "Python" not in capsys.readouterr().out


def test_a_hot_group_of_copies_is_one_group(spark):
    rows = [(i, "the same text") for i in range(3000)] + [(3000 + i, f"other {i}") for i in range(100)]
    got = exact_dedup(frame(spark, rows)).where("group_size > 1").collect()
    assert len(got) == 3000 and {r.keep_id for r in got} == {0} and {r.group_size for r in got} == {3000}


def test_only_the_result_of_a_jaccard_join_is_kept(spark, odd, tmp_path, monkeypatch):
    """Before, the sets, the entries of the matrix, the texts of pairs and the edges stayed."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    got = jaccard_join(odd)
    assert {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)} == {"components"}
    same(got.collect(), jaccard(odd_documents()))


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_the_shuffles_of_a_stored_table_are_dropped(spark, tmp_path, monkeypatch):
    """Before, they stayed until the driver collected its garbage."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    before = shuffles(spark)
    setting = spark.conf.get(common._CLEANUP, "false")
    assert common.stored(spark.range(1000).repartition(4, "id").groupBy("id").count(), "test").count() == 1000
    assert spark.conf.get(common._CLEANUP, "false") == setting
    until = time.time() + 10
    while len(shuffles(spark) - before) > 1 and time.time() < until:  # files go in the background
        time.sleep(0.1)
    assert len(shuffles(spark) - before) <= 1  # that of the count


def jaccard(docs, size=5):
    sets = []
    for doc_id, text in docs:
        words = words_of(text)
        n = min(size, len(words))
        sets.append((doc_id, {tuple(words[i: i + n]) for i in range(len(words) - n + 1)} if n else set()))
    label = {d: d for d, _ in sets if d is not None}

    def top(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((top(a), top(b)))
                label[high] = low
    return [(d, len(s), None if d is None else top(d)) for d, s in sets]


def test_jaccard_join(odd):
    same(jaccard_join(odd).collect(), jaccard(odd_documents()))


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_jaccard_join_at_the_border(spark, rounds):
    """Chains of near copies whose similarities lie around the threshold."""
    rng = random.Random(5)
    rows, last = [], sentence(rng, 60, 300).split()
    for i in range(90):
        if i % 15 == 0:
            last = sentence(rng, rng.randrange(5, 80), 300).split()
        last = list(last)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            last[rng.randrange(len(last))] = f"y{rng.randrange(50)}"
        if rng.random() < 0.3:
            last = last[: max(1, len(last) - rng.randrange(4))]
        rows.append((1000 - i, " ".join(last)))
    same(jaccard_join(frame(spark, rows), rounds=rounds).collect(), jaccard(rows))


def test_hot_columns_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_COLUMN", 3)
    rng = random.Random(6)
    shared = sentence(rng, 60)
    rows = [(i, shared + " " + sentence(rng, rng.randrange(0, 12))) for i in range(60)]
    same(jaccard_join(frame(spark, rows)).collect(), jaccard(rows))


def test_rows_of_one_id_are_one_document(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "p q r s t u"), (3, "p q r s t u")]
    assert {r.component_id for r in jaccard_join(frame(spark, rows)).collect()} == {1}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 201)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(101)}, 200: 200, 201: 200}


def repeats(docs, width, keep_first=False):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is None, docs[i][0] or 0))
    count, first = {}, {}
    for i in order:
        raw = (docs[i][1] or "").encode()
        for s in range(len(raw) - width + 1):
            window = raw[s: s + width]
            count[window] = count.get(window, 0) + 1
            first.setdefault(window, (i, s))
    out = []
    for i, (doc_id, text) in enumerate(docs):
        raw = (text or "").encode()
        marks = np.zeros(len(raw), bool)
        for s in range(len(raw) - width + 1):
            window = raw[s: s + width]
            if count[window] > 1 and not (keep_first and first[window] == (i, s)):
                marks[s: s + width] = True
        spans = int((np.diff(np.concatenate([[0], marks.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~marks])
        out.append((doc_id, len(raw), int(marks.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("block_segments, block_bytes", [(4000, 100_000), (2, 100_000), (4000, 250)])
def test_remove_repeats(spark, odd, block_segments, block_bytes):
    """Also where every name has too many segments, or bytes, for a block."""
    got = remove_repeats(odd, block_segments=block_segments, block_bytes=block_bytes).drop("spans").collect()
    same(got, repeats(odd_documents(), 200))


def test_remove_repeats_but_the_first(spark):
    rows = [r for r in odd_documents() if r[0] is not None and r[0] != 6]
    got = remove_repeats(frame(spark, rows), keep_first=True).drop("spans").collect()
    same(got, repeats(rows, 200, keep_first=True))


def test_periodic_texts(spark):
    rows = [(1, "De " * 67), (2, "De " * 68), (3, "ab" * 101), (4, "abc" * 67 + "z"), (5, "x" * 199), (6, "x" * 200),
            (7, "y" * 201)]
    same(remove_repeats(frame(spark, rows)).drop("spans").collect(), repeats(rows, 200))


def test_windows_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 300)
    raw = sentence(random.Random(8), 400).encode()
    names = [n for part in suffix_dedup.segments(raw) for n in zip(*part)]
    assert [(f, l) for _, f, l, _ in names][0][0] == 0 and names[-1][2] == len(raw) - 200
    assert all(a[2] + 1 == b[1] for a, b in zip(names, names[1:]))


def test_suffix_ranks_are_the_order_of_suffixes():
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(600))
    starts = np.arange(len(data) - 200 + 1)
    ranks = suffix_dedup.suffix_ranks(np.frombuffer(data, np.uint8), 200, starts)
    order = sorted(starts.tolist(), key=lambda s: data[s: s + 200])
    assert [ranks[s] for s in order] == sorted(ranks.tolist())


@pytest.mark.parametrize("width", [3, 12, 200])
def test_longest_previous_factors(width):
    rng = random.Random(width)
    for size, letters in [(width, b"a"), (700, b"a"), (700, b"ab"), (700, b"abcdefgh"), (700, bytes(range(256)))]:
        data = bytes(rng.choice(letters) for _ in range(size))
        if size > 600:
            data = data[:300] + data[40:290] + data[:150]
        starts = np.array(sorted(rng.sample(range(len(data) - width + 1), min(150, len(data) - width + 1))))
        lengths, sources = suffix_dedup.longest_previous_factors(np.frombuffer(data, np.uint8), width, starts)
        for i, s in enumerate(starts.tolist()):
            def common(j):
                t = starts[j]
                return next((k for k in range(width) if data[s + k] != data[t + k]), width)

            assert lengths[i] == max(map(common, range(i)), default=0)
            assert sources[i] == -1 if not lengths[i] else sources[i] < i and common(sources[i]) == lengths[i]


def test_texts_named_together_are_named_as_alone():
    rng = random.Random(10)
    raws = [sentence(rng, rng.randrange(30, 90), 50).encode() for _ in range(40)] + [b"x" * 700, b"x" * 300, b"ab" * 200]
    raws = [r for r in raws if len(r) >= 200]
    expand = lambda n, a, b: {(s, int(n)) for s in range(a, b + 1)}
    alone = [set().union(*(expand(n, a, b) for part in suffix_dedup.segments(r) for n, a, b, _ in zip(*part)))
             for r in raws]
    got = [set() for _ in raws]
    for part in suffix_dedup.together(raws):
        for text, name, first, last, _ in zip(*part):
            got[text] |= expand(name, first, last)
    assert got == alone


def test_empty_tables(none):
    assert exact_dedup(none).count() == jaccard_join(none).count() == remove_repeats(none).count() == 0
