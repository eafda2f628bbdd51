"""Classifiers by their held-out accuracy, the language model by a plain version of itself."""

from __future__ import annotations

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from duebook.llm import common, queries, suffix_lm
from duebook.llm.quality import FEATURES, PASSAGE_WORDS, QualityModel, _gradients, fit, fit_quality, passages_of, score_quality
from duebook.llm.suffix_lm import score_texts
from duebook.llm.toxicity import cells_of, fit_toxicity, score_toxicity
from duebook.llm.words import words_of
from tests.llm.conftest import frame, odd_documents, sentence

LARGER = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    ones = labels == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("name, label", [("op2_toxicity", "toxic"), ("op4_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = queries.queries()[name](spark, LARGER).where("held_out").join(labels, "doc_id").toPandas()
    assert len(rows) > 200
    assert auc(rows["score"].to_numpy(), rows[label].to_numpy()) > 0.94
    assert (rows["predicted"] == rows[label]).mean() > 0.96


@pytest.mark.parametrize("fitted, scored, label", [
    (fit_toxicity, score_toxicity, "toxic"), (fit_quality, score_quality, "quality")])
def test_odd_documents_are_scored(spark, odd, none, fitted, scored, label):
    labels = spark.createDataFrame(
        [(i, i % 2, 9) for i in range(10, 40)] + [(10, 0, 9), (None, 1, 9), (11, None, 9), (12, 7, 9)],
        f"doc_id long, {label} int, score int")
    model = fitted(odd, labels, F.col("doc_id") > 12)
    got = scored(odd, model).collect()
    assert len(got) == len(odd_documents())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert scored(none, model).count() == 0
    for part in (labels.where(f"{label} = 1"), labels.limit(0)):  # one class, none
        model = fitted(odd, part, F.lit(True))
        assert len({r.score for r in scored(odd, model).collect()}) == 1


def test_cells_are_of_lower_case_bytes():
    assert (cells_of("IDIOT") == cells_of("idiot")).all()
    assert len(cells_of("abcd")) == 0 and len(cells_of("abcde")) == 1 and len(cells_of(None)) == 0


def test_every_word_is_in_a_passage():
    rng = random.Random(1)
    assert len(passages_of(sentence(rng, 10 * PASSAGE_WORDS + 1))) == 11
    assert passages_of(None).shape == passages_of(" ").shape == (1, FEATURES)


def test_attention_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(n, FEATURES)) for n in (1, 3, 5)]
    labels = np.array([0, 1, 1])
    model = fit(bags, labels, 0.6)
    flat, starts = np.concatenate(bags), np.array([0, 1, 4])

    def loss(m: QualityModel) -> float:
        p = m.forward(flat, starts)["p"]
        return float(-(labels * np.log(p) + (1 - labels) * np.log(1 - p)).sum())

    run = model.forward(flat, starts)
    assert np.allclose(np.add.reduceat(run["weights"], starts), 1)
    for name, gradient in _gradients(model, run, run["p"] - labels).items():
        place = tuple(rng.integers(0, s) for s in model.params[name].shape)
        model.params[name][place] += 1e-5
        up = loss(model)
        model.params[name][place] -= 2e-5
        down = loss(model)
        model.params[name][place] += 1e-5
        assert math.isclose((up - down) / 2e-5, gradient[place], rel_tol=1e-3, abs_tol=1e-5)


END = "</end>"


def plain_scores(docs, held, depth, share, least, discount=0.75):
    """The same model from counts of all contexts."""
    texts = [[*words_of(t), END] for _, t in docs]
    train = [t for t, h in zip(texts, held) if not h]
    total = sum(map(len, train))
    words = Counter(w for t in train for w in t)
    need = lambda s: max(least, math.ceil(s * total))
    follow = {}
    for t in train:
        for i in range(len(t)):
            for d in range(1, min(i, depth) + 1):
                follow.setdefault(tuple(t[i - d: i]), Counter())[t[i]] += 1
    size = {c: sum(n.values()) for c, n in follow.items()}
    # A context's count is that of its words; a candidate's last word is a stored entry before it.
    candidates = {c for c in follow if size[c] >= need(share["context"])}
    entries = {c: {w: n for w, n in follow[c].items() if n >= need(share["entry"])} for c in candidates}
    root = lambda w: (words[w] + 0.5) / (total + 0.5 * (len(words) + 1))
    left = {c: 1 - sum(n - discount for n in e.values()) / size[c] for c, e in entries.items()}

    def p(c, w, states):
        while c and c not in states:
            c = c[1:]
        if not c:
            return root(w)
        seen = entries[c].get(w, 0)
        return (seen - discount if seen else 0) / size[c] + left[c] * p(c[1:], w, states)

    states = set()
    for c, e in entries.items():
        if e:
            beneath = {w: p(c[1:], w, candidates) for w in e}
            gain = sum(n * math.log(n / size[c] / beneath[w]) for w, n in e.items())
            rest = size[c] - sum(e.values())
            if rest:
                gain += rest * math.log(rest / size[c] / min(1, max(1e-12, 1 - sum(beneath.values()))))
            if gain >= 0.5 * math.log(total) * (len(e) + 1):
                states |= {c[i:] for i in range(len(c))}
    out = []
    for t in texts:
        score = sum(math.log10(p(tuple(t[max(0, i - depth): i]), w, states)) for i, w in enumerate(t))
        out.append((len(t), sum(words[w] > 0 for w in t), total, sum(math.log10(root(w)) for w in t), score))
    return out, states


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_suffix_tree_scores(spark, depth):
    rng = random.Random(11)
    docs = []
    for i in range(120):
        words, state = [], "ab"
        for _ in range(rng.randrange(0, 60)):
            state = state[1] + rng.choice({"ab": "cca", "ba": "aab", "ca": "bb", "bc": "aac"}.get(state, "abc"))
            words.append(state[1] if rng.random() < 0.95 else f"r{rng.randrange(40)}")
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (502, "A  b\tC")]
    held = [zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs]
    share = {"context": 0.01, "entry": 0.002}
    wanted, states = plain_scores(docs, held, depth, share, 2)
    assert any(len(s) == min(depth, 2) for s in states)
    got = score_texts(frame(spark, docs), ~queries.held_out("doc_id", 5, 1), depth, word_share=0.002,
                      context_share=share["context"], entry_share=share["entry"]).collect()
    got = {r.doc_id: r for r in got}
    assert len(got) == len(docs)
    for (doc_id, _), (n, known, total, base, score) in zip(docs, wanted):
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


@pytest.mark.parametrize("word_share", [5e-7, 0.002, 1.0])
def test_a_context_seen_often_enough_is_kept_whatever_its_share(spark, word_share):
    """Three words that follow each other three times among 60,000 others, by the default least
    counts: 5e-5 of the tokens would be four times."""
    rng = random.Random(12)
    docs = [(i, sentence(rng, 1000, 3000)) for i in range(60)]
    docs += [(100 + i, f"{sentence(rng, 20)} left of centre stage {sentence(rng, 20)}") for i in range(3)]
    docs += [(200, "left of centre stage"), (201, "off centre stage"), (202, "stage centre of left")]
    held = [d >= 200 for d, _ in docs]
    wanted, states = plain_scores(docs, held, 3, {"context": 0, "entry": 0}, 2)
    assert {(b"left",), (b"of",)} <= states
    got = {r.doc_id: r for r in score_texts(frame(spark, docs), F.col("doc_id") < 200, word_share=word_share).collect()}
    for (doc_id, _), (n, known, total, base, score) in zip(docs, wanted):
        r = got[doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_language_model_of_odd_documents(spark, odd, none):
    got = score_texts(odd, F.lit(True)).collect()
    assert len(got) == len(odd_documents())
    assert all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in got)
    assert score_texts(none, F.lit(True)).count() == 0
    unlearnt = score_texts(odd, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in unlearnt} == {(0, 0)}


def test_contexts_help_on_held_out_texts(spark):
    rows = queries.queries()["op10_suffix_lm"](spark, LARGER).where("held_out")
    sums = rows.agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > 0.98 * sums[1] and sums[0] > sums[1]


def test_only_the_table_of_the_tree_is_kept(spark, odd, tmp_path, monkeypatch):
    """Before, the counted words stayed too."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    got = score_texts(odd, F.lit(True))
    assert {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)} == {"suffix-tree"}
    assert got.count() == len(odd_documents())


def test_levels_are_dropped_when_their_part_of_the_table_is_written(spark, odd, tmp_path, monkeypatch):
    """Before, the grams of all levels lay beside the table until it was whole."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: f"file://{tmp_path}")
    beside, write = {}, suffix_lm.written

    def watched(rows, path, **options):
        beside[path.rsplit("/", 1)[1]] = {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)}
        return write(rows, path, **options)

    monkeypatch.setattr(suffix_lm, "written", watched)
    score_texts(odd, F.lit(True))
    levels = {n: {x for x in beside[f"words={n}"] if x.startswith("level-")} for n in (1, 2, 3, 4)}
    assert levels == {4: {"level-1", "level-2", "level-3"}, 3: {"level-1", "level-2"}, 2: {"level-1"}, 1: set()}


def test_counted_grams_travel_as_arrays(spark, monkeypatch):
    """Before, each gram of a task was a row of the shuffle."""
    monkeypatch.setattr(suffix_lm, "CHUNK_TOKENS", 50)
    rng = random.Random(5)
    texts = [sentence(rng, rng.randrange(1, 90), 12) for _ in range(40)]
    every = spark.sparkContext.broadcast(np.full(1 << (suffix_lm.FILTER_BITS - 6), ~np.uint64(0)))
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    for ranges in (1, 7, 40):
        found = suffix_lm._count_grams(rows, 1, 2, every, ranges)
        assert "MapInArrow" in found._jdf.queryExecution().toString()
        tokens = [suffix_lm.tokens_of([t])[0].view(np.int64).tolist() for t in texts]
        wanted = Counter(pair for t in tokens for pair in zip(t, t[1:]))
        assert {(r.c, r.s): r.n for r in found.collect()} == {k: n for k, n in wanted.items() if n >= 2}


def test_texts_read_together_come_back_as_one_row_of_a_range(spark, monkeypatch):
    """Before, the lookup made a row for each text and range of names, so their number grew with both."""
    rng = random.Random(6)
    docs = [(i, sentence(rng, 40, 500)) for i in range(60)]
    scores = lambda: {r.doc_id: r for r in score_texts(
        frame(spark, docs).coalesce(1), F.col("doc_id") % 3 > 0, word_share=0.01).collect()}
    wanted = scores()
    monkeypatch.setattr(suffix_lm, "SOUGHT_TOKENS", 100)
    made, apply = [], PandasCogroupedOps.applyInArrow
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", lambda *args: made.append(apply(*args)) or made[-1])
    got = scores()
    ranges = suffix_lm._ranges(wanted[0].train_tokens, 100)
    assert ranges > 10 and len(made) == 1 and made[0].count() <= ranges + 1
    assert got.keys() == wanted.keys()
    for doc_id, r in wanted.items():
        assert got[doc_id][:4] == r[:4]
        assert np.allclose(got[doc_id][4:], r[4:], rtol=1e-12)


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_tokens_are_words_wherever_the_bytes_are_cut(monkeypatch, size):
    """Before, each word was hashed by itself."""
    texts = [t for _, t, *_ in odd_documents()] + [None, "", "  a\tA\x0bb\x0c", "a" * 50 + " b" * 40, "x y É é", "\ud800 ?"]
    words = [words_of(t) for t in texts]
    monkeypatch.setattr(suffix_lm, "READ_BYTES", size)
    tokens, sizes = suffix_lm.tokens_of(texts)
    assert sizes.tolist() == [len(w) + 1 for w in words]
    names = [x for w in words for x in (*w, None)]  # an end is None
    assert len(set(zip(names, tokens.tolist()))) == len(set(names)) == len(set(tokens.tolist()))
    assert suffix_lm.END in tokens
    valid = pa.array([t if t != "\ud800 ?" else "? ?" for t in texts])
    assert (suffix_lm.tokens_of(pa.concat_arrays([pa.array(["left out"]), valid]).slice(1))[0] == tokens).all()


def test_names_are_ordered_and_found():
    rng = np.random.default_rng(7)
    top = np.uint64(1 << 60)
    for names in (np.zeros(0, np.uint64), rng.integers(0, 1 << 64, 5000, np.uint64), rng.integers(0, 50, 5000).astype(np.uint64),
                  np.append(rng.integers(0, 9, 500).astype(np.uint64) + top, ~np.uint64(0))):
        assert (names[suffix_lm._order(names)] == np.sort(names)).all()
        known = np.unique(names[::2])
        at = suffix_lm._Names(known).find(names)
        assert ((at >= 0) == np.isin(names, known)).all() and (known[at[at >= 0]] == names[at >= 0]).all()


def test_a_filter_lets_its_names_pass(spark):
    names = np.random.default_rng(8).integers(0, 1 << 64, 3000, np.uint64)
    rows = spark.createDataFrame([(int(x),) for x in names[:1000].view(np.int64)], "g long").repartition(3)
    found = suffix_lm._filter(rows)
    assert suffix_lm._passing(found, names[:1000]).all() and suffix_lm._passing(found, names[1000:]).sum() < 10
    assert not suffix_lm._passing(suffix_lm._filter(rows.limit(0)), names).any()
