"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded, a gated attention gives each encoding a
weight, and the weighted sum is scored. Only documents have labels; which passages matter is
learnt from those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.caches import CACHED_BYTES, ENTRY, remembered
from duebook.llm.sampling import labelled_sample

PASSAGE_WORDS = 48
WORD_CELLS = 64
HIDDEN, GATE = 24, 16
#: Labelled texts of each class that the model is fitted on at most; this bounds the driver's share.
SAMPLE_PER_CLASS = 1_500
EPOCHS, BATCH, RATE = 20, 64, 0.005
_SHAPES = 14
#: Features of a passage: means of its words' shapes, shares of word cells, three of the whole.
FEATURES = _SHAPES + WORD_CELLS + 3


def _shape(word: str) -> tuple[float, ...]:
    n = len(word)
    if word.isalpha() and word.islower():  # most words
        upper = digits = marks = 0
        letters = n
    else:
        upper = sum(map(str.isupper, word))
        digits = sum(map(str.isdigit, word))
        marks = n - sum(map(str.isalnum, word))
        letters = sum(map(str.isalpha, word))
    return (
        math.log1p(n), upper / n, float(n > 1 and upper == letters > 0), digits / n, marks / n,
        float("|" in word), word.count("!") / n, (len(word.encode("utf-8", "replace")) - n) / n,
        float(word[-1] == "."), float(word[-1] == ","), float(word[0].isupper()), float(letters == 0),
        float(n <= 2), float(n >= 15),
    )


class _Words(dict):
    """Word to its row in `shapes` and its cell."""

    def __init__(self) -> None:
        super().__init__()
        self._start()

    def _start(self) -> None:
        self.clear()
        self.bytes = 0
        self.shapes = np.zeros((1024, _SHAPES), dtype=np.float32)
        self.cells = np.zeros(1024, dtype=np.int64)

    def start_text(self) -> None:
        """Beyond CACHED_BYTES all is forgotten, but not within a text, whose words refer to rows."""
        if self.bytes > CACHED_BYTES:
            self._start()

    def __missing__(self, word: str) -> int:
        self.bytes += len(word) + ENTRY + 4 * _SHAPES + 8
        row = len(self)
        if row == len(self.cells):
            self.shapes = np.concatenate([self.shapes, np.zeros_like(self.shapes)])
            self.cells = np.concatenate([self.cells, np.zeros_like(self.cells)])
        self.shapes[row] = _shape(word)
        plain = word.lower().strip(".,!?|;:")
        self.cells[row] = xxhash.xxh3_64_intdigest(plain.encode("utf-8", "replace")) % WORD_CELLS
        self[word] = row
        return row


def passages_of(text: str | None) -> np.ndarray:
    """A row of features per passage of PASSAGE_WORDS words; an empty text is one empty passage."""
    words = (text or "").split()
    if not words:
        return np.zeros((1, FEATURES), dtype=np.float32)
    table = remembered("word shapes", _Words)
    table.start_text()
    ids = np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words))
    starts = np.arange(0, len(ids), PASSAGE_WORDS)
    sizes = np.diff(np.append(starts, len(ids)))
    passage = np.arange(len(ids)) // PASSAGE_WORDS
    out = np.empty((len(starts), FEATURES), dtype=np.float32)
    out[:, :_SHAPES] = np.add.reduceat(table.shapes[ids], starts) / sizes[:, None]
    cells = np.bincount(passage * WORD_CELLS + table.cells[ids], minlength=len(starts) * WORD_CELLS)
    out[:, _SHAPES:-3] = cells.reshape(-1, WORD_CELLS) / sizes[:, None]
    repeats = np.append(False, ids[1:] == ids[:-1])
    out[:, -3] = np.bincount(passage, weights=repeats, minlength=len(starts)) / sizes
    order = np.lexsort((ids, passage))
    fresh = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(passage[order]) != 0))
    out[:, -2] = np.bincount(passage[order], weights=fresh, minlength=len(starts)) / sizes
    out[:, -1] = sizes / PASSAGE_WORDS
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]

    def forward(self, bags: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """bags: passages of documents one after the other, from `starts` on."""
        p = self.params
        x = np.clip((bags - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["w0"])
        t, s = np.tanh(h @ p["V"] + p["v0"]), _sigmoid(h @ p["U"] + p["u0"])
        e = (t * s) @ p["a"]
        sizes = np.diff(np.append(starts, len(bags)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        weights = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(weights[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "weights": weights, "z": z, "sizes": sizes,
                "p": _sigmoid(z @ p["c"] + p["c0"])}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts; passages are held for a bounded number of words at a time."""
        out, bags, held = [], [], 0
        for text in texts:
            bags.append(passages_of(text))
            held += len(bags[-1])
            if held > 20_000:
                out.append(self._score(bags))
                bags, held = [], 0
        if bags:
            out.append(self._score(bags))
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = [len(b) for b in bags]
        return self.forward(np.concatenate(bags), np.cumsum([0, *sizes[:-1]]))["p"]


def _gradients(model: QualityModel, run: dict[str, np.ndarray], error: np.ndarray) -> dict[str, np.ndarray]:
    """error: of each document, the loss by its log odds."""
    p, sizes, w, h = model.params, run["sizes"], run["weights"], run["h"]
    starts = np.cumsum(sizes) - sizes
    dz = np.repeat(error[:, None] * p["c"], sizes, axis=0)
    dw = (dz * h).sum(axis=1)
    de = w * (dw - np.repeat(np.add.reduceat(w * dw, starts), sizes))
    dt = de[:, None] * p["a"] * run["s"] * (1 - run["t"] ** 2)
    ds = de[:, None] * p["a"] * run["t"] * run["s"] * (1 - run["s"])
    dh = w[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T
    dx = dh * (1 - h**2)
    return {"c": run["z"].T @ error, "c0": error.sum(keepdims=True), "a": (run["t"] * run["s"]).T @ de,
            "V": h.T @ dt, "v0": dt.sum(axis=0), "U": h.T @ ds, "u0": ds.sum(axis=0),
            "W": run["x"].T @ dx, "w0": dx.sum(axis=0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, share: float, seed: int = 7) -> QualityModel:
    """bags: the passages of each document; share: of label 1 among all labelled documents."""
    rng = np.random.default_rng(seed)
    n, y = len(bags), labels.astype(np.float64)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    params = {"W": normal(FEATURES, HIDDEN), "w0": np.zeros(HIDDEN), "V": normal(HIDDEN, GATE),
              "v0": np.zeros(GATE), "U": normal(HIDDEN, GATE), "u0": np.zeros(GATE),
              "a": normal(GATE), "c": np.zeros(HIDDEN), "c0": np.zeros(1)}
    prior = float(np.log((share * n + 1) / ((1 - share) * n + 1)))
    if not 0 < y.sum() < n:
        params["c0"] += prior
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), params)
    flat = np.concatenate(bags).astype(np.float64)
    model = QualityModel(flat.mean(axis=0), flat.std(axis=0) + 1e-3, params)
    weight = np.where(y > 0, n / 2 / y.sum(), n / 2 / (n - y.sum()))
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            chosen = order[at: at + BATCH]
            sizes = [len(bags[i]) for i in chosen]
            run = model.forward(np.concatenate([bags[i] for i in chosen]), np.cumsum([0, *sizes[:-1]]))
            error = weight[chosen] * (run["p"] - y[chosen]) / len(chosen)
            step += 1
            for k, g in _gradients(model, run, error).items():
                g = g + 1e-4 * params[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                params[k] -= RATE * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    params["c0"] += prior  # classes weighed alike in the fit
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "quality",
                per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id",
                text_col: str = "text") -> QualityModel:
    """Learn from labelled texts where `learn_from` holds, at most per_class of each label.

    Without texts of both labels, the model is the share of label 1 for every text.
    """
    sample, share = labelled_sample(docs, labels, label_col, per_class, learn_from, id_col, text_col)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"],
                                "bag": [passages_of(t).astype("<f4").tobytes() for t in batch["text"]]})

    rows = sample.mapInPandas(features, "id long, label int, bag binary").toPandas()
    rows = rows.sort_values(["label", "id", "bag"], ignore_index=True)  # one order at every run
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in rows["bag"]]
    return fit(bags, rows["label"].to_numpy(), share)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score from 0 to 1, predicted (1 if the score reaches the threshold).

    Null and empty texts are one empty passage. Every passage of a text is read. Rows with the
    same or a null id are scored one by one. Other columns are not read.
    """
    # Of fixed size, whatever was learnt from.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["id"], "missing": batch["missing"],
                                "score": shared.value.scores(list(batch["text"]))})

    ident = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(ident, F.lit(0)).alias("id"), ident.isNull().alias("missing"),
                       F.col(text_col).alias("text"))
    return rows.mapInPandas(scored, "doc_id long, missing boolean, score double").select(
        F.when(~F.col("missing"), F.col("doc_id")).alias(id_col), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
