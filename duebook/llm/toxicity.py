"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams that occur in a text (bytes, A-Z in lower case), hashed into a fixed
number of cells. Each is scaled by the log of the ratio of its shares in toxic and other texts,
and a logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duebook.llm.sampling import labelled_sample

#: Bytes of an n-gram: stems within words, and whole words with the blank before them.
SIZES = (5, 7, 9)
CELL_BITS = 20
#: Labelled texts of each class that the model is fitted on at most; this bounds the driver's share.
#: Each class has the same bound and the share of the classes in all labels sets the intercept.
SAMPLE_PER_CLASS = 2_000
#: Texts of the sample that a feature must occur in.
LEAST_TEXTS = 3
#: Features whose log-count ratio is nearer to 0 are as common in either class; they get no weight.
LEAST_RATIO = 1.5
SMOOTHING = 1.0
RIDGE = 0.1
STEPS = 60
#: Parts of the sample; each is scored by a model of the others, and these scores set the scale.
FOLDS = 3

_ODD = np.uint64(0x9E3779B97F4A7C15)


def cells_of(text: str | None) -> np.ndarray:
    """The cells of all n-grams of a text, repeated ones too."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8).astype(np.uint64)
    out = []
    for n in SIZES:
        count = len(raw) - n + 1
        if count <= 0:
            break
        gram = np.full(count, np.uint64(n), dtype=np.uint64)
        for i in range(n):
            gram = (gram << np.uint64(8)) | raw[i: i + count]
        out.append((gram * _ODD) >> np.uint64(64 - CELL_BITS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


class _Distinct:
    """Distinct cells of a text without sorting: the last place of each cell counts."""

    def __init__(self) -> None:
        self._last = np.zeros(1 << CELL_BITS, dtype=np.int64)

    def __call__(self, cells: np.ndarray) -> np.ndarray:
        places = np.arange(len(cells))
        self._last[cells] = places
        return cells[self._last[cells] == places]


def _packed(cells: np.ndarray) -> bytes:
    """Distinct cells in order, as compressed steps: about a third of their size, for the driver's sake."""
    return zlib.compress(np.diff(np.sort(cells), prepend=0).astype("<u4").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<u4"), dtype=np.int32)


@dataclass
class ToxicityModel:
    weights: np.ndarray  # log-count ratio times fitted weight, by cell
    scale: float
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        distinct = _Distinct()
        sums = np.array([self.weights[distinct(cells_of(t))].sum() for t in texts], dtype=np.float64)
        return _sigmoid(self.scale * sums + self.intercept)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_weights(cells: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Weight per cell. cells: the distinct cells of each text; y: 0 or 1, both there."""
    size, n = 1 << CELL_BITS, len(cells)
    toxic, other = np.zeros(size), np.zeros(size)
    for text_cells, label in zip(cells, y):
        (toxic if label else other)[text_cells] += 1
    ratio = np.log((toxic + SMOOTHING) / (toxic + SMOOTHING).sum()) \
        - np.log((other + SMOOTHING) / (other + SMOOTHING).sum())
    ratio[(toxic + other < LEAST_TEXTS) | (np.abs(ratio) < LEAST_RATIO)] = 0
    used = [c[ratio[c] != 0] for c in cells]
    flat = np.concatenate(used)
    text = np.repeat(np.arange(n), [len(c) for c in used])
    value = ratio[flat]
    # Classes weigh alike in the fit, whatever their part of the sample.
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = np.bincount(text, weights=value * w[flat], minlength=n) + b
        error = weight * (_sigmoid(z) - y)
        g = np.bincount(flat, weights=value * error[text], minlength=size) + RIDGE * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        b -= 0.02 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return ratio * w


def _scaled(sums: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Scale and intercept of a logistic curve through the sums, for that share of label 1."""
    weight = np.where(y > 0, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    spread = sums.std() + 1e-9
    x = np.stack([sums / spread, np.ones(len(y))], axis=1)
    at = np.zeros(2)
    for _ in range(50):  # Newton, with a ridge that keeps separable sums finite
        p = _sigmoid(x @ at)
        gradient = x.T @ (weight * (p - y)) + 1e-4 * at
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        at -= np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return float(at[0] / spread), float(at[1])


def fit(cells: list[np.ndarray], labels: np.ndarray, share: float) -> ToxicityModel:
    """share: of label 1 among all labelled texts."""
    n, y = len(cells), labels.astype(np.float64)
    if not 0 < y.sum() < n:
        prior = np.log((share * n + 1) / ((1 - share) * n + 1))
        return ToxicityModel(np.zeros(1 << CELL_BITS), 1.0, float(prior))
    fold = np.empty(n, dtype=np.int64)
    for label in (0, 1):  # each fold has its part of either label
        places = np.flatnonzero(y == label)
        fold[places] = np.arange(len(places)) % FOLDS
    sums = np.zeros(n)
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if 0 < y[inside].sum() < len(inside):
            weights = fit_weights([cells[i] for i in inside], y[inside])
            sums[outside] = [weights[cells[i]].sum() for i in outside]
    scale, intercept = _scaled(sums, y, share)
    return ToxicityModel(fit_weights(cells, y), max(scale, 0.0), intercept)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn_from: Column, label_col: str = "toxic",
                 per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id",
                 text_col: str = "text") -> ToxicityModel:
    """Learn from labelled texts where `learn_from` holds, at most per_class of each label.

    Without texts of both labels, the model is the share of label 1 for every text.
    """
    sample, share = labelled_sample(docs, labels, label_col, per_class, learn_from, id_col, text_col)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        distinct = _Distinct()
        for batch in batches:
            yield pd.DataFrame({
                "id": batch["id"], "label": batch["label"],
                "cells": [_packed(distinct(cells_of(t))) for t in batch["text"]],
            })

    rows = sample.mapInPandas(features, "id long, label int, cells binary").toPandas()
    rows = rows.sort_values(["label", "id", "cells"], ignore_index=True)  # one order at every run
    cells, found = [_unpacked(c) for c in rows["cells"]], rows["label"].to_numpy()
    del rows
    return fit(cells, found, share)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score from 0 to 1, predicted (1 if the score reaches the threshold).

    Null and empty texts have no n-grams; the intercept is their score. Whole texts are read.
    Rows with the same or a null id are scored one by one. Other columns are not read.
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
