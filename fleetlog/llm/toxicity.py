"""Toxicity by a chain of linear classifiers (operator 10).

Categories are predicted one after the other: the model of a category sees the
features of the text and the probabilities of all earlier categories.  In
training, these earlier probabilities are out-of-fold predictions, so that a
later model learns from probabilities as wrong as those it meets afterwards.

With ``kinds``, that many categories before the labelled ones are learnt: the texts
labelled in the last category are clustered by their features, and each cluster is a
category of its own.

Features are the presence of words and of byte 4- and 5-grams of words (blanks
mark word ends); the ``features`` most telling ones by chi-square are kept.
Fitting takes at most ``sample_rows`` labelled texts, the first in the order of
their hash, and stays on the driver; every text is then scored whole.
Null and empty texts get the models' base probabilities.  Rows without a label
in some category take no part in fitting.  Without labelled rows of both kinds
a category's probability is its share of positives (0 if there is no row).
Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from fleetlog.llm.textkit import bounded_sample, byte_grams, hash_words, mix, prepare, slices, texts_of, words_of

SAMPLE_ROWS = 8_000
FEATURES = 512
FOLDS = 5
MIN_DOCUMENTS = 4  # that a feature must occur in
MIN_CHI_SQUARE = 30.0
SLICE = 1 << 19  # bytes of text that fitting turns into features at once, on the driver
PRECISION = 0.97  # that a threshold must have on out-of-fold predictions
_WORD = np.uint64(1 << 63)
_FILTER_BITS = 20


@dataclass(frozen=True)
class Chain:
    categories: list[str]
    features: np.ndarray  # sorted
    weights: list[np.ndarray]  # by category: intercept, features, earlier categories
    thresholds: list[float]  # by category: the probability from which it is predicted


def _grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word index)"""
    bare = pc.utf8_lower(pc.replace_substring_regex(words, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    grams, owner = byte_grams(bare, (4, 5))
    return np.concatenate([grams, hash_words(bare) | _WORD]), np.concatenate([owner, np.arange(len(bare))])


def _pairs(part: pa.RecordBatch, select=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a slice; ``select`` turns features into
    indices, negative for those to leave out."""
    found = words_of(texts_of(part))
    if not len(found.words):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams, owner = _grams(found.words)
    if select is not None:
        grams = select(grams)
        owner, grams = owner[grams >= 0], grams[grams >= 0]
    values, grams = np.unique(grams, return_inverse=True)
    order = np.argsort(owner, kind="stable")
    grams, counts = grams[order], np.bincount(owner, minlength=len(found.words))
    starts = np.cumsum(counts) - counts
    words = np.unique(found.rows() * len(found.words) + found.codes)
    rows, words = np.divmod(words[counts[words % len(found.words)] > 0], len(found.words))
    many = counts[words]
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    keys = np.unique(np.repeat(rows, many) * max(1, len(values)) + grams[np.repeat(starts[words], many) + within])
    return keys // max(1, len(values)), values[keys % max(1, len(values))] if len(values) else values


def _selector(features: np.ndarray):
    """Maps features to their place in ``features``, others to -1."""
    shift = np.uint64(64 - _FILTER_BITS)
    near = np.zeros(1 << _FILTER_BITS, bool)
    near[(mix(features) >> shift).astype(np.int64)] = True

    def select(grams: np.ndarray) -> np.ndarray:
        out = np.full(len(grams), -1, np.int64)
        maybe = np.flatnonzero(near[(mix(grams) >> shift).astype(np.int64)])
        at = np.searchsorted(features, grams[maybe])
        at[at == len(features)] = 0
        hit = features[at] == grams[maybe] if len(features) else np.zeros(len(maybe), bool)
        out[maybe[hit]] = at[hit]
        return out

    return select


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05, steps: int = 250) -> np.ndarray:
    """L2-penalised logistic regression by accelerated gradient steps, equal
    rows taken together; the first column of ``x`` is the intercept, which goes
    unpenalised."""
    w = np.zeros(x.shape[1], np.float32)
    share = y.mean() if len(y) else 0.0
    if share in (0.0, 1.0):
        w[0] = 30.0 if share else -30.0
        return w
    w[0] = np.log(share / (1 - share))
    _, first, same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * x.itemsize}")[:, 0], return_index=True, return_inverse=True)
    n = len(y)
    x, many, y = x[first], np.bincount(same).astype(np.float32), np.bincount(same, weights=y).astype(np.float32)
    ridge = np.full(x.shape[1], penalty / n, np.float32)
    ridge[0] = 0
    probe = np.ones(x.shape[1], np.float32)
    for _ in range(12):  # largest curvature, by power iteration
        probe = x.T @ (many * (x @ (probe / np.linalg.norm(probe))))
    rate = 1 / (0.25 * np.linalg.norm(probe) / n + ridge.max())
    ahead = w.copy()
    for t in range(steps):
        new = ahead - rate * (x.T @ (many * _sigmoid(x @ ahead) - y) / n + ridge * ahead)
        ahead = new + t / (t + 3) * (new - w)
        w = new
    return w


def _select(parts: list[pa.RecordBatch], labels: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` features with the largest chi-square over all categories."""
    n, done = len(labels), 0
    rows = labels.shape[1] + 1
    features, sums = [np.zeros(0, np.uint64)], [np.zeros((0, rows), np.float32)]

    def merge() -> None:
        merged, at = np.unique(np.concatenate(features), return_inverse=True)
        both = np.concatenate(sums)
        sums[:] = [np.stack([np.bincount(at, weights=both[:, k], minlength=len(merged)) for k in range(rows)], axis=1).astype(np.float32)]
        features[:] = [merged]

    for part in parts:
        row, feature = _pairs(part)
        values, at = np.unique(feature, return_inverse=True)
        marks = np.concatenate([np.ones((part.num_rows, 1)), labels[done : done + part.num_rows]], axis=1)
        features.append(values)
        sums.append(np.stack([np.bincount(at, weights=marks[row, k], minlength=len(values)) for k in range(rows)], axis=1).astype(np.float32))
        done += part.num_rows
        if len(features) > 8:
            merge()
    merge()
    totals = {"f": features[0], "n": sums[0].astype(np.float64)}
    seen, best = totals["n"][:, 0], np.zeros(len(totals["f"]))
    for k in range(1, rows):
        positive = labels[:, k - 1].sum()
        expected = seen * positive / max(1, n)
        spread = np.maximum(expected * (1 - seen / max(1, n)) * (1 - positive / max(1, n)), 1e-9)
        best = np.maximum(best, np.where(seen >= MIN_DOCUMENTS, (totals["n"][:, k] - expected) ** 2 / spread, 0))
    chosen = np.lexsort((totals["f"], -best))[:top]
    return np.sort(totals["f"][chosen[best[chosen] >= MIN_CHI_SQUARE]])


def _matrix(parts: list[pa.RecordBatch], features: np.ndarray) -> np.ndarray:
    select, out = _selector(features), []
    for part in parts:
        x = np.zeros((part.num_rows, len(features) + 1), np.float32)
        x[:, 0] = 1
        row, feature = _pairs(part, select) if len(features) else (np.zeros(0, np.int64),) * 2
        x[row, feature.astype(np.int64) + 1] = 1
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, len(features) + 1), np.float32)


def _kinds(x: np.ndarray, positive: np.ndarray, count: int, rounds: int = 25) -> np.ndarray:
    """A 0/1 column for each of ``count`` clusters of the positive rows: spherical k-means over the
    features present, begun with the row nearest to the mean and then with those least like
    the rows before; ties go to the first.  Rows without features are in none."""
    out = np.zeros((len(x), count), np.float32)
    rows = np.flatnonzero((positive > 0) & (x[:, 1:].sum(axis=1) > 0))
    if not len(rows):
        return out
    unit = x[rows, 1:] / np.sqrt(x[rows, 1:].sum(axis=1, keepdims=True))
    centres = unit[[int((unit @ unit.mean(axis=0)).argmax())]]
    while len(centres) < count:
        centres = np.concatenate([centres, unit[[int((unit @ centres.T).max(axis=1).argmin())]]])
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        sums = np.stack([unit[own == k].sum(axis=0) for k in range(count)])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres).astype(np.float32)
    out[rows, (unit @ centres.T).argmax(axis=1)] = 1
    return out


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """On out-of-fold predictions, the best F1 among the cuts whose precision is
    at least ``PRECISION``; of cuts alike, the middle of the widest gap between
    probabilities, on the log scale.  0.5 without such a cut."""
    order = np.argsort(-p, kind="stable")
    ranked, hits, taken = p[order], np.cumsum(y[order]), np.arange(1, len(y) + 1)
    below = np.append(ranked[1:], 0.0)[: len(y)]
    f1 = np.where((below < ranked) & (hits >= PRECISION * taken), 2 * hits / (taken + max(1.0, y.sum())), 0)
    if not f1.any():
        return 0.5
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax(np.log(ranked[best] + 1e-9) - np.log(below[best] + 1e-9))]
    return float(np.sqrt((ranked[k] + 1e-9) * (below[k] + 1e-9)))


def fit(labelled: DataFrame, categories: list[str], sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, folds: int = FOLDS, kinds: int = 0) -> Chain:
    """Fit on ``text`` and one 0/1 column for each category, in chain order, behind
    ``kinds`` learnt ones named ``<last category>_kind_<number>``."""
    prepare(labelled.sparkSession)
    marks = [F.col(c).cast("double").alias(c) for c in categories]
    sample = bounded_sample(labelled.select("text", *marks).dropna(), sample_rows).toArrow().combine_chunks()
    labels = np.stack([sample[c].to_numpy() for c in categories], axis=1).astype(np.float32)
    parts = [part for batch in sample.select(["text"]).to_batches() for part in slices(batch, "text", SLICE)]
    chosen = _select(parts, labels, features)
    x = _matrix(parts, chosen)
    if kinds:
        labels = np.concatenate([_kinds(x, labels[:, -1], kinds), labels], axis=1)
        categories = [*(f"{categories[-1]}_kind_{k + 1}" for k in range(kinds)), *categories]
    fold = np.arange(len(labels)) % folds
    weights, thresholds = [], []
    for k in range(len(categories)):
        y, beside = labels[:, k], np.zeros(len(labels), np.float32)
        for f in range(folds):
            beside[fold == f] = _sigmoid(x[fold == f] @ _logistic(x[fold != f], y[fold != f]))
        weights.append(_logistic(x, y))
        thresholds.append(_threshold(beside, y))
        x = np.concatenate([x, beside[:, None]], axis=1)
    del sample, parts, x
    pa.default_memory_pool().release_unused()  # the driver lives on
    return Chain(list(categories), chosen, weights, thresholds)


def score(docs: DataFrame, chain: Chain, columns: list[str] = ["doc_id"], prefix: str = "p_") -> DataFrame:
    """``columns`` of every row and ``p_<category>`` for each category; columns of these
    names give way."""
    prepare(docs.sparkSession)
    names = [f"{prefix}{c}" for c in chain.categories]
    columns = [c for c in columns if c not in names]
    own = "text" if "text" in columns else "_text"
    passed = docs.select(*columns, *([] if own in columns else [F.col("text").alias(own)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, own):
                x = _matrix([part.select([own]).rename_columns(["text"])], chain.features)
                for w in chain.weights:
                    x = np.concatenate([x, _sigmoid(x @ w).astype(np.float32)[:, None]], axis=1)
                found = x[:, x.shape[1] - len(names) :].astype(np.float64)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], *(pa.array(found[:, k]) for k in range(len(names)))], [*columns, *names])

    return passed.mapInArrow(run, passed.select(*columns, *(F.lit(0.0).alias(n) for n in names)).schema)
