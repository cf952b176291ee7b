"""Quality classifier: supervised subword embeddings.

Each word is represented by the mean of learned vectors for its hashed form and its hashed character n-grams, and each
pair of neighbouring words by a learned vector of the hashed pair; pairs of a word with itself share one vector, as
which word it is says nothing.  A document is the mean of its words' and pairs' vectors, and a softmax layer gives
class probabilities.  Vectors and layer are trained together by numpy stochastic gradient descent on at
most ``SAMPLE`` labelled rows of each class; the intercept is then corrected to the class shares of all labelled
rows.  As the layer is linear in the mean, scoring needs one number per hashed feature, kept per distinct word.

Defined results: null, empty and white-space texts score the corrected intercept; texts are read whole; repeated
rows score alike; without labels of both classes every text scores 0.5 (or the share of the one class seen);
empty tables give empty results; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, fit_in_task, labelled_sample

SAMPLE = 1500
BITS, DIM, EPOCHS, RATE = 18, 16, 6, 0.5
NGRAMS = (3, 4)
REPEAT = 0  # the feature of a word's pair with itself
PAIRS = 1 << BITS  # word pairs have the upper half of the features
THRESHOLD = 0.7
_CACHE_LIMIT, _CELLS = 300_000, 100_000
_BASE, _MIX = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)


def hashed(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed features of words, in chunks of similar length: word numbers, feature ids, which of them count, word keys.

    A word, marked by ``<`` and ``>`` at its ends, has one feature for itself and one for each character n-gram.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        rows = max(1, _CELLS // int(lengths[order[at]]))
        part = order[at : at + rows]
        width = int(lengths[part[-1]])
        part = part[: max(1, _CELLS // width)]
        at += len(part)
        n = lengths[part]
        width = int(n[-1])
        flat = np.frombuffer("".join(f"<{words[i]}>" for i in part.tolist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.arange(width) < n[:, None]
        c = np.zeros((len(part), width), np.uint64)
        c[inside] = flat
        powers = np.cumprod(np.full(width, _BASE, np.uint64))
        keys, counts = [(c * powers).sum(axis=1, dtype=np.uint64)[:, None]], [np.ones((len(part), 1), bool)]
        for size in NGRAMS:
            if width >= size:
                key = np.full((len(part), width - size + 1), size, np.uint64)
                for i in range(size):
                    key = key * _BASE + c[:, i : width - size + 1 + i]
                keys.append(key)
                counts.append(inside[:, size - 1 :])
        ids = ((np.concatenate(keys, axis=1) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)
        yield part, np.maximum(ids, 1), np.concatenate(counts, axis=1), keys[0][:, 0]


def pairs(keys: np.ndarray) -> np.ndarray:
    """Features of the neighbouring pairs of words with these keys."""
    mixed = ((keys[:-1] * _BASE + keys[1:]) * _MIX) >> np.uint64(64 - BITS)
    return np.where(keys[:-1] == keys[1:], REPEAT, PAIRS + mixed.astype(np.int64))


def train(rows: list[tuple[str, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """Per-feature scores and the intercept of the log-odds of class 1, from (text, label) rows."""
    bags = [text.split() for text, _ in rows]
    words = sorted(set().union(*bags))
    known: dict[str, tuple[np.ndarray, np.uint64]] = {}
    for part, ids, counts, keys in hashed(words):
        known.update((words[i], (f[c], k)) for i, f, c, k in zip(part.tolist(), ids, counts, keys))
    docs = []
    for bag, (_, y) in zip(bags, rows):
        if not bag:
            continue
        parts = [known[w][0] for w in bag]
        both = pairs(np.array([known[w][1] for w in bag], np.uint64))
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ids = np.concatenate([*parts, both])
        weights = np.concatenate([np.repeat(1 / sizes, sizes), np.ones(len(both))]) / (len(bag) + len(both))
        unique, inverse = np.unique(ids, return_inverse=True)
        docs.append((unique, np.bincount(inverse, weights).astype(np.float32)[:, None], y))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (2 * PAIRS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            ids, weight, y = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            mean = (vectors[ids] * weight).sum(axis=0)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * p
            # The step of a vector is scaled by its share of the largest weight, so long texts move their words, too.
            vectors[ids] -= rate * (weight / weight.max()) * back
    odds = layer[:, 1] - layer[:, 0]
    return (vectors @ odds).astype(np.float32), float(bias[1] - bias[0])


def word_scores(words: list[str], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean score of each word's features, and its key."""
    means, keys = np.zeros(len(words)), np.zeros(len(words), np.uint64)
    for part, ids, counts, key in hashed(words):
        means[part] = np.where(counts, scores[ids], 0).sum(axis=1, dtype=np.float64) / counts.sum(axis=1)
        keys[part] = key
    return means, keys


def fit(docs: DataFrame, labels: DataFrame, exclude: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """(scores, intercept) learned from labelled rows where ``exclude`` (over ``__id``) is false; trained in one executor task."""
    rows, counts = labelled_sample(docs, labels, "quality", exclude, sample, id_col, text_col)

    def learn(rows: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
        taken = [sum(1 for _, y in rows if y == c) for c in (0, 1)]
        if not all(taken):
            return np.zeros(2 * PAIRS, np.float32), 0.0 if not any(taken) else math.copysign(4.0, taken[1] - taken[0])
        scores, intercept = train(rows)
        return scores, intercept + math.log(counts[1] / counts[0] * taken[0] / taken[1])

    return fit_in_task(rows, learn)


def score_column(model, text_col: str = "text") -> Column:
    """Probability of class 1 for each whole text."""
    scores, intercept = model

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        means, keys, out = np.zeros(0), np.zeros(0, np.uint64), []
        texts = texts.tolist()
        for lo, hi in by_bytes([len(t or "") for t in texts]):
            for at in range(lo, hi, 64):
                bags = [text.split() if text else [] for text in texts[at : min(at + 64, hi)]]
                new = set().union(*bags).difference(known)
                if len(known) + len(new) > _CACHE_LIMIT:
                    known.clear()
                    means, keys, new = means[:0], keys[:0], set().union(*bags)
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new))))
                    more = word_scores(list(new), scores)
                    means, keys = np.concatenate([means, more[0]]), np.concatenate([keys, more[1]])
                for words in bags:
                    n = len(words)
                    i = np.fromiter(map(known.__getitem__, words), np.int64, n)
                    total = means[i].sum() + scores[pairs(keys[i])].sum(dtype=np.float64) if n else 0.0
                    x = intercept + total / max(1, 2 * n - 1)
                    out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, x)))))
        return pd.Series(out, dtype="float64")

    return quality(F.col(text_col))
