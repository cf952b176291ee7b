"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel with Nyström landmarks.

Kernel: K(x, y) = sum over character triples t of phi_t(x) phi_t(y), where phi_t(x) sums ``DECAY ** span`` over all
places where t occurs in x as a subsequence of span at most ``SPAN``; it is normalised by the lengths of phi.  So
characters inserted into a word, or left out of it, lower the likeness a little instead of breaking the match.
Characters fall into 63 classes (letters and digits have their own).

Instances are the words of a text with all but letters and digits removed, and runs of three or more single
characters joined, between marks of their ends; a text is as toxic as its worst instance.  Labels are per text, so
training alternates (multiple instances).  A word may be an insult if toxic texts hold it more often than clean ones
and, for it or a run of its characters, the lower bound of the log-odds is above ``EVIDENCE``: each toxic text names
such words among its three worst as positives, each clean text its three worst ones as negatives (besides words drawn
from clean texts), weighted by the texts that hold them.  Landmarks are drawn from both, instances are mapped by
K(x, landmarks) K(landmarks)^(-1/2), and a linear SVM is fitted by dual coordinate descent.  The shares of toxic
texts by value among texts kept apart (``APART``), made to rise only, give the score.  At most ``SAMPLE`` labelled rows of each class are used.  The machine is
linear in phi, so it is applied as one table of triples.

Defined results: null, empty and symbol-only texts get the score of an instance without likeness to anything;
texts are read whole, words longer than 32 characters in overlapping pieces; repeated rows score alike; without
labels of both classes all scores are the smoothed share of toxic labels; empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, labelled_sample

SAMPLE = 1500
DECAY, SPAN, CLASSES = 0.5, 6, 64
LANDMARKS, ROUNDS = 256, 2
COST, SWEEPS, APART = 10.0, 60, 0.3
EVIDENCE, DEVIATIONS, RUNS = 1.0, 2.0, (5, 6, 7)
THRESHOLD = 0.7
END = "_"  # marks both ends of an instance
_LONGEST, _CACHE_LIMIT = 32, 300_000
_GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_SYMBOLS = re.compile(r"[\W_]+")


def _pieces(word: str) -> list[str]:
    """Overlapping pieces of a long word between marks of its ends."""
    word = f"{END}{word}{END}"
    return [word[i : i + _LONGEST] for i in range(0, len(word), _LONGEST // 2)]


def instances(text: str | None) -> set[str]:
    """The distinct strings of a text that are scored."""
    words = (text or "").lower().split()
    found = set(words)
    out = set()
    for w in found:
        if not w.isalnum():
            w = _SYMBOLS.sub("", w)
        if len(w) > _LONGEST:
            out.update(_pieces(w))
        elif len(w) >= 3:
            out.add(f"{END}{w}{END}")
    run: list[str] = []
    if any(len(w) == 1 for w in found):
        for w in [*words, ".."]:
            if len(w) == 1 and w.isalnum():
                run.append(w)
                continue
            if len(run) >= 3:
                out.update(_pieces("".join(run)))
            run = []
    return out


def _classes(words: list[str]) -> np.ndarray:
    """(words, longest) character classes, 0 behind the end."""
    if not words:
        return np.zeros((0, 1), np.int32)
    n = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = 37 + flat % 27
    code = np.where((flat >= 97) & (flat <= 122), flat - 96, code)
    code = np.where((flat >= 48) & (flat <= 57), flat - 21, code)
    out = np.zeros((len(words), max(3, int(n.max()))), np.int32)
    out[np.repeat(np.arange(len(words)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = code
    return out


def triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """phi of each word in coordinates: word number, triple number, weight."""
    c = _classes(words)
    rows, cols, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b in _GAPS:
        if c.shape[1] <= b:
            continue
        x, y, z = c[:, : c.shape[1] - b], c[:, a : c.shape[1] - b + a], c[:, b:]
        r, at = np.nonzero(z)
        rows.append(r)
        cols.append((x[r, at].astype(np.int64) * CLASSES + y[r, at]) * CLASSES + z[r, at])
        weights.append(np.full(len(r), DECAY ** (b + 1)))
    row, col, weight = np.concatenate(rows), np.concatenate(cols), np.concatenate(weights)
    key, inverse = np.unique(row * CLASSES**3 + col, return_inverse=True)
    return key // CLASSES**3, key % CLASSES**3, np.bincount(inverse, weight, len(key))


def unit_triples(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`triples`, each word's phi divided by its length."""
    row, col, weight = triples(words)
    norm = np.sqrt(np.bincount(row, weight * weight, len(words)))
    return row, col, weight / norm[row]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised kernel of each word with each landmark."""
    lr, lc, lw = unit_triples(landmarks)
    known = np.unique(lc)
    dense = np.zeros((len(landmarks), len(known)))
    dense[lr, np.searchsorted(known, lc)] = lw
    out = np.zeros((len(words), len(landmarks)))
    for at in range(0, len(words), 500):
        row, col, weight = unit_triples(words[at : at + 500])
        place = np.minimum(np.searchsorted(known, col), len(known) - 1)
        shared = known[place] == col
        row, place, weight = row[shared], place[shared], weight[shared]
        cuts = np.flatnonzero(np.diff(row, prepend=-1))
        if len(cuts):
            out[at + row[cuts]] = np.add.reduceat(dense[:, place] * weight, cuts, axis=1).T
    return out


def decide(words: list[str], table: np.ndarray) -> np.ndarray:
    """Value of the linear machine ``table`` over unit phi for each word (0 for words shorter than a triple)."""
    value = np.zeros(len(words))
    order = np.argsort(np.fromiter(map(len, words), np.int64, len(words)), kind="stable")
    for at in range(0, len(order), 2000):  # words of like length, so that little is padded
        part = order[at : at + 2000]
        c = _classes([words[i] for i in part.tolist()])
        top, square = np.zeros(len(part)), np.zeros(len(part))
        for a, b in _GAPS:
            if c.shape[1] <= b:
                continue
            z = c[:, b:]
            w = DECAY ** (b + 1)
            place = (c[:, : c.shape[1] - b] * CLASSES + c[:, a : c.shape[1] - b + a]) * CLASSES + z
            top += w * np.where(z > 0, table[place], 0).sum(axis=1)
            square += w * w * (z > 0).sum(axis=1)
        value[part] = top / np.sqrt(np.maximum(square, 1e-12))
    again = [i for i, w in enumerate(words) if len(set(w)) < len(w)]  # only these can hold a triple twice, so that its weights add up
    for at in range(0, len(again), 5000):
        part = again[at : at + 5000]
        row, col, weight = unit_triples([words[i] for i in part])
        value[part] = np.bincount(row, weight * table[col], len(part))
    return value


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """Linear hinge-loss machine, ``COST * weight`` a row, by coordinate descent in the dual; the last column's offset is left out."""
    rng, x = np.random.default_rng(seed), np.hstack([x, np.ones((len(x), 1))])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    square, most = (x * x).sum(axis=1), COST * weight
    active = np.arange(len(x))
    for sweep in range(SWEEPS):
        for i in rng.permutation(active).tolist():
            new = min(max(alpha[i] + (1 - y[i] * (w @ x[i])) / square[i], 0.0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        # Every fifth sweep goes over all rows, those between over the rows that bear on the margin.
        active = np.arange(len(x)) if sweep % 5 == 3 else np.flatnonzero((alpha > 0) | (y * (x @ w) < 1))
    return w[:-1]


def _excess(words: list[str], bags: list[np.ndarray], ys: np.ndarray) -> np.ndarray:
    """For each word the largest lower bound (``DEVIATIONS``) of the log-odds that a text with one of its runs is toxic.

    Runs are the word itself and its stretches of ``RUNS`` characters; odds are against those of any text.
    """
    number: dict[str, int] = {}
    runs = [np.array(sorted({number.setdefault(w[i : i + n], len(number)) for n in RUNS for i in range(len(w) - n + 1)} | {number.setdefault(w, len(number))})) for w in words]
    seen = np.zeros((2, len(number)))
    for bag, y in zip(bags, ys):
        if len(bag):
            seen[y, np.unique(np.concatenate([runs[i] for i in bag]))] += 1
    total = np.bincount(ys, minlength=2)[:, None]
    odds = np.log((seen[1] + 0.5) / (seen[0] + 0.5)) - np.log((total[1] + 1.0) / (total[0] + 1.0))
    low = odds - DEVIATIONS * np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    return np.array([low[r].max() for r in runs])


def _machine(texts: list[tuple[str, int]], rng: np.random.Generator, seed: int) -> np.ndarray:
    """The table of triples of the machine learned from (text, label) pairs."""
    bags, ys = [sorted(instances(t)) for t, _ in texts], np.array([y for _, y in texts])
    words = sorted({w for bag in bags for w in bag})
    number = {w: i for i, w in enumerate(words)}
    bags = [np.array([number[w] for w in bag], np.int64) for bag in bags]
    # To begin with: how surely toxic texts hold a run of characters of the word more often than clean ones.
    seen = np.zeros((2, len(words)))
    for bag, y in zip(bags, ys):
        seen[y, bag] += 1
    value = _excess(words, bags, ys)
    insult = (value > min(EVIDENCE, value.max(initial=0.0) / 2)) & (seen[1] > seen[0])
    clean = np.flatnonzero(seen[0])

    def values(table: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(decide(words[i : i + 20000], table) for i in range(0, len(words), 20000))])

    table = np.zeros(CLASSES**3, np.float32)
    for step in range(ROUNDS):
        value = values(table) if step else value
        good, bad = np.zeros(len(words)), np.zeros(len(words))
        for bag, y in zip(bags, ys):
            worst = bag[np.argsort(-value[bag], kind="stable")[:3]]
            if y:  # a text may hold several insults; one without any names none
                worst = worst[insult[worst]]
            (good if y else bad)[worst] = 1
        pos = np.flatnonzero(good)
        bad[rng.choice(clean, min(len(clean), 3000), replace=False)] = 1
        neg = np.flatnonzero((bad > 0) & (seen[0] > 0))  # a word of both kinds of texts counts on both sides
        if not len(pos) or not len(neg):
            break
        pos, neg = pos[np.argsort(-seen[1, pos], kind="stable")], neg[np.argsort(-value[neg], kind="stable")]
        marks = [words[i] for i in dict.fromkeys([*pos[: LANDMARKS * 3 // 4].tolist(), *neg[:LANDMARKS].tolist()])][:LANDMARKS]
        around = kernel(marks, marks)
        vals, vecs = np.linalg.eigh(around)
        root = (vecs / np.sqrt(np.maximum(vals, 1e-6))) @ vecs.T  # K(landmarks)^(-1/2)
        x = kernel([words[i] for i in np.concatenate([pos, neg])], marks) @ root
        y = np.repeat([1.0, -1.0], [len(pos), len(neg)])
        weight = np.concatenate([seen[1, pos], seen[0, neg]])
        w = _svm(x, y, weight, seed)
        row, col, size = unit_triples(marks)
        table = np.bincount(col, size * (root @ w)[row], CLASSES**3).astype(np.float32)
    return table


def train(rows: list[tuple[str, int]], counts: dict[int, int], seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, values, shares): a text's probability is read from the line through (values, shares) at its largest value."""
    texts = sorted({(t, y) for t, y in rows})
    rng = np.random.default_rng(seed)
    apart = rng.random(len(texts)) < APART
    ys = np.array([y for _, y in texts])
    if len(set(ys[apart].tolist())) < 2 or len(set(ys[~apart].tolist())) < 2:  # too few texts: the same ones serve both
        learned = judged = range(len(texts))
    else:
        learned, judged = np.flatnonzero(~apart).tolist(), np.flatnonzero(apart).tolist()
    table = _machine([texts[i] for i in learned], rng, seed)
    bags, ys = [sorted(instances(texts[i][0])) for i in judged], ys[list(judged)]
    top = np.array([decide(b, table).max() if b else 0.0 for b in bags])
    # Shares of toxic texts by value, rising only (pooled neighbours), weighted to the class counts of all labelled rows.
    share = np.bincount(ys, minlength=2) / np.array([max(1, counts.get(c, 0)) for c in (0, 1)])
    weight = 1 / share[ys]
    weight *= len(ys) / weight.sum()
    blocks: list[list[float]] = []  # rows, toxic rows, least and largest value
    for at in np.unique(top):
        here = top == at
        blocks.append([weight[here].sum(), weight[here & (ys == 1)].sum(), at, at])
        while len(blocks) > 1 and blocks[-1][1] * blocks[-2][0] <= blocks[-2][1] * blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    n, bad, least, most = np.array(blocks).T
    return table, np.column_stack([least, most]).ravel(), np.repeat(np.maximum.accumulate((bad + 0.5) / (n + 1)), 2)


def fit(docs: DataFrame, labels: DataFrame, exclude: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text"):
    """The machine learned from labelled rows where ``exclude`` (over ``__id``) is false; trained in one executor task."""
    rows, counts = labelled_sample(docs, labels, "toxic", exclude, sample, id_col, text_col)

    def learn(rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len({y for _, y in rows}) < 2:
            share = (counts.get(1, 0) + 0.5) / (counts.get(0, 0) + counts.get(1, 0) + 1)
            return np.zeros(CLASSES**3, np.float32), np.zeros(1), np.array([share])
        return train(rows, counts)

    return fit_in_task(rows, learn)


def score_column(model, text_col: str = "text") -> Column:
    """Probability that a whole text is toxic."""
    table, values, shares = model

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        known: dict[str, float] = {}
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 64):
            bags = [instances(t) for t in texts.iloc[at : at + 64]]
            new = list(set().union(*bags).difference(known))
            if len(known) + len(new) > _CACHE_LIMIT:
                known.clear()
                new = list(set().union(*bags))
            known.update(zip(new, decide(new, table).tolist()))
            top = np.array([max(map(known.__getitem__, bag), default=0.0) for bag in bags])
            out[at : at + len(bags)] = np.interp(top, values, shares)
        return pd.Series(out)

    return toxicity(F.col(text_col))
