"""Held-out accuracy and edge cases of the two classifiers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscore.llm import quality, toxicity
from answerscore.llm.common import labelled_sample

WORDS = ["river", "stone", "garden", "window", "summer", "winter", "letter", "silver", "market", "bridge", "yellow", "planet"]


def made(n, seed, bad):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(15, 60))]
        label = int(rng.random() < 0.4)
        rows.append((i, " ".join(bad(rng, words) if label else words), label))
    return rows


def shout(rng, words):
    return [rng.choice([w.upper() + "!!", w + "***"]) for w in words]


def insult(rng, words):
    at = rng.randrange(len(words))
    return words[:at] + [rng.choice(["blorgface", "zickwad", "blorgfaces"])] + words[at:]


def scored(spark, module, column, rows, label_of, extra):
    docs = spark.createDataFrame([(i, t, "other", 0.1) for i, t, _ in rows] + extra, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, label_of(y)) for i, _, y in rows] + [(None, 1), (10_000, None)], f"doc_id long, {column} int")
    model = module.fit(docs, labels, F.col("__id") % 4 == 2)
    return {r["doc_id"]: r["p"] for r in docs.select("doc_id", module.score_column(model).alias("p")).collect()}


EXTRA = [(900, None, None, None), (901, "", None, None), (902, "*** !!", None, None), (903, "river stone " * 20000, None, None), (904, "river stone " * 20000, None, None)]


def test_quality(spark):
    rows = made(240, 1, shout)
    got = scored(spark, quality, "quality", rows, lambda bad: 1 - bad, EXTRA)
    held = [(got[i], 1 - bad) for i, _, bad in rows if i % 4 == 2]
    assert np.mean([(p >= 0.5) == y for p, y in held]) >= 0.95
    assert got[900] == got[901] and got[903] == got[904] and all(0 <= p <= 1 for p in got.values())


def test_toxicity_and_inserted_characters(spark):
    rows = made(240, 2, insult)
    extra = [*EXTRA, (910, "the river blorgxface bridge", None, None), (911, "a blo-rg.fa-ce by the river", None, None), (912, "so z i c k w a d of you", None, None), (913, "summer letters " + "blorgface" * 5, None, None)]
    got = scored(spark, toxicity, "toxic", rows, lambda bad: bad, extra)
    held = [(got[i], bad) for i, _, bad in rows if i % 4 == 2]
    assert np.mean([(p >= 0.5) == y for p, y in held]) >= 0.95
    assert min(got[i] for i in (910, 911, 912, 913)) > 0.5 > max(got[900], got[902], got[903])
    assert got[900] == got[901] and all(0 <= p <= 1 for p in got.values())


def test_toxicity_of_stems_and_wrong_labels():
    rng, rows = random.Random(5), []
    for i in range(600):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(15, 60))]
        label = int(i % 4 == 0)
        if label and i % 40:  # one toxic label in ten is wrong
            words[3] = "zickwad" + rng.choice(["er", "en", "tz", "ung", "pf", "lich"])
        elif not label and i % 10 == 1:  # the stem alone is no insult
            words[3] = "zickwad"
        rows.append((" ".join(words), label))
    table, values, shares = toxicity.train(rows[:400], {0: 300, 1: 100})
    assert (np.diff(values) >= 0).all() and (np.diff(shares) >= 0).all()

    def score(text):
        return float(np.interp(toxicity.decide(sorted(toxicity.instances(text)), table).max(), values, shares))

    held = [(score(text) >= 0.7, "zickwad" in text and "zickwad " not in text + " ") for text, _ in rows[400:]]
    assert np.mean([p for p, y in held if y]) >= 0.9 and np.mean([p for p, y in held if not y]) <= 0.02


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_without_labels_of_both_classes(spark, module, column):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    for labels in ([], [(1, 1)]):
        model = module.fit(docs, spark.createDataFrame(labels, f"doc_id long, {column} int"), F.lit(False))
        assert all(0 <= r[0] <= 1 for r in docs.select(module.score_column(model)).collect())
    assert docs.limit(0).select(module.score_column(model)).count() == 0


def test_kernel_is_the_subsequence_kernel():
    def phi(s):
        out = {}
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.SPAN)):
                    out[s[i] + s[j] + s[k]] = out.get(s[i] + s[j] + s[k], 0) + toxicity.DECAY ** (k - i + 1)
        return out

    words = ["banana", "bandana", "xyz", "aaaaaa", "cabin"]

    def like(a, b):
        x, y = phi(a), phi(b)
        return sum(v * y.get(t, 0) for t, v in x.items()) / np.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    assert np.allclose(toxicity.kernel(words, words), [[like(a, b) for b in words] for a in words])
    table = np.random.default_rng(0).normal(size=toxicity.CLASSES**3).astype(np.float32)
    row, col, weight = toxicity.unit_triples(words)
    want = np.bincount(row, weight * table[col], len(words))
    for sign in (1, -1):
        got, true = toxicity.decide(words, sign * table), sign * want
        assert np.allclose(got[true > 0], true[true > 0], atol=1e-5) and (got[true <= 0] <= 1e-6).all()


def test_quality_score_by_its_definition(spark):
    rng = np.random.default_rng(1)
    scores = rng.normal(size=2 * quality.PAIRS).astype(np.float32)
    most = (1 << 64) - 1

    def key(chars, start):
        out = start
        for c in chars:
            out = (out * 1_000_003 + ord(c)) & most
        return out

    def word(w):
        out, power = 0, 1
        for c in f"<{w}>":
            power = power * 1_000_003 & most
            out = (out + ord(c) * power) & most
        return out

    def slot(k):
        return (k * 0x9E3779B97F4A7C15 & most) >> 64 - quality.BITS

    def brute(text):
        words = (text or "").split()
        total = 0.0
        for w in words:
            m = f"<{w}>"
            keys = [word(w)] + [key(m[i : i + n], n) for n in quality.NGRAMS for i in range(len(m) - n + 1)]
            total += np.mean([scores[max(1, slot(k))] for k in keys], dtype=np.float64)
        for a, b in zip(words, words[1:]):
            total += scores[0 if a == b else quality.PAIRS + slot(word(a) * 1_000_003 + word(b))]
        return 1 / (1 + math.exp(-(0.3 + total / max(1, 2 * len(words) - 1))))

    texts = [None, "", " ", "one", "a a a b", "Straße naïve 中文 x", "words of a longer text " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["i"]: r["p"] for r in docs.select("i", quality.score_column((scores, 0.3)).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [brute(t) for t in texts], atol=1e-6)


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + i)) for i in range(60)] + [(5, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    rows, counts = labelled_sample(docs, labels, "quality", F.lit(False), 8, class_bytes=200)
    got = rows.collect()
    assert counts == {0: 30, 1: 30} and {r["y"] for r in got} == {0, 1}
    for y in (0, 1):
        own = [len(r["text"]) for r in got if r["y"] == y]
        assert 1 <= len(own) <= 9 and (sum(own) <= 200 or len(own) == 1)
