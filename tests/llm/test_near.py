"""Groups of similar shingle sets against brute force."""

from __future__ import annotations

import random

from answerscore.llm import near


def brute(texts, shingle=5):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i].lower().split() == texts[j].lower().split() or sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = sorted((label[i], label[j]))[::-1]
                label = [new if x == old else x for x in label]
    return label


def test_one_of_each_group_of_similar_texts(spark):
    rng = random.Random(3)
    texts = ["", " ", "one two", "One  two", "one two three"]
    for size in (8, 12, 30, 60, 200, 400):
        for _ in range(4):
            base = [str(rng.randrange(10**6)) for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (0.01, 0.02, 0.03):  # similarities on both sides of 4/5
                texts.append(" ".join("new" + str(rng.random()) if rng.random() < edits else w for w in base))
            texts.append(" ".join(base[: int(size * 0.85)]))
    want = brute(texts)
    assert len(set(want)) < len(texts) - 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in near.keep_one(docs).collect()) == sorted(set(want))


def test_large_shards_are_split(spark):
    rng = random.Random(5)
    common = [str(rng.randrange(10**6)) for _ in range(100)]
    texts = [" ".join(common + [str(rng.randrange(10**6)) for _ in range(extra)]) for extra in (4, 12, 30, 60) for _ in range(8)]
    texts += [" ".join("new" if rng.random() < 0.03 else w for w in t.split()) for t in texts[::2]] + ["a " * n for n in range(4, 10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want, first = brute(texts), {}
    for i, label in enumerate(want):
        first.setdefault(label, i)
    for shard_rows in (20_000, 3):
        groups = near.similar_groups(docs, shard_rows=shard_rows).collect()
        least = {}
        for r in groups:
            least[r["component"]] = min(r["id"], least.get(r["component"], r["id"]))
        assert sorted((r["id"], least[r["component"]]) for r in groups) == [(i, first[x]) for i, x in enumerate(want)]


def test_rows_of_one_id_or_none(spark):
    base = " ".join(map(str, range(100)))
    rows = [(1, "other words stand in this text"), (1, base), (1, base), (2, base + " x"), (None, base + " x"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in near.keep_one(docs).collect())
    assert kept == [(-1, base + " x"), (1, base), (1, "other words stand in this text"), (3, None)]
    assert near.keep_one(docs.limit(0)).count() == 0
