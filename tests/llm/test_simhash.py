"""SimHash fingerprints, BK-trees and components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash

from answerscore.llm import simhash as S


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \t", "one", "A b C", "É É é é a a a a", "x " * 3000, "a\x1cb c\x85d e f g", "Same words again and again and again"])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute(text)


def near_values(rng, n):
    base = rng.integers(0, 2**63, n // 10, dtype=np.uint64)
    out = np.repeat(base, 10)
    for _ in range(3):
        out ^= np.where(rng.random(len(out)) < 0.6, np.uint64(1) << rng.integers(0, 64, len(out), dtype=np.uint64), np.uint64(0))
    return np.unique(out)


def components(values, radius):
    labels = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    while True:
        new = np.array([labels[row].min() for row in near])
        if (new == labels).all():
            return labels
        labels = new


def test_tree_finds_all_within_the_radius():
    values = near_values(np.random.default_rng(1), 400)
    found = np.zeros((len(values), len(values)), bool)
    for item, hits in S.BKTree(values).within(values, 4):
        found[item, hits] = True
    assert (found == (np.bitwise_count(values[:, None] ^ values[None, :]) <= 4)).all()


@pytest.mark.parametrize("shard_rows", [20_000, 30, 2])
def test_links_span_the_components(spark, shard_rows):
    values = near_values(np.random.default_rng(2), 600)
    prints = spark.createDataFrame([(int(v) - (1 << 64) if v >= 1 << 63 else int(v), i) for i, v in enumerate(values.tolist())], "fp long, node long")
    got = {r["node"]: r["component"] for r in S.connected_components(S.fingerprint_links(prints, 4, shard_rows, 50)).collect()}
    assert [got.get(i, i) for i in range(len(values))] == components(values, 4).tolist()


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in S.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_groups_of_odd_rows(spark):
    rows = [(3, "a b c d e", "x"), (1, "A B C D E", "y"), (1, "A B C D E", "y"), (None, "a b c d e", "z"), (7, None, "z"), (8, " ", "z"), (9, "other words stand in this text", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in S.simhash_groups(docs).collect())
    assert got == [(-1, 1), (1, 1), (1, 1), (3, 1), (7, 7), (8, 7), (9, 9)]
    assert S.simhash_groups(docs.limit(0)).count() == 0


def test_ids_that_clash_or_are_null(spark):
    rows = [(1, "a b c d e"), (1, "other words stand in this text"), (None, "third words are a text of their own"), (None, "a b c d e"), (5, "other words stand in this text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["fp"], r["component_id"]) for r in S.simhash_groups(docs).collect())
    fps = {t: S.with_fingerprint(docs).filter(docs.text == t).first()["fp"] for _, t in rows}
    want = [(1, "a b c d e", 1), (1, "other words stand in this text", 1), (-1, "third words are a text of their own", None), (-1, "a b c d e", 1), (5, "other words stand in this text", 1)]
    assert got == sorted((i, fps[t], c) for i, t, c in want)
