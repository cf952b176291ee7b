"""Winnowing against its definition."""

from __future__ import annotations

import hashlib
import random

import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerscore.llm import winnowing as W


def positions(hashes, w):
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        if window:
            out.append(i + max(j for j, h in enumerate(window) if h == min(window)))
    return sorted(set(out))


def rolling(words):
    """Cyclic polynomial of word hashes, as a signed long."""
    out = 0
    for x in words:
        out = ((out << 1 | out >> 63) & (1 << 64) - 1) ^ xxhash.xxh64_intdigest(x.encode(), 42)
    return out - (1 << 64) if out >> 63 else out


def prints(text):
    words = text.split()
    hashes = [rolling(words[i : i + W.K]) for i in range(max(1, len(words) - W.K + 1))] if words else []
    return {hashes[i] for i in positions(hashes, W.W)}, positions(hashes, W.W)


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text("ab \t", max_size=60), min_size=1, max_size=20), w=st.integers(1, 9), k=st.integers(1, 5))
def test_least_hashes_with_rightmost_ties(spark, texts, w, k):
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    rows = W.winnow(W.winnow(df, "t", "all", k, 1), "t", "got", k, w).collect()
    for r in rows:
        hashes = [x["hash"] for x in r["all"]]
        words = (r["t"] or "").split()
        assert len(hashes) == (max(1, len(words) - k + 1) if words else 0)
        assert hashes == [rolling(words[i : i + k]) for i in range(len(hashes))]
        assert [x["pos"] for x in r["got"]] == positions(hashes, w)
        assert all(x["hash"] == hashes[x["pos"]] for x in r["got"])


def test_shared_passages_leave_a_common_fingerprint(spark):
    shared = " ".join(f"s{i}" for i in range(W.K + W.W - 1))
    df = spark.createDataFrame([("a b c " + shared + " d e",), (" ".join(f"u{i}" for i in range(40)) + "\n" + shared,)], "t string")
    a, b = ({x["hash"] for x in r["p"]} for r in W.winnow(df, "t", "p").collect())
    assert a & b


def test_edited_texts(spark):
    texts = {5: "one two three four five six seven eight", 2: "äöü ß " * 30, 9: None, 11: "", 3: "x"}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_chars int")
    order = sorted(texts)
    got = {r["doc_id"]: r for r in W.compare_edited(docs).collect()}
    assert sorted(got) == order
    for i, j in zip(order, [*order[1:], order[0]]):
        a, b = texts[i] or "", texts[j] or ""
        q = len(a) // 4
        assert got[i]["n_chars"] == len(a)
        assert got[i]["edited_sha256"] == hashlib.sha256((a[: len(a) - q] + b[:q]).encode()).hexdigest()
        own, places = prints(a)
        assert got[i]["positions"] == places
        assert abs(got[i]["near_edited"] - dice(own, prints(a[: len(a) - q] + b[:q])[0])) < 1e-12
        assert abs(got[i]["near_next"] - dice(own, prints(b)[0])) < 1e-12
    assert got[9]["fingerprint"] == got[11]["fingerprint"]
    single = W.compare_edited(docs.filter(F.col("doc_id") == 5)).collect()
    assert single[0]["near_next"] == 1.0
    assert W.compare_edited(docs.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c d e"), (2, "f")], "doc_id long, text string")
    assert W.compare_edited(docs).count() == 4


def test_next_rows_over_many_buckets(spark):
    rng = random.Random(1)
    ids = [rng.randrange(-50, 60) for _ in range(150)] + [None, None, -(2**63), 2**63 - 1]
    docs = spark.createDataFrame([(i, f"t{n:03}", n) for n, i in enumerate(ids)], "id long, text string, n long")
    want = sorted(((i is None, i or 0, f"t{n:03}") for n, i in enumerate(ids)))
    for rows in (1000, 20, 2):
        got = {r["text"]: r["next_text"] for r in W.with_next(docs, "id", ["text"], bucket_rows=rows).collect()}
        assert got == {a[2]: b[2] for a, b in zip(want, [*want[1:], want[0]])}
