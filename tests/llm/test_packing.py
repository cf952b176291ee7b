"""Packing: exact round trip of ids, gapless sequences, little padding."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from answerscore.llm import packing as P

TEXTS = ["", None, "plain words here", "  two  spaces ", "line\n\nbreaks \n end", "<|endoftext|> inside", "naïve café — 12,5 don't", "a " * 5000, "tab\tand\u00a0nbsp \u2003em", "x" * 300, " lead", "trail ", "\x1c \x1f odd"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.tokenizer_path("byte_bpe_50k.json"))


def test_chunks_equal_the_tokenizer(tokenizer):
    coder = P.chunks(P.tokenizer_path("byte_bpe_50k.json"), P.tokenizer_path("byte_bpe_50k.tiktoken"))
    for text in TEXTS:
        got = np.frombuffer(coder.encode(text or ""), "<u2").tolist()
        assert got == tokenizer.encode(text or "", add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.text("ab '.,12\n\t é\u00a0\u3000中<|>endoftx", max_size=300)))
def test_chunks_equal_the_tokenizer_on_random_texts(tokenizer, text):
    text = text.encode("utf-8", "ignore").decode()
    coder = P.chunks(P.tokenizer_path("byte_bpe_50k.json"), P.tokenizer_path("byte_bpe_50k.tiktoken"))
    assert np.frombuffer(coder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_solver_meets_the_conditions_of_least_squares():
    rng = np.random.default_rng(2)
    histogram = rng.integers(0, 400, 64)
    histogram[0] = 0
    combos = P.combinations(histogram, 64)
    a = np.zeros((64, len(combos)))
    for i in range(3):
        np.add.at(a, (combos[:, i], np.arange(len(combos))), 1)
    a[0] = 0
    x = P.solve(combos, histogram, 20_000)
    slope = a.T @ (a @ x - histogram)
    assert (x >= 0).all() and slope.min() > -1 and abs(slope @ x) < 1e-3 * (histogram @ histogram)
    assert (P.combinations(histogram, 64).sum(axis=1) == 64).all()


def check(rows, ids):
    for doc, wanted in ids.items():
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(wanted)
            assert zlib.crc32(wanted[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(wanted)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= P.WINDOW
        short += at < P.WINDOW
    assert short <= 1


def test_round_trip(spark, tokenizer):
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join("wordy" for _ in range(n)) for n in rng.integers(1, 3000, 60).tolist()]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    check(P.pack(docs).collect(), ids)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "a b c")], "doc_id long, text string")
    rows = P.pack(docs).collect()
    assert len(rows) == 6 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 6


def test_solution_is_feasible_and_fits():
    rng = np.random.default_rng(0)
    h = np.bincount(rng.integers(1, 2048, 20000), minlength=2048)
    h[0] = 0
    slots, used, made = P.plan(h)
    assert (used <= h).all() and sum(s[0] for row in slots for s in row) == used.sum()
    assert (used * np.arange(2048)).sum() == made * P.WINDOW
    assert used.sum() > 0.5 * h.sum()
    combos = P.combinations(h)
    assert (combos.sum(axis=1) == P.WINDOW).all()
    assert (P.solve(combos, h) >= 0).all()
