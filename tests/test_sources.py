"""Files in and out, the ledger, the encoder and the stream."""

from __future__ import annotations

import json

import numpy as np
import pytest

from answerscore.functions.keccak import keccak_hex
from answerscore.operators import encoder
from answerscore.sources import files, vectors
from answerscore.streaming import status


def write(path, value):
    path.write_text(json.dumps(value))
    return str(path)


def test_cases_and_traffic(spark, tmp_path):
    path = write(tmp_path / "c.json", {"note": "n", "cases": [{"id": "1", "question": "q", "ground_truth": "g", "good": "a", "bad": "b", "intent": "i"}]})
    assert files.read_cases(spark, path).first()["ground_truth"] == "g"
    with pytest.raises(ValueError):
        files.read_cases(spark, write(tmp_path / "e.json", {"cases": []}))
    rows = files.read_traffic(spark, write(tmp_path / "t.json", {"rows": [{"q": "a", "gt": "b", "a": "c"}, {"q": "d", "gt": "e", "a": "f", "model": "m"}]}))
    assert [(r["row"], r["model"]) for r in rows.collect()] == [(0, None), (1, "m")]


def test_cached_scores_and_dumps(spark, tmp_path):
    path = write(tmp_path / "s.json", [0.5, 0.25])
    assert [tuple(r) for r in files.read_cached_scores(spark, path, 2).collect()] == [(0, 0.5), (1, 0.25)]
    with pytest.raises(ValueError):
        files.read_cached_scores(spark, path, 3)
    dump = files.read_dump(spark, write(tmp_path / "lex.json", {"module": "m", "scores": {"b:x:good": 1.0, "t:4": 0.5, "NEWS|007": 0.1}}))
    got = {r["id"]: (r["file"], r["set"], r["case"], r["kind"], r["intent"], r["row"]) for r in files.parsed_ids(dump).collect()}
    assert got == {"b:x:good": ("lex", "b", "x", "good", None, None), "t:4": ("lex", None, None, None, None, 4), "NEWS|007": ("lex", None, None, None, "NEWS", 7)}


def test_cached_scores_over_several_lines(spark, tmp_path):
    (tmp_path / "s.json").write_text("[0.5,\n 0.25,\n 1]\n")
    assert [r["score"] for r in files.read_cached_scores(spark, str(tmp_path / "s.json"), 3).collect()] == [0.5, 0.25, 1.0]


def test_registry_hash():
    assert keccak_hex(b"") == "0xc5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert len({keccak_hex(b"x" * n) for n in (134, 135, 136, 137, 300)}) == 5


def test_append_new_skips_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "q string, n int")
    path = str(tmp_path / "corpus")
    assert files.append_new(rows, path, "q") == 2
    assert files.append_new(rows.union(spark.createDataFrame([("c", 3)], "q string, n int")), path, "q") == 1
    assert spark.read.parquet(path).count() == 3


def test_word_vectors(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("cat 3 4\nCat 1 0\nbad-word 1 1\ndog 0 2\n")
    words = vectors.read_glove(spark, str(path))
    assert [r["word"] for r in words.orderBy("rank").collect()] == ["cat", "dog"]
    packed = {r["key"]: r["vec"] for r in vectors.packed(words).collect()}
    assert packed == {"cat": [76, 102], "dog": [0, 127]}


def test_status_changes_emit_every_flip(spark):
    rows = spark.createDataFrame([("k", "a", 1), ("k", "b", 2), ("k", "pending", 3), ("k", "b", 4), ("k", "a", 5), ("j", "a", 1)], "key string, status string, seq long")
    assert sorted((r["key"], r["seq"]) for r in status.changes_in_batch(rows).collect()) == [("j", 1), ("k", 1), ("k", 2), ("k", 5)]


def test_word_pieces_and_encoder(spark):
    vocabulary = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "the", "."])}
    assert encoder.word_pieces("The playing. zzz", vocabulary) == [2, 6, 4, 5, 7, 1, 3]
    assert encoder.spread(list(range(10)), 4) == [0, 1, 5, 9]
    rng, width = np.random.default_rng(0), 24
    w = {"embeddings.word_embeddings.weight": rng.normal(size=(8, width)), "embeddings.position_embeddings.weight": rng.normal(size=(128, width)), "embeddings.token_type_embeddings.weight": rng.normal(size=(2, width))}
    norms = ["embeddings.LayerNorm"]
    for layer in range(6):
        at = f"encoder.layer.{layer}."
        for name, shape in (("attention.self.query", (width, width)), ("attention.self.key", (width, width)), ("attention.self.value", (width, width)), ("attention.output.dense", (width, width)), ("intermediate.dense", (48, width)), ("output.dense", (width, 48))):
            w[at + name + ".weight"], w[at + name + ".bias"] = rng.normal(size=shape) / 5, np.zeros(shape[0])
        norms += [at + "attention.output.LayerNorm", at + "output.LayerNorm"]
    for name in norms:
        w[name + ".weight"], w[name + ".bias"] = np.ones(width), np.zeros(width)
    texts = spark.createDataFrame([("the playing",), ("the playing",), (None,), ("zzz .",)], "text string")
    found = encoder.sentence_vectors(texts, vocabulary, w).collect()
    assert len(found) == 3 and all(len(r["vecs"]) == 4 and abs(np.linalg.norm(r["vecs"][3]) - 1) < 1e-5 for r in found)
    triples = spark.createDataFrame([("1", "", "the playing", "the playing"), ("2", "zzz .", "the playing", "zzz .")], "id string, q string, gt string, a string")
    sims = {r["id"]: r for r in encoder.similarities(triples, encoder.sentence_vectors(texts, vocabulary, w)).collect()}
    assert sims["1"]["cb"] == pytest.approx(1, abs=1e-5) and sims["1"]["cq"] == sims["1"]["cb"] and sims["2"]["cq"] == pytest.approx(1, abs=1e-5)
