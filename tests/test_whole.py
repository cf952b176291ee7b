"""Features of whole texts: against token rows, beyond their bounds, against the SQL of the queries, and without shuffles of tokens."""

from __future__ import annotations

import glob
import os
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from answerscore.functions import text as T
from answerscore.operators import features as FE
from answerscore.operators import whole
from answerscore.operators.score import guards, score, score_whole
from answerscore.plans import inputs as I
from answerscore.plans import registry

from .conftest import SF

PIECES = """the The not no No US USA United States Unions of America NAA National Aeronautics Agency AB 3.1 3,100 3.1M 3 m 5k k billion Million 2.6
two Seven ten one 1,250.75 0 1 22C 22 rise rose fell yes true false fake real open runs passed classes boxes quickly é über Málaga 5é é5 1.2.3 1..2
4,a . , ; ! ? : - thousand 1e5 10T tn 12mn K ZZ ABC Able Baker Charlie x Is valid 1000000 1,000,000 1005 日本 🙂 unable don't""".split()
BENCH = ("lex_fbeta_bench", "score_bench")


def random_triples(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    text = lambda: "".join(r.choice(PIECES) + r.choice((" ", " ", " ", ", ", ". ", "", "\n", "-")) for _ in range(r.choice((0, 1, 2, 5, 20, 60))))
    rows = []
    for i in range(n):
        q, gt, a = text(), text(), text()
        if i % 4 == 0:
            a = gt.replace("not ", "").replace("3.1", "3.101") + a
        rows.append((str(i), q, gt, a))
    return rows


def test_features_equal_those_of_token_rows(spark):
    triples = spark.createDataFrame(random_triples(1, 400), "id string, q string, gt string, a string").union(I.triples_cases(spark))
    rows = {r["id"]: r for r in FE.features(triples).collect()}
    mine = {r["id"]: r for r in whole.whole_features(triples).filter("p_tot is not null").collect()}
    assert mine.keys() == rows.keys()
    for key, row in rows.items():
        for c in whole.ALL:
            assert mine[key][c] == pytest.approx(row[c], abs=1e-9), (key, c)
    theirs = {r["id"]: r["score"] for r in score(triples).collect()}
    assert {r["id"]: r["score"] for r in score_whole(triples).collect()} == pytest.approx(theirs, abs=1e-9)


def test_nulls_blanks_and_texts_without_tokens(spark):
    rows = [("a", None, None, None), ("b", "q", "gt", " \t"), ("c", None, "same text", "Same text!"), ("d", "q", "!!", "??"), ("e", "q", "gt", "..."), ("f", "q", "", "gt")]
    triples = spark.createDataFrame(rows, "id string, q string, gt string, a string")
    assert {r["id"]: r["score"] for r in score_whole(triples).collect()} == {"a": 0.0, "b": 0.0, "c": 1.0, "d": 1.0, "e": 0.0, "f": 0.0}
    assert score_whole(triples.limit(0)).count() == 0


def test_long_texts_are_split_the_same_in_pieces(monkeypatch):
    text = " ".join(random.Random(2).choices(PIECES, k=3000))
    words = whole.Words()
    plain, grams = words.split(text), [set(whole.different(g).tolist()) for g in whole.byte_grams(text)]
    for size in (1, 7, 64):
        monkeypatch.setattr(whole, "PIECE", size)
        assert (words.split(text) == plain).all()
        assert [set(whole.different(g).tolist()) for g in whole.byte_grams(text)] == grams


def long_tables(folder) -> str:
    """Tables whose documents say something new after token 2,048 and, once, after byte 65,536."""
    passages = ["Aurora holds 2.6 billion dollars.", "The Danube does not flow through Vienna."]
    filler, late = "word " * 2048, "z" * 70_000 + " "
    docs = [filler + passages[0], filler + "The Danube does flow through Vienna.", late + passages[0], late + passages[1], "Aurora holds 2.6 billion.", filler]
    pq.write_table(pa.table({"item_id": pa.array(range(2), pa.int64()), "text": passages}), f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(docs)), pa.int64()), "text": docs}), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", BENCH)
def test_bench_queries_read_whole_texts(spark, tmp_path, name):
    sf = long_tables(tmp_path)
    mine = {r["id"]: r.asDict() for r in registry.QUERIES[name](spark, sf).collect()}
    assert len(mine) == 6
    of = "r" if name == "lex_fbeta_bench" else "score"
    assert mine["0"][of] > 2 * mine["5"][of]  # what the passage says comes after 2,048 tokens
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    result = con.execute(registry.ORACLE[name])
    names = [d[0] for d in result.description]
    theirs = {row[names.index("id")]: dict(zip(names, row)) for row in result.fetchall()}
    assert mine.keys() == theirs.keys()
    for key, row in theirs.items():
        assert mine[key] == {c: v if c == "id" else pytest.approx(float(v), abs=2e-6) for c, v in row.items()}


@pytest.mark.parametrize("name", BENCH)
def test_bench_queries_neither_write_tokens_nor_shuffle_documents(spark, monkeypatch, name):
    def written(df, table):
        raise AssertionError(f"{table} is written")

    for module in ("features", "score"):
        monkeypatch.setattr(f"answerscore.operators.{module}.materialised", written)
    monkeypatch.setattr("answerscore.plans.scoring.materialised", written)
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    above = plan[: plan.index("MapInArrow")]
    assert "Join" not in above and "Aggregate" not in above and "Window" not in above


def test_whole_texts_are_compared_only_if_their_beginnings_agree(spark, monkeypatch):
    rows = [("a", "The Danube flows.", "the " * 50_000), ("b", "A", "b"), ("c", "é", "e")]
    triples = spark.createDataFrame(rows, "id string, gt string, a string")
    monkeypatch.setattr(T, "normalised", lambda s: F.when(F.length(s) > 0, F.raise_error(F.lit("normalised")).cast("string")))
    assert [r["guard"] for r in guards(triples).collect()] == [None] * 3
    with pytest.raises(Exception, match="normalised"):
        guards(triples.withColumn("a", F.upper("gt"))).collect()


def test_guard_of_equal_texts(spark):
    r = random.Random(3)
    plain = lambda s: re.sub(r"(?<![0-9])[.,]|[.,](?![0-9])|[\x00-+\-/:-@\[-`{-\x7f]+", "", s).translate({c: c + 32 for c in range(65, 91)})
    rows = []
    for i in range(600):
        gt = "".join(r.choice("aAbé1 2.,-日\n") for _ in range(r.choice((1, 3, 70, 200)))) + "x"
        a = "".join(c.swapcase() if c.isascii() and r.random() < 0.5 else c for c in gt).replace(" ", r.choice((" ", " -" * 40)))
        if i % 3 == 0:
            spot = r.randrange(len(a))
            a = a[:spot] + r.choice("b.,1é ") + a[spot + 1 :]
        rows.append((str(i), "- " * r.choice((0, 0, 50)) + gt, a))
    found = {x["id"]: x["guard"] for x in guards(spark.createDataFrame(rows, "id string, gt string, a string")).collect()}
    equal = {key: 0.0 if not a.strip() else 1.0 if plain(gt) == plain(a) else None for key, gt, a in rows}
    assert found == equal
    assert 100 < sum(x is None for x in equal.values()) < 500
