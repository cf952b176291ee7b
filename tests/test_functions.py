"""Scalar functions against plain Python."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from answerscore.functions import calibration as C
from answerscore.functions import text as T


def values(spark, rows, *columns):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").orderBy("i")
    return [tuple(r) for r in df.select(*columns).collect()]


def test_tokens_keep_separators_between_digits(spark):
    got = values(spark, ["1,000 and 3.14.", "don't", "é1 x", "", "a.b 1.a"], T.tokens(F.col("s")))
    assert [g[0] for g in got] == [["1,000", "and", "3.14"], ["don", "t"], ["é1", "x"], [], ["a", "b", "1", "a"]]


def test_stems_and_alternatives(spark):
    got = values(spark, ["running", "priced", "makes", "loss", "22C", "seven", "1,5km", "Runs"], T.stem(F.col("s")), T.alternative(F.col("s")), T.token_key(F.col("s")))
    assert got == [("runn", "running", "running"), ("pric", "price", "priced"), ("make", "makes", "makes"), ("loss", "loss", "loss"), ("22c", "22", "22c"), ("7", "7", "7"), ("15km", "15", "15km"), ("runs", "runs", "runs")]


def test_fnv_matches_its_definition(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    words = ["", "a", "über", "seven"]
    assert [g[0] for g in values(spark, words, T.fnv1a(F.col("s")))] == [fnv(w) for w in words]


def test_leading_values_and_scales(spark):
    got = values(spark, ["3,120", "228.50", "3.1T", "x9", "7."], T.leading_value(F.col("s")), T.scale(F.col("s"), T.token_key(F.col("s"))))
    assert got == [(3120.0, 0), (228.5, 0), (3.1, 12), (0.0, 0), (7.0, 0)]


@pytest.mark.parametrize("n", [2, 3])
def test_gram_slots_match_bytes(spark, n):
    text = "  Über-Maß, 1.5x\n--end. "

    def slots(s):
        out, last = [], True
        for b in s.encode():
            word = b >= 128 or chr(b).isalnum()
            if word:
                out.append(b + 32 if 65 <= b <= 90 else b)
            elif not last:
                out.append(32)
            last = not word
        grams = {int.from_bytes(bytes(out[i : i + n]), "big") for i in range(len(out) - n + 1)}
        return {((g * 0x9E3779B1 & 0xFFFFFFFF) >> 13) & 131071 for g in grams}

    df = spark.createDataFrame([(text,), (None,), ("a",)], "s string")
    got = [set(r[0]) for r in T.with_gram_slots(df, "s", "g", n).select("g").collect()]
    assert got == [slots(text), set(), set()]


def test_calibration(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.9,), (float("nan"),)], "x double")
    x = F.col("x")
    rows = df.select(C.clamp01(x), C.soft_credit(x), C.step_tiebreak(x, x, 0.5, 0.02), C.smoothsteps(x, 1), C.rel_close(x, x * 1.004)).collect()
    assert rows[1][0] == 0.5 and rows[3][0] == 0.0
    assert rows[1][1] == 0.0 and rows[2][1] == pytest.approx((0.18 / 0.28) ** 2)
    assert rows[1][2] == pytest.approx(0.99) and rows[0][2] == 0.0
    assert rows[1][3] == 0.5 and all(r[4] for r in rows[:3])


def test_blank_and_normalised(spark):
    got = values(spark, [" \t\n", "\x0b", "A-1.5!", "a15"], T.is_blank(F.col("s")), T.normalised(F.col("s")))
    assert [g[0] for g in got] == [True, False, False, False]
    assert got[2][1] == "a1.5" and got[3][1] == "a15"


def test_json_in_prose(spark):
    got = values(spark, ['Here: ["a", " ", "b"] done', "```json\n{}\n```"], T.json_array_in(F.col("s")), T.unfenced(F.col("s")))
    assert got[0][0] == ["a", "b"] and got[1][1] == "{}"


def test_tie_sources_that_are_not_there(spark):
    from dataclasses import replace

    from answerscore.config import LEXICAL, grid
    from answerscore.functions.calibration import calibrated
    from answerscore.operators.score import score
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        calibrated(F.lit(0.5), replace(LEXICAL, step_t=0.5, tie_src=9))
    with pytest.raises(ValueError):
        calibrated(F.lit(0.5), replace(LEXICAL, step_t=0.5, tie_src=4))
    with pytest.raises(ValueError):
        score(spark.createDataFrame([("1", "q", "a b", "a c")], "id string, q string, gt string, a string"), replace(LEXICAL, w_emb=0.5))
    assert len(grid(LEXICAL, m_negcov=[0.1, 0.2, 0.3], limit=2)) == 2 and not grid(LEXICAL, w_lex=[0.5], w_gram3=[0.1])


def test_soft_budget(spark):
    from answerscore.operators.features import precision

    rows = [("x", "a", i, 10_000, None, False, i == 1) for i in range(6)]
    marked = spark.createDataFrame(rows, "id string, side string, pos int, w long, at_other int, hit boolean, in_q boolean")
    soft = spark.createDataFrame([("x", "a", i, 0.5) for i in range(6)], "id string, side string, pos int, credit double")
    assert [precision(marked, soft, n).first()["p_hit"] for n in (512, 2, 0)] == [2.5, 1.0, 0.0]
