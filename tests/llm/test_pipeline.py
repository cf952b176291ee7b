"""The pipeline's stages on a small table of planted cases."""

from __future__ import annotations

import corpus_pipeline as P
from tests.conftest import SF


def test_stages_on_the_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == list(P.COLUMNS), name
        docs = P.materialise(out, "stage")
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] > 0
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert pieces.count() >= counts[4]
    total = pieces.groupBy("sequence_id").sum("length").collect()
    assert sum(r[1] < 2048 for r in total) <= 1


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "t", 0), (None, "x y z " * 10, "en", None, 60)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for _, stage in P.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n >= 0
            if out.columns == list(P.COLUMNS):
                docs = out
