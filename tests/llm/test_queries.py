"""The registered queries of the small table: contracts of their columns."""

from __future__ import annotations

import re
import zlib

import pytest

from answerscore.llm import simhash, winnowing
from answerscore.llm.queries import QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("name, parts, part", [("op1_quality_classifier", 4, 2), ("op6_toxicity", 3, 1)])
def test_classifier_queries(spark, name, parts, part):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == part)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_simhash_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_simhash"](spark, SF).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    assert all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in rows) and prints == {i: simhash.fingerprint(t) for i, t in texts.items()}
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert {r["doc_id"]: r["component_id"] for r in rows} == label


def test_licence_and_winnowing_queries(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = QUERIES["op2_license_scan"](spark, SF).collect()
    assert len(rows) == n and any(r["licences"] for r in rows)
    rows = QUERIES["op10_winnowing"](spark, SF).collect()
    assert len(rows) == n and all(re.fullmatch("[0-9a-f]{64}", r["fingerprint"]) for r in rows)
    assert winnowing.K + winnowing.W - 1 == 8
