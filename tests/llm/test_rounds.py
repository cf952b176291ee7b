"""Rounds that end before the components are found."""

from __future__ import annotations

import pytest

from answerscore.llm import simhash


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    with pytest.raises(RuntimeError):
        simhash.connected_components(links, max_rounds=2)
