"""All queries of the engine by name, with the SQL that says the same."""

from __future__ import annotations

from . import evaluation, files, scoring, vectors

QUERIES: dict = {**scoring.QUERIES, **evaluation.QUERIES, **vectors.QUERIES, **files.QUERIES}
ORACLE: dict[str, str] = {**scoring.ORACLE, **evaluation.ORACLE, **vectors.ORACLE, **files.ORACLE}
