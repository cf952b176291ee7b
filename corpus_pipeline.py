"""The corpus pipeline: quality, repeated lines, near-duplicates, source mix, packing.

Each stage takes what the one before it kept and returns the columns of ``documents``, but for the last, which
returns the packed pieces.  ``run`` writes every stage's result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscore.llm import line_dedup, mixing, near, packing, quality
from answerscore.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at or above the threshold, by a model of all labelled rows among them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(False))
    return docs.filter(quality.score_column(model) >= quality.THRESHOLD).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those with no line left go."""
    kept = line_dedup.strip(docs.select(*COLUMNS))
    return _measured(kept.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash candidates whose five-word shingles are confirmed as similar (0.8 or more)."""
    return near.keep_one(docs.select(*COLUMNS), shingle=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their copies in the mix."""
    return mixing.mix_copies(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
