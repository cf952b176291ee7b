"""Word-vector text files and packed vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscore.functions import text as T
from answerscore.operators.vectors import centred, quantised


def read_glove(spark: SparkSession, path: str, limit: int = 40_000) -> DataFrame:
    """(rank, word, vec) of lines ``word x1 x2 ...``: ASCII letters and digits only, first of equal keys, first ``limit``.

    The line order of the file counts; it is kept by ids that grow along the scan.
    """
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    parts = lines.select("line", F.split(F.trim("value"), " +").alias("p")).filter(F.rlike(F.get(F.col("p"), F.lit(0)), F.lit("^[A-Za-z0-9]+$")) & (F.size("p") > 1))
    rows = parts.select("line", F.get(F.col("p"), F.lit(0)).alias("word"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("double")).alias("vec"))
    first = Window.partitionBy(T.word_key(F.col("word"))).orderBy("line")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").orderBy("line").limit(limit)
    return rows.select(F.col("line").alias("rank"), "word", "vec")


def read_distilled(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """(word, vec) of lines whose last ``dim`` fields are numbers; lower-case ASCII words only, the first line of each."""
    p = F.col("p")
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    rows = lines.select("line", F.split(F.trim("value"), " +").alias("p")).filter(F.size("p") == dim + 1)
    rows = rows.select("line", F.lower(F.get(p, F.lit(0))).alias("word"), F.transform(F.slice(p, F.lit(2), F.lit(dim)), lambda x: x.cast("double")).alias("vec"))
    return rows.filter(F.rlike("word", F.lit("^[a-z0-9]+$"))).groupBy("word").agg(F.min_by("vec", "line").alias("vec"))


def packed(words: DataFrame, centre: bool = False) -> DataFrame:
    """(key, hash, vec of int8), ordered by hash: the table that word-vector features join with."""
    if centre:
        words = centred(words, "vec", "vec")
    out = quantised(words, "vec", "vec").select(T.word_key(F.col("word")).alias("key"), "vec")
    return out.withColumn("hash", T.fnv1a(F.col("key"))).select("key", "hash", "vec")


def write_packed(table: DataFrame, path: str) -> None:
    table.repartitionByRange("hash").sortWithinPartitions("hash").write.mode("overwrite").parquet(path)
