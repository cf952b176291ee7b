"""Helpers shared by the corpus operators: tables in the shared folder, ordering, small text rules."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rule shared by the operators: a word is a run of other characters.
SPACE = r"\x20\x09-\x0D"
#: Bytes of text of one class that a fit may learn from.
SAMPLE_BYTES = 16 << 20
#: Bytes of text that a Python worker holds at once, besides the batch Spark gives it.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="answerscore-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/answerscore/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table from :func:`materialise` that no later step reads."""
    path = getattr(df, "_materialised", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def by_bytes(sizes: list[int | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, end) of slices of consecutive rows that hold ``limit`` bytes at most, or one row."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + (n or 0) > limit:
            yield first, i
            first, total = i, 0
        total += n or 0
    if first < len(sizes):
        yield first, len(sizes)


def text_of(column: str = "text") -> Column:
    """The text with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than white space (space, tab to carriage return)."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32 of the id as text leaves ``part`` when divided by ``parts``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def range_bucket(df: DataFrame, column: str, rows: int = 32_768, few: int = 512) -> tuple[DataFrame, str]:
    """Add ``__bucket``: the number of equal-frequency bounds at or below the value of a long column; about ``rows`` rows
    each, fewer (down to a sixteenth) where that leaves less than ``few`` buckets.

    Bounds come from one ``percentile_approx`` over the narrow column: one long for ``rows`` rows reaches the driver.
    They are searched in two steps, so a row costs twice the square root of their number in comparisons.  Rows of equal
    value share a bucket, buckets are in value order, and nulls come last.
    """
    count = df.count()
    n = count // min(rows, max(rows // 16, count // few, 1)) + 1
    bounds = df.select(F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    bounds = sorted(set(bounds or []))
    if bounds:
        wide = max(1, round(len(bounds) ** 0.5))
        parts = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]

        def array(values: list[int]) -> str:
            return "array(" + ",".join(f"{b}L" if b > -(2**63) else "-9223372036854775807L" for b in values) + ")"

        heads, inner = array([p[0] for p in parts]), "array(" + ",".join(map(array, parts)) + ")"
        df = df.withColumn("__part", F.expr(f"size(filter({heads}, b -> b <= `{column}`))"))
        found = F.expr(f"(__part - 1) * {wide} + size(filter({inner}[__part - 1], b -> b <= `{column}`))")
        bucket = F.when(F.col(column).isNull(), len(bounds) + 1).when(F.col("__part") == 0, 0).otherwise(found)
        return df.withColumn("__bucket", bucket).drop("__part"), "__bucket"
    return df.withColumn("__bucket", F.when(F.col(column).isNull(), 1).otherwise(0)), "__bucket"


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, exclude: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text", class_bytes: int = SAMPLE_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """Rows ``(id, text, y)`` to learn from, and the class counts: at most ``per_class`` rows and ``class_bytes`` bytes of each class.

    Rows are taken in the order of a hash of the id from all labelled rows where ``exclude`` is false; only ids
    and labels are sorted.  The sample is the one bounded part of a fit; the counts cover all labelled rows.  A text
    is taken whole or not at all, and the first of a class always.
    """
    usable = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).filter(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~exclude).distinct()
    counts = {int(r[0]): int(r[1]) for r in usable.groupBy("__y").count().collect()}
    picked = None
    for y in (0, 1):
        part = usable.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        picked = part if picked is None else picked.union(part)
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text")).join(F.broadcast(picked), F.col("__key") == F.col("__id"))
    upto = Window.partitionBy("__y").orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__text")).rowsBetween(Window.unboundedPreceding, -1)  # `per_class` ids at most
    rows = rows.withColumn("__n", F.octet_length(text_of("__text"))).withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    rows = rows.filter((F.col("__before") == 0) | (F.col("__before") + F.col("__n") <= class_bytes))
    return rows.select(F.col("__id").alias("id"), text_of("__text").alias("text"), F.col("__y").alias("y")), counts


def fit_in_task(rows: DataFrame, train: Callable[[list[tuple[str, int]]], tuple]) -> tuple:
    """``train`` over all (text, label) rows in one executor task; only the model, a tuple of arrays and numbers, comes back."""

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["id", "y", "text"], kind="stable")
        out = io.BytesIO()
        np.savez(out, *map(np.asarray, train(list(zip(part["text"], part["y"].tolist())))))
        return pd.DataFrame({"model": [out.getvalue()]})

    found = rows.groupBy().applyInPandas(learn, "model binary").first()
    if found is None:
        return train([])
    with np.load(io.BytesIO(bytes(found[0]))) as stored:
        return tuple(x if x.ndim else x.item() for x in (stored[k] for k in stored.files))
