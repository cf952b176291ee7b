"""Readers and writers of the evaluation files. All go through Spark, so any path Spark can reach will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscore.tables import materialised

CASES = "note string, cases array<struct<id: string, intent: string, question: string, ground_truth: string, good: string, bad: string>>"
ATTACKS = "note string, cases array<struct<name: string, rule: string, question: string, ground_truth: string, honest: string, attack: string, why: string>>"
TRAFFIC = "note string, rows array<struct<q: string, gt: string, a: string, model: string>>"
LEDGER = """intent string, profile string, hash string, url string, tx string, size int, values map<string, double>,
    metrics struct<margin: double, wins: string, spearman: double, family: struct<margin: double, wins: string>>"""
DUMP = "module string, scores map<string, double>, `order` array<string>"


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_cases(spark: SparkSession, path: str, attacks: bool = False) -> DataFrame:
    """Cases of a ``{cases: [...]}`` file in file order (column ``row``); a file without cases is an error."""
    rows = _json(spark, path, ATTACKS if attacks else CASES).select(F.posexplode("cases").alias("row", "c")).select("row", "c.*")
    if rows.isEmpty():
        raise ValueError(f"no cases in {path}")
    return rows


def read_traffic(spark: SparkSession, path: str) -> DataFrame:
    """(row, q, gt, a, model) of a ``{rows: [...]}`` file."""
    return _json(spark, path, TRAFFIC).select(F.posexplode("rows").alias("row", "r")).select("row", "r.*")


def read_cached_scores(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """(row, score) of a bare JSON array; another length than ``expected`` is an error."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", "array<double>")).alias("row", "score"))
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{path} has {n} scores, not {expected}")
    return rows


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, score) of score dumps; ``path`` may be a glob, the variant's name is the file's."""
    rows = _json(spark, path, DUMP).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json(?:/[^/]*)?$", 1).alias("file"), F.explode("scores").alias("id", "score"))
    return rows


def parsed_ids(dump: DataFrame) -> DataFrame:
    """Add what composite ids say: ``b:<case>:<kind>`` and ``tp:<case>:<kind>`` cases, ``t:<n>`` and ``<intent>|<n>`` rows."""
    parts = F.split("id", ":")
    case = F.rlike("id", F.lit("^(b|tp):"))
    row = F.coalesce(F.regexp_extract("id", r"^t:([0-9]+)$", 1), F.lit(""))
    row = F.when(row != "", row).otherwise(F.regexp_extract("id", r"^[^|]+\|([0-9]+)$", 1))
    return dump.select(
        "*", F.when(case, F.get(parts, F.lit(0))).alias("set"), F.when(case, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), ":")).alias("case"),
        F.when(case, F.element_at(parts, -1)).alias("kind"), F.when(F.contains("id", F.lit("|")), F.split_part(F.col("id"), F.lit("|"), F.lit(1))).alias("intent"), F.when(row != "", row.cast("int")).alias("row"),
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, LEDGER)


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def write_report(report: DataFrame, path: str, key: str = "module") -> None:
    """A report is a few rows: one indented JSON object, each row's other columns under its ``key``, in key order."""
    body = F.to_json(F.struct(*(c for c in report.columns if c != key)), {"pretty": "true", "ignoreNullFields": "false"})
    entry = F.concat(F.lit('  "'), F.col(key), F.lit('" : '), F.regexp_replace(body, "\n", "\n  "))
    entries = report.select(F.col(key), entry.alias("entry")).groupBy().agg(F.array_sort(F.collect_list(F.struct(key, "entry"))).alias("all"))
    text = F.concat(F.lit("{\n"), F.array_join(F.col("all.entry"), ",\n"), F.lit("\n}"))
    entries.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def traffic_scores(traffic: DataFrame, dump: DataFrame) -> DataFrame:
    """Traffic rows with the scores that dumps give them by their index; rows without one have none."""
    scores = parsed_ids(dump).filter("row is not null").select("file", "row", "intent", "score")
    return traffic.join(scores, "row", "left")


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(path)


def append_new(rows: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the Parquet table at ``path`` does not have yet; returns how many."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates([key])
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    rows = materialised(rows, "new")
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n
