"""Queries of the corpus operators over whole tables, with production parameters, and their SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gif, licences, line_dedup, mixing, packing, quality, simhash, toxicity, url_graph, winnowing
from .common import held_out, table


def _classified(spark: SparkSession, sf_dir: str, operator, parts: int, part: int) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = operator.fit(docs, labels, held_out(F.col("__id"), parts, part))
    out = docs.select("doc_id", held_out(F.col("doc_id"), parts, part).alias("held_out"), operator.score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= operator.THRESHOLD).cast("int"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality, 4, 2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").alias("n_sentences"), F.array_join(F.transform("sentences", lambda x: x["id"]), ",").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["licence"]))), ",").alias("licences"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.features(gif.store(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity, 3, 1)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_graph.judge(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.strip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("runs", lambda x: F.concat_ws("-", x["first"].cast("string"), x["end"].cast("string"))), ",").alias("runs"), F.array_join(F.transform("copies", lambda x: F.format_string("%d-%d=%d:%d", x["first"], x["end"], x["source"], x["source_first"])), ",").alias("copies"), "text")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_license_scan, op3_packing, op4_simhash, op5_media_gif, op6_toxicity, op7_url_filter, op8_line_dedup, op9_mixing, op10_winnowing)}


def _license_sql() -> str:
    """The licence scan in DuckDB SQL, from the same catalogue of sentences and rules."""
    known = ", ".join(f"('{form}', '{key}')" for key, forms in licences.SENTENCES.items() for form in forms)
    rules = ", ".join(f"('{licence}', '>{'>'.join(sequence)}>')" for licence, sequence in licences.RULES)
    lower = "translate(sentence, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    marked = r"regexp_replace(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), '\s*\n\s*', chr(1), 'g')"
    return rf"""WITH known AS (SELECT * FROM (VALUES {known}) t(form, id)), rules AS (SELECT * FROM (VALUES {rules}) t(licence, chain)),
cut AS (SELECT doc_id, regexp_split_to_array({marked}, chr(1)) AS parts FROM documents),
spread AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS sentence FROM cut),
found AS (SELECT s.doc_id, s.pos, k.id FROM spread s JOIN known k ON trim(regexp_replace(regexp_replace({lower}, '[^\p{{L}}\p{{N}}\s]+', '', 'g'), '\s+', ' ', 'g')) = k.form),
chains AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY pos) AS ids, '>' || string_agg(id, '>' ORDER BY pos) || '>' AS chain FROM found GROUP BY doc_id),
fits AS (SELECT c.doc_id, string_agg(DISTINCT r.licence, ',' ORDER BY r.licence) AS licences FROM chains c JOIN rules r ON contains(c.chain, r.chain) GROUP BY c.doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS INTEGER) AS n_sentences, coalesce(c.ids, '') AS sentence_ids, coalesce(f.licences, '') AS licences FROM documents d LEFT JOIN chains c ON c.doc_id = d.doc_id LEFT JOIN fits f ON f.doc_id = d.doc_id"""


ORACLE: dict[str, str] = {"op2_license_scan": _license_sql()}
