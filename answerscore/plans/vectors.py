"""Queries over the embeddings table: quantising, cosines, pooling, soft credit, blends."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscore.config import TOPICAL
from answerscore.functions.calibration import soft_credit as credit
from answerscore.operators import vectors as V

from . import inputs as I

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v, u): each vector with the next one of its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return _embeddings(spark, sf_dir).withColumn("u", F.lead("v").over(w)).filter("u is not null")


_E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_PAIRS = f"{_E}, pr AS (SELECT * FROM (SELECT vec_id, label, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS u FROM e) WHERE u IS NOT NULL)"
_Q = lambda v: f"list_transform({v}, lambda x: CAST(round_even(x / sqrt(list_dot_product({v}, {v})) * 127, 0) AS INTEGER))"


@query(f"{_E}, q AS (SELECT vec_id, {_Q('v')} AS q FROM e) SELECT vec_id, array_to_string(q, ',') AS q FROM q")
def int8_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.quantised(_embeddings(spark, sf_dir), "v", "q").select("vec_id", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


@query(f"{_PAIRS}, q AS (SELECT vec_id, list_transform({_Q('v')}, lambda x: CAST(x AS DOUBLE)) AS a, list_transform({_Q('u')}, lambda x: CAST(x AS DOUBLE)) AS b FROM pr) SELECT vec_id, round(greatest(0.0, least(1.0, list_dot_product(a, b) / 16129.0)), 6) AS cosine FROM q")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = V.quantised(V.quantised(_pairs(spark, sf_dir), "v", "a"), "u", "b")
    return both.select("vec_id", F.round(V.int8_cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


@query(f"{_PAIRS} SELECT vec_id, round(greatest(0.0, least(1.0, list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u))))), 6) AS cosine FROM pr")
def unit_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("vec_id", V.unit(F.col("v")).alias("v"), V.unit(F.col("u")).alias("u"))
    return p.select("vec_id", F.round(V.unit_dot(F.col("v"), F.col("u")), 6).alias("cosine"))


_FLAT = f"{_E}, q AS (SELECT label, {_Q('v')} AS q FROM e), f AS (SELECT label, unnest(range(1, len(q) + 1)) AS dim, unnest(q) AS x FROM q), s AS (SELECT label, list(CAST(x AS DOUBLE) ORDER BY dim) AS v FROM (SELECT label, dim, sum(x) AS x FROM f GROUP BY label, dim) GROUP BY label)"


@query(f"{_FLAT} SELECT a.label AS label_a, b.label AS label_b, round(CASE WHEN list_dot_product(a.v, b.v) > 0 THEN least(1.0, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))) ELSE 0.0 END, 6) AS cosine FROM s a JOIN s b ON a.label < b.label")
def sum_pool_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the summed int8 vectors of each two labels."""
    sums = V.summed(V.quantised(_embeddings(spark, sf_dir), "v", "q"), ["label"], "q")
    b = sums.select(F.col("label").alias("label_b"), F.col("vec").alias("b"))
    pairs = sums.select(F.col("label").alias("label_a"), F.col("vec").alias("a")).join(b, F.col("label_a") < F.col("label_b"))
    return pairs.select("label_a", "label_b", F.round(V.sum_cosine(F.col("a"), F.col("b")), 6).alias("cosine"))


_MEAN = f"{_E}, f AS (SELECT label, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e), m AS (SELECT label, dim, avg(x) AS x FROM f GROUP BY label, dim), n AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY label)"


@query(f"{_MEAN} SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(x / size, 5) AS x FROM m JOIN n USING (label)")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = V.mean_pooled(_embeddings(spark, sf_dir), ["label"], "v")
    return pooled.select("label", F.posexplode("vec").alias("dim", "x")).select("label", "dim", F.round("x", 5).alias("x"))


@query(f"{_E}, f AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS dim, unnest(v) AS x FROM e), m AS (SELECT dim, avg(x) AS x FROM f GROUP BY dim) SELECT f.vec_id, round(sqrt(sum((f.x - m.x) * (f.x - m.x))), 5) AS size FROM f JOIN m ON m.dim = f.dim GROUP BY f.vec_id")
def sif_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    centred = V.centred(_embeddings(spark, sf_dir), "v", "c")
    return centred.select("vec_id", F.round(V.norm(F.col("c")), 5).alias("size"))


_COS = "greatest(0.0, least(1.0, list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u)))))"


@query(f"{_PAIRS}, c AS (SELECT vec_id, {_COS} AS c FROM pr) SELECT vec_id, round(CASE WHEN c < 0.2 THEN 0.0 ELSE ((c - 0.2) / 0.8) * ((c - 0.2) / 0.8) END, 5) AS credit FROM c WHERE abs(c - 0.2) > 1e-6")
def soft_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("vec_id", V.unit_dot(V.unit(F.col("v")), V.unit(F.col("u"))).alias("c")).filter(F.abs(F.col("c") - 0.2) > 1e-6)
    return p.select("vec_id", F.round(credit(F.col("c"), 0.2), 5).alias("credit"))


@query(f"""{_E}, q AS (SELECT vec_id, label, list_transform({_Q('v')}, lambda x: CAST(x AS DOUBLE)) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM e)
SELECT a.vec_id, round(max(greatest(0.0, least(1.0, list_dot_product(a.v, b.v) / 16129.0))), 6) AS best FROM q a JOIN q b ON b.label = a.label AND b.n <= 128 AND b.vec_id <> a.vec_id GROUP BY a.vec_id""")
def soft_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best int8 cosine of each vector with the first 128 of its label, itself left out."""
    q = V.quantised(_embeddings(spark, sf_dir), "v", "q").select("vec_id", "label", "q")
    first = q.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).filter(F.col("n") <= V.PAIR_CAP)
    other = first.select("label", F.col("vec_id").alias("other"), F.col("q").alias("there"))
    pairs = q.join(other, "label").filter("other != vec_id")
    return pairs.groupBy("vec_id").agg(F.round(F.max(V.int8_cosine(F.col("q"), F.col("there"))), 6).alias("best"))


_BLEND = replace(TOPICAL, w_qa=0.2, emb_a_w=0.25, emb_b_w=0.75, gate_lex=0.3)


@query(f"{_PAIRS}, c AS (SELECT vec_id, {_COS} AS c FROM pr) SELECT vec_id, round(greatest(0.0, least(1.0, (0.8 * (0.25 * c + 0.75 * c * c) + 0.2 * c) * greatest(0.0, least(1.0, c / 0.3)))), 5) AS blend FROM c")
def embed_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth blend with a lexical gate, on cosines that stand in for the encoder's."""
    c = F.col("c")
    p = _pairs(spark, sf_dir).select("vec_id", V.unit_dot(V.unit(F.col("v")), V.unit(F.col("u"))).alias("c"))
    topical = V.topical(c, F.lit(0.0), F.lit(0.0), c * c, c, _BLEND)
    return p.select("vec_id", F.round(V.blend(topical, c, _BLEND), 5).alias("blend"))
