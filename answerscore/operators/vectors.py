"""Word and sentence vectors: quantising, cosines, pooling, best soft match, blends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscore.config import Config
from answerscore.functions.calibration import clamp01, soft_credit

from .tokens import CONTENT

PAIR_CAP, BUDGET = 128, 512


def dot(a: Column, b: Column) -> Column:
    """Sum of products as a double; whole numbers stay exact."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = norm(v)
    return F.transform(v, lambda x: F.when(size > 0, x / size).otherwise(F.lit(0.0)))


def quantised(df: DataFrame, vec_col: str, out: str) -> DataFrame:
    """Add the int8 form of a vector: unit length times 127, rounded half to even, within -127 and 127."""
    df = df.withColumn("__norm", norm(F.col(vec_col)))
    cell = lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.bround(x.cast("double") / F.col("__norm") * 127)))
    return df.withColumn(out, F.when(F.col("__norm") > 0, F.transform(vec_col, cell)).otherwise(F.transform(vec_col, lambda x: F.lit(0.0))).cast("array<int>")).drop("__norm")


def int8_cosine(a: Column, b: Column) -> Column:
    """Cosine of two int8 vectors of length 127: never negative, 1 at most."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / 16129.0))


def unit_dot(a: Column, b: Column) -> Column:
    return clamp01(dot(a, b))


def summed(df: DataFrame, keys: list[str], vec_col: str, how=F.sum, out: str = "vec") -> DataFrame:
    """(keys, out): the sum (or other aggregate) of vectors, dimension by dimension."""
    flat = df.select(*keys, F.posexplode(vec_col).alias("dim", "x")).groupBy(*keys, "dim").agg(how(F.col("x").cast("double")).alias("x"))
    cells = flat.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("cells"))
    return cells.select(*keys, F.transform("cells", lambda c: c["x"]).alias(out))


def mean_pooled(df: DataFrame, keys: list[str], vec_col: str, out: str = "vec") -> DataFrame:
    """Mean vector of each group at length 1."""
    return summed(df, keys, vec_col, F.avg, "__mean").select(*keys, unit(F.col("__mean")).alias(out))


def centred(df: DataFrame, vec_col: str, out: str) -> DataFrame:
    """Add the vector less the mean of all rows; the mean is one row, so it is joined by broadcast."""
    mean = summed(df.select(F.lit(1).alias("__one"), vec_col), ["__one"], vec_col, F.avg, "__mean").drop("__one")
    return df.crossJoin(F.broadcast(mean)).withColumn(out, F.zip_with(vec_col, "__mean", lambda x, m: x.cast("double") - m)).drop("__mean")


def sum_cosine(a: Column, b: Column) -> Column:
    """Cosine of two summed vectors; 0 when it is negative or a side is zero."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & (dot(a, b) > 0), F.least(F.lit(1.0), dot(a, b) / size)).otherwise(0.0)


def sentence_cos(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(id, sentence_cos) of the two sides' summed content word vectors; ``words``: (word, vec of int8)."""
    found = rows.filter((F.col("w") > CONTENT) & ~F.col("numeric") & F.col("side").isin("gt", "a")).join(words, F.col("key") == F.col("word"))
    sides = summed(found, ["id", "side"], "vec").groupBy("id").pivot("side", ["gt", "a"]).agg(F.first("vec"))
    return sides.select("id", F.coalesce(sum_cosine(F.col("gt"), F.col("a")), F.lit(0.0)).alias("sentence_cos"))


def soft_credits(rows: DataFrame, words: DataFrame, soft_min: float = 0.72, soft_w: float = 1.0, cap: int = PAIR_CAP) -> DataFrame:
    """(id, side, pos, credit): what word vectors give a content token for the other side's nearest word.

    Only the first ``cap`` content tokens with a vector of the other side are looked at, so the pairs of a triple
    are bounded; triples are the unit of distribution.
    """
    order = Window.partitionBy("id", "side").orderBy("pos")
    found = rows.filter((F.col("w") > CONTENT) & ~F.col("numeric") & F.col("side").isin("gt", "a")).join(words, F.col("key") == F.col("word")).select("id", "side", "pos", "vec")
    other = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap)
    other = other.select("id", F.when(F.col("side") == "gt", "a").otherwise("gt").alias("side"), F.col("vec").alias("there"))
    best = found.join(other, ["id", "side"]).groupBy("id", "side", "pos").agg(F.max(int8_cosine(F.col("vec"), F.col("there"))).alias("best"))
    return best.select("id", "side", "pos", soft_credit(F.col("best"), soft_min, soft_w).alias("credit"))


def topical(ca: Column, c2: Column, c4: Column, cb: Column, cq: Column, config: Config) -> Column:
    """Similarity of answer and ground truth at four depths, mixed with that of answer and question."""
    sim = config.emb_a_w * ca + config.emb_l2_w * c2 + config.emb_l4_w * c4 + config.emb_b_w * cb
    return (1 - config.w_qa) * sim + config.w_qa * cq


def blend(topical: Column, lex: Column, config: Config) -> Column:
    """The topical value with the lexical one added to it or as a gate before it."""
    if config.gate_lex > 0:
        return clamp01(topical * clamp01(lex / config.gate_lex))
    return clamp01(topical + config.emb_lex_w * lex)
