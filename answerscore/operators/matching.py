"""Joins between the token rows of the two sides of a triple."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerscore.functions import text as T
from answerscore.functions.calibration import rel_close

from .tokens import CONTENT


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.filter(F.col("side") == side)


def scale_hits(rows: DataFrame, side: str, other: str) -> DataFrame:
    """(id, pos) of tokens whose non-zero magnitude the other side asserts, too."""
    there = _side(rows, other).filter("scale > 0").select("id", "scale")
    return _side(rows, side).filter("scale > 0").join(there, ["id", "scale"], "left_semi").select("id", "pos")


def acronym_bridges(rows: DataFrame, side: str, other: str) -> DataFrame:
    """(id, pos, first, last): acronym tokens of ``side`` with the content tokens of ``other`` they stand for.

    An acronym stands for a capitalised content token that it begins, or for the run of content tokens whose
    initials it is; the first such place counts, the prefix before the initials.  ``first`` and ``last`` are
    content ranks of the other side.
    """
    order = Window.partitionBy("id").orderBy("pos")
    content = _side(rows, other).filter(F.col("w") > CONTENT).select("id", "pos", "cap", "pre", "first")
    content = content.withColumn("rank", F.row_number().over(order))
    run = [F.when(F.lead("first", i).over(order) != "", F.lead("first", i).over(order)) for i in range(4)]
    content = content.select("id", "cap", "pre", "rank", *(F.concat(*run[:n]).alias(f"i{n}") for n in (2, 3, 4)))
    short = _side(rows, side).filter("acro != ''").select("id", "pos", "acro")
    n = F.length("acro")
    by_prefix = F.col("cap") & (F.substring("pre", F.lit(1), n) == F.col("acro"))
    initials = F.when(n == 2, F.col("i2")).when(n == 3, F.col("i3")).otherwise(F.col("i4"))
    pairs = short.join(content, "id").filter(by_prefix | (initials == F.col("acro")))
    pairs = pairs.withColumn("last", F.when(by_prefix, F.col("rank")).otherwise(F.col("rank") + n - 1))
    return pairs.groupBy("id", "pos").agg(F.min("rank").alias("first"), F.min_by("last", "rank").alias("last"))


def bridged(rows: DataFrame) -> DataFrame:
    """(id, side, pos) of all tokens that an acronym bridge in either direction covers."""
    order = Window.partitionBy("id", "side").orderBy("pos")
    content = rows.filter((F.col("w") > CONTENT) & F.col("side").isin("gt", "a")).select("id", "side", "pos", F.row_number().over(order).alias("rank"))
    out = None
    for side, other in (("a", "gt"), ("gt", "a")):
        links = acronym_bridges(rows, side, other)
        covered = links.select("id", F.explode(F.sequence("first", "last")).alias("rank")).join(_side(content, other), ["id", "rank"])
        part = links.select("id", F.lit(side).alias("side"), "pos").union(covered.select("id", "side", "pos"))
        out = part if out is None else out.union(part)
    return out.distinct()


def figure_matches(rows: DataFrame, side: str, others: tuple[str, ...]) -> DataFrame:
    """(id, pos) of figures of ``side`` that some figure of the other sides is within 0.5 % of.

    Candidates meet by id and logarithmic bucket: figures that close lie in the same or the next bucket.
    """
    bucket = F.floor(F.log("val") / 0.0051).cast("long")
    mine = _side(rows, side).filter("val > 0").select("id", "pos", F.col("val").alias("x"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    theirs = rows.filter((F.col("val") > 0) & F.col("side").isin(*others)).select("id", F.col("val").alias("y"), bucket.alias("b"))
    return mine.join(theirs, ["id", "b"]).filter(rel_close(F.col("x"), F.col("y"))).select("id", "pos").distinct()


def foreign_figures(rows: DataFrame) -> DataFrame:
    """(id, pos) of figures of the answer, other than 1, that neither ground truth nor question states."""
    figures = _side(rows, "a").filter((F.col("val") > 0) & (F.abs(F.col("val") - 1) >= 1e-6)).select("id", "pos")
    return figures.join(figure_matches(rows, "a", ("gt", "q")), ["id", "pos"], "left_anti")


def wrong_numbers(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, pos) of numeric tokens of the answer whose key is in neither of the other sets."""
    mine = _side(rows, "a").filter("numeric").select("id", "pos", F.col("key").alias("word"))
    return mine.join(sets.filter(F.col("side").isin("gt", "q")).select("id", "word"), ["id", "word"], "left_anti").select("id", "pos")


def entity_figures(rows: DataFrame) -> DataFrame:
    """(id, side, pairs): slots of figures paired with the nearest capitalised content token within four tokens.

    The left one wins at equal distance.  Looks at eight neighbours by window functions, so there is no self-join.
    """
    order = Window.partitionBy("id", "side").orderBy("pos")
    fits = F.when(F.col("cap") & (F.col("w") > CONTENT), F.col("stem"))
    at = [F.lag(fits, d).over(order) if left else F.lead(fits, d).over(order) for d in (1, 2, 3, 4) for left in (True, False)]
    figure = F.when(F.col("numeric"), F.col("key")).when((F.col("alt") != F.col("key")) & (F.col("scale") != 0), F.col("alt"))
    pairs = rows.select("id", "side", figure.alias("figure"), F.coalesce(*at).alias("entity")).filter("figure is not null and entity is not null").distinct()
    gram = T.fnv1a(F.col("entity")).bitwiseXOR(T.mul32(T.fnv1a(F.col("figure")), 0xC2B2AE35))
    return pairs.groupBy("id", "side").agg(F.collect_set(T.slot(gram)).alias("pairs"))


def content_bigrams(rows: DataFrame) -> DataFrame:
    """(id, side, bigrams): slots of neighbouring content stems."""
    order = Window.partitionBy("id", "side").orderBy("pos")
    content = rows.filter(F.col("w") > CONTENT).select("id", "side", "stem", F.lag("stem").over(order).alias("prev")).filter("prev is not null")
    pairs = content.select("id", "side", "prev", "stem").distinct()
    gram = T.fnv1a(F.col("prev")).bitwiseXOR(T.mul32(T.fnv1a(F.col("stem")), 0x85EBCA6B))
    return pairs.groupBy("id", "side").agg(F.collect_set(T.slot(gram)).alias("bigrams"))
