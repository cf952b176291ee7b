"""Polarity: the stance of a text on the verdict, authenticity and direction axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscore import lexicon


def stances(rows: DataFrame) -> DataFrame:
    """(id, side, negates, and for each axis its sign and whether a later word takes the other side).

    The first polarity word decides, turned over by a negation before it.  ``no`` counts only before a clause
    boundary or as the only token.
    """
    n = rows.groupBy("id", "side").agg(F.count("*").alias("n"))
    words = rows.filter(F.col("key").isin(*lexicon.NEG, *(w for _, pos, neg in lexicon.AXES for w in (*pos, *neg))))
    words = words.join(n, ["id", "side"])
    counts = (F.col("key") != "no") | F.col("bnd") | (F.col("n") == 1)
    aggregates = [F.bool_or(F.col("key").isin(*lexicon.NEG)).alias("negates")]
    for name, pos, neg in lexicon.AXES:
        sign = F.when(counts & F.col("key").isin(*pos), 1).when(counts & F.col("key").isin(*neg), -1)
        sign = F.when(F.col("neg"), -sign).otherwise(sign)
        aggregates += [F.coalesce(F.min_by(sign, F.when(sign.isNotNull(), F.col("pos"))), F.lit(0)).alias(name), F.coalesce(F.min(sign) != F.max(sign), F.lit(False)).alias(name + "_mixed")]
    found = words.groupBy("id", "side").agg(*aggregates)
    blank = {"negates": False} | {name: 0 for name, _, _ in lexicon.AXES} | {name + "_mixed": False for name, _, _ in lexicon.AXES}
    return n.select("id", "side").join(found, ["id", "side"], "left").fillna(blank)


def tally(stance: DataFrame, gram3: DataFrame) -> DataFrame:
    """(id, agree, contra, silent, two_faced, negation_differs) of the answer against the ground truth."""
    g = stance.filter("side = 'gt'").drop("side")
    a = stance.filter("side = 'a'").drop("side")
    a = a.withColumnsRenamed({c: "a_" + c for c in a.columns if c != "id"})
    both = g.join(a, "id").join(gram3.select("id", "gram3"), "id")
    kinds = {"agree": [], "contra": [], "silent": [], "two_faced": []}
    for name, _, _ in lexicon.AXES:
        mine, theirs = F.col(name), F.col("a_" + name)
        faced = F.col(f"a_{name}_mixed") & (F.col("gram3") > 0.6)
        kinds["silent"].append((mine != 0) & (theirs == 0))
        kinds["contra"].append((mine != 0) & (theirs != 0) & (theirs != mine))
        kinds["two_faced"].append((mine != 0) & (theirs == mine) & faced)
        kinds["agree"].append((mine != 0) & (theirs == mine) & ~faced)
    counts = [sum((c.cast("int") for c in cs[1:]), cs[0].cast("int")).alias(k) for k, cs in kinds.items()]
    return both.select("id", *counts, (F.col("negates") != F.col("a_negates")).alias("negation_differs"))
