"""Rank agreement between two scorers, over everything and within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.60


def average_ranks(df: DataFrame, column: str, out: str, groups: list[str]) -> DataFrame:
    """Add 1-based ranks within the groups, ties averaged.

    Ranks come from distinct values and their counts, so a value that many rows share moves once.
    """
    counts = df.groupBy(*groups, column).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("__n").over(before), F.lit(0)) + (F.col("__n") + 1) / 2.0).drop("__n")
    on = [df[c].eqNullSafe(ranks[c]) for c in (*groups, column)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(ranks.select(*groups, column, out), condition).select(df["*"], ranks[out])


def spearman(df: DataFrame, x: str, y: str, groups: list[str], least: int = 1, flat_is_zero: bool = True) -> DataFrame:
    """(groups, n, rho) of groups with at least ``least`` rows; a constant side gives 0 (or null)."""
    ranked = average_ranks(average_ranks(df, x, "__rx", groups), y, "__ry", groups)
    n, sx, sy = F.count("*"), F.sum("__rx"), F.sum("__ry")
    cov = n * F.sum(F.col("__rx") * F.col("__ry")) - sx * sy
    vx, vy = n * F.sum(F.col("__rx") * F.col("__rx")) - sx * sx, n * F.sum(F.col("__ry") * F.col("__ry")) - sy * sy
    out = ranked.groupBy(*groups).agg(n.alias("n"), cov.alias("__c"), vx.alias("__vx"), vy.alias("__vy")).filter(F.col("n") >= least)
    rho = F.when((F.col("__vx") > 0) & (F.col("__vy") > 0), F.col("__c") / F.sqrt(F.col("__vx") * F.col("__vy"))).otherwise(F.lit(0.0) if flat_is_zero else F.lit(None).cast("double"))
    return out.select(*groups, "n", rho.alias("rho"))


def pooled_spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, rho) over all rows."""
    return spearman(df.withColumn("__all", F.lit(1)), x, y, ["__all"]).drop("__all")


def mean_group_spearman(df: DataFrame, x: str, y: str, group: str, outer: list[str] | None = None, least: int = 3) -> DataFrame:
    """(outer, groups, rho): mean of the rank correlations of groups; small and constant groups are skipped."""
    outer = outer or []
    inner = spearman(df, x, y, [*outer, group], least, flat_is_zero=False).filter("rho is not null")
    return inner.groupBy(*outer).agg(F.count("*").alias("groups"), F.avg("rho").alias("rho"))


def rank_gaps(df: DataFrame, id_col: str, x: str, y: str, top: int = 8) -> DataFrame:
    """The rows on whose rank the two scorers differ most."""
    ranked = average_ranks(average_ranks(df.withColumn("__all", F.lit(1)), x, "rank_x", ["__all"]), y, "rank_y", ["__all"])
    return ranked.select(id_col, "rank_x", "rank_y", F.abs(F.col("rank_x") - F.col("rank_y")).alias("gap")).orderBy(F.col("gap").desc(), id_col).limit(top)


def agrees(rho: Column, floor: float = FLOOR) -> Column:
    return F.coalesce(rho >= floor, F.lit(False))


def correlation_matrix(long: DataFrame, proxies: list[str]) -> DataFrame:
    """(module, proxy, n, rho) of every module against each proxy; ``long``: (module, row, score).

    ``n`` counts the rows both have; rho is rounded to 4 places, null where the numbers of rows differ.
    """
    sizes = long.groupBy("module").agg(F.count("*").alias("size"))
    right = long.filter(F.col("module").isin(*proxies)).select(F.col("module").alias("proxy"), "row", F.col("score").alias("y"))
    pairs = long.select("module", "row", F.col("score").alias("x")).join(right, "row")
    rho = spearman(pairs, "x", "y", ["module", "proxy"])
    out = rho.join(sizes, "module").join(sizes.select(F.col("module").alias("proxy"), F.col("size").alias("proxy_size")), "proxy")
    return out.select("module", "proxy", "n", F.when(F.col("size") == F.col("proxy_size"), F.round("rho", 4)).alias("rho"))
