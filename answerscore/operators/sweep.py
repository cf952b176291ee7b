"""Sweeps over thresholds, weights and configurations on scores or features that are computed once."""

from __future__ import annotations

from dataclasses import asdict
from functools import reduce
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscore.config import Config
from answerscore.functions.calibration import step_tiebreak
from answerscore.tables import materialised

from .agreement import mean_group_spearman


def roc(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, cut, margin) for every distinct score as a threshold; ``scored``: (group, score, good 0/1).

    Cumulative counts over the distinct scores from the top: no threshold meets all rows.
    """
    group = group or []
    per = scored.groupBy(*group, F.col("score").alias("cut")).agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    down = Window.partitionBy(*group).orderBy(F.col("cut").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*group)
    rate = lambda c: F.when(F.sum(c).over(every) > 0, F.sum(c).over(down) / F.sum(c).over(every)).otherwise(0.0)
    return per.select(*group, "cut", (rate("g") - rate("b")).alias("margin"))


def best_step(curve: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, best_cut, best_margin): the highest margin, at the lowest threshold that has it; (0, 0) if none is positive."""
    group = group or []
    best = curve.groupBy(*group).agg(F.max_by(F.struct("cut", "margin"), F.struct(F.round("margin", 12), -F.col("cut"))).alias("b"))
    there = F.col("b.margin") > 0
    return best.select(*group, F.when(there, F.col("b.cut")).otherwise(0.0).alias("best_cut"), F.when(there, F.col("b.margin")).otherwise(0.0).alias("best_margin"))


def fixed_thresholds(spark: SparkSession, step: float = 0.02) -> DataFrame:
    return spark.range(1, round(1 / step)).select(F.round(F.col("id") * step, 3).alias("cut"))


def roc_at(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(cut, margin) for given thresholds: counts per distinct score first, then the small cross product."""
    per = scored.groupBy("score").agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    hit = F.col("score") >= F.col("cut")
    both = per.crossJoin(F.broadcast(thresholds)).groupBy("cut").agg(*(F.sum(F.when(hit, F.col(c)).otherwise(0)).alias("h" + c) for c in "gb"), F.sum("g").alias("g"), F.sum("b").alias("b"))
    return both.select("cut", (F.col("hg") / F.col("g") - F.col("hb") / F.col("b")).alias("margin"))


def step_grid(scored: DataFrame, grid: DataFrame) -> DataFrame:
    """(cut, b, mean_good, mean_bad, margin) of the step with tie-break over a grid of (cut, b)."""
    x = step_tiebreak(F.col("score"), F.col("score"), F.col("cut"), F.col("b"))
    both = scored.crossJoin(F.broadcast(grid)).groupBy("cut", "b").agg(F.avg(F.when(F.col("good") == 1, x)).alias("mean_good"), F.avg(F.when(F.col("good") == 0, x)).alias("mean_bad"))
    return both.withColumn("margin", F.col("mean_good") - F.col("mean_bad"))


def float_ties(df: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    """How many rows share their 32-bit value with another: n - distinct."""
    return df.groupBy(*(groups or [])).agg(F.count(column).alias("n"), (F.count(column) - F.count_distinct(F.col(column).cast("float"))).alias("ties"))


def summary(df: DataFrame, column: str, groups: list[str] | None = None) -> DataFrame:
    c = F.col(column)
    return df.groupBy(*(groups or [])).agg(F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.coalesce(F.stddev_pop(c), F.lit(0.0)).alias("spread"))


def offline_report(scored: DataFrame) -> DataFrame:
    """One row on a scored set (score, good 0/1): both classes' ranges, margin, best hard step, 32-bit ties."""
    sides = [f(F.when(F.col("good") == g, F.col("score"))).alias(n + k) for g, k in ((1, "good"), (0, "bad")) for f, n in ((F.min, "low_"), (F.max, "high_"), (F.avg, "mean_"))]
    one = scored.agg(*sides).withColumn("margin", F.col("mean_good") - F.col("mean_bad"))
    return one.crossJoin(F.broadcast(best_step(roc(scored)))).crossJoin(F.broadcast(float_ties(scored, "score")))


def weight_grid(spark: SparkSession, axes: dict[str, list[float]]) -> DataFrame:
    """(point, one column per weight): the product of the lists in order, without the point of only zeros."""
    grid = spark.createDataFrame([(0,)], "point int")
    for name, values in axes.items():
        axis = spark.createDataFrame(list(enumerate(values)), f"__i int, {name} double")
        grid = grid.crossJoin(F.broadcast(axis)).withColumn("point", F.col("point") * len(values) + F.col("__i")).drop("__i")
    return grid.filter(reduce(lambda a, b: a + b, (F.col(n) for n in axes)) > 0)


def blend_agreement(features: DataFrame, grid: DataFrame, axes: list[str], champion: str, group: str, outer: list[str]) -> DataFrame:
    """(point, weights, outer, rho): mean rank agreement within groups of each weighted sum of features.

    The grid is small and fixed, so it is broadcast; ranks are computed per point and group in one pass.
    """
    total = reduce(lambda a, b: a + b, (F.coalesce(F.col("f_" + a), F.lit(0.0)) * F.col(a) for a in axes))
    rows = features.select(*outer, group, F.col(champion).alias("__y"), *(F.col(a).alias("f_" + a) for a in axes)).crossJoin(F.broadcast(grid))
    rows = rows.withColumn("__x", F.round(F.least(F.lit(1.0), total), 9))
    return mean_group_spearman(rows, "__x", "__y", group, ["point", *axes, *outer])


def best_point(agreement: DataFrame, outer: list[str]) -> DataFrame:
    """The best grid point of each outer group; the first in grid order wins ties."""
    w = Window.partitionBy(*outer).orderBy(F.round("rho", 9).desc_nulls_last(), "point")
    return agreement.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def top_points(agreement: DataFrame, axes: list[str], top: int = 8) -> DataFrame:
    """The points of the highest mean over outer groups."""
    return agreement.groupBy("point", *axes).agg(F.avg("rho").alias("mean_rho")).orderBy(F.round("mean_rho", 9).desc(), "point").limit(top)


#: Fields that choose a branch of the score, so that they are the same for all configurations of one plan.
_BRANCHES = ("p_concave", "w_emb", "step_t", "step_w", "step_r", "tie_src", "gate_lex", "post_iters", "post_pivot", "post_frac", "sigk", "sharpen", "m_num_match")


def config_scores(features: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """(config, id, score) of one feature table, written once and read once, under many configurations.

    The fields in which the configurations differ are columns of a table of one row each, which is broadcast: it is as
    long as the list passed in.  So the plan is that of one configuration, however many there are.
    """
    from .score import finish

    features, parts = materialised(features, "features"), {}
    for name, c in configs.items():
        parts.setdefault(tuple(getattr(c, f) for f in _BRANCHES), []).append((name, asdict(c)))
    out = []
    for part in parts.values():
        fixed = dict(part[0][1])
        varied = [f for f, v in fixed.items() if any(c[f] != v for _, c in part)]
        table = features.sparkSession.createDataFrame([(name, *(float(c[f]) for f in varied)) for name, c in part], ", ".join(["config string", *(f"__{f} double" for f in varied)]))
        rows = features.crossJoin(F.broadcast(table))
        out.append(finish(rows, SimpleNamespace(**fixed | {f: F.col(f"__{f}") for f in varied})).select("config", "id", "score"))
    return reduce(DataFrame.unionByName, out)


def feasible(margin: Column, wins: Column, cases: Column, worst_self: Column, stddev: Column, family_margin: float = 0.45) -> Column:
    """All cases won, good self-matches, spread, and margin."""
    return (wins == cases) & (worst_self >= 0.75) & (stddev > 0) & (margin >= family_margin)


def top_results(results: DataFrame, top: int = 12, by: str = "margin") -> DataFrame:
    return results.orderBy(F.col(by).desc(), *(c for c in ("config", "point") if c in results.columns)).limit(top)


def report(long: DataFrame, rows: str, columns: str, names: list[str], value: str) -> DataFrame:
    """Long (rows, columns, value) as a matrix."""
    return long.groupBy(rows).pivot(columns, names).agg(F.first(value))
