"""Registrations: what each intent holds, what could be won back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DETAILS = "candidate_margin double, champion_margin double, historical_rows_evaluated long, spearman string"


def details(regs: DataFrame, column: str = "eval_details") -> DataFrame:
    """Add candidate_margin, champion_margin, rows and rho parsed from JSON text; spearman may be a number or an object."""
    d = F.from_json(F.col(column), DETAILS)
    rho = F.coalesce(F.expr("try_cast(__d.spearman as double)"), F.map_values(F.from_json(F.col("__d.spearman"), "map<string,double>"))[0])
    out = regs.withColumn("__d", d).withColumn("rho", rho)
    return out.select(*regs.columns, F.col("__d.candidate_margin").alias("candidate_margin"), F.col("__d.champion_margin").alias("champion_margin"), F.coalesce("__d.historical_rows_evaluated", F.lit(0)).alias("rows"), "rho")


def best_per_intent(regs: DataFrame) -> DataFrame:
    """One registration per intent: the last active one, else the one of the highest id.  ``seq`` is the order seen."""
    active = (F.col("status") == "active").cast("int")
    order = Window.partitionBy("intent").orderBy(active.desc(), F.when(active == 1, F.col("seq")).otherwise(F.coalesce("registration_id", F.lit(0))).desc(), "seq")
    return regs.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def passed(margin: Column, champion: Column, rows: Column, rho: Column, floor: float = 0.60) -> Column:
    """Margin above the champion's and, where there is traffic, no rank agreement known to be below the floor."""
    return F.coalesce((margin > champion) & ~((rows > 0) & F.coalesce(rho < floor, F.lit(False))), F.lit(False))


def reclaim_winners(regs: DataFrame) -> DataFrame:
    """(intent, registration_id, candidate_margin, champion): the best passing registration of intents not held."""
    parsed = details(regs)
    held = regs.filter("status = 'active'").select("intent").distinct()
    champions = parsed.groupBy("intent").agg(F.coalesce(F.max("champion_margin"), F.lit(0.0)).alias("champion"))
    lost = parsed.join(held, "intent", "left_anti").join(champions, "intent")
    won = lost.filter(passed(F.col("candidate_margin"), F.col("champion"), F.col("rows"), F.col("rho")))
    best = won.groupBy("intent").agg(F.max_by(F.struct("registration_id", "candidate_margin", "champion"), F.struct("candidate_margin", -F.col("seq"))).alias("b"))
    return best.select("intent", "b.*")


def not_held(regs: DataFrame) -> DataFrame:
    return regs.select("intent").distinct().join(regs.filter("status = 'active'").select("intent"), "intent", "left_anti")


def holdings(regs: DataFrame) -> DataFrame:
    """(active, total, missing): how many intents are held, and which are not."""
    best = best_per_intent(regs)
    is_active = F.col("status") == "active"
    return best.agg(F.count_if(is_active).alias("active"), F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(~is_active, F.col("intent")))).alias("missing"))


def new_hashes(regs: DataFrame, existing: DataFrame) -> DataFrame:
    return regs.join(existing, "hash", "left_anti")
