"""Gates over scored cases: separation, structure, attacks, families, head to head."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answerscore.config import LEXICAL, Config

from .score import score


def case_triples(cases: DataFrame, kinds: dict[str, str], order: str = "id") -> DataFrame:
    """(id, case, kind, q, gt, a): a triple for each kind of answer; ``kinds`` maps a kind to its answer column."""
    answers = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("a")) for k, c in kinds.items()))
    rows = cases.select(F.col(order).alias("case"), F.col("question").alias("q"), F.col("ground_truth").alias("gt"), F.inline(answers))
    return rows.select(F.concat_ws("|", "case", "kind").alias("id"), "case", "kind", "q", "gt", "a")


def scored_cases(cases: DataFrame, kinds: dict[str, str], config: Config = LEXICAL) -> DataFrame:
    """(case, one score column per kind)."""
    triples = case_triples(cases, kinds)
    scored = triples.select("id", "case", "kind").join(score(triples.select("id", "q", "gt", "a"), config), "id")
    return scored.groupBy("case").pivot("kind", list(kinds)).agg(F.first("score"))


def separation(scored: DataFrame) -> DataFrame:
    """One row of separation metrics from (case, good, bad, self)."""
    margin = F.col("good") - F.col("bad")
    pooled = [F.count("*") * 2, F.sum(F.col("good") + F.col("bad")), F.sum(F.col("good") * F.col("good") + F.col("bad") * F.col("bad"))]
    lost = F.when(margin == 0, F.concat("case", F.lit("(tie)"))).when(margin < 0, F.col("case"))
    out = scored.agg(
        F.count("*").alias("cases"), F.count_if(margin > 0).alias("wins"), F.count_if(margin == 0).alias("ties"), F.avg(margin).alias("candidate_margin"), F.avg("good").alias("mean_good"),
        F.avg("bad").alias("mean_bad"), F.min("self").alias("worst_self"), F.min(margin).alias("min_case_margin"), F.array_sort(F.collect_list(lost)).alias("losses"),
        F.when(pooled[0] > 1, F.sqrt(F.greatest(F.lit(0.0), pooled[2] - pooled[1] * pooled[1] / pooled[0]) / (pooled[0] - 1))).otherwise(0.0).alias("score_stddev"),
    )
    return out


def family_gate(metrics: DataFrame, margin: float = 0.40, worst_self: float = 0.75) -> DataFrame:
    """A family passes with at most one case not won, the margin, and good self-matches."""
    ok = (F.col("wins") >= F.col("cases") - 1) & (F.col("candidate_margin") >= margin) & (F.col("worst_self") >= worst_self)
    return metrics.select("*", ok.alias("passed"))


def attack_checks(scored: DataFrame) -> DataFrame:
    """(name, ok, detail) from (name, rule, honest, attack); an unknown rule fails."""
    h, a = F.col("honest"), F.col("attack")
    ok = F.when(F.col("rule") == "below_honest", a < h - 0.10).when(F.col("rule") == "near_zero", a <= 0.20).when(F.col("rule") == "near_honest", a >= h - 0.15).otherwise(False)
    known = F.col("rule").isin("below_honest", "near_zero", "near_honest")
    name = F.when(known, F.format_string("%s [%s]", "name", "rule")).otherwise(F.col("name"))
    detail = F.when(known, F.format_string("honest=%.4f attack=%.4f", h, a)).otherwise(F.concat(F.lit("unknown rule "), "rule"))
    return scored.select(name.alias("name"), ok.alias("ok"), detail.alias("detail"))


def crossed(cases: DataFrame, order: str = "id") -> DataFrame:
    """Add ``next_gt``: the ground truth of the next case, of the first after the last."""
    w = Window.orderBy(order)
    everyone = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return cases.withColumn("next_gt", F.coalesce(F.lead("ground_truth").over(w), F.first("ground_truth").over(everyone)))


def structural_checks(spark: SparkSession, cases: DataFrame, config: Config = LEXICAL) -> DataFrame:
    """(name, ok, detail): blank answers are 0, texts match themselves and beat others, odd inputs stay in [0, 1]."""
    cases = crossed(cases)
    both = scored_cases(cases, {"self": "ground_truth", "cross": "next_gt"}, config)
    worst = both.agg(F.min("self").alias("self"), F.min(F.col("self") - F.col("cross")).alias("gap"))
    long = "lorem ipsum dolor sit amet consectetur adipiscing " * 1600
    weird = "\U0001f680\U0001f319 登月成功了 مرحبا Привет мир ✅ \x00�� binary \x01"
    odd = [("empty", None, ""), ("white", None, " \t\n \r "), ("long", None, long), ("long_self", long, long), ("weird", None, weird), ("weird_self", weird, weird)]
    first = cases.orderBy("id").limit(1).select(F.col("question").alias("q"), F.col("ground_truth").alias("g"))
    triples = spark.createDataFrame(odd, "id string, gt string, a string").crossJoin(F.broadcast(first)).select("id", F.when(F.col("id") == "weird_self", F.col("a")).otherwise(F.col("q")).alias("q"), F.coalesce("gt", "g").alias("gt"), "a")
    s = score(triples, config).groupBy().pivot("id", [o[0] for o in odd]).agg(F.first("score"))
    row = worst.crossJoin(s)
    inside = lambda c: F.col(c).between(0, 1)
    checks = [
        ("empty answer scores 0", F.col("empty") == 0, "empty"), ("white-space answer scores 0", F.col("white") == 0, "white"), ("perfect answers score 0.75 or more", F.col("self") >= 0.75, "self"),
        ("self-match beats the next case", F.col("gap") > 0, "gap"), ("long answer stays in range", inside("long"), "long"), ("long ground truth stays in range", inside("long_self"), "long_self"),
        ("odd characters stay in range", inside("weird"), "weird"), ("text without words matches itself", F.col("weird_self") >= 0.75, "weird_self"),
    ]
    made = F.array(*(F.struct(F.lit(n).alias("name"), ok.alias("ok"), F.format_string("%.4f", F.col(c)).alias("detail")) for n, ok, c in checks))
    return row.select(F.inline(made))


def head_to_head(candidate: DataFrame, baselines: DataFrame) -> DataFrame:
    """(module, not_worse): the candidate's one row of metrics against each baseline row, in margin and in wins."""
    c = candidate.select(F.col("candidate_margin").alias("__m"), F.col("wins").alias("__w"))
    return baselines.crossJoin(F.broadcast(c)).select("module", ((F.col("__m") >= F.col("candidate_margin")) & (F.col("__w") >= F.col("wins"))).alias("not_worse"))


def failures(checks: DataFrame, candidate: str) -> DataFrame:
    """(module, failed, counts): failed checks per module; only the candidate's decide whether a run has failed."""
    failed = checks.groupBy("module").agg(F.count_if(~F.col("ok")).alias("failed"))
    return failed.select("module", "failed", (F.col("module") == candidate).alias("counts"))


def answer_corpus(questions: DataFrame, models: DataFrame, silent: str = "silent") -> DataFrame:
    """(q, gt, model, a): every question for every model, and one model that answers nothing.

    ``models`` is a short list and is broadcast; answers are to be filled in, those of the silent model are empty.
    """
    asked = questions.select("q", "gt").crossJoin(F.broadcast(models.select("model"))).withColumn("a", F.lit(None).cast("string"))
    return asked.unionByName(questions.select("q", "gt", F.lit(silent).alias("model"), F.lit("").alias("a")))
