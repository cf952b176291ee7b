"""One row of features per triple; no configuration but the word-vector credit is needed to make them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerscore.functions import text as T
from answerscore.functions.calibration import clamp01
from answerscore.tables import materialised

from . import matching as M
from . import polarity
from .tokens import CONTENT, content_counts, probe, side_texts, token_rows, token_sets

UNIT = 10_000.0  # token weights are whole numbers of 1/10,000


def annotated(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Tokens of answer and ground truth with in_q, at_other (matched position on the other side), hit (bridge or scale)."""
    facing = rows.filter(F.col("side").isin("gt", "a"))
    other = sets.filter(F.col("side").isin("gt", "a")).withColumn("side", F.when(F.col("side") == "gt", "a").otherwise("gt"))
    forms = facing.select("id", "side", "pos", F.posexplode(F.array("key", "stem", "alt")).alias("form", "word"))
    to_other = forms.join(other, ["id", "side", "word"]).groupBy("id", "side", "pos").agg(F.min_by("first_pos", "form").alias("at_other"))
    to_q = forms.join(sets.filter("side = 'q'").select("id", "word"), ["id", "word"], "left_semi").select("id", "side", "pos").distinct().withColumn("in_q", F.lit(True))
    scales = M.scale_hits(rows, "a", "gt").withColumn("side", F.lit("a")).unionByName(M.scale_hits(rows, "gt", "a").withColumn("side", F.lit("gt")))
    hits = M.bridged(rows).unionByName(scales).distinct().withColumn("hit", F.lit(True))
    key = ["id", "side", "pos"]
    return facing.join(to_other, key, "left").join(to_q, key, "left").join(hits, key, "left").fillna(False, ["in_q", "hit"])


SOFT_BUDGET = 512  # fixed value: so many words of an answer are looked up in the vectors


def precision(marked: DataFrame, soft: DataFrame | None = None, budget: int = SOFT_BUDGET) -> DataFrame:
    """(id, p_hit, p_tot, an_content, an_novel): of what the answer asserts, how much the ground truth has.

    Words only the question has count for 0.35.  ``soft``: (id, side, pos, credit) of word vectors; the first
    ``budget`` content words that nothing else matches can have credit.
    """
    rows = marked.filter("side = 'a'")
    credit = F.lit(0.0)
    if soft is not None:
        rows, credit = rows.join(soft, ["id", "side", "pos"], "left"), F.coalesce("credit", F.lit(0.0))
    w, found, content = F.col("w"), F.col("at_other").isNotNull() | F.col("hit"), F.col("w") > CONTENT
    part = F.when(found, w).when(F.col("in_q"), w * 0).otherwise(0)
    total = F.when(found, w * 100).when(F.col("in_q"), w * 35).otherwise(w * 100)
    alone = ~found & ~F.col("in_q") & content
    if soft is not None:
        upto = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("__asked", F.sum(F.when(alone, 1).otherwise(0)).over(upto))
        alone = alone & (F.col("__asked") <= budget)
    extra = F.when(alone, w * credit).otherwise(0.0)
    return rows.groupBy("id").agg(
        (F.sum(part) / UNIT + F.sum(extra) / UNIT).alias("p_hit"), (F.sum(total) / (100 * UNIT)).alias("p_tot"),
        (F.sum(F.when(content, w).otherwise(0)) / UNIT).alias("an_content"), (F.sum(F.when(content & ~F.col("in_q"), w).otherwise(0)) / UNIT).alias("an_novel"),
    )


def recall(marked: DataFrame, rows: DataFrame, soft: DataFrame | None = None, soft_cap: float = 0.35) -> DataFrame:
    """(id, r_hit, r_tot, k_hit, k_tot, contra_w): how much of the ground truth the answer covers, in all and beyond the question.

    A match under a negation that the ground truth does not have is no cover; its weight is ``contra_w``.
    """
    mine = marked.filter("side = 'gt'")
    theirs = rows.filter("side = 'a'").select("id", F.col("pos").alias("at_other"), F.col("neg").alias("a_neg"))
    mine = mine.join(theirs, ["id", "at_other"], "left")
    credit = F.lit(0.0)
    if soft is not None:
        mine, credit = mine.join(soft, ["id", "side", "pos"], "left"), F.coalesce("credit", F.lit(0.0))
    w, matched = F.col("w"), F.col("at_other").isNotNull()
    against = ~F.col("hit") & matched & F.col("a_neg") & ~F.col("neg") & (w > CONTENT)
    hard = F.col("hit") | (matched & ~against)
    key = ~F.col("in_q")
    zero = F.lit(0).cast("long")
    total = lambda c: F.sum(F.when(c, w).otherwise(zero)) / UNIT
    softly = lambda c: F.sum(F.when(c & ~hard & (w > CONTENT), w * credit).otherwise(0.0)) / UNIT
    out = mine.groupBy("id").agg(total(hard).alias("r_hit"), total(F.lit(True)).alias("r_tot"), total(hard & key).alias("k_hit"), total(key).alias("k_tot"), total(against).alias("contra_w"), softly(F.lit(True)).alias("r_soft"), softly(key).alias("k_soft"))
    capped = lambda h, s, t: F.col(h) + F.least(F.col(s), soft_cap * F.col(t))
    return out.select("id", capped("r_hit", "r_soft", "r_tot").alias("r_hit"), "r_tot", capped("k_hit", "k_soft", "k_tot").alias("k_hit"), "k_tot", "contra_w")


def numbers(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, gt_nums, gt_nums_hit, wrong_nums, gt_fig, gt_fig_hit, foreign_fig) of triples whose ground truth has numeric tokens."""
    gt = rows.filter("side = 'gt'")
    in_answer = sets.filter("side = 'a'").select("id", F.col("word").alias("key"), F.lit(True).alias("there"))
    hit = gt.filter("numeric").join(in_answer, ["id", "key"], "left")
    nums = hit.groupBy("id").agg(F.count("*").alias("gt_nums"), F.count("there").alias("gt_nums_hit"))
    count = lambda df, name: df.groupBy("id").agg(F.count("*").alias(name))
    out = nums.join(count(M.wrong_numbers(rows, sets), "wrong_nums"), "id", "left")
    out = out.join(count(gt.filter("val > 0"), "gt_fig"), "id", "left").join(count(M.figure_matches(rows, "gt", ("a",)), "gt_fig_hit"), "id", "left")
    return out.join(count(M.foreign_figures(rows), "foreign_fig"), "id", "left").fillna(0)


def grams(triples: DataFrame) -> DataFrame:
    """(id, gram3, gram2): byte n-gram likeness of ground truth and answer."""
    out = triples.select("id", "gt", "a")
    for n in (3, 2):
        out = T.with_gram_slots(T.with_gram_slots(out, "gt", f"g{n}", n), "a", f"a{n}", n)
    return out.select("id", *(T.contained_or_dice(F.col(f"g{n}"), F.col(f"a{n}")).alias(f"gram{n}") for n in (3, 2)))


def paired(sets: DataFrame, column: str, out: str) -> DataFrame:
    """(id, out, n_gt, n_a): Dice of the two sides' slot sets."""
    none = F.array().cast("array<bigint>")
    sides = sets.groupBy("id").pivot("side", ["gt", "a"]).agg(F.first(column))
    g, a = F.coalesce("gt", none), F.coalesce("a", none)
    return sides.select("id", T.dice(g, a).alias(out), F.size(g).alias(f"{out}_gt"), F.size(a).alias(f"{out}_a"))


def features(triples: DataFrame, soft: DataFrame | None = None, soft_cap: float = 0.35) -> DataFrame:
    """All features of (id, q, gt, a) triples; triples with a side without tokens have no row.

    Tokens, sets and matches are used by many of the aggregations below, so they are written once."""
    rows = materialised(token_rows(side_texts(triples)), "tokens")
    sets = materialised(token_sets(rows), "sets")
    marked = materialised(annotated(rows, sets), "marked")
    gram = materialised(grams(triples), "grams")
    out = precision(marked, soft).join(recall(marked, rows, soft, soft_cap), "id").join(gram, "id")
    counts = content_counts(rows).groupBy("id").pivot("side", ["gt", "a"]).agg(F.first("content")).select("id", F.col("gt").alias("content_gt"), F.col("a").alias("content_a"))
    out = out.join(counts, "id").join(paired(M.content_bigrams(rows), "bigrams", "adjacency"), "id", "left")
    out = out.join(paired(M.entity_figures(rows), "pairs", "entity"), "id", "left").join(numbers(rows, sets), "id", "left")
    out = out.join(polarity.tally(polarity.stances(rows), gram), "id", "left")
    return out.fillna(0)


def combined(f: DataFrame, f_beta2: float = 0.36, p_concave: bool = True, key_base: float = 0.5, floor: float = 0.3) -> DataFrame:
    """Add p_raw, p, r and lex to precision and recall sums."""
    from answerscore.functions.calibration import f_beta

    ratio = lambda a, b: F.when(F.col(b) > 0, clamp01(F.col(a) / F.col(b))).otherwise(0.0)
    f = f.withColumn("p_raw", ratio("p_hit", "p_tot"))
    f = f.withColumn("p", F.col("p_raw") * (2 - F.col("p_raw")) if p_concave else F.col("p_raw"))
    f = f.withColumn("r_all", ratio("r_hit", "r_tot")).withColumn("novelty", F.when(F.col("an_content") > 0, F.col("an_novel") / F.col("an_content")).otherwise(0.0))
    keyed = clamp01(ratio("k_hit", "k_tot") * (key_base + (1 - key_base) * F.col("r_all")) + floor * F.col("r_all") * clamp01((F.col("novelty") - 0.2) * 3.0))
    f = f.withColumn("r", F.when(F.col("k_tot") > 0, keyed).otherwise(F.col("r_all")))
    return f.withColumn("lex", f_beta(F.col("p"), F.col("r"), f_beta2))
