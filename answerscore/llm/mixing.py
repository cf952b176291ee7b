"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Among all document rates between 0 and ``cap`` that meet each source's token constraint, the one closest in
relative entropy to equal rates is an exponential tilt of the document's size:

    rate / (cap - rate) = exp(lambda_source * size / scale_source) / (cap - 1)

``lambda`` solves the convex dual, one equation a source: sum(size * rate) = target.  Newton steps, kept in
a shrinking bracket, run as distributed aggregations over (source, size, number of documents), the exact
summary of what the dual depends on.  Rates then become whole copies: each (source, size) cell takes the
whole number nearest to its running total, so rounding errors do not add up, and deals them evenly to its
documents in the order of a hash of the id.  What a source then lacks or has too much goes, from its largest
documents on, to whole cells of documents and at last one cut copy, so the words taken equal the target.

Defined results: null text has size 0 and takes nothing; null sources form one source, ordered last; rows of
equal id are separate documents; an empty table gives an empty result; columns with clashing names are kept
(:func:`mix_copies`) as the working columns start with two underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, text_of, word_count

CAP = 3
WEIGHTS = (5, 2, 1)
SALTS = 64
NEWTON_STEPS = 200  # more than halving the bracket needs; beyond it the solver fails


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): all words shared by weight, at most ``cap`` times a source's own size.

    The excess of capped sources is shared again by weight: with sources in descending order of weight / size
    the capped ones come first, so the final share is found by one pass over the ordered source table.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("__w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    everyone = Window.partitionBy()
    ordered = Window.orderBy((F.col("source_size") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("__all", F.sum("source_size").over(everyone)).withColumn("__weights", F.sum("__w").over(everyone))
    by = by.withColumn("__cap", cap * F.col("source_size"))
    left = F.col("__all") - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    share = left * F.col("__w") / (F.col("__weights") - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    by = by.withColumn("__share", share).withColumn("__full", F.col("__share") > F.col("__cap"))
    # In this order the capped sources are a prefix: behind the first that is not capped all share one rate.
    free = by.withColumn("__n", F.row_number().over(ordered)).withColumn("__first", F.min(F.when(~F.col("__full"), F.col("__n"))).over(everyone))
    rate = F.max(F.when(F.col("__n") == F.col("__first"), F.col("__share") / F.col("__w"))).over(everyone)
    target = F.when(F.col("__first").isNull() | (F.col("__n") < F.col("__first")), F.col("__cap").cast("double")).otherwise(F.least(rate * F.col("__w"), F.col("__cap").cast("double")))
    return free.select("source", "source_size", target.alias("target"))


def _rate(lam, x, cap: int):
    """cap * logistic(lambda * x - ln(cap - 1)); a lambda of null stands for plus infinity (a capped source)."""
    odds = F.exp(F.least(F.lit(700.0), -lam * x)) * float(cap - 1)
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(float(cap) / (1.0 + odds))


def tilts(cells: DataFrame, targets: DataFrame, cap: int = CAP, steps: int = NEWTON_STEPS) -> DataFrame:
    """(source, scale, lambda) that solve the dual; ``cells`` has source, size, n."""
    scale = cells.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    state = targets.join(scale, targets["source"].eqNullSafe(scale["source"]), "left").select(
        targets["source"], "source_size", "target", F.greatest(F.coalesce("scale", F.lit(1.0)), F.lit(1e-9)).alias("scale"), F.lit(0.0).alias("lam"),
        F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"), F.col("target").between(F.lit(1e-9), F.lit(cap - 1e-9) * F.col("source_size")).alias("open"),
    )
    state = materialise(state, "tilts")
    for _ in range(steps):
        s, c = state.alias("s"), cells.alias("c")
        x = F.col("size") / F.col("scale")
        r = _rate(F.col("lam"), x, cap)
        slope = r * (1.0 - r / cap)
        sums = s.filter("open").join(c, F.col("s.source").eqNullSafe(F.col("c.source"))).groupBy("s.source").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("f"), F.sum(F.col("n") * F.col("size") * x * slope).alias("g")
        )
        sums = sums.select(F.col("source").alias("of"), "f", "g")
        new = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        miss = F.col("f") - F.col("target")
        low = F.when(miss < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - miss / F.greatest(F.col("g"), F.lit(1e-300))
        new = new.withColumn("__low", F.coalesce(low, F.col("low"))).withColumn("__high", F.coalesce(high, F.col("high")))
        middle = F.when((F.col("__low") < -1e5) | (F.col("__high") > 1e5), 2.0 * F.col("lam") - F.signum(miss)).otherwise((F.col("__low") + F.col("__high")) / 2)
        inside = (newton > F.col("__low")) & (newton < F.col("__high")) & (F.abs(newton - F.col("lam")) <= 4.0 + F.abs(F.col("lam")))
        lam = F.when(inside, newton).otherwise(middle)
        still = F.col("open") & (F.abs(miss) > 1e-6 * F.col("target")) & (F.col("__high") - F.col("__low") > 1e-12)
        new = new.select("source", "source_size", "target", "scale", F.when(still, lam).otherwise(F.col("lam")).alias("lam"), F.col("__low").alias("low"), F.col("__high").alias("high"), F.coalesce(still, F.lit(False)).alias("open"))
        new = materialise(new, "tilts")
        discard(state)
        state = new
        if state.filter("open").isEmpty():
            break
    else:
        raise RuntimeError(f"no tilt meets a source's target after {steps} steps")
    shut = F.when(F.col("target") < 1e-9, F.lit(-1e6)).when(F.col("target") > (cap - 1e-9) * F.col("source_size"), F.lit(None).cast("double")).otherwise(F.round("lam", 9))  # rounded: the order of sums must not show
    return state.select("source", "source_size", "target", "scale", shut.alias("lam"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_hash=None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies (whole) and taken (words).

    ``taken`` differs from ``copies * size`` only for one document a source, whose last copy is cut.
    ``row_hash`` orders equal ids (default: the id alone).
    """
    key = F.xxhash64(F.col(id_col)) if row_hash is None else row_hash
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_of(text_col)).alias("size"), key.alias("key"))
    sizes = materialise(sizes, "sizes")
    salt = F.pmod(F.col("key"), F.lit(SALTS))
    cells = materialise(sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    solved = tilts(cells, source_targets(sizes.select("source", "size"), weights, cap), cap)
    c = cells.alias("c").join(solved.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select("c.source", "size", "n", "source_size", "target", _rate(F.col("lam"), F.col("size") / F.col("scale"), cap).alias("rate"))
    # Copies of a cell: its step of the rounded running total. As many cells as a source has different sizes.
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    up_to, before = down.rowsBetween(Window.unboundedPreceding, 0), down.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.col("n") * F.col("rate"))
    c = c.withColumn("k", F.when(F.col("size") > 0, F.least(F.round(total.over(up_to)) - F.round(F.coalesce(total.over(before), F.lit(0.0))), cap * F.col("n"))).otherwise(F.lit(0)).cast("long"))
    c = c.withColumn("over", F.sum(F.col("k") * F.col("size")).over(Window.partitionBy("source")) - F.round("target").cast("long"))
    # What is missing (over < 0) or too much (over > 0), offered to the cells in turn, largest documents first.
    room = F.when(F.col("over") < 0, (cap * F.col("n") - F.col("k")) * F.col("size")).otherwise(F.col("k") * F.col("size"))
    c = c.withColumn("room", room).withColumn("left", F.abs("over") - F.coalesce(F.sum("room").over(before), F.lit(0)))
    c = c.withColumn("moved", F.greatest(F.lit(0), F.least("room", "left")) * -F.signum("over").cast("long"))
    c = c.withColumn("words", F.col("k") * F.col("size") + F.col("moved"))
    c = c.select("source", "size", "n", "source_size", "target", "rate", F.when(F.col("size") > 0, F.floor(F.col("words") / F.greatest("size", F.lit(1)))).otherwise(0).alias("k"), "words")
    c = c.withColumn("rest", F.col("words") - F.col("k") * F.col("size"))
    # The rank of a document in its cell: salted, so that no cell of many equal sizes meets in one task.
    salted = sizes.groupBy("source", "size", salt.alias("salt")).agg(F.count("*").alias("m"))
    per_cell = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = salted.withColumn("first", F.coalesce(F.sum("m").over(per_cell), F.lit(0)))
    plan = salted.alias("a").join(c.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select("a.source", "a.size", "salt", "first", "n", "source_size", "target", "rate", "k", "rest")
    own = Window.partitionBy("source", "size", "salt").orderBy("key", "doc_id")
    ranked = sizes.withColumn("salt", salt).withColumn("rank", F.row_number().over(own) - 1)
    r = ranked.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.size") == F.col("p.size")) & (F.col("r.salt") == F.col("p.salt")))
    at = F.col("first") + F.col("rank")
    whole = F.floor(F.col("k") / F.col("n"))
    extra = F.col("k") - whole * F.col("n")
    copies = (whole + F.when(at < extra, 1).otherwise(0)).cast("long")
    part = F.when(at == extra, F.col("rest")).otherwise(0).cast("long")
    return r.select("r.doc_id", "r.source", "r.size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("r.size") + part).alias("taken"), F.col("r.key").alias("key"))


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed rows themselves: each document as often as it has copies, with all its columns.

    The cut copy that completes a source keeps its first words, joined by spaces.  Documents without
    words carry none of the mix and are left out, as are those whose rate rounds to no copy.
    """
    columns = docs.columns
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.col(source_col))
    plan = mix(docs, weights, cap, id_col, text_col, source_col, key).filter("taken > 0")
    plan = plan.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list(F.struct("copies", (F.col("taken") - F.col("copies") * F.col("size")).alias("part"))).alias("__plan"))
    rows = docs.withColumn("__hash", key)
    joined = rows.join(plan, rows[id_col].eqNullSafe(plan["__id"]) & (F.col("__hash") == F.col("__key")))
    # Rows equal in id, text and source share one list of plans: row i of them takes entry i.
    same = Window.partitionBy("__id", "__key").orderBy("__hash")
    joined = joined.withColumn("__p", F.get(F.col("__plan"), F.row_number().over(same) - 1)).filter("__p is not null")
    cuts = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__p.copies").cast("int")), F.when(F.col("__p.part") > 0, F.array(F.col("__p.part"))).otherwise(F.array().cast("array<bigint>")))
    joined = joined.withColumn("__cut", F.explode(cuts))
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda x: F.length(x) > 0)
    text = F.when(F.col("__cut") < 0, F.col(text_col)).otherwise(F.array_join(F.slice(words, F.lit(1), F.greatest(F.col("__cut"), F.lit(0)).cast("int")), " "))
    out = joined.withColumn(text_col, text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length(text_col).cast("long"))
    return out.select(*columns)
