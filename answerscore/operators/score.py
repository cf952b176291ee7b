"""The score of an answer: guards, features, penalties, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscore.config import LEXICAL, Config
from answerscore.functions import text as T
from answerscore.functions.calibration import calibrated, clamp01, step_tiebreak
from answerscore.tables import materialised

from .features import combined, features
from .tokens import side_texts, token_rows
from .vectors import blend, sentence_cos, soft_credits, topical
from .whole import whole_features


SIMS = ("ca", "c2", "c4", "cb", "cq")


def guards(triples: DataFrame, config: Config = LEXICAL) -> DataFrame:
    """Add ``guard``: the score that the texts alone decide, or null.

    Blank answer: 0.  Empty ground truth: 0, or with ``nogt_q`` and a column ``cq`` how well the answer fits the question.
    Ground truth and answer equal in what counts: 1, or with ``exact_tie`` and ``cq`` less by that share of the distance
    to the question.  With an empty question these are 0 and 1.
    """
    texts = triples.select("*", *(F.coalesce(F.col(c) if c in triples.columns else F.lit(None).cast("string"), F.lit("")).alias("__" + c) for c in ("q", "gt", "a")))
    missing, exact = F.lit(0.0), F.lit(1.0)
    if "cq" in triples.columns:
        fit, asked = clamp01(F.col("cq")), F.col("__q") != ""
        if config.nogt_q > 0:
            stepped = step_tiebreak(fit, fit, config.step_t, config.step_b, config.step_w) if config.step_t > 0 else fit
            missing = F.when(asked, stepped).otherwise(0.0)
        if config.exact_tie > 0:
            exact = F.when(asked, clamp01(1.0 - config.exact_tie * (1.0 - fit))).otherwise(1.0)
    same = T.alike_at_head(F.col("__gt"), F.col("__a")) & (T.normalised(F.col("__gt")) == T.normalised(F.col("__a")))  # whole texts only where they may be equal
    guard = F.when(T.is_blank(F.col("__a")), 0.0).when(F.col("__gt") == "", missing).when(same, exact)
    return texts.withColumn("guard", guard).drop("__q", "__gt", "__a")


def penalised(raw: Column, config: Config) -> Column:
    """``raw`` after the multiplicative facts: order, entities, negation, numbers, polarity, figures."""
    c = F.col
    full = (c("k_tot") > 0) & (c("k_hit") >= c("k_tot") * 0.999)
    reordered = full & (c("p_raw") >= 0.999) & (c("adjacency") < 0.15) & (c("content_gt") >= 3) & (c("content_a") >= 3)
    swapped = (c("entity_gt") > 0) & (c("entity_a") > 0) & (c("entity") < 0.05) & full
    negated = (c("contra_w") > 0) & (c("k_tot") > 0)
    factor = lambda applies, x: F.when(applies, x).otherwise(1.0)  # noqa: E731  (raw stays once in the expression)
    raw = raw * factor(reordered, config.m_order) * factor(swapped, config.m_entity)
    raw = raw * factor(negated, 1 - config.m_negcov * clamp01(c("contra_w") / c("k_tot")))
    missing = config.m_num_miss_base + (1 - config.m_num_miss_base) * c("gt_nums_hit") / c("gt_nums")
    raw = raw * factor(c("gt_nums") > 0, missing)
    raw = raw * factor((c("gt_nums") > 0) & (c("wrong_nums") > 0) & (c("gt_nums_hit") < c("gt_nums")), config.m_num_wrong)
    decided = (c("contra") > 0) | (c("two_faced") > 0)
    lone = ~decided & (c("agree") == 0) & (c("silent") == 0) & c("negation_differs")
    raw = (
        F.when(c("contra") > 0, raw * config.m_contra).when(c("two_faced") > 0, raw * config.m_two_faced).when(c("agree") > 0, raw + (1 - raw) * config.b_agree)
        .when(c("silent") > 0, raw * config.m_silent).when(lone, raw * (1 - 0.35 * c("lex"))).otherwise(raw)
    )
    if config.m_num_match > 0:
        perfect = (c("gt_nums") > 0) & (c("gt_fig") > 0) & (c("gt_fig_hit") == c("gt_fig")) & (c("foreign_fig") == 0)
        raw = F.when(perfect & ~(reordered | swapped | negated | decided | lone), raw + (1 - raw) * config.m_num_match).otherwise(raw)
    return clamp01(raw)


def finish(f: DataFrame, config: Config = LEXICAL) -> DataFrame:
    """Add lex_only, raw and score to feature rows; sweeps call this again and again on one feature table."""
    f = combined(f, config.f_beta2, config.p_concave, config.r_key_base, config.r_floor)
    f = f.withColumn("lex_only", clamp01(config.w_lex * F.col("lex") + config.w_gram3 * F.col("gram3") + config.w_gram2 * F.col("gram2")))
    raw = F.col("lex_only")
    ties = {1: F.col("lex_only"), 2: F.col("gram3"), 3: F.col("r")}
    if config.w_emb > 0 and set(SIMS) <= set(f.columns):
        raw = blend(topical(*map(F.col, SIMS), config), raw, config)
        ties |= {4: F.col("cq"), 5: F.col("ca"), 6: clamp01(0.5 * F.col("lex_only") + 0.5 * F.col("cb")), 7: F.col("c2"), 8: F.col("c4")}
    elif config.w_emb > 0 and "sentence_cos" in f.columns:
        raw = clamp01((1 - config.w_emb) * raw + config.w_emb * F.col("sentence_cos"))
    elif config.w_emb > 0:
        raise ValueError("w_emb needs word vectors or the similarities of an encoder")
    f = f.withColumn("raw", penalised(raw, config))
    return f.withColumn("score", calibrated(F.col("raw"), config, ties, F.col("r")))


def score(triples: DataFrame, config: Config = LEXICAL, soft: DataFrame | None = None, words: DataFrame | None = None, sims: DataFrame | None = None) -> DataFrame:
    """(id, score) of each (id, q, gt, a); ids must be unique. Null texts are empty.

    ``words`` (word key, int8 vec) gives soft credit and, where ``w_emb`` is positive, the sentence cosine; ``sims``
    (id, ca, c2, c4, cb, cq; see :func:`encoder.similarities`) gives the encoder's blend instead.  ``soft`` are credits
    made elsewhere.  Similarities that a triple lacks are 0.
    """
    columns = ["id", "q", "gt", "a"]
    if sims is not None:
        triples = triples.join(sims.select("id", *SIMS), "id", "left").fillna(0.0, list(SIMS))
        columns += SIMS
    guarded = guards(triples, config)
    rest = guarded.filter("guard is null").select(*columns)
    cosines = None
    if words is not None:
        rows = materialised(token_rows(side_texts(rest.select("id", "q", "gt", "a"))), "tokens")
        soft = soft_credits(rows, words, config.soft_min, config.soft_w) if soft is None else soft
        cosines = sentence_cos(rows, words)
    f = features(rest.select("id", "q", "gt", "a"), soft, config.soft_cap_frac)
    if sims is not None:
        f = f.join(rest.select("id", *SIMS), "id")
    elif cosines is not None and config.w_emb > 0:
        f = f.join(cosines, "id", "left").fillna(0.0, ["sentence_cos"])
    scored = finish(f, config).select("id", "score")
    return guarded.select("id", "guard").join(scored, "id", "left").select("id", F.coalesce("guard", "score", F.lit(0.0)).alias("score"))


def score_whole(triples: DataFrame, config: Config = LEXICAL) -> DataFrame:
    """(id, score) as :func:`score` gives them without vectors, but over all tokens and bytes of the texts.

    A triple is scored where its texts are read: there is no shuffle, and nothing is written.
    """
    scored = finish(whole_features(guards(triples.select("id", "q", "gt", "a"), config)), config)
    own = F.when(F.col("p_tot").isNotNull(), F.col("score"))  # without tokens on one side there are no features
    return scored.select("id", F.coalesce("guard", own, F.lit(0.0)).alias("score"))
