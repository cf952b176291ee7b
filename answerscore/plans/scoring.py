"""Queries over tokens, matches, features and scores, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscore.config import LEXICAL, SOFTENED, merged
from answerscore.functions import text as T
from answerscore.operators import features as FE
from answerscore.operators import matching as M
from answerscore.operators import polarity
from answerscore.operators.score import finish, guards, score, score_whole
from answerscore.operators.tokens import CONTENT, side_texts, token_rows, token_sets
from answerscore.operators.whole import whole_features
from answerscore.tables import materialised

from . import inputs as I
from . import oracle as O

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DOC_TEXTS = "texts AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'd' AS side, coalesce(text, '') AS text FROM documents)"


_LONG = {"pos", "first", "last", "first_pos", "n_kept", "n_tokens", "slots", "pairs", "at_other", "adjacency_gt", "adjacency_a", "entity_gt", "entity_a"}


def _longs(df: DataFrame) -> DataFrame:
    """Positions and sizes as longs, as SQL counts them."""
    return df.withColumns({c: F.col(c).cast("long") for c, kind in df.dtypes if c in _LONG and kind == "int"})


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir: _longs(f(spark, sf_dir))
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents")
    return token_rows(docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("d").alias("side"), F.coalesce("text", F.lit("")).alias("text")))


def case_tokens(spark: SparkSession) -> DataFrame:
    return token_rows(side_texts(I.triples_cases(spark)))


def conv_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(side_texts(I.triples_conv(spark, sf_dir)))


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def q6(*names: str, of: str = "") -> str:
    return ", ".join(f"round({of}{n}, 6) AS {n}" for n in names)


# --- tokens -------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{T.WORD}')) AS n_tokens, least(len(regexp_extract_all(coalesce(text, ''), '{T.WORD}')), 2048) AS n_kept FROM documents")
def tok_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return I.table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(text)).alias("n_tokens"), F.size(T.tokens(text)).alias("n_kept"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(list_transform(regexp_extract_all(text, '{T.WORD}'), lambda w: {O.key('w')})) AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 50")
def tok_top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("tok")).select(T.word_key(F.col("tok")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(50)


@query(f"SELECT word, {O.fnv('word')} AS hash FROM (SELECT DISTINCT unnest(list_transform(regexp_extract_all(text, '{T.WORD}'), lambda w: {O.key('w')})) AS word FROM documents)")
def tok_hash_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = I.table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("tok")).select(T.word_key(F.col("tok")).alias("word")).distinct()
    return words.select("word", T.fnv1a(F.col("word")).alias("hash"))


@query(f"WITH {O.tokens(DOC_TEXTS)} SELECT tok, key, stem, alt, min(w) AS least, max(w) AS most, count(*) AS n FROM tok GROUP BY tok, key, stem, alt")
def tok_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems, alternatives and weights of all tokens of the documents."""
    return doc_tokens(spark, sf_dir).groupBy("tok", "key", "stem", "alt").agg(F.min("w").alias("least"), F.max("w").alias("most"), F.count("*").alias("n"))


_CS = O.sides(I.SQL_CS)
_CONV = O.sides(I.SQL_CONV)
_TOKEN_COLUMNS = ("id", "side", "pos", "tok", "key", "stem", "alt", "w", "numeric", "proper", "cap", "bnd", "acro", "first", "pre", "scale", "val", "neg")


@query(f"WITH {_CS} SELECT id, side, pos, tok, key, stem, alt, w FROM tok", "tok_stem")
def tok_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_tokens(spark).select("id", "side", "pos", "tok", "key", "stem", "alt", "w")


@query(f"WITH {_CS} SELECT id, side, count(*) FILTER (w > 5000) AS content, CAST(sum(w) AS BIGINT) AS weight FROM tok GROUP BY id, side")
def tok_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_tokens(spark).groupBy("id", "side").agg(F.count_if(F.col("w") > CONTENT).alias("content"), F.sum("w").alias("weight"))


@query(f"WITH {O.tokens(DOC_TEXTS)} SELECT id, count(*) FILTER (numeric) AS numerics, count(*) FILTER (val > 0) AS figures, round(max(val), 3) AS largest, count(*) FILTER (neg) AS negated, count(*) FILTER (bnd) AS bounds FROM tok GROUP BY id")
def tok_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric tokens, figures, negated tokens and clause ends of every document."""
    rows = doc_tokens(spark, sf_dir)
    return rows.groupBy("id").agg(F.count_if("numeric").alias("numerics"), F.count_if(F.col("val") > 0).alias("figures"), F.round(F.max("val"), 3).alias("largest"), F.count_if("neg").alias("negated"), F.count_if("bnd").alias("bounds"))


@query(f"WITH {_CS} SELECT id, side, pos, tok, numeric, scale, round(val, 3) AS val FROM tok WHERE numeric OR scale > 0 OR val > 0")
def case_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_tokens(spark).filter("numeric or scale > 0 or val > 0").select("id", "side", "pos", "tok", "numeric", "scale", F.round("val", 3).alias("val"))


@query(f"WITH {_CS} SELECT id, side, pos, tok, acro, first, pre, cap, proper FROM tok WHERE cap")
def tok_acronyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_tokens(spark).filter("cap").select("id", "side", "pos", "tok", "acro", "first", "pre", "cap", "proper")


@query(f"WITH {_CS} SELECT id, pos, first, last, 'a' AS side FROM {O.bridge('a', 'gt')} UNION ALL SELECT id, pos, first, last, 'gt' FROM {O.bridge('gt', 'a')}")
def acronym_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_tokens(spark)
    return M.acronym_bridges(rows, "a", "gt").withColumn("side", F.lit("a")).unionByName(M.acronym_bridges(rows, "gt", "a").withColumn("side", F.lit("gt")))


@query(f"WITH {_CS} SELECT id, side, pos, tok, bnd, neg FROM tok")
def clause_negation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_tokens(spark).select("id", "side", "pos", "tok", "bnd", "neg")


# --- guards -------------------------------------------------------------------------------------------------------
def _all_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.triples_conv(spark, sf_dir).unionByName(I.triples_cases(spark))


_BOTH = I.SQL_CONV.replace("\ntriples AS", "\nconv AS") + ",\n" + I.SQL_CS.replace("\ntriples AS", "\nwritten AS") + ",\ntriples AS (SELECT * FROM conv UNION ALL SELECT * FROM written)"


@query(f"WITH {_BOTH}, {O.GUARDS} SELECT id, CAST(guard AS DOUBLE) AS guard, guard IS NULL AS open FROM guards", "guard_texts")
def guard_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank answers, empty ground truths, and texts equal in what counts."""
    return guards(_all_triples(spark, sf_dir)).select("id", "guard", F.col("guard").isNull().alias("open"))


# --- sets and matches ---------------------------------------------------------------------------------------------
@query(f"WITH {_CONV}, {O.SETS} SELECT id, side, word, first_pos FROM sets")
def set_first_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_sets(conv_tokens(spark, sf_dir)).select("id", "side", "word", "first_pos")


@query(f"WITH {_CONV}, {O.SETS}, {O.MARKED} SELECT id, side, pos, spot AS at_other, in_q, hit FROM marked")
def match_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = conv_tokens(spark, sf_dir)
    return FE.annotated(rows, token_sets(rows)).select("id", "side", "pos", "at_other", "in_q", "hit")


@query(f"WITH {_CS} SELECT t.id, t.pos FROM tok t WHERE t.side = 'a' AND t.scale > 0 AND EXISTS (SELECT 1 FROM tok o WHERE o.id = t.id AND o.side = 'gt' AND o.scale = t.scale)")
def scale_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scale_hits(case_tokens(spark), "a", "gt")


def _marked(spark: SparkSession, triples: DataFrame):
    """Token rows and their matches, written once as several aggregations read them."""
    rows = materialised(token_rows(side_texts(triples)), "tokens")
    return rows, materialised(FE.annotated(rows, materialised(token_sets(rows), "sets")), "marked")


@query(f"WITH {_CONV}, {O.SETS}, {O.MARKED}, {O.PRECISION} SELECT id, {q6('p_hit', 'p_tot', 'an_content', 'an_novel')} FROM prec")
def lex_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, marked = _marked(spark, I.triples_conv(spark, sf_dir))
    return FE.precision(marked).select("id", *r6("p_hit", "p_tot", "an_content", "an_novel"))


@query(f"WITH {_CONV}, {O.SETS}, {O.MARKED}, {O.RECALL} SELECT id, {q6('r_hit', 'r_tot', 'k_hit', 'k_tot', 'contra_w')} FROM rec")
def lex_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, marked = _marked(spark, I.triples_conv(spark, sf_dir))
    return FE.recall(marked, rows).select("id", *r6("r_hit", "r_tot", "k_hit", "k_tot", "contra_w"))


def _lex(spark: SparkSession, triples: DataFrame) -> DataFrame:
    rows, marked = _marked(spark, triples)
    return FE.combined(FE.precision(marked).join(FE.recall(marked, rows), "id")).select("id", *r6("p", "r", "lex"))


_LEX_SQL = f"{O.SETS}, {O.MARKED}, {O.PRECISION}, {O.RECALL}, {O.COMBINED} SELECT id, {q6('p', 'r', 'lex')} FROM lexed"


@query(f"WITH {_CONV}, {_LEX_SQL}")
def lex_fbeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lex(spark, I.triples_conv(spark, sf_dir))


@query(f"WITH {O.sides(I.SQL_BENCH, whole=True)}, {_LEX_SQL}")
def lex_fbeta_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical parts of the score of whole documents; documents and passages without tokens have no row."""
    sums = whole_features(I.triples_bench(spark, sf_dir), only_lexical=True).filter("p_tot is not null")
    return FE.combined(sums).select("id", *r6("p", "r", "lex"))


# --- grams --------------------------------------------------------------------------------------------------------
@query(f"WITH {I.SQL_CONV}, {O.GRAMS} SELECT id, {q6('gram3', 'gram2')} FROM grams")
def gram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FE.grams(I.triples_conv(spark, sf_dir)).select("id", *r6("gram3", "gram2"))


@query(f"WITH slots AS (SELECT doc_id, {O.gram_list('coalesce(text, chr(32))', 3)} AS s FROM documents) SELECT doc_id, len(s) AS slots FROM slots")
def gram_slot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct trigram slots of every document."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "text")
    return T.with_gram_slots(docs, "text", "s", 3).select("doc_id", F.size("s").alias("slots"))


@query(f"WITH {_CONV}, {O.ADJACENT} SELECT id, {q6('adjacency')}, adjacency_gt, adjacency_a FROM adjacent WHERE adjacency_gt + adjacency_a > 0")
def adjacency_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = M.content_bigrams(conv_tokens(spark, sf_dir)).filter("side in ('gt', 'a')")
    return FE.paired(both, "bigrams", "adjacency").select("id", *r6("adjacency"), "adjacency_gt", "adjacency_a")


# --- facts --------------------------------------------------------------------------------------------------------
def _case_features(spark: SparkSession) -> DataFrame:
    return FE.combined(FE.features(I.triples_cases(spark)))


_CASE_FEATURES = f"WITH {_CS}, {O.FEATURES}"


@query(f"{_CASE_FEATURES} SELECT id, {q6('contra_w', 'k_tot')}, round(CASE WHEN contra_w > 0 AND k_tot > 0 THEN 1 - least(1.0, CAST(contra_w AS DOUBLE) / k_tot) ELSE 1.0 END, 6) AS factor FROM feats")
def negated_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _case_features(spark)
    factor = F.when((F.col("contra_w") > 0) & (F.col("k_tot") > 0), 1 - F.least(F.lit(1.0), F.col("contra_w") / F.col("k_tot"))).otherwise(1.0)
    return f.select("id", *r6("contra_w", "k_tot"), F.round(factor, 6).alias("factor"))


@query(f"WITH {_CS}, {O.SETS}, {O.NUMBERS} SELECT id, gt_nums, gt_nums_hit, wrong_nums FROM numbers")
def numeric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_tokens(spark)
    return FE.numbers(rows, token_sets(rows)).select("id", "gt_nums", "gt_nums_hit", "wrong_nums")


@query(f"WITH {_CS}, {O.SETS}, {O.NUMBERS} SELECT id, gt_fig, gt_fig_hit, foreign_fig, gt_fig > 0 AND gt_fig_hit = gt_fig AND foreign_fig = 0 AS perfect FROM numbers")
def figure_value_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = case_tokens(spark)
    perfect = (F.col("gt_fig") > 0) & (F.col("gt_fig_hit") == F.col("gt_fig")) & (F.col("foreign_fig") == 0)
    return FE.numbers(rows, token_sets(rows)).select("id", "gt_fig", "gt_fig_hit", "foreign_fig", perfect.alias("perfect"))


@query(f"WITH {_CS} SELECT x.id, x.pos FROM tok x WHERE x.side = 'a' AND x.val > 0 AND abs(x.val - 1) >= 1e-6 AND NOT EXISTS (SELECT 1 FROM tok y WHERE y.id = x.id AND y.side IN ('gt', 'q') AND y.val > 0 AND {O.CLOSE})")
def figure_foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.foreign_figures(case_tokens(spark)).select("id", "pos")


@query(f"WITH {O.tokens(DOC_TEXTS)}, {O.ENTITY} SELECT id, len(s) AS pairs FROM enslots")
def entity_figure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.entity_figures(doc_tokens(spark, sf_dir)).select("id", F.size("pairs").alias("pairs"))


@query(f"{_CASE_FEATURES} SELECT id, {q6('entity')}, entity_gt, entity_a, entity_gt > 0 AND entity_a > 0 AND entity < 0.05 AND k_tot > 0 AND k_hit >= k_tot * 0.999 AS swapped FROM feats")
def entity_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _case_features(spark)
    full = (F.col("k_tot") > 0) & (F.col("k_hit") >= F.col("k_tot") * 0.999)
    return f.select("id", *r6("entity"), "entity_gt", "entity_a", ((F.col("entity_gt") > 0) & (F.col("entity_a") > 0) & (F.col("entity") < 0.05) & full).alias("swapped"))


@query(f"{_CASE_FEATURES} SELECT id, {q6('p_raw', 'adjacency')}, content_gt, content_a, k_tot > 0 AND k_hit >= k_tot * 0.999 AND p_raw >= 0.999 AND adjacency < 0.15 AND content_gt >= 3 AND content_a >= 3 AS reordered FROM feats")
def order_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _case_features(spark)
    full = (F.col("k_tot") > 0) & (F.col("k_hit") >= F.col("k_tot") * 0.999)
    test = full & (F.col("p_raw") >= 0.999) & (F.col("adjacency") < 0.15) & (F.col("content_gt") >= 3) & (F.col("content_a") >= 3)
    return f.select("id", *r6("p_raw", "adjacency"), "content_gt", "content_a", test.alias("reordered"))


_AXIS_COLUMNS = ("verdict", "authenticity", "direction", "verdict_mixed", "authenticity_mixed", "direction_mixed")


@query(f"WITH {_CS}, {O.STANCES} SELECT id, side, negates, {', '.join(_AXIS_COLUMNS)} FROM stances")
def polarity_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polarity.stances(case_tokens(spark)).select("id", "side", "negates", *_AXIS_COLUMNS)


@query(f"WITH {_CS}, {O.GRAMS}, {O.STANCES}, {O.TALLY} SELECT id, agree, contra, silent, two_faced, negation_differs FROM tally")
def polarity_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polarity.tally(polarity.stances(case_tokens(spark)), FE.grams(I.triples_cases(spark)))


@query(f"WITH {_CS}, {O.FEATURES}, {O.finished(merged(LEXICAL, {'m_num_match': 0.5}))} SELECT id, {q6('raw', 'score')} FROM scored")
def numeric_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the cases under a profile that rewards complete and clean figures."""
    return finish(FE.features(I.triples_cases(spark)), merged(LEXICAL, {"m_num_match": 0.5})).select("id", *r6("raw", "score"))


# --- the score ----------------------------------------------------------------------------------------------------
@query(f"WITH {O.scored(I.SQL_CONV)} SELECT id, {q6('score')} FROM final")
def score_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the lexical score of every conversation answer."""
    return score(I.triples_conv(spark, sf_dir)).select("id", *r6("score"))


@query(f"WITH {O.scored(I.SQL_CS)} SELECT id, {q6('score')} FROM final")
def score_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(I.triples_cases(spark)).select("id", *r6("score"))


@query(f"WITH {O.scored(I.SQL_BENCH, whole=True)} SELECT id, {q6('score')} FROM final")
def score_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical score of every whole document."""
    return score_whole(I.triples_bench(spark, sf_dir)).select("id", *r6("score"))


_WORDS = "CAST(len(regexp_extract_all(a, '[^ \\t\\n\\f\\r]+')) AS DOUBLE)"


@query(f"WITH {I.SQL_CONV} SELECT id, round(least({_WORDS}, 100000) / (least({_WORDS}, 100000) + 70), 6) AS reward FROM triples")
def length_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.triples_conv(spark, sf_dir).select("id", F.round(T.length_reward(F.col("a")), 6).alias("reward"))


@query(f"WITH {I.SQL_CONV}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(a), '\\s+'), lambda x: x <> '') AS x, regexp_split_to_array(lower(gt), '\\s+') AS y FROM triples) SELECT id, round(CASE WHEN len(x) > 0 THEN CAST(len(list_filter(x, lambda v: list_contains(y, v))) AS DOUBLE) / len(x) ELSE 0.0 END, 6) AS overlap FROM w")
def word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain baseline: share of the answer's words that the ground truth has."""
    return I.triples_conv(spark, sf_dir).select("id", F.round(T.word_overlap(F.col("a"), F.col("gt")), 6).alias("overlap"))


# --- the score with similarities and word vectors ------------------------------------------------------------------
_IDS = [f"{c[0]}:{kind}" for c in I.CASES for kind in ("good", "bad")]
#: (id, ca, c2, c4, cb, cq): stand-ins for an encoder's similarities
_SIMS = [(key, *(round((i * step + 7) % 100 / 100, 2) for step in (37, 53, 71, 89, 29))) for i, key in enumerate(_IDS)]
_BLENDS = {
    "score_embedded": replace(SOFTENED, w_qa=0.2, emb_a_w=0.25, emb_l2_w=0.1, emb_l4_w=0.05, emb_b_w=0.6, emb_lex_w=0.2),
    "score_gated_step": replace(SOFTENED, w_qa=0.3, emb_b_w=1.0, gate_lex=0.3, step_t=0.4, step_b=0.1, tie_src=6),
    "score_depth_tie": replace(SOFTENED, emb_l2_w=0.5, emb_l4_w=0.5, emb_b_w=0.0, step_t=0.5, step_b=0.2, step_w=0.1, tie_src=7),
}
_TIES = {6: "0.5 * lex_only + 0.5 * cb", 7: "c2"}


def _sims_sql() -> str:
    return "sims AS (SELECT * FROM (VALUES " + ", ".join(f"('{r[0]}', " + ", ".join(f"{x}::DOUBLE" for x in r[1:]) + ")" for r in _SIMS) + ") t(id, ca, c2, c4, cb, cq))"


def _blend_sql(c) -> str:
    topical = f"({1 - c.w_qa} * ({c.emb_a_w} * ca + {c.emb_l2_w} * c2 + {c.emb_l4_w} * c4 + {c.emb_b_w} * cb) + {c.w_qa} * cq)"
    raw = O.clamp(f"{topical} * {O.clamp(f'lex_only / {c.gate_lex}')}" if c.gate_lex else f"{topical} + {c.emb_lex_w} * lex_only")
    score = None
    if c.step_t:
        hard = O.clamp(f"(raw - {c.step_t - c.step_w}) / {2 * c.step_w}") if c.step_w else f"CASE WHEN raw >= {c.step_t} THEN 1.0 ELSE 0.0 END"
        score = f"{1 - c.step_b} * {hard} + {c.step_b} * {O.clamp(_TIES[c.tie_src])}"
    elif not c.sharpen:
        score = "raw"
    done = O.finished(c, "embedded", raw, score)
    return f"""WITH {O.sides(I.SQL_CS)},\n{O.FEATURES},\n{_sims_sql()}, embedded AS (SELECT f.*, s.ca, s.c2, s.c4, s.cb, s.cq FROM feats f JOIN sims s ON s.id = f.id),
{done},\n{O.GUARDS} SELECT t.id, round(coalesce(g.guard, s.score, 0.0), 6) AS score FROM triples t LEFT JOIN guards g ON g.id = t.id LEFT JOIN scored s ON s.id = t.id"""


def _sims(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SIMS, "id string, ca double, c2 double, c4 double, cb double, cq double")


def _blended(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return score(I.triples_cases(spark), _BLENDS[name], sims=_sims(spark)).select("id", *r6("score"))

    return query(_blend_sql(_BLENDS[name]), name)(run)


for _name in _BLENDS:
    _blended(_name)

_GUARD_ROWS = [("n1", "which city", "", "Lisbon", 0.8), ("n2", "", "", "Lisbon", 0.8), ("n3", "which city", "", " \t", 0.8), ("n4", "which city", "", "Porto", 0.3), ("e1", "which city", "It is Lisbon.", "it is LISBON", 0.6), ("e2", "", "Lisbon", "lisbon!", 0.6), ("e3", "which city", "Lisbon", "", 0.6)]
_GUARDED = replace(LEXICAL, nogt_q=1.0, exact_tie=0.5, step_t=0.5, step_b=0.1)
_GUARD_SQL = "g AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r[:4]) + f", {r[4]}::DOUBLE)" for r in _GUARD_ROWS) + ") t(id, q, gt, a, cq))"


@query(f"WITH {_GUARD_SQL} SELECT id, round(CASE WHEN NOT regexp_matches(a, '[^ \\t]') THEN 0.0 WHEN q = '' THEN 0.0 ELSE 0.9 * CASE WHEN cq >= 0.5 THEN 1.0 ELSE 0.0 END + 0.1 * cq END, 6) AS score FROM g WHERE gt = ''")
def guard_no_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without a ground truth, by how well they fit the question."""
    return _guarded(spark).filter("id like 'n%'")


@query(f"WITH {_GUARD_SQL} SELECT id, round(CASE WHEN a = '' THEN 0.0 WHEN q = '' THEN 1.0 ELSE 1.0 - 0.5 * (1.0 - cq) END, 6) AS score FROM g WHERE gt <> ''")
def exact_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers equal to the ground truth, told apart by the question."""
    return _guarded(spark).filter("id like 'e%'")


def _guarded(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(_GUARD_ROWS, "id string, q string, gt string, a string, cq double")
    sims = rows.select("id", *(F.lit(0.0).alias(c) for c in ("ca", "c2", "c4", "cb")), "cq")
    return score(rows.drop("cq"), _GUARDED, sims=sims).select("id", *r6("score"))
