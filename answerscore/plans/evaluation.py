"""Queries over scored rows: gates, agreement, sweeps, ledgers, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscore.config import LEXICAL, grid, merged
from answerscore.functions import calibration as C
from answerscore.functions import text as T
from answerscore.operators import agreement as A
from answerscore.operators import evaluate as E
from answerscore.operators import features as FE
from answerscore.operators import ledger as L
from answerscore.operators import sweep as S
from answerscore.operators.score import score
from answerscore.streaming import status
from answerscore.tables import shared_folder

from . import inputs as I
from . import oracle as O

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- inputs -------------------------------------------------------------------------------------------------------
def _two_scorers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, q, x, y): each conversation answer under two plain scorers, rounded so that ties are ties everywhere."""
    t = I.triples_conv(spark, sf_dir)
    return t.select("id", F.split_part("id", F.lit("-"), F.lit(1)).alias("conv"), F.round(T.word_overlap(F.col("a"), F.col("gt")), 9).alias("x"), F.round(T.length_reward(F.col("a")), 9).alias("y"))


_WORDS = "CAST(len(regexp_extract_all(a, '[^ \\t\\n\\f\\r]+')) AS DOUBLE)"
_TWO = f"""WITH {I.SQL_CONV},
w AS (SELECT id, a, list_filter(regexp_split_to_array(lower(a), '\\s+'), lambda x: x <> '') AS x, regexp_split_to_array(lower(gt), '\\s+') AS y FROM triples),
two AS (SELECT id, split_part(id, '-', 1) AS conv, round(CASE WHEN len(x) > 0 THEN CAST(len(list_filter(x, lambda v: list_contains(y, v))) AS DOUBLE) / len(x) ELSE 0.0 END, 9) AS x, round({_WORDS} / ({_WORDS} + 70), 9) AS y FROM w)"""


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, good): documents with a quality label, scored by their share of stop words."""
    from answerscore import lexicon

    docs, labels = I.table(spark, sf_dir, "documents"), I.table(spark, sf_dir, "labels")
    words = T.words(F.coalesce(F.col("text"), F.lit("")))
    docs = docs.select("doc_id", F.transform(words, T.word_key).alias("w"))
    share = F.size(F.filter("w", lambda x: x.isin(*lexicon.STOP))) / F.greatest(F.size("w"), F.lit(1))
    return docs.join(labels.filter("quality is not null"), "doc_id").select("doc_id", F.round(share, 3).alias("score"), F.col("quality").alias("good"))


def _labelled_sql() -> str:
    from answerscore import lexicon

    return f"""WITH wd AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{T.WORD}'), lambda t: {O.key('t')}) AS w FROM documents),
lb AS (SELECT doc_id, round(CAST(len(list_filter(w, lambda x: {O._in('x', lexicon.STOP)})) AS DOUBLE) / greatest(len(w), 1), 3) AS score, quality AS good FROM wd JOIN labels USING (doc_id) WHERE quality IS NOT NULL)"""


_LB = _labelled_sql()


def _case_scores(spark: SparkSession) -> DataFrame:
    return E.scored_cases(I.cases(spark), {"good": "good", "bad": "bad", "self": "ground_truth"})


_CASE_TRIPLES = I.SQL_CASES + """,
triples AS (SELECT id || '|good' AS id, question AS q, ground_truth AS gt, good AS a FROM cases UNION ALL SELECT id || '|bad', question, ground_truth, bad FROM cases UNION ALL SELECT id || '|self', question, ground_truth, ground_truth FROM cases)"""
_SCORED_CASES = f"""WITH {O.scored(_CASE_TRIPLES)},
wide AS (SELECT split_part(id, '|', 1) AS "case", max(score) FILTER (id LIKE '%|good') AS good, max(score) FILTER (id LIKE '%|bad') AS bad, max(score) FILTER (id LIKE '%|self') AS self FROM final GROUP BY 1)"""
_METRICS = """metrics AS (SELECT count(*) AS cases, count(*) FILTER (good > bad) AS wins, count(*) FILTER (good = bad) AS ties, avg(good - bad) AS candidate_margin, avg(good) AS mean_good, avg(bad) AS mean_bad,
    min(self) AS worst_self, min(good - bad) AS min_case_margin, array_to_string(list_sort(list(CASE WHEN good = bad THEN "case" || '(tie)' WHEN good < bad THEN "case" END) FILTER (good <= bad)), ',') AS losses,
    (SELECT stddev_samp(x) FROM (SELECT good AS x FROM wide UNION ALL SELECT bad FROM wide)) AS score_stddev FROM wide)"""


# --- gates --------------------------------------------------------------------------------------------------------
@query(f"{_SCORED_CASES}, {_METRICS} SELECT cases, wins, ties, round(candidate_margin, 6) AS candidate_margin, round(mean_good, 6) AS mean_good, round(mean_bad, 6) AS mean_bad, round(worst_self, 6) AS worst_self, round(min_case_margin, 6) AS min_case_margin, coalesce(losses, '') AS losses, round(score_stddev, 6) AS score_stddev FROM metrics")
def separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.separation(_case_scores(spark))
    rounded = {c: F.round(c, 6) for c in ("candidate_margin", "mean_good", "mean_bad", "worst_self", "min_case_margin", "score_stddev")}
    return m.withColumns(rounded | {"losses": F.array_join("losses", ",")})


@query(f"{_SCORED_CASES}, {_METRICS} SELECT cases, wins, round(candidate_margin, 6) AS candidate_margin, wins >= cases - 1 AND candidate_margin >= 0.40 AND worst_self >= 0.75 AS passed FROM metrics")
def family_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.family_gate(E.separation(_case_scores(spark))).select("cases", "wins", F.round("candidate_margin", 6).alias("candidate_margin"), "passed")


_ATTACK_TRIPLES = I.SQL_ATTACKS + ",\ntriples AS (SELECT name || '|honest' AS id, question AS q, ground_truth AS gt, honest AS a FROM attacks UNION ALL SELECT name || '|attack', question, ground_truth, attack FROM attacks)"


@query(f"""WITH {O.scored(_ATTACK_TRIPLES)},
wide AS (SELECT a.name, a.rule, h.score AS honest, x.score AS attack FROM attacks a JOIN final h ON h.id = a.name || '|honest' JOIN final x ON x.id = a.name || '|attack')
SELECT CASE WHEN rule IN ('below_honest', 'near_zero', 'near_honest') THEN name || ' [' || rule || ']' ELSE name END AS name,
    CASE rule WHEN 'below_honest' THEN attack < honest - 0.10 WHEN 'near_zero' THEN attack <= 0.20 WHEN 'near_honest' THEN attack >= honest - 0.15 ELSE false END AS ok,
    CASE WHEN rule IN ('below_honest', 'near_zero', 'near_honest') THEN printf('honest=%.4f attack=%.4f', honest, attack) ELSE 'unknown rule ' || rule END AS detail FROM wide""")
def attack_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    attacks = I.attacks(spark)
    scored = E.scored_cases(attacks.withColumnRenamed("name", "id"), {"honest": "honest", "attack": "attack"})
    return E.attack_checks(attacks.select("name", "rule").join(scored.withColumnRenamed("case", "name"), "name"))


@query()
def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.structural_checks(spark, I.cases(spark))


@query("""WITH a AS (SELECT 'lexical' AS module, round(avg(x), 6) AS m, count(*) FILTER (x > y) AS w FROM two), b AS (SELECT 'length' AS module, round(avg(y), 6) AS m, count(*) FILTER (y > x) AS w FROM two)
SELECT b.module, a.m >= b.m AND a.w >= b.w AS not_worse FROM a, b UNION ALL SELECT a.module, true FROM a""".replace("WITH a", _TWO + ", a", 1))
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _two_scorers(spark, sf_dir)
    one = two.agg(F.lit("lexical").alias("module"), F.round(F.avg("x"), 6).alias("candidate_margin"), F.count_if(F.col("x") > F.col("y")).alias("wins"))
    other = two.agg(F.lit("length").alias("module"), F.round(F.avg("y"), 6).alias("candidate_margin"), F.count_if(F.col("y") > F.col("x")).alias("wins"))
    return E.head_to_head(one, other.unionByName(one))


# --- agreement ----------------------------------------------------------------------------------------------------
_RANKED = "SELECT *, rank() OVER (PARTITION BY {g} ORDER BY x) + (count(*) OVER (PARTITION BY {g}, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {g} ORDER BY y) + (count(*) OVER (PARTITION BY {g}, y) - 1) / 2.0 AS ry FROM {t}"
_EV = "WITH ev AS (SELECT event_id, event_type, round(value, 2) AS x, CAST(user_id AS DOUBLE) AS y, 1 AS one FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "events").select("event_id", "event_type", F.round("value", 2).alias("x"), F.col("user_id").cast("double").alias("y"))


@query(f"{_EV}, r AS ({_RANKED.format(g='one', t='ev')}) SELECT count(*) AS n, round(coalesce(corr(rx, ry), 0), 6) AS rho FROM r")
def spearman_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pooled_spearman(_events(spark, sf_dir), "x", "y").select("n", F.round("rho", 6).alias("rho"))


@query(f"{_EV}, r AS ({_RANKED.format(g='event_type', t='ev')}) SELECT event_type, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY event_type")
def spearman_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.spearman(_events(spark, sf_dir), "x", "y", ["event_type"], flat_is_zero=False).select("event_type", "n", F.round("rho", 6).alias("rho"))


@query(f"{_TWO}, r AS ({_RANKED.format(g='conv', t='two')}), g AS (SELECT conv, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END AS rho FROM r GROUP BY conv HAVING count(*) >= 3) SELECT count(rho) AS groups, round(avg(rho), 6) AS rho FROM g WHERE rho IS NOT NULL")
def agreement_by_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean rank correlation of two scorers within conversations of three answers or more."""
    return A.mean_group_spearman(_two_scorers(spark, sf_dir), "x", "y", "conv").select("groups", F.round("rho", 6).alias("rho"))


@query(f"{_EV}, r AS ({_RANKED.format(g='one', t='ev')}) SELECT event_id, round(rx, 1) AS rank_x, round(ry, 1) AS rank_y, round(abs(rx - ry), 1) AS gap FROM r ORDER BY abs(rx - ry) DESC, event_id LIMIT 8")
def rank_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rank_gaps(_events(spark, sf_dir), "event_id", "x", "y").select("event_id", *(F.round(c, 1).alias(c) for c in ("rank_x", "rank_y", "gap")))


@query(f"{_TWO}, one AS (SELECT *, 1 AS one FROM two), r AS ({_RANKED.format(g='one', t='one')}) SELECT round(corr(rx, ry), 6) AS rho, corr(rx, ry) >= 0.60 AS agrees FROM r")
def agreement_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pooled_spearman(_two_scorers(spark, sf_dir), "x", "y").select(F.round("rho", 6).alias("rho"), A.agrees(F.col("rho")).alias("agrees"))


_MODULES = f"""{_TWO}, long AS (SELECT 'overlap' AS module, id AS row, x AS score FROM two UNION ALL SELECT 'length', id, y FROM two UNION ALL SELECT 'brevity', id, -y FROM two UNION ALL SELECT 'both', id, round(x + y, 9) FROM two)"""


@query(f"""{_MODULES}, p AS (SELECT a.module, b.module AS proxy, a.score AS x, b.score AS y FROM long a JOIN long b ON a.row = b.row WHERE b.module IN ('overlap', 'length')),
r AS ({_RANKED.format(g='module, proxy', t='p')}) SELECT module, proxy, count(*) AS n, round(coalesce(corr(rx, ry), 0), 4) AS rho FROM r GROUP BY module, proxy""")
def corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _two_scorers(spark, sf_dir)
    modules = F.array(*(F.struct(F.lit(n).alias("module"), c.alias("score")) for n, c in (("overlap", F.col("x")), ("length", F.col("y")), ("brevity", -F.col("y")), ("both", F.round(F.col("x") + F.col("y"), 9)))))
    return A.correlation_matrix(two.select(F.col("id").alias("row"), F.inline(modules)), ["overlap", "length"])


@query(f"""{_TWO}, len AS (SELECT two.id, two.x, length(a) AS y, 1 AS one FROM two JOIN triples ON triples.id = two.id), r AS ({_RANKED.format(g='one', t='len')})
SELECT round(corr(rx, ry), 6) AS with_length, round(-corr(rx, ry), 6) AS with_brevity FROM r""")
def length_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = I.triples_conv(spark, sf_dir).select("id", F.round(T.word_overlap(F.col("a"), F.col("gt")), 9).alias("x"), F.length("a").alias("y"))
    return A.pooled_spearman(t, "x", "y").select(F.round("rho", 6).alias("with_length"), F.round(-F.col("rho"), 6).alias("with_brevity"))


# --- sweeps -------------------------------------------------------------------------------------------------------
_ROC = "roc AS (SELECT c.cut, avg(CASE WHEN good = 1 THEN CAST(score >= c.cut AS DOUBLE) END) - avg(CASE WHEN good = 0 THEN CAST(score >= c.cut AS DOUBLE) END) AS margin FROM lb, (SELECT DISTINCT score AS cut FROM lb) c GROUP BY c.cut)"


@query(f"{_LB}, {_ROC} SELECT cut, round(margin, 6) AS margin FROM roc")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.roc(_labelled(spark, sf_dir)).select("cut", F.round("margin", 6).alias("margin"))


@query(f"{_LB}, {_ROC} SELECT cut AS best_cut, round(margin, 6) AS best_margin FROM roc ORDER BY round(margin, 12) DESC, cut LIMIT 1")
def roc_best_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.best_step(S.roc(_labelled(spark, sf_dir))).select("best_cut", F.round("best_margin", 6).alias("best_margin"))


@query(f"{_LB}, t AS (SELECT CAST(round(i * 0.02, 3) AS DOUBLE) AS cut FROM range(1, 50) r(i)) SELECT cut, round(avg(CASE WHEN good = 1 THEN CAST(score >= cut AS DOUBLE) END) - avg(CASE WHEN good = 0 THEN CAST(score >= cut AS DOUBLE) END), 6) AS margin FROM lb, t GROUP BY cut")
def roc_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.roc_at(_labelled(spark, sf_dir), S.fixed_thresholds(spark)).select("cut", F.round("margin", 6).alias("margin"))


@query(f"""{_LB}, g AS (SELECT c AS cut, b FROM (VALUES (0.1), (0.2), (0.3)) a(c), (VALUES (0.0), (0.02), (0.1)) d(b)),
x AS (SELECT g.cut, g.b, good, (1 - g.b) * CASE WHEN score >= g.cut THEN 1.0 ELSE 0.0 END + g.b * score AS v FROM lb, g)
SELECT CAST(cut AS DOUBLE) AS cut, CAST(b AS DOUBLE) AS b, round(avg(CASE WHEN good = 1 THEN v END), 6) AS mean_good, round(avg(CASE WHEN good = 0 THEN v END), 6) AS mean_bad, round(avg(CASE WHEN good = 1 THEN v END) - avg(CASE WHEN good = 0 THEN v END), 6) AS margin FROM x GROUP BY cut, b""")
def step_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = spark.createDataFrame([(c, b) for c in (0.1, 0.2, 0.3) for b in (0.0, 0.02, 0.1)], "cut double, b double")
    return S.step_grid(_labelled(spark, sf_dir), points).select("cut", "b", *(F.round(c, 6).alias(c) for c in ("mean_good", "mean_bad", "margin")))


@query(f"""{_LB}, {_ROC}, best AS (SELECT cut AS best_cut, round(margin, 6) AS best_margin FROM roc ORDER BY round(margin, 12) DESC, cut LIMIT 1),
s AS (SELECT min(score) FILTER (good = 1) AS low_good, max(score) FILTER (good = 1) AS high_good, avg(score) FILTER (good = 1) AS mg, min(score) FILTER (good = 0) AS low_bad, max(score) FILTER (good = 0) AS high_bad, avg(score) FILTER (good = 0) AS mb,
    count(score) AS n, count(score) - count(DISTINCT CAST(score AS FLOAT)) AS ties FROM lb)
SELECT low_good, high_good, round(mg, 6) AS mean_good, low_bad, high_bad, round(mb, 6) AS mean_bad, round(mg - mb, 6) AS margin, best_cut, best_margin, n, ties FROM s, best""")
def offline_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report on one scored set: ranges, margin, best step, ties."""
    report = S.offline_report(_labelled(spark, sf_dir))
    return report.withColumns({c: F.round(c, 6) for c in ("mean_good", "mean_bad", "margin", "best_margin")})


@query(f"""WITH {O.scored(_ATTACK_TRIPLES)},
wide AS (SELECT a.name, a.rule, h.score AS honest, x.score AS attack FROM attacks a JOIN final h ON h.id = a.name || '|honest' JOIN final x ON x.id = a.name || '|attack')
SELECT 'lexical' AS module, count(*) FILTER (NOT CASE rule WHEN 'below_honest' THEN attack < honest - 0.10 WHEN 'near_zero' THEN attack <= 0.20 WHEN 'near_honest' THEN attack >= honest - 0.15 ELSE false END) AS failed, true AS counts FROM wide""")
def attack_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed attack checks of the candidate."""
    return E.failures(QUERIES["attack_rules"](spark, sf_dir).withColumn("module", F.lit("lexical")), "lexical")


_UNIT = "u AS (SELECT event_id, (x - min(x) OVER ()) / nullif(max(x) OVER () - min(x) OVER (), 0) AS v FROM ev)"


def _unit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _events(spark, sf_dir)
    ends = ev.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return ev.crossJoin(F.broadcast(ends)).select("event_id", F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")).alias("v"))


_SM = lambda v: f"({v} * {v} * (3 - 2 * {v}))"


@query(f"{_EV}, {_UNIT}, p AS (SELECT event_id, CASE WHEN v <= 0.4 THEN 0.5 * v / 0.4 ELSE 0.5 + 0.5 * (v - 0.4) / 0.6 END AS a FROM u), s1 AS (SELECT event_id, {_SM('a')} AS b FROM p), s2 AS (SELECT event_id, {_SM('b')} AS c FROM s1) SELECT event_id, round(c + 0.5 * ({_SM('c')} - c), 6) AS y FROM s2")
def smoothstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_events(spark, sf_dir).select("event_id", F.round(C.smoothsteps(F.col("v"), 2, 0.4, 0.5), 6).alias("y"))


@query(f"{_EV}, {_UNIT} SELECT event_id, round(1 / (1 + exp(-8 * (v - 0.4545))), 6) AS y FROM u")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit_events(spark, sf_dir).select("event_id", F.round(C.logistic(F.col("v"), 8.0, 0.4545), 6).alias("y"))


@query(f"{_EV} SELECT event_type, count(x) AS n, count(x) - count(DISTINCT CAST(x AS FLOAT)) AS ties FROM ev GROUP BY event_type")
def f32_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.float_ties(_events(spark, sf_dir), "x", ["event_type"])


@query(f"{_EV} SELECT event_type, min(x) AS low, max(x) AS high, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS spread FROM ev GROUP BY event_type")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.summary(_events(spark, sf_dir), "x", ["event_type"]).select("event_type", "low", "high", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


_AXES = {"cb": [0.0, 0.15, 0.3, 0.45, 0.6, 0.8, 1.0], "cq": [0.0, 0.15, 0.3, 0.45, 0.6, 0.8, 1.0], "lex": [0.0, 0.15, 0.3, 0.45, 0.6, 0.8, 1.0], "r": [0.0, 0.15, 0.3]}


@query("SELECT CAST(((i * 7 + j) * 7 + k) * 3 + l AS INTEGER) AS point, a[i + 1] AS cb, a[j + 1] AS cq, a[k + 1] AS lex, b[l + 1] AS r FROM (SELECT [0.0, 0.15, 0.3, 0.45, 0.6, 0.8, 1.0]::DOUBLE[] AS a, [0.0, 0.15, 0.3]::DOUBLE[] AS b), range(0, 7) x(i), range(0, 7) y(j), range(0, 7) z(k), range(0, 3) w(l) WHERE i + j + k + l > 0")
def weight_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weight_grid(spark, _AXES)


_SMALL = {"x": [0.0, 0.5, 1.0], "y": [0.0, 0.5, 1.0]}
_BLEND = f"""{_TWO}, f AS (SELECT two.conv, two.x, two.y, CAST(length(t.a) % 97 AS DOUBLE) AS champ FROM two JOIN triples t ON t.id = two.id),
grid AS (SELECT i * 3 + j AS point, i / 2.0 AS wx, j / 2.0 AS wy FROM range(0, 3) a(i), range(0, 3) b(j) WHERE i + j > 0),
m AS (SELECT point, wx, wy, conv, round(least(1.0, wx * x + wy * y), 9) AS x, champ AS y FROM f, grid), r AS ({_RANKED.format(g='point, conv', t='m')}),
g AS (SELECT point, wx, wy, conv, CASE WHEN count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 THEN corr(rx, ry) END AS rho FROM r GROUP BY point, wx, wy, conv HAVING count(*) >= 3),
agree AS (SELECT point, wx AS x, wy AS y, avg(rho) AS rho, count(rho) AS groups FROM g WHERE rho IS NOT NULL GROUP BY point, wx, wy)"""


def _blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = I.triples_conv(spark, sf_dir).select("id", (F.length("a") % 97).cast("double").alias("champ"))
    f = _two_scorers(spark, sf_dir).join(t, "id")
    return S.blend_agreement(f, S.weight_grid(spark, _SMALL), ["x", "y"], "champ", "conv", [])


@query(f"{_BLEND} SELECT CAST(point AS INTEGER) AS point, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, groups, round(rho, 6) AS rho FROM agree")
def blend_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blends(spark, sf_dir).select("point", "x", "y", "groups", F.round("rho", 6).alias("rho"))


@query(f"{_BLEND} SELECT CAST(point AS INTEGER) AS point, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(rho, 6) AS rho FROM agree ORDER BY round(rho, 9) DESC, point LIMIT 1")
def best_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _blends(spark, sf_dir).withColumn("all", F.lit(1))
    return S.best_point(one, ["all"]).select("point", "x", "y", F.round("rho", 6).alias("rho"))


@query(f"{_BLEND} SELECT CAST(point AS INTEGER) AS point, round(rho, 6) AS mean_rho FROM agree ORDER BY round(rho, 9) DESC, point LIMIT 8")
def top_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_points(_blends(spark, sf_dir), ["x", "y"]).select("point", F.round("mean_rho", 6).alias("mean_rho"))


_CONFIGS = {f"g{i}": c for i, c in enumerate(grid(merged(LEXICAL), w_lex=[0.6, 0.76, 0.9], w_gram3=[0.1, 0.2], m_negcov=[0.6, 1.0]))}


def _config_sql() -> str:
    parts = []
    for name, c in _CONFIGS.items():
        parts.append(f"SELECT '{name}' AS config, id, score FROM (WITH {O.finished(c)} SELECT id, score FROM scored)")
    return f"WITH {O.sides(I.SQL_CS)},\n{O.FEATURES},\nruns AS (" + "\nUNION ALL ".join(parts) + ")"


_RUNS = _config_sql()


def _config_runs(spark: SparkSession) -> DataFrame:
    return S.config_scores(FE.features(I.triples_cases(spark)), _CONFIGS)


@query(f"{_RUNS} SELECT config, count(*) AS n, round(avg(CASE WHEN id LIKE '%:good' THEN score END) - avg(CASE WHEN id LIKE '%:bad' THEN score END), 6) AS margin FROM runs GROUP BY config ORDER BY margin DESC, config LIMIT 12")
def config_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins of a grid of configurations over one feature table, best twelve."""
    good, bad = (F.avg(F.when(F.endswith("id", F.lit(k)), F.col("score"))) for k in (":good", ":bad"))
    runs = _config_runs(spark).groupBy("config").agg(F.count("*").alias("n"), F.round(good - bad, 6).alias("margin"))
    return S.top_results(runs)


@query(f"{_RUNS} SELECT id, " + ", ".join(f"round(max(CASE WHEN config = '{c}' THEN score END), 6) AS {c}" for c in _CONFIGS) + " FROM runs GROUP BY id")
def pivot_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.report(_config_runs(spark).withColumn("score", F.round("score", 6)), "id", "config", list(_CONFIGS), "score")


# --- ledger and stream --------------------------------------------------------------------------------------------
@query(f"WITH {I.SQL_LEDGER}, o AS (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY CASE WHEN status = 'active' THEN 1 ELSE 0 END DESC, CASE WHEN status = 'active' THEN seq ELSE registration_id END DESC, seq) AS n FROM ledger) SELECT intent, registration_id, status FROM o WHERE n = 1")
def best_per_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.best_per_intent(I.ledger(spark)).select("intent", "registration_id", "status")


_PARSED = """d AS (SELECT *, CAST(json_extract(eval_details, '$.candidate_margin') AS DOUBLE) AS m, CAST(json_extract(eval_details, '$.champion_margin') AS DOUBLE) AS ch, coalesce(CAST(json_extract(eval_details, '$.historical_rows_evaluated') AS BIGINT), 0) AS n_rows,
    coalesce(try_cast(json_extract_string(eval_details, '$.spearman') AS DOUBLE), try_cast(regexp_extract(eval_details, '"spearman": [{]"[a-z]+": ([0-9.]+)', 1) AS DOUBLE)) AS rho FROM ledger)"""


@query(f"""WITH {I.SQL_LEDGER}, {_PARSED}, c AS (SELECT intent, coalesce(max(ch), 0) AS champion FROM d GROUP BY intent HAVING count(*) FILTER (status = 'active') = 0),
w AS (SELECT d.intent, d.registration_id, d.m, c.champion, row_number() OVER (PARTITION BY d.intent ORDER BY d.m DESC, d.seq) AS n FROM d JOIN c ON c.intent = d.intent WHERE d.m > c.champion AND NOT (d.n_rows > 0 AND coalesce(d.rho < 0.60, false)))
SELECT intent, registration_id, m AS candidate_margin, champion FROM w WHERE n = 1""")
def reclaim_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reclaim_winners(I.ledger(spark))


@query(f"WITH {I.SQL_LEDGER} SELECT intent FROM ledger GROUP BY intent HAVING count(*) FILTER (status = 'active') = 0")
def not_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.not_held(I.ledger(spark))


@query(f"WITH {I.SQL_LEDGER}, h AS (SELECT intent, bool_or(status = 'active') AS held FROM ledger GROUP BY intent) SELECT count(*) FILTER (held) AS active, count(*) AS total, array_to_string(list_sort(list(intent) FILTER (NOT held)), ',') AS missing FROM h")
def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.holdings(I.ledger(spark)).withColumn("missing", F.array_join("missing", ","))


_CHANGES = "SELECT key, status, seq FROM (SELECT CAST(user_id AS VARCHAR) AS key, event_type AS status, event_id AS seq, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS last FROM events) WHERE last IS NULL OR last <> status"


@query(_CHANGES)
def status_changes_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.changes_in_batch(_status_rows(I.table(spark, sf_dir, "events")))


def _status_rows(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))


@query(_CHANGES)
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; the changes it emits, read back from the sink's folder."""
    at = f"{shared_folder(spark)}/answerscore/status-{uuid.uuid4().hex}"
    schema = I.table(spark, sf_dir, "events").schema
    stream = _status_rows(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parq*"))
    status.log_changes(stream, f"{at}/log", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, status string, seq long").parquet(f"{at}/log")
