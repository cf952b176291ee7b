"""Queries over files in and out: each writes its rows to the shared folder, reads them back and has its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscore.functions import calibration as C
from answerscore.functions import text as T
from answerscore.functions.keccak import keccak256
from answerscore.operators import evaluate as E
from answerscore.operators import ledger as L
from answerscore.operators import sweep as S
from answerscore.operators import vectors as V
from answerscore.sources import files, vectors
from answerscore.streaming import status
from answerscore.tables import shared_folder

from . import inputs as I

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/answerscore/{name}-{uuid.uuid4().hex}"


def _written(spark: SparkSession, text: str, name: str) -> str:
    """A text file in a folder of its own."""
    path = _path(spark, name) + "/lex.json"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def _values(rows: list[tuple], names: str) -> str:
    def one(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({names})"


# --- sources ------------------------------------------------------------------------------------------------------
_CASE = ("id", "intent", "question", "ground_truth", "good", "bad")


@query(f"SELECT CAST(row AS INTEGER) AS row, id, intent, question, ground_truth, good, bad FROM {_values([(i, *c) for i, c in enumerate(I.CASES)], 'row, ' + ', '.join(_CASE))}")
def read_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, json.dumps({"note": "n", "cases": [dict(zip(_CASE, c)) for c in I.CASES]}, indent=1, ensure_ascii=False), "cases")
    return files.read_cases(spark, path)


_ATTACK = ("name", "rule", "question", "ground_truth", "honest", "attack")


@query(f"SELECT CAST(row AS INTEGER) AS row, name, rule, question, ground_truth, honest, attack FROM {_values([(i, *c) for i, c in enumerate(I.ATTACKS)], 'row, ' + ', '.join(_ATTACK))}")
def read_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _written(spark, json.dumps({"cases": [dict(zip(_ATTACK, c)) for c in I.ATTACKS]}), "attacks")
    return files.read_cases(spark, path, attacks=True).drop("why")


_TRAFFIC = [("how far", "5 km", "5km", None), ("who runs it", "the agency", "an agency", "m1"), ("when", "in March", "", "m2")]


def _traffic(spark: SparkSession) -> DataFrame:
    rows = [{"q": q, "gt": gt, "a": a} | ({"model": m} if m else {}) for q, gt, a, m in _TRAFFIC]
    return files.read_traffic(spark, _written(spark, json.dumps({"rows": rows}), "traffic"))


_SQL_TRAFFIC = f"traffic AS (SELECT CAST(row AS INTEGER) AS row, q, gt, a, model FROM {_values([(i, *r) for i, r in enumerate(_TRAFFIC)], 'row, q, gt, a, model')})"


@query(f"WITH {_SQL_TRAFFIC} SELECT * FROM traffic")
def read_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traffic(spark)


@query("SELECT CAST(row AS INTEGER) AS row, score FROM " + _values([(0, 0.5), (1, 0.25), (2, 1.0)], "row, score"))
def read_cached_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_cached_scores(spark, _written(spark, "[0.5,\n 0.25, 1]", "cached"), 3)


_DUMP = {"b:x:good": 1.0, "tp:x:y:bad": 0.125, "t:1": 0.5, "NEWS|002": 0.25, "other": 0.75}
_SQL_DUMP = f"dump AS (SELECT 'lex' AS file, id, score FROM {_values(list(_DUMP.items()), 'id, score')})"
_SQL_IDS = """ids AS (SELECT *, CASE WHEN regexp_matches(id, '^(b|tp):') THEN split_part(id, ':', 1) END AS "set", CASE WHEN regexp_matches(id, '^(b|tp):') THEN regexp_extract(id, '^[^:]+:(.*):[^:]*$', 1) END AS "case",
    CASE WHEN regexp_matches(id, '^(b|tp):') THEN regexp_extract(id, '[^:]*$') END AS kind, CASE WHEN contains(id, '|') THEN split_part(id, '|', 1) END AS intent, try_cast(regexp_extract(id, '^(t:|[^|]+[|])([0-9]+)$', 2) AS INTEGER) AS row FROM dump)"""


def _dump(spark: SparkSession) -> DataFrame:
    return files.read_dump(spark, _written(spark, json.dumps({"module": "m", "scores": _DUMP, "order": list(_DUMP)}), "dump"))


@query(f"WITH {_SQL_DUMP}, {_SQL_IDS} SELECT * FROM ids")
def read_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.parsed_ids(_dump(spark))


@query(f"WITH {_SQL_DUMP}, {_SQL_IDS}, {_SQL_TRAFFIC} SELECT t.*, i.file, i.intent, i.score FROM traffic t LEFT JOIN ids i ON i.row = t.row")
def traffic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic joined with the scores that a dump has at its row numbers."""
    return files.traffic_scores(_traffic(spark), _dump(spark))


_REGISTERED = [("NEWS", "text", "h1", 9236, 0.69, "40/40", 0.63, 0.57), ("MAPS", "numeric", "h2", 9237, 0.70, "39/40", None, None)]


def _ledger_json() -> str:
    rows = []
    for intent, profile, h, size, margin, wins, rho, family in _REGISTERED:
        metrics = {"margin": margin, "wins": wins} | ({"spearman": rho} if rho else {}) | ({"family": {"margin": family, "wins": "11/12"}} if family else {})
        rows.append({"intent": intent, "profile": profile, "hash": h, "url": "u", "tx": "t", "size": size, "values": {"W_LEX": 0.76}, "metrics": metrics})
    return json.dumps(rows, indent=2)


_FLAT = ("metrics.margin", "metrics.wins", "metrics.spearman", "metrics.family.margin as family")
_SQL_REGISTERED = f"SELECT intent, profile, hash, CAST(size AS INTEGER) AS size, margin, wins, spearman, family FROM {_values(_REGISTERED, 'intent, profile, hash, size, margin, wins, spearman, family')}"


@query(_SQL_REGISTERED)
def read_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_ledger(spark, _written(spark, _ledger_json(), "ledger")).selectExpr("intent", "profile", "hash", "size", *_FLAT)


@query(f"SELECT intent, size FROM ({_SQL_REGISTERED}) WHERE hash <> 'h1'")
def new_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose hash the ledger does not have."""
    rows = files.read_ledger(spark, _written(spark, _ledger_json(), "ledger"))
    return L.new_hashes(rows, spark.createDataFrame([("h1",)], "hash string")).select("intent", "size")


_GLOVE = "cat 3 4\nCat 1 0\nbad-word 1 1\ndog 0 2\nBird 1 1"


@query("SELECT word, a, b FROM " + _values([("cat", 3.0, 4.0), ("dog", 0.0, 2.0), ("Bird", 1.0, 1.0)], "word, a, b"))
def glove_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.read_glove(spark, _written(spark, _GLOVE, "glove")).select("word", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))


@query("SELECT word, a, b FROM " + _values([("cat", 3.0, 4.0), ("dog", 0.0, 2.0), ("bird", 1.0, 1.0)], "word, a, b"))
def distilled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.read_distilled(spark, _written(spark, _GLOVE + "\nlong 1 2 3", "distilled"), 2).select("word", F.col("vec")[0].alias("a"), F.col("vec")[1].alias("b"))


# --- sinks --------------------------------------------------------------------------------------------------------
@query("SELECT l_returnflag AS module, count(*) AS n, sum(l_linenumber) AS lines FROM lineitem GROUP BY 1")
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of line items as an indented report, parsed again."""
    report = I.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("module")).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
    path = _path(spark, "report")
    files.write_report(report, path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string, struct<n: long, lines: long>>")).alias("module", "r")).select("module", "r.n", "r.lines")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, n_chars AS score FROM documents")
def write_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "scores")
    files.write_scores(I.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").alias("score")), path)
    return spark.read.parquet(path)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (0, 1, 2)")
def append_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations, path = I.table(spark, sf_dir, "nation"), _path(spark, "ledger")
    for region in range(3):
        files.append_ledger(nations.filter(F.col("n_regionkey") == region).select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string").json(path)


@query("SELECT DISTINCT o_orderpriority AS q FROM orders")
def append_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys appended twice stand once."""
    rows, path = I.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("q")), _path(spark, "corpus")
    files.append_new(rows.filter("q < '3'"), path, "q")
    files.append_new(rows, path, "q")
    return spark.read.parquet(path)


@query("SELECT key, a, b FROM " + _values([("cat", 76, 102), ("dog", 0, 127), ("bird", 90, 90)], "key, a, b"))
def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word vectors quantised, written in hash order and read back."""
    path = _path(spark, "packed")
    vectors.write_packed(vectors.packed(vectors.read_glove(spark, _written(spark, _GLOVE, "glove"))), path)
    return spark.read.parquet(path).select("key", F.col("vec")[0].cast("int").alias("a"), F.col("vec")[1].cast("int").alias("b"))


# --- functions ----------------------------------------------------------------------------------------------------
@query("SELECT turn, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY turn")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays found again in text with a fence and words around them; blank strings go."""
    rows = I.table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("turn").agg(F.collect_list(F.concat(F.lit("id "), F.col("conv_id"))).alias("all"))
    text = F.concat(F.lit("Here they are:\n```json\n"), F.to_json(F.concat("all", F.array(F.lit(" ")))), F.lit("\n``` as asked"))
    return rows.select("turn", F.size(T.json_array_in(text)).cast("long").alias("n"))


@query("SELECT doc_id, trim(text, E' ') AS text FROM documents WHERE text IS NOT NULL AND NOT contains(text, '`') AND regexp_matches(text, '^[A-Za-z]') AND regexp_matches(text, '[A-Za-z.]$')")
def unfenced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents").filter("text is not null and not contains(text, '`')").filter(F.rlike("text", F.lit("^[A-Za-z]")) & F.rlike("text", F.lit(r"[A-Za-z.]\z")))
    return docs.select("doc_id", T.unfenced(F.concat(F.lit("```text\n"), "text", F.lit("\n```"))).alias("text"))


_REPORTS = [
    ("full", "candidate_margin 0.6847 | wins 40/40 | ties 0\nscore_stddev 0.3931\nworst_self_match 1.0000\nspearman vs champion  0.6352\nfamily_margin 0.5653 | wins 15/15\n[FAIL] family"),
    ("part", "candidate_margin 0.1000 | wins 13/40 | ties 2\n[FAIL] a\n[FAIL] b\nspearman vs base -0.2"),
    ("none", "no figures"),
]


@query("SELECT name, margin, CAST(wins AS INTEGER) AS wins, CAST(ties AS INTEGER) AS ties, spearman, stddev, worst_self, CAST(fails AS INTEGER) AS fails, fam_margin, CAST(fam_wins AS INTEGER) AS fam_wins, CAST(fam_total AS INTEGER) AS fam_total FROM "
       + _values([("full", 0.6847, 40, 0, 0.6352, 0.3931, 1.0, 1, 0.5653, 15, 15), ("part", 0.1, 13, 2, -0.2, None, None, 2, None, None, None), ("none", None, None, None, None, None, None, 0, None, None, None)], "name, margin, wins, ties, spearman, stddev, worst_self, fails, fam_margin, fam_wins, fam_total"))
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(_REPORTS, "name string, text string")
    return rows.select("name", T.report_metrics(F.col("text")).alias("m")).select("name", "m.*")


_HASHES = [("", "0xc5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"), ("abc", "0x4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45")]


@query(f"SELECT * FROM {_values(_HASHES, 'text, hash')}")
def keccak_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(t,) for t, _ in _HASHES], "text string")
    return rows.select("text", keccak256(F.encode("text", "UTF-8")).alias("hash"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n FROM events WHERE user_id >= 256 GROUP BY 1")
def watched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"))
    return status.watched(rows).groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, round((margin - 0.010046) / 0.98 * 32, 6) AS cases, round(margin - 0.062, 6) AS estimate, p_size >= 30 AND margin >= 0.45 AS feasible FROM (SELECT *, p_retailprice / 2200.0 AS margin FROM part)")
def margin_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What margins stand for, on a table of figures."""
    m = F.col("p_retailprice") / 2200.0
    ok = S.feasible(m, F.when(F.col("p_size") >= 30, 40).otherwise(39), F.lit(40), F.lit(1.0), F.lit(0.39))
    return I.table(spark, sf_dir, "part").select("p_partkey", F.round(C.fixture_count(m), 6).alias("cases"), F.round(C.proxy_estimate(m), 6).alias("estimate"), ok.alias("feasible"))


@query("SELECT c.c_name AS q, c.c_mktsegment AS gt, m.model, CASE WHEN m.model = 'silent' THEN '' END AS a FROM customer c CROSS JOIN (VALUES ('m1'), ('m2'), ('silent')) m(model)")
def answer_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = I.table(spark, sf_dir, "customer").select(F.col("c_name").alias("q"), F.col("c_mktsegment").alias("gt"))
    return E.answer_corpus(questions, spark.createDataFrame([("m1",), ("m2",)], "model string"))


# --- word vectors in the score --------------------------------------------------------------------------------------
_WORDS = [("river", 127, 0), ("stream", 120, 40), ("bank", 0, 127), ("shore", 10, 126), ("stone", -127, 0)]
_TOKENS = [("x", "gt", 0, "river"), ("x", "gt", 1, "bank"), ("x", "a", 0, "stream"), ("x", "a", 1, "stone"), ("y", "gt", 0, "river"), ("y", "a", 0, "unknown"), ("z", "gt", 0, "bank"), ("z", "a", 3, "shore"), ("z", "a", 4, "bank")]
_SQL_WORDS = f"w AS (SELECT * FROM {_values(_WORDS, 'word, x, y')}), k AS (SELECT t.*, w.x, w.y FROM {_values(_TOKENS, 'id, side, pos, key')} JOIN w ON w.word = t.key)"


def _word_rows(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = spark.createDataFrame([(*t, 10_000, False) for t in _TOKENS], "id string, side string, pos int, key string, w long, numeric boolean")
    return rows, spark.createDataFrame([(w, [x, y]) for w, x, y in _WORDS], "word string, vec array<int>")


@query(f"WITH {_SQL_WORDS}, b AS (SELECT a.id, a.side, a.pos, max(greatest(0.0, least(1.0, (a.x * o.x + a.y * o.y) / 16129.0))) AS best FROM k a JOIN k o ON o.id = a.id AND o.side <> a.side GROUP BY ALL) "
       "SELECT id, side, pos, round(CASE WHEN best < 0.72 THEN 0.0 ELSE ((best - 0.72) / 0.28) * ((best - 0.72) / 0.28) END, 6) AS credit FROM b")  # fmt: skip
def soft_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words = _word_rows(spark)
    return V.soft_credits(rows, words).select("id", "side", "pos", F.round("credit", 6).alias("credit"))


@query(f"WITH {_SQL_WORDS}, s AS (SELECT id, side, sum(x) AS x, sum(y) AS y FROM k GROUP BY id, side), ids AS (SELECT DISTINCT id FROM s) "
       "SELECT ids.id, round(coalesce(CASE WHEN g.x * a.x + g.y * a.y > 0 THEN least(1.0, (g.x * a.x + g.y * a.y) / (sqrt(g.x * g.x + g.y * g.y) * sqrt(a.x * a.x + a.y * a.y))) ELSE 0.0 END, 0.0), 6) AS sentence_cos FROM ids LEFT JOIN s g ON g.id = ids.id AND g.side = 'gt' LEFT JOIN s a ON a.id = ids.id AND a.side = 'a'")  # fmt: skip
def sentence_cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, words = _word_rows(spark)
    return V.sentence_cos(rows, words).select("id", F.round("sentence_cos", 6).alias("sentence_cos"))
