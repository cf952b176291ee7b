"""Triples and cases derived from the driver's tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Written for this engine: (id, intent, question, ground_truth, good, bad)
CASES = [
    ("c01", "cert", "Is the certificate of example.org valid?", "Yes, the certificate is valid until March 2031.", "Yes. It is valid until March 2031", "No, the certificate expired in March 2031."),
    ("c02", "price", "What did one share of Borealis cost?", "Borealis closed at 1,250.75 dollars, up 3.1 percent.", "Borealis ended the day at 1250.75, up 3.1%", "Borealis closed at 1,920.10 dollars, down 4 percent."),
    ("c03", "cap", "How large is the fund?", "The fund holds 3.1 trillion dollars.", "It holds $3.1T", "The fund holds 3.1 billion dollars."),
    ("c04", "geo", "Where is the server?", "The server is in the United States.", "It is hosted in the US", "The server is in Norway."),
    ("c05", "weather", "Will it rain in Porto?", "No rain is expected in Porto tomorrow.", "Porto stays dry, no rain is expected", "Rain is expected in Porto tomorrow."),
    ("c06", "chain", "Which network holds more?", "Aurora holds 2.6 billion and Cobalt holds 1.9 billion.", "Aurora has 2.6 billion, Cobalt has 1.9 billion.", "Aurora holds 1.9 billion and Cobalt holds 2.6 billion."),
    ("c07", "order", "Name the capital.", "Lisbon is the capital of Portugal today", "Portugal has its capital in Lisbon today", "Portugal today capital the of is Lisbon"),
    ("c08", "media", "Is the photo genuine?", "The photo is authentic and shows a real harbour.", "Authentic, a real harbour", "The photo is fake and synthetic."),
    ("c09", "trend", "How did the index move?", "The index fell sharply after the report.", "It fell sharply after the report was out.", "The index rose sharply after the report."),
    ("c10", "count", "How many moons does the planet have?", "The planet has seven moons.", "It has 7 moons", "It has 12 moons."),
    ("c11", "space", "Who runs the agency?", "The National Aeronautics agency NAA runs the probe.", "NAA runs the probe", "A private company runs the probe."),
    ("c12", "unit", "How warm is it?", "It is 22 degrees in Vienna.", "Vienna has 22C now", "It is 31 degrees in Vienna."),
    ("c13", "code", "How do I undo a commit?", "Run git reset to move the branch back; files stay changed.", "Use git reset, the files stay changed", "Delete the repository and clone it again."),
    ("c14", "scan", "Is the link safe?", "The link is malicious, a phishing page.", "Malicious phishing page, do not open", "The link is safe and legitimate."),
    ("c15", "empty", "", "Nothing was found in the archive.", "Nothing found in the archive", "Many files were found, never fewer than ten."),
    ("c16", "mixed", "Did the build pass?", "The build passed with no errors.", "passed, no errors", "The build did not pass; it failed."),
    ("c17", "accents", "¿Dónde está la estación?", "La estación está en el centro de Málaga.", "En el centro de Málaga está la estación", "Está lejos, en Sevilla."),
    ("c18", "glued", "How far is it?", "It is 1,000km by road and 5é by sea.", "1000km by road", "It is 900km by road."),
    ("c19", "letters", "What don't they sell?", "They don't sell 3 m boards or 5 k packs.", "They don't sell 3 m boards", "They sell 3 m boards and 5 k packs"),
    ("c20", "exact", "Repeat the code.", "Code A-17, value 1.57", "code a 17 value 1.57", "Code A-17, value 157"),
]
# (name, rule, question, ground_truth, honest, attack)
ATTACKS = [
    ("echo", "near_zero", "Which city is the capital of Portugal?", "Lisbon", "Lisbon is the capital", "Which city is the capital of Portugal?"),
    ("flip", "below_honest", "Did the index move?", "The index fell sharply.", "The index fell sharply", "The index rose sharply"),
    ("negate", "below_honest", "Is rain expected?", "Rain is expected in the north.", "Rain is expected in the north", "Rain is not expected in the north"),
    ("pad", "near_honest", "Name the river.", "The Danube flows through Vienna.", "The Danube flows through Vienna", "Sure, happy to help: the Danube flows through Vienna."),
    ("blank", "near_zero", "Name the river.", "The Danube", "The Danube", "..."),
    ("other", "loudest", "Name the river.", "The Danube", "The Danube", "The Rhine"),
]
# (intent, registration_id, status, eval_details)
LEDGER = [
    ("FACTS", 300, "active", '{"candidate_margin": 0.61, "champion_margin": 0.55, "historical_rows_evaluated": 40, "spearman": {"a": 0.71}}'),
    ("FACTS", 310, "lost", '{"candidate_margin": 0.66, "champion_margin": 0.60, "historical_rows_evaluated": 0, "spearman": null}'),
    ("PRICES", 280, "lost", '{"candidate_margin": 0.72, "champion_margin": 0.51, "historical_rows_evaluated": 12, "spearman": 0.66}'),
    ("PRICES", 290, "lost", '{"candidate_margin": 0.70, "champion_margin": 0.64, "historical_rows_evaluated": 12, "spearman": {"b": 0.41}}'),
    ("PRICES", 295, "pending", "{}"),
    ("SCORES", 270, "lost", '{"candidate_margin": 0.40, "champion_margin": 0.52, "historical_rows_evaluated": 0}'),
    ("NEWS", 301, "active", "{}"),
    ("NEWS", 305, "active", '{"candidate_margin": 0.5}'),
    ("MAPS", 260, "lost", '{"candidate_margin": 0.58, "champion_margin": 0.31, "historical_rows_evaluated": 9, "spearman": null}'),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CASES, "id string, intent string, question string, ground_truth string, good string, bad string")


def attacks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ATTACKS, "name string, rule string, question string, ground_truth string, honest string, attack string")


def ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, i) for i, r in enumerate(LEDGER)], "intent string, registration_id int, status string, eval_details string, seq int")


def triples_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, q, gt, a): each user turn with the assistant's next turn; gt is the conversation's last assistant text."""
    turns = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(every)
    rows = turns.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("next_text"), last.alias("gt"))
    rows = rows.filter("role = 'user' and next_role = 'assistant'")
    return rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("q"), F.coalesce("gt", F.lit("")).alias("gt"), F.coalesce("next_text", F.lit("")).alias("a"))


def triples_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, q, gt, a): every document as an answer to one benchmark passage, the passages dealt in turn."""
    items = table(spark, sf_dir, "benchmark").select("text", (F.row_number().over(Window.orderBy("item_id")) - 1).alias("n"))
    items = items.withColumn("many", F.count("*").over(Window.partitionBy()))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("a"))
    many = items.agg(F.max("many").alias("m"))
    docs = docs.crossJoin(F.broadcast(many)).withColumn("n", F.pmod("doc_id", "m").cast("int"))
    return docs.join(items.select(F.col("n"), F.coalesce("text", F.lit("")).alias("gt")), "n").select(F.col("doc_id").cast("string").alias("id"), F.lit("").alias("q"), "gt", "a")


def triples_cases(spark: SparkSession) -> DataFrame:
    """(id, q, gt, a): good and bad answers of the written cases."""
    c = cases(spark)
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("a")) for k in ("good", "bad")))
    rows = c.select("id", F.col("question").alias("q"), F.col("ground_truth").alias("gt"), F.inline(kinds))
    return rows.select(F.concat_ws(":", "id", "kind").alias("id"), "q", "gt", "a")


def _values(rows: list[tuple]) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + ")"


SQL_CASES = f"cases AS (SELECT * FROM {_values(CASES)} t(id, intent, question, ground_truth, good, bad))"
SQL_ATTACKS = f"attacks AS (SELECT * FROM {_values(ATTACKS)} t(name, rule, question, ground_truth, honest, attack))"
SQL_LEDGER = f"ledger AS (SELECT * FROM {_values([(*r, i) for i, r in enumerate(LEDGER)])} t(intent, registration_id, status, eval_details, seq))"
SQL_CONV = """turns AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
        last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS gt
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
triples AS (SELECT conv_id || '-' || turn AS id, coalesce(text, '') AS q, coalesce(gt, '') AS gt, coalesce(next_text, '') AS a FROM turns WHERE role = 'user' AND next_role = 'assistant')"""
SQL_BENCH = """items AS (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS m FROM benchmark),
triples AS (SELECT CAST(doc_id AS VARCHAR) AS id, '' AS q, coalesce(i.text, '') AS gt, coalesce(d.text, '') AS a FROM documents d JOIN items i ON d.doc_id % i.m = i.n)"""
SQL_CS = SQL_CASES + """,
triples AS (SELECT id || ':good' AS id, question AS q, ground_truth AS gt, good AS a FROM cases UNION ALL SELECT id || ':bad', question, ground_truth, bad FROM cases)"""
