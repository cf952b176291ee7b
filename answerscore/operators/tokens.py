"""Token rows: one row per token of each text, with all attributes the scorer needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from answerscore import lexicon
from answerscore.functions import text as T

CONTENT = 5000  # weights above this (in 1/10,000) are content


def side_texts(triples: DataFrame) -> DataFrame:
    """(id, side, text): the question, ground truth and answer of each triple as rows of one table."""
    sides = F.array(*(F.struct(F.lit(s).alias("side"), F.coalesce(F.col(s), F.lit("")).alias("text")) for s in ("q", "gt", "a")))
    return triples.select("id", F.inline(sides))


def token_rows(texts: DataFrame, keys: tuple[str, ...] = ("id", "side"), text_col: str = "text") -> DataFrame:
    """Tokens of ``text_col`` with their attributes; ``pos`` counts from 0 within a text.

    The one shuffle brings a text's tokens together for the windows that look at neighbours.
    """
    rows = texts.select(*keys, F.posexplode(T.tokens_with_gaps(F.col(text_col))).alias("pos", "__t"), F.rlike(text_col, F.lit("^" + T.WORD)).alias("__starts"))
    rows = rows.select(*keys, "pos", F.col("__t.tok").alias("tok"), F.col("__t.gap").alias("gap"), "__starts")
    tok = F.col("tok")
    rows = rows.withColumn("key", T.token_key(tok)).withColumn("numeric", T.is_numeric(tok))
    upper = F.rlike(tok, F.lit("^[A-Z]"))
    rows = rows.withColumn("proper", upper & ((F.col("pos") > 0) | ~F.col("__starts")))
    rows = rows.select(
        *keys, "pos", "tok", "key", T.stem(tok).alias("stem"), T.alternative(tok).alias("alt"), T.weight(tok, F.col("key"), F.col("numeric"), F.col("proper")).alias("w"), "numeric", "proper",
        upper.alias("cap"), F.rlike("gap", F.lit("[.,;!?:]")).alias("bnd"), T.acronym(tok).alias("acro"), F.lower(F.regexp_extract(tok, "^[A-Za-z]", 0)).alias("first"),
        T.prefix(tok).alias("pre"), T.scale(tok, F.col("key")).alias("scale"), T.scale(tok, T.word_key(tok)).alias("wscale"), T.leading_value(tok).alias("lead"),
    )
    order = Window.partitionBy(*keys).orderBy("pos")
    own = F.when((F.col("lead") > 0) & (F.col("wscale") > 0), F.col("lead") * F.pow(F.lit(10.0), F.col("wscale"))).otherwise(F.col("lead"))
    following = F.when((F.lead("lead").over(order) == 0) & (F.lead("wscale").over(order) > 0), F.pow(F.lit(10.0), F.lead("wscale").over(order))).otherwise(F.lit(1.0))
    last_neg = F.max(F.when(F.col("key").isin(*lexicon.NEG), F.col("pos"))).over(order.rowsBetween(-4, -1))
    last_bnd = F.max(F.when(F.col("bnd"), F.col("pos"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("val", own * following).withColumn("neg", F.coalesce(last_neg > F.coalesce(last_bnd, F.lit(-1)), F.lit(False)))
    return rows.drop("wscale", "lead")


def token_sets(rows: DataFrame) -> DataFrame:
    """(id, side, word, first_pos): keys, stems and alternatives of each text with the first token that has them."""
    forms = F.explode(F.array_distinct(F.array("key", "stem", "alt")))
    return rows.select("id", "side", "pos", forms.alias("word")).groupBy("id", "side", "word").agg(F.min("pos").alias("first_pos"))


def probe(rows: DataFrame, sets: DataFrame, out: str) -> DataFrame:
    """Add ``out``: where a token is matched in the set, by key, else by stem, else by alternative; null if nowhere.

    The three forms of a token probe the set in one join; the form of the highest priority that is found decides.
    """
    forms = rows.select("id", "side", "pos", F.posexplode(F.array("key", "stem", "alt")).alias("form", "word"))
    found = forms.join(sets.select("id", "word", "first_pos"), ["id", "word"]).groupBy("id", "side", "pos").agg(F.min_by("first_pos", "form").alias(out))
    return rows.join(found, ["id", "side", "pos"], "left")


def content_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id", "side").agg(F.count_if(F.col("w") > CONTENT).alias("content"))
