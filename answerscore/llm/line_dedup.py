"""Removal of later copies of repeated runs of lines, in DataFrame operations only.

The corpus is a sequence of line identifiers.  Suffixes of that sequence are grouped by their first 1, 2, 4 ...
lines through distributed prefix doubling: a suffix's rank at depth ``2h`` is decided by its rank at depth ``h``
and the rank of the suffix ``h`` lines later.  Suffixes that share a rank at some depth form an interval of the
suffix array with at least that common prefix; a rank is named by the first position of its interval, so it is
exact at every depth and tells at once which member is the original.  Suffixes alone in their interval are
dropped from deeper rounds; rounds go on until all are alone or at the end of what they share.

Which lines go: a run counts as repeated if it has at least ``min_words`` words and stands earlier in the corpus, too.
Every line of such a run lies in a window of ``min_words`` words, taken forward from a line or backward from
it, that lies in the run; so the lines to delete are those of all windows that are not the first of their
interval.  The common prefix of a window of m lines is read from two ranks of depth 2^j <= m that overlap.

Where they come from: neighbouring suffixes whose deepest intervals begin at neighbouring lines are one maximal
repeated run with its source, the first place of these lines (:func:`repeated_runs`, column ``copies``).

Order: documents by id (null ids last), lines by position; the first occurrence stays.  Rows that repeat both
id and text are one document and share its result; rows of one id and different texts are different documents.
Null text has no lines.  A document all of whose lines go keeps an empty text; :func:`strip` says so in
``n_lines`` and ``n_removed``.  Lines are split at line feeds and compared as they are.  Texts of any number of lines
are handled in sorted windows, not in arrays that grow line by line.  Ids are whole numbers.  Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, materialise

MIN_WORDS = 8
_LAST = 2**63 - 1


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, pos, ord, line, w): one row per line; ``ord`` orders all lines, ``doc, th`` name the document."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "text"))
    start = F.col("doc").cast("decimal(38,0)") * F.lit(2**60).cast("decimal(19,0)") + F.shiftleft(F.col("th").bitwiseAND(F.lit(2**28 - 1)), 32).cast("decimal(19,0)")
    order = (start + F.col("pos").cast("decimal(10,0)")).cast("decimal(38,0)")
    words = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACE}]+")), F.lit(0))
    return rows.select("doc", "th", "pos", order.alias("ord"), F.unhex(F.md5("text")).alias("line"), words.alias("w"))


def _rank(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``rank`` (first position of the interval) to the rows whose keys at least two rows share.

    The ranks are written first: then both sides of the join are plain shuffles, and adaptive execution can split
    the partition of a very common line, which it cannot below an aggregation that keeps its partitioning.
    """
    shared = rows.groupBy(*keys).agg(F.min("ord").alias("rank"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    return rows.join(materialise(shared, "intervals"), keys)


def _suffixes(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """Lines that stand at least twice, in islands of neighbours, with their window ahead [pos, end) and behind [begin, pos]."""
    lines = materialise(line_table(docs, id_col, text_col), "lines")
    base = _rank(lines, ["line"]).select("doc", "th", "pos", "ord", "w", "rank")
    own = Window.partitionBy("doc", "th").orderBy("pos")
    base = base.dropDuplicates(["doc", "th", "pos"]).withColumn("island", F.col("pos") - F.row_number().over(own))
    piece = Window.partitionBy("doc", "th", "island")
    upto = piece.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("p", F.sum("w").over(upto)).withColumn("p0", F.col("p") - F.col("w"))
    base = base.withColumn("all", F.max("p").over(piece)).filter(F.col("all") >= min_words)
    base = base.withColumn("lo", F.min("pos").over(piece)).withColumn("hi", F.max("pos").over(piece))
    ahead = F.min("pos").over(piece.orderBy("p0").rangeBetween(min_words, Window.unboundedFollowing))
    behind = F.max("pos").over(piece.orderBy("p").rangeBetween(Window.unboundedPreceding, -min_words)) + 1
    base = base.withColumn("end", F.when(ahead.isNotNull(), ahead).when(F.col("all") >= F.col("p0") + min_words, F.col("hi") + 1))
    base = base.withColumn("begin", F.when(behind.isNotNull(), behind).when(F.col("p") >= min_words, F.col("lo")))
    base = materialise(base.select("doc", "th", "island", "pos", "ord", "rank", "end", "begin", "p0", F.col("w").cast("long").alias("words")), "suffixes")
    discard(lines)
    return base


def suffix_ranks(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows, ranks): later copies [pos, end) of windows of ``min_words`` words; and for each suffix with an earlier
    copy the deepest interval it shares with one: depth, words, and ``rank``, the place where the interval begins."""
    base = _suffixes(docs, min_words, id_col, text_col)
    forward = base.filter("end is not null").select("doc", "th", "island", "pos", "end")
    backward = base.filter("begin is not null").select("doc", "th", "island", F.col("begin").alias("pos"), (F.col("pos") + 1).alias("end"))
    windows = materialise(forward.union(backward).distinct().withColumn("m", F.col("end") - F.col("pos")), "windows")
    deepest = windows.agg(F.max("m")).first()[0] or 0
    columns = ["doc", "th", "island", "pos", "ord", "rank", "p0", "words"]
    ranks, out, deep, depth = base.select(*columns), None, None, 1
    key = ["doc", "th", "pos"]
    while True:
        level = ranks.filter("ord != rank").select(*columns, F.lit(depth).alias("depth"))
        deep = level if deep is None else deep.union(level)
        if depth <= deepest:
            level = windows.filter((F.col("m") >= depth) & (F.col("m") < 2 * depth))
            named = level.join(ranks.select(*key, "ord", F.col("rank").alias("a")), key)
            whole = named.filter(F.col("m") == depth).filter("ord != a").select(*key, "end")
            if depth > 1:
                tail = ranks.select("doc", "th", (F.col("pos") + depth).alias("end"), F.col("rank").alias("b"))
                split = named.filter(F.col("m") > depth).join(tail, ["doc", "th", "end"])
                whole = whole.union(_rank(split, ["m", "a", "b"]).filter("ord != rank").select(*key, "end"))
            found = materialise(whole, "copies")
            out = found if out is None else out.union(found)
        seq = Window.partitionBy("doc", "th", "island").orderBy("pos")
        after = F.lead(F.struct("pos", "rank", "words"), depth).over(seq)
        pairs = ranks.withColumn("__after", after).filter(F.col("__after.pos") == F.col("pos") + depth)
        pairs = pairs.select(*key, "island", "ord", F.col("rank").alias("a"), F.col("__after.rank").alias("b"), "p0", (F.col("words") + F.col("__after.words")).alias("words"))
        ranks = materialise(_rank(pairs, ["a", "b"]).select(*columns), "ranks")
        depth *= 2
        if ranks.isEmpty():
            break
    none = windows.filter("false").select(*key, "end")
    return out if out is not None else none, deep


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, th, pos, end): windows of lines [pos, end) that are later copies of an earlier window."""
    return suffix_ranks(docs, min_words, id_col, text_col)[0]


def repeated_runs(ranks: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, th, first, end, source, source_first): maximal runs of at least ``min_words`` words and the first place of each.

    At one depth, suffixes at neighbouring lines whose intervals begin at neighbouring lines are one run; a run that
    lies in another of the document is left out.
    """
    best = ranks.groupBy("doc", "th", "pos").agg(F.max(F.struct("depth", "ord", "rank", "p0", "words")).alias("s")).select("doc", "th", "pos", "s.*")
    step = Window.partitionBy("doc", "th").orderBy("pos")
    shift = F.col("rank") - F.col("ord")
    same = (F.lag("pos").over(step) == F.col("pos") - 1) & (F.lag("depth").over(step) == F.col("depth")) & (F.lag(shift).over(step) == shift)
    best = best.withColumn("__run", F.sum(F.when(same, 0).otherwise(1)).over(step))
    last = F.max(F.struct("pos", (F.col("p0") + F.col("words")).alias("p"), "depth"))
    runs = best.groupBy("doc", "th", "__run").agg(F.min("pos").alias("first"), last.alias("last"), F.min("p0").alias("p0"), F.min("rank").alias("rank"))
    runs = runs.filter(F.col("last.p") - F.col("p0") >= min_words).select("doc", "th", "first", (F.col("last.pos") + F.col("last.depth")).cast("int").alias("end"), "rank")
    outer = F.max("end").over(Window.partitionBy("doc", "th").orderBy("first", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__outer", outer).filter("__outer is null or end > __outer")
    whole = F.lit(2**60).cast("decimal(19,0)")
    source = ((F.col("rank") - F.pmod("rank", whole)) / whole).cast("long")
    return runs.select("doc", "th", "first", "end", source.alias("source"), F.pmod("rank", F.lit(2**32).cast("decimal(19,0)")).cast("int").alias("source_first"))


def strip(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows with ``text_col`` stripped of later copies, and n_lines, n_removed, runs, copies.

    ``runs`` lists the removed runs of lines as struct<first, end>, ``copies`` the repeated runs with the document
    (2^63 - 1: null id) and line of their first place.  Clashing input columns of these names are replaced.
    """
    windows, ranks = suffix_ranks(docs, min_words, id_col, text_col)
    before = Window.partitionBy("doc", "th").orderBy("pos", "end").rowsBetween(Window.unboundedPreceding, -1)
    # Windows that overlap or touch are one run.
    new = F.coalesce((F.col("pos") > F.max("end").over(before)).cast("int"), F.lit(1))
    runs = windows.distinct().withColumn("__new", new).withColumn("__run", F.sum("__new").over(Window.partitionBy("doc", "th").orderBy("pos", "end").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("doc", "th", "__run").agg(F.min("pos").alias("first"), F.max("end").alias("end"))
    runs = runs.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("runs"))
    found = repeated_runs(ranks, min_words).groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("first", "end", "source", "source_first"))).alias("copies"))
    gone = materialise(runs.join(found, ["doc", "th"], "left").withColumnsRenamed({"doc": "__doc", "th": "__th"}), "runs")
    rows = docs.drop("n_lines", "n_removed", "runs", "copies")
    on = (F.coalesce(rows[id_col].cast("long"), F.lit(_LAST)) == F.col("__doc")) & (F.xxhash64(rows[text_col]) == F.col("__th"))
    rows = rows.join(gone, on, "left").drop("__doc", "__th")
    none = F.array().cast("array<struct<first:int,end:int>>")
    rows = rows.withColumn("runs", F.coalesce("runs", none)).withColumn("copies", F.coalesce("copies", F.array().cast("array<struct<first:int,end:int,source:bigint,source_first:int>>")))
    rows = rows.withColumn("__lines", F.split(text_col, "\n"))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    rows = rows.withColumn("n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(n)).withColumn("n_removed", F.aggregate("runs", F.lit(0), lambda a, x: a + x["end"] - x["first"]))
    # What stays lies between the runs.
    edges = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("runs", lambda x: x["end"])), F.concat(F.transform("runs", lambda x: x["first"]), F.array(F.col("n_lines"))), lambda a, b: F.slice(F.col("__lines"), a + 1, b - a))
    kept = F.array_join(F.flatten(edges), "\n")
    return rows.withColumn(text_col, F.when((F.col("n_removed") == 0) | F.col(text_col).isNull(), F.col(text_col)).otherwise(kept)).drop("__lines")
