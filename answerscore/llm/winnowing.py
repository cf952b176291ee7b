"""Document fingerprints by winnowing, in DataFrame expressions only.

Words (runs of non-white-space, case kept) are hashed, and each run of ``k`` words has a rolling hash: the cyclic
polynomial of its word hashes, rot(h1, k-1) ^ ... ^ rot(hk, 0).  All rolling hashes of a text are made together, those
of 2, 4 ... words from pairs of shorter ones.  In every window of ``w`` such hashes the least is chosen, the rightmost
on ties, and its position is kept.  Any passage of at least ``w + k - 1`` words that two texts share therefore leaves a
common fingerprint.  Fewer than ``k`` words: one hash of the whole sequence; fewer than ``w`` hashes: one window;
no words (null or empty text): an empty fingerprint.

Texts of any length are processed whole in array expressions inside each row, a fixed number of passes each: no Python.

Defined results of :func:`compare_edited`: null texts are empty; rows of equal id are ordered by their texts, null ids
come last; repeated rows are repeated; a single row is its own next; empty tables give empty results; further columns,
whatever their names, are ignored; ids are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, range_bucket

K, W = 4, 5


def word_hashes(text: Column) -> Column:
    """xxhash64 of each word of ``text``, in order."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda x: F.length(x) > 0)
    return F.transform(words, lambda x: F.xxhash64(x))


def turned(x: Column, bits: int) -> Column:
    """A long with its bits rotated to the left."""
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits)) if bits % 64 else x


def _joined(a: Column, b: Column, m: int, n: int) -> Column:
    """Rolling hashes of m + n words from those of m words (``a``) and of n words (``b``)."""
    count = F.greatest(F.least(F.size(a), F.size(b) - m), F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), count), F.slice(b, F.lit(m + 1), count), lambda x, y: turned(x, n).bitwiseXOR(y))


def winnow(df: DataFrame, text_col: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Add ``out``: array<struct<hash, pos>> of the chosen k-gram hashes of ``text_col``, in text order."""
    t, h, p, double = f"__{out}_t", f"__{out}_h", f"__{out}_p", f"__{out}_d"
    df = df.withColumn(t, word_hashes(F.coalesce(F.col(text_col), F.lit(""))))
    # Hashes of k words: the binary digits of k say which powers of two they are joined from.
    df, size, power = df.withColumn(double, F.col(t)), 0, 1
    while power <= k:
        if k & power:
            df = df.withColumn(h, F.col(double) if not size else _joined(F.col(h), F.col(double), size, power))
            size += power
        if 2 * power <= k:
            df = df.withColumn(double, _joined(F.col(double), F.col(double), power, power))
        power *= 2
    whole = F.reduce(F.col(t), F.lit(0).cast("long"), lambda a, b: turned(a, 1).bitwiseXOR(b))
    df = df.withColumn(h, F.when(F.size(t).between(1, k - 1), F.array(whole)).otherwise(F.col(h))).drop(double)
    # The rightmost least position of windows of 1, 2, 4 ... hashes; two such windows cover one of w.
    df = df.withColumn(p, F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>")))
    width = 1
    while width < w:
        step = min(width, w - width)
        later = F.slice(F.col(p), F.lit(step + 1), F.greatest(F.size(p) - step, F.lit(0)))
        best = F.zip_with(F.slice(F.col(p), F.lit(1), F.greatest(F.size(p) - step, F.lit(0))), later, lambda a, b: F.when(F.get(F.col(h), b) <= F.get(F.col(h), a), b).otherwise(a))
        last = F.reduce(F.col(p), F.lit(0), lambda a, b: F.when(F.get(F.col(h), b) <= F.get(F.col(h), a), b).otherwise(a))
        df = df.withColumn(p, F.when(F.size(p) > step, best).when(F.size(p) > 0, F.array(last)).otherwise(F.col(p)))
        width += step
    chosen = F.transform(F.array_distinct(p), lambda i: F.struct(F.get(F.col(h), i).alias("hash"), i.alias("pos")))
    return df.withColumn(out, chosen).drop(t, h, p)


def digest(prints: Column) -> Column:
    """A fingerprint as text: SHA-256 of its hashes and positions."""
    return F.sha2(F.array_join(F.transform(prints, lambda x: F.concat_ws(":", F.hex(x["hash"]), x["pos"].cast("string"))), ","), 256)


def hash_set(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: x["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Dice likeness of two hash sets: twice the common hashes over both sizes; 1 for two empty sets."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def with_next(df: DataFrame, id_col: str, carried: list[str], prefix: str = "next_", bucket_rows: int = 32_768) -> DataFrame:
    """Add each carried column of the next row in ascending ``id_col`` (after the last row: of the first).

    Rows are dealt to range buckets of about ``bucket_rows`` rows; each bucket also gets a copy of the first row of the
    bucket after it, so that no window holds more than a bucket.  Null ids come last; rows of equal id are ordered by
    their carried columns.
    """
    df, bucket = range_bucket(df, id_col, bucket_rows)
    order = [F.col(id_col).asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in carried if dict(df.dtypes)[c] in ("string", "bigint"))]
    # One row a bucket: its smallest id, and the bucket that it follows.
    heads = df.groupBy(bucket).agg(F.min(id_col).alias("__head"))
    along = Window.orderBy(bucket)
    ends = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.withColumn("__before", F.coalesce(F.lag(bucket).over(along), F.last(bucket).over(ends)))
    ghosts = df.join(F.broadcast(heads), bucket).filter(F.col(id_col).eqNullSafe(F.col("__head"))).drop("__head")
    ghosts = ghosts.withColumn(bucket, F.col("__before")).drop("__before").withColumn("__ghost", F.lit(1))
    own = Window.partitionBy(bucket).orderBy("__ghost", *order)
    rows = df.withColumn("__ghost", F.lit(0)).unionByName(ghosts)
    for c in carried:
        rows = rows.withColumn(prefix + c, F.lead(c).over(own))
    return rows.filter("__ghost = 0").drop("__ghost", bucket)


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that of the next document.

    ``positions`` are the word numbers at which the chosen k-grams of the text begin.  The edited text has its last quarter of code points replaced by the first as many of the next document.
    Null texts are empty.  One row per input row; with a single row it is its own next.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = winnow(base, "text", "prints", k, w)
    base = base.select("doc_id", "text", digest(F.col("prints")).alias("fingerprint"), F.transform("prints", lambda x: x["pos"]).alias("positions"), hash_set(F.col("prints")).alias("set"))
    near = with_next(base, "doc_id", ["text", "set"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    near = near.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    near = near.drop("next_text", "text")
    near = winnow(near, "edited", "edited_prints", k, w)
    return near.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", digest(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(F.col("set"), hash_set(F.col("edited_prints"))).alias("near_edited"), likeness(F.col("set"), F.col("next_set")).alias("near_next"), "positions",
    )
