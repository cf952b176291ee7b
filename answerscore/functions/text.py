"""Scalar text functions as Columns: everything stays in the JVM.

Text is read as UTF-8 bytes: only ASCII letters fold, and every byte from 0x80 on is a word byte.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscore import lexicon

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"(?:[0-9](?:[.,][0-9])*|[A-Za-z]|[^\x00-\x7F])+"
GAP = r"[\x00-/:-@\[-`{-\x7F]*"
MAX_TOKENS = 2048
MASK32 = 0xFFFFFFFF


def lower_ascii(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def words(text: Column) -> Column:
    """All tokens of a text."""
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def tokens(text: Column) -> Column:
    """The first 2048 tokens: runs of word bytes; ``.`` and ``,`` stay between two digits."""
    return F.slice(words(text), 1, MAX_TOKENS)


def tokens_with_gaps(text: Column) -> Column:
    """array<struct<tok, gap>> of the first 2048 tokens with the bytes up to the next one."""
    pattern = F.lit(f"({WORD})({GAP})")
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("tok"), F.regexp_extract_all(text, pattern, 2).alias("gap"))
    return F.slice(zipped, 1, MAX_TOKENS)


def is_in(s: Column, values) -> Column:
    return s.isin(*values)


def word_key(tok: Column) -> Column:
    """The key of a token before numerals are rewritten: lower case, commas skipped."""
    return F.replace(lower_ascii(tok), F.lit(","), F.lit(""))


def literal_map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def has_alpha(tok: Column) -> Column:
    return F.rlike(tok, F.lit("[A-Za-z]"))


def is_numeric(tok: Column) -> Column:
    """A digit and no ASCII letter, or a number word."""
    return (F.rlike(tok, F.lit("[0-9]")) & ~has_alpha(tok)) | is_in(word_key(tok), lexicon.NUMERALS)


def token_key(tok: Column) -> Column:
    """The key of a token; number words have that of their digits."""
    key = word_key(tok)
    return F.coalesce(F.try_element_at(literal_map({k: str(v) for k, v in lexicon.NUMERALS.items()}), key), key)


def _cut(tok: Column, n: int) -> Column:
    return word_key(F.substring(tok, F.lit(1), F.length(tok) - n))


def stem(tok: Column) -> Column:
    """One English suffix off: ing (7 bytes or more), ed, ly, es (6), s (5), the first that fits."""
    n, low = F.octet_length(tok), lower_ascii(tok)
    rule = F.when((n >= 7) & F.endswith(low, F.lit("ing")), _cut(tok, 3))
    for suffix in ("ed", "ly", "es"):
        rule = rule.when((n >= 6) & F.endswith(low, F.lit(suffix)), _cut(tok, 2))
    rule = rule.when((n >= 5) & F.endswith(low, F.lit("s")), _cut(tok, 1)).otherwise(word_key(tok))
    return F.when(is_numeric(tok), token_key(tok)).otherwise(rule)


def alternative(tok: Column) -> Column:
    """``..ed`` without its d; the figure at the head of a token that goes on; else the token."""
    head = F.regexp_extract(tok, r"^[0-9][0-9.,]*", 0)
    rule = F.when((F.octet_length(tok) >= 5) & F.endswith(lower_ascii(tok), F.lit("ed")), _cut(tok, 1))
    rule = rule.when((head != "") & (F.length(head) < F.length(tok)), word_key(head)).otherwise(word_key(tok))
    return F.when(is_numeric(tok), token_key(tok)).otherwise(rule)


def fnv1a(key: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes of a key without commas."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(key, "UTF-8")), F.lit(".."), 0), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda a, x: (a.bitwiseXOR(x) * 16777619).bitwiseAND(F.lit(MASK32)))


def mul32(x: Column, factor: int) -> Column:
    """x * factor modulo 2**32, without overflow of the long."""
    high = (F.shiftright(x, 16) * factor).bitwiseAND(F.lit(0xFFFF))
    return (x.bitwiseAND(F.lit(0xFFFF)) * factor + F.shiftleft(high, 16)).bitwiseAND(F.lit(MASK32))


def slot(gram: Column) -> Column:
    """The slot of a 32-bit gram in the 131,072-slot table."""
    return F.shiftright(mul32(gram, 0x9E3779B1), 13).bitwiseAND(F.lit(131071))


def scale(tok: Column, key: Column) -> Column:
    """Power of ten that a token asserts, 0 if none: by its key, or by the last letter of a digit-led token."""
    last = F.try_element_at(literal_map({k: v for k, v in lexicon.SCALES.items() if len(k) == 1}), F.right(lower_ascii(tok), F.lit(1)))
    by_key = F.try_element_at(literal_map(lexicon.SCALES), key)
    return F.coalesce(by_key, F.when(F.rlike(tok, F.lit("^[0-9]")) & (F.octet_length(tok) >= 2), last), F.lit(0))


def leading_value(tok: Column) -> Column:
    """The number at the head of a token: commas skipped, the first dot before a digit is the decimal point; else 0."""
    digits = F.replace(F.regexp_extract(tok, r"^[0-9][0-9,]*(?:\.[0-9][0-9,]*)?", 0), F.lit(","), F.lit(""))
    return F.coalesce(F.when(digits != "", digits.cast("double")), F.lit(0.0))


def weight(tok: Column, key: Column, numeric: Column, proper: Column) -> Column:
    """Token weight in units of 1/10,000, so sums are exact."""
    size = F.least(F.octet_length(tok), F.lit(12))
    plain = 10000 + 600 * size + F.when(proper, 13000).otherwise(0)
    return F.when(numeric, 30000).when(is_in(key, lexicon.STOP), 1200).when(F.rlike(tok, F.lit(r"[^\x00-\x7F]")), 5000).otherwise(plain).cast("long")


def acronym(tok: Column) -> Column:
    """2 to 4 capitals, lower-cased; else empty."""
    return F.when(F.rlike(tok, F.lit("^[A-Z]{2,4}$")), lower_ascii(tok)).otherwise("")


def prefix(tok: Column) -> Column:
    """Up to four letters at the head, lower-cased."""
    return lower_ascii(F.regexp_extract(tok, "^[A-Za-z]{0,4}", 0))


def is_blank(s: Column) -> Column:
    return ~F.rlike(F.coalesce(s, F.lit("")), F.lit(r"[^ \t\n\f\r]"))


def normalised(s: Column) -> Column:
    """What counts when texts are compared for equality: word bytes, and ``.`` or ``,`` between digits.

    The rest goes character by character: to match whole words, Java's regular expressions need a stack as deep as a word is long.
    """
    return lower_ascii(F.regexp_replace(s, r"[\x00-+\-/:-@\[-`{-\x7F]+|(?<![0-9])[.,]|[.,](?![0-9])", ""))


def alike_at_head(a: Column, b: Column, n: int = 64) -> Column:
    """False only where ``normalised`` differs, from the first ``n`` characters: of the word bytes in them, one text's begin with the other's."""
    x, y = (lower_ascii(F.regexp_replace(F.left(s, F.lit(n)), r"[\x00-/:-@\[-`{-\x7F]+", "")) for s in (a, b))
    return F.startswith(x, y) | F.startswith(y, x)


def length_reward(a: Column, half: float = 70.0) -> Column:
    """n / (n + half) for the number n of white-space words, at most 100,000."""
    n = F.least(F.coalesce(F.regexp_count(a, F.lit(r"[^ \t\n\f\r]+")), F.lit(0)), F.lit(100000))
    return n / (n + half)


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the white-space words of ``a`` that ``b`` has too, case folded."""
    x = F.filter(F.split(F.lower(a), r"\s+"), lambda w: w != "")
    y = F.split(F.lower(b), r"\s+")
    return F.when(F.size(x) > 0, F.size(F.filter(x, lambda w: F.array_contains(y, w))) / F.size(x)).otherwise(0.0)


def json_array_in(text: Column) -> Column:
    """The non-blank strings of the JSON array between the first ``[`` and the last ``]``."""
    found = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<string>")
    return F.filter(found, lambda x: F.trim(x) != "")


def report_metrics(text: Column) -> Column:
    """struct of the metrics that the text of an evaluation report states; null where it does not state them."""
    number = lambda pattern, group, kind: F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast(kind)
    margin, family = r"candidate_margin ([0-9.]+) \| wins (\d+)/(\d+) \| ties (\d+)", r"family_margin ([0-9.]+) \| wins (\d+)/(\d+)"
    return F.struct(
        number(margin, 1, "double").alias("margin"), number(margin, 2, "int").alias("wins"), number(margin, 4, "int").alias("ties"), number(r"spearman vs \S+\s+(-?[0-9.]+)", 1, "double").alias("spearman"),
        number(r"score_stddev ([0-9.]+)", 1, "double").alias("stddev"), number(r"worst_self_match ([0-9.]+)", 1, "double").alias("worst_self"), F.regexp_count(text, F.lit(r"\[FAIL\]")).alias("fails"),
        number(family, 1, "double").alias("fam_margin"), number(family, 2, "int").alias("fam_wins"), number(family, 3, "int").alias("fam_total"),
    )


def unfenced(text: Column) -> Column:
    """Text without a Markdown code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def with_gram_slots(df: DataFrame, text_col: str, out: str, n: int, limit: int = 65536) -> DataFrame:
    """Add distinct slots of byte n-grams (2 or 3) of the first 65,536 bytes of a text.

    ASCII letters fold; each run of other ASCII bytes is one space; leading ones go.  Each step is a column of its
    own, so that no array is computed again for each element of the next.
    """
    codes, kept = f"__{out}_codes", f"__{out}_kept"
    pairs = F.regexp_extract_all(F.hex(F.substring(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 1, limit)), F.lit(".."), 0)
    code = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))
    word = lambda x: (x >= 128) | x.between(48, 57) | x.between(65, 90) | x.between(97, 122)
    df = df.withColumn(codes, F.transform(code, lambda x: F.when(x.between(65, 90), x + 32).when(word(x), x).otherwise(32)))
    df = df.withColumn(kept, F.filter(codes, lambda x, i: (x != 32) | ((i > 0) & (F.get(F.col(codes), i - 1) != 32))))
    places = F.when(F.size(kept) >= n, F.sequence(F.lit(0), F.size(kept) - n)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.get(F.col(kept), i).cast("long")
    gram = (lambda i: at(i) * 256 + at(i + 1)) if n == 2 else (lambda i: at(i) * 65536 + at(i + 1) * 256 + at(i + 2))
    return df.withColumn(out, F.array_distinct(F.transform(places, lambda i: slot(gram(i))))).drop(codes, kept)


def contained_or_dice(gt: Column, a: Column) -> Column:
    """The larger of Dice and the share of ``gt`` that ``a`` has; 0 if either is empty."""
    inter, g, n = F.size(F.array_intersect(gt, a)), F.size(gt), F.size(a)
    return F.when((g == 0) | (n == 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(2.0 * inter / (g + n), inter / g)))


def dice(a: Column, b: Column) -> Column:
    both = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), 2.0 * F.size(F.array_intersect(a, b)) / both))
