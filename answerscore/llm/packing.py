"""Packing token sequences by non-negative least squares.

Each document is tokenised once into a table in the shared folder; full windows are cut off, which leaves a rest of
0 to 2047 tokens.  The histogram of rests (2047 numbers, whatever the corpus) goes to the driver, where pairs and
triples of lengths that fill a window exactly are enumerated and their repeat counts are solved by non-negative least
squares against the histogram, rounded and made feasible greedily.  Every rest has a rank among the rests of its
length, counted in salted cells, which says which combination's slot it takes.  Rests left over are laid end to end,
longest first, and cut at the window's end, so all sequences but one at most are full.

Only the ids, packed to two bytes, move: once, to their cells.

Defined results: null text is an empty text and has the end id alone; rows of equal id are separate documents; an
empty table gives no pieces; other columns are ignored; texts of any length are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, materialise

WINDOW, END_ID, CELL_ROWS = 2048, 1, 100_000
TRIPLE_LENGTHS, SOLVER_STEPS = 64, 300
_MIXED = re.compile(r" \s|\s ")
_CACHE_LIMIT = 400_000


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunks(dict):
    """Bytes of the ids (little-endian, two bytes each) of a space and the text behind it, kept per distinct chunk."""

    def __init__(self, vocabulary: str, ranks: str):
        import base64

        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        super().__init__()
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        ids = np.array(self.plain(" " + chunk), "<u2").tobytes()
        if len(chunk) < 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as the tokenizer file gives them.

        Where single spaces stand between other characters, the pre-tokenizer always cuts before the space,
        so the chunks between them can be tokenised apart; the rank file holds the same vocabulary.  Texts with
        other white space at a space, or with the text of a special token, go to the tokenizer whole.
        """
        if not text:
            return b""
        if _MIXED.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.plain(first), "<u2").tobytes() + b"".join(map(self.__getitem__, rest))


_OPEN: dict[tuple[str, str], Chunks] = {}


def chunks(vocabulary: str, ranks: str) -> Chunks:
    """One tokenizer per process."""
    key = (vocabulary, ranks)
    if key not in _OPEN:
        _OPEN[key] = Chunks(*key)
    return _OPEN[key]


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, uid, ids, n): each text's ids with the end id; ``uid`` numbers the rows of the written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = chunks(tokenizer_path(vocabulary), tokenizer_path(ranks))
        end = np.array([END_ID], "<u2").tobytes()
        for batch in batches:
            for at, stop in by_bytes(pc.binary_length(batch.column(1)).to_pylist()):
                part = batch.slice(at, stop - at)
                ids = [coder.encode(t or "") + end for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int64())], names=["doc_id", "ids", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n long").withColumn("uid", F.monotonically_increasing_id())


def combinations(histogram: np.ndarray, window: int = WINDOW, triples: int = TRIPLE_LENGTHS) -> np.ndarray:
    """(combinations, 3) lengths that fill a window, 0 for a pair's third: all pairs, and triples of the commonest lengths."""
    lengths = np.flatnonzero(histogram)
    have = set(lengths.tolist())
    out = [(a, window - a, 0) for a in lengths.tolist() if a <= window - a and window - a in have]
    common = sorted(np.argsort(-histogram, kind="stable")[:triples].tolist())
    out += [(a, b, window - a - b) for i, a in enumerate(common) for b in common[i:] if a and b and window - a - b >= b and window - a - b in have]
    return np.array(sorted(set(out)), np.int64).reshape(-1, 3)


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int = SOLVER_STEPS) -> np.ndarray:
    """Non-negative repeat counts x that minimise ||A x - histogram||, by multiplicative least-squares steps."""
    size = len(histogram)

    def lengths(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(combos[:, i], x, size) for i in range(3))
        out[0] = 0
        return out

    def back(v: np.ndarray) -> np.ndarray:
        v = np.where(np.arange(size) == 0, 0.0, v)
        return v[combos].sum(axis=1)

    wanted = back(histogram.astype(float))
    x = wanted / 6 + 1e-9
    for _ in range(steps):
        x *= wanted / np.maximum(back(lengths(x)), 1e-12)
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[list[tuple[int, int, int]]], np.ndarray, int]:
    """For each length its slots (count, first sequence, offset) in order; how many rests they use; number of sequences."""
    left = histogram.astype(np.int64).copy()
    slots: list[list[tuple[int, int, int]]] = [[] for _ in histogram]
    combos, made = combinations(histogram, window), 0
    x = solve(combos, histogram) if len(combos) else np.zeros(0)
    order = np.argsort(-x, kind="stable")
    for rounded in (True, False):  # first the rounded solution, as far as there are rests, then what still fits
        for i in order.tolist():
            parts = [int(a) for a in combos[i] if a]
            most = min(int(left[a]) // parts.count(a) for a in parts)
            count = min(most, int(x[i] + 0.5)) if rounded else most
            if count:
                offset = 0
                for a in parts:
                    slots[a].append((count, made, offset))
                    left[a] -= count
                    offset += a
                made += count
    return slots, histogram - left, made


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokens = materialise(token_table(docs, id_col, text_col, vocabulary, ranks), "tokens")
    rest, full = F.col("n") % window, F.floor(F.col("n") / window)
    salt = F.pmod(F.xxhash64("uid"), F.lit(max(64, tokens.count() // CELL_ROWS)))  # so that no cell grows with the table
    cells = materialise(tokens.groupBy(rest.alias("rest"), salt.alias("salt")).agg(F.count("*").alias("docs"), F.sum(full).cast("long").alias("windows")), "cells")
    per_rest = cells.groupBy("rest").agg(F.sum("docs").alias("docs"), F.sum("windows").alias("windows")).orderBy("rest").collect()  # at most `window` rows
    histogram = np.zeros(window, np.int64)
    for r in per_rest:
        histogram[r[0]] = r[1]
    histogram[0] = 0
    slots, used, made = plan(histogram, window)
    left = histogram - used
    sizes = left * np.arange(window)
    begin = np.concatenate((np.cumsum(sizes[::-1])[::-1][1:], [0]))  # longer rests lie before shorter ones
    streams = -(-int(sizes.sum()) // window)
    firsts, total = {}, made + streams
    for r in per_rest:
        firsts[r[0]] = total
        total += r[2]
    before = Window.partitionBy("rest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = F.create_map(*(F.lit(x) for pair in firsts.items() for x in (pair[0], pair[1]))) if firsts else F.lit(None).cast("map<int,long>")
    cells = cells.select("rest", "salt", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("rank0"), (F.coalesce(F.sum("windows").over(before), F.lit(0)) + base[F.col("rest").cast("int")]).alias("window0"))
    own = Window.partitionBy("rest", "salt").orderBy("uid")
    ranked = tokens.withColumn("rest", rest).withColumn("salt", salt)
    ranked = ranked.withColumn("rank", F.row_number().over(own) - 1).withColumn("at", F.coalesce(F.sum(full).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(cells, ["rest", "salt"]).select("doc_id", "ids", "n", (F.col("rank0") + F.col("rank")).cast("long").alias("rank"), (F.col("window0") + F.col("at")).cast("long").alias("first"))
    tables = {a: tuple(np.array(c, np.int64) for c in (np.cumsum([s[0] for s in row]), [s[1] for s in row], [s[2] for s in row])) for a, row in enumerate(slots) if row}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of a rest."""
        if rank < used[length]:
            ends, sequences, offsets = tables[length]
            i = int(np.searchsorted(ends, rank, side="right"))
            yield length, int(sequences[i]) + rank - (int(ends[i - 1]) if i else 0), int(offsets[i])
            return
        at = int(begin[length]) + (rank - int(used[length])) * length
        while length:
            size = min(length, window - at % window)
            yield size, made + at // window, at % window
            at, length = at + size, length - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, ids, n, rank, first in zip(*(c.to_pylist() for c in batch.columns)):
                wide = np.frombuffer(ids, "<u2").astype("<u4")
                pieces = [(window, first + i, 0) for i in range(n // window)]
                if n % window:
                    pieces += place(n % window, rank)
                start = 0
                for size, sequence, offset in pieces:
                    out.append((doc, start, size, zlib.crc32(wide[start : start + size].tobytes()), n, sequence, offset))
                    start += size
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    return ranked.mapInArrow(run, ", ".join(f"{c} long" for c in names))
