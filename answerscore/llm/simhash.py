"""SimHash near-duplicate groups, searched with BK-trees over pigeonhole shards.

* Fingerprint: 64 bits; a bit is set if more than half of the shingle hashes (XXH64, seed 42, of the
  space-joined words, repeats included) have it.  Fewer words than a shingle: the whole word sequence is
  the one shingle.  No words (null, empty or white-space text): fingerprint zero.
* Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bit blocks, so each
  distinct fingerprint goes to one shard per block.  A shard builds a BK-tree (children keyed by integer
  Hamming distance to the parent) in the task that owns it, and all its members descend it together,
  following only edges within the radius.  Nothing that grows with the corpus is broadcast.
* A shard that is too large even when split by further blocks is dealt to blocks of rows, and each pair of row blocks
  is searched by a task of its own: exact, with bounded memory.
* A shard emits a spanning star per local component, never all pairs; large-star / small-star rounds join
  stars across shards.  Exact copies collapse to one node, their fingerprint, before the search.

Null ids: rows keep a row in the result and link others; a component's id is the smallest non-null id in it (null if
there is none).  Rows of one id and different texts are different documents.  Repeated rows are repeated in the
result.  Texts of any length are read whole.  Ids are whole numbers.  Empty tables give empty results.  Further
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

RADIUS = 4
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z fold, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1))
    stops = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[at : at + _CHUNK].tolist(), stops[at : at + _CHUNK].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 4, out: str = "fp") -> DataFrame:
    """Add the SimHash of ``text_col`` as a signed long (the same 64 bits)."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).astype(np.int64))

    return docs.withColumn(out, simhash(F.col(text_col)))


class BKTree:
    """A Burkhard-Keller tree over unsigned 64-bit values; children are keyed by Hamming distance to their parent."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.root: tuple[int, dict] | None = None
        if len(values):
            self.root = (0, {})
            todo = [(self.root, np.arange(1, len(values)))]
            while todo:
                (item, children), rest = todo.pop()
                distance = np.bitwise_count(values[rest] ^ values[item])
                order = np.argsort(distance, kind="stable")
                rest, distance = rest[order], distance[order]
                cuts = np.flatnonzero(np.diff(distance)) + 1
                for group, d in zip(np.split(rest, cuts), distance[np.concatenate(([0], cuts))] if len(rest) else []):
                    children[int(d)] = child = (int(group[0]), {})
                    if len(group) > 1:
                        todo.append((child, group[1:]))

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each tree value that some query reaches: its index, and the queries at most ``radius`` away."""
        todo = [(self.root, np.arange(len(queries)))] if self.root and len(queries) else []
        while todo:
            (item, children), at = todo.pop()
            distance = np.bitwise_count(queries[at] ^ self.values[item])
            hit = at[distance <= radius]
            if len(hit):
                yield item, hit
            for edge, child in children.items():
                follow = at[np.abs(distance.astype(np.int16) - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


def _components(values: np.ndarray, radius: int) -> np.ndarray:
    """For each value the index of its component's root under links within ``radius``."""
    parent = np.arange(len(values))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for item, hits in BKTree(values).within(values, radius):
        mine = root(item)
        for other in np.unique(parent[hits]).tolist():
            other = root(other)
            if other != mine:
                parent[max(other, mine)] = mine = min(other, mine)
    for x in range(len(parent)):
        parent[x] = root(x)
    return parent


def _blocks(bits: range, parts: int) -> list[tuple[int, int]]:
    """``parts`` (shift, width) blocks that cover ``bits``."""
    edges = np.linspace(bits.start, bits.stop, parts + 1).round().astype(int).tolist()
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _value(shift: int, width: int):
    return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))


def row_blocks(rows: DataFrame, key: list[str], size: int) -> DataFrame:
    """Each row for each pair (lo, hi) of row blocks that its block is in; ``count``: rows of the key, null if they fit.

    A key of many rows has as many blocks as give ``size`` rows each; every two rows meet in some pair of blocks.
    """
    n = F.coalesce(F.ceil(F.col("count") / size), F.lit(1)).cast("long")
    rows = rows.withColumn("__own", F.pmod(F.xxhash64("node", *key), n)).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return rows.withColumn("lo", F.least("__own", "__other")).withColumn("hi", F.greatest("__own", "__other")).drop("count", "__own", "__other")


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, shard_rows: int = 20_000, group_rows: int = 2_000) -> DataFrame:
    """Links (a, b), a < b, that span the components of distinct fingerprints ``(fp long, node long)``.

    A block value with more than ``shard_rows`` fingerprints is split again by the blocks of its other bits;
    that is exact too, as the at most ``radius`` differing bits lie among them.
    """
    blocks = _blocks(range(64), radius + 1)
    keyed = prints.select("fp", "node", F.posexplode(F.array(*(_value(s, w) for s, w in blocks))).alias("block", "value"))
    large = keyed.groupBy("block", "value").count().filter(F.col("count") > shard_rows).select("block", "value", F.lit(True).alias("large"))
    finer = []  # for each block: the values of the blocks of all other bits
    for shift, width in blocks:
        rest = _blocks(range(64 - width), radius + 1)
        rotated = F.shiftrightunsigned("fp", shift + width).bitwiseOR(F.shiftleft("fp", 64 - shift - width)) if shift + width < 64 else F.col("fp")
        finer.append(F.array(*(F.shiftrightunsigned(rotated, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in rest)))
    sub = F.when(F.col("large"), F.element_at(F.array(*finer), F.col("block") + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    key = ["block", "value", "part", "finer"]
    shards = keyed.join(large, ["block", "value"], "left").select("fp", "node", "block", "value", "large", F.posexplode(sub).alias("part", "finer"))
    still = shards.filter("large").groupBy(*key).count().filter(F.col("count") > shard_rows)
    shards = row_blocks(shards.join(still, key, "left"), key, shard_rows)
    groups = max(1, -(-prints.count() * (radius + 1) // group_rows))
    shards = shards.select("fp", "node", F.xxhash64(*key, "lo", "hi").alias("unit")).withColumn("grp", F.pmod("unit", F.lit(groups)))

    def link(part: pd.DataFrame) -> pd.DataFrame:
        unit = part["unit"].to_numpy()
        order = np.argsort(unit, kind="stable")
        unit, fp, node = unit[order], part["fp"].to_numpy()[order].astype(np.uint64), part["node"].to_numpy()[order]
        cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
        a, b = [], []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(unit)]):
            if hi - lo > 1:
                roots = _components(fp[lo:hi], radius)
                least = np.full(hi - lo, np.iinfo(np.int64).max)
                np.minimum.at(least, roots, node[lo:hi])
                to = least[roots]
                mine = node[lo:hi]
                a.append(to[to != mine])
                b.append(mine[to != mine])
        empty = np.zeros(0, np.int64)
        return pd.DataFrame({"a": np.concatenate([empty, *a]), "b": np.concatenate([empty, *b])})

    return shards.groupBy("grp").applyInPandas(link, "a long, b long").distinct()


def connected_components(links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, component): each linked node with the smallest node reachable, by alternating large and small stars.

    All rounds are aggregations and joins over the link table, written to the shared folder; stars of any
    size are summed before the shuffle and skewed joins are left to adaptive execution.  Rounds end when the links
    are stars: no node is both a centre and a leaf, or the leaf of two.
    """
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")

    def stars(df: DataFrame) -> bool:
        ends = df.select(F.col("a").alias("node"), F.lit(0).alias("leaf")).union(df.select("b", F.lit(1)))
        counts = ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max(1 - F.col("leaf")).alias("centre"))
        return counts.filter((F.col("leaf") > 1) | (F.col("leaf") > 0) & (F.col("centre") > 0)).isEmpty()

    rounds = 0
    while not stars(links):
        if rounds == max_rounds:
            raise RuntimeError(f"links are not stars yet after {max_rounds} rounds")
        rounds += 1
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct()
        new = materialise(small, "links")
        discard(links)
        links = new
    return links.select(F.col("b").alias("node"), F.col("a").alias("component"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """One row per document: ``id_col``, ``fp`` (signed long), ``component_id`` (smallest id reachable by links)."""
    marked = materialise(with_fingerprint(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", shingle).select("id", "fp"), "simhash")
    prints = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    parts = connected_components(fingerprint_links(prints.select("fp", F.col("fp").alias("node")), radius))
    grouped = prints.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    names = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    known = grouped.join(names, "part").select("fp", "component_id")
    return marked.join(known, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")
