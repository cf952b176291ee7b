"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least 4/5.

* A text's set holds the XXH64 hashes (seed 42) of its shingles, as in :mod:`simhash`; texts of the same folded words
  are one node, named by a hash of the words.  Texts without words are one node without links.
* A set of n hashes is sent to the shards of its n - ceil(4n/5) + 2 smallest hashes, or of its ``KEYS`` smallest if
  these are fewer.  Two sets of similarity 4/5 or more share two of the former (prefix filter); that they share none
  of the ``KEYS`` smallest has a probability below 0.2 ** 20 = 1e-14 a pair, and two below 2e-12: each of the smallest
  hashes of their union lies in both sets with a probability of at least 4/5.
* A shard of more than ``SHARD_ROWS`` nodes is split by the second hash that two similar sets share, and what is too
  large then by pairs of row blocks (:func:`simhash.row_blocks`).  So no task holds more than two blocks.
* A shard takes as candidates the pairs within ``RADIUS`` bits, by a BK-tree over 64-bit SimHashes of the sets (shards
  of a few nodes by all their pairs); at similarity 4/5 the mean distance is 10 bits, so 26 is more than five
  deviations off.  At this radius a tree follows most of its edges: what keeps the search small are the shards.
* Pairs that cannot be similar are left out: sets of sizes m and n are similar exactly if at most (m + n) / 9 hashes are
  in one of them only, and of these there are at least as many as bits in which the 512 parities of the sets differ.
* Candidates are confirmed by their sets.  First each node is held against one like node before it in the order of
  (size, node), so large groups of like texts cost one pair a node; then every candidate pair that the components of
  the confirmed pairs do not hold already.  So the components are those of all confirmed pairs.

Defined results: null, empty and white-space texts are one group, exact copies another; rows of one id and different
texts are different documents; texts of any length are read whole; ids are of any ordered type; empty tables give empty
results; further columns of any name pass through, but for names that begin with two underscores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .simhash import BKTree, connected_components, row_blocks

RADIUS, STAR_RADIUS = 26, 16
KEYS, SHARD_ROWS = 20, 20_000
_FEW = 48  # shards up to this size are searched by all their pairs
_CHUNK = 1 << 15


def shingle_set(text: str | None, shingle: int) -> tuple[int, np.ndarray]:
    """The node of a text, and the sorted distinct hashes of its shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    node = int(np.uint64(digest(joined, 7)).astype(np.int64))
    if not words:
        return node, np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    return node, np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n))


def _simhash(hashes: np.ndarray) -> np.int64:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0].astype(np.int64)


def parities(hashes: np.ndarray) -> bytes:
    """512 bits: for each value of the hashes' upper nine bits, whether it occurs an odd number of times."""
    return np.packbits((np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).tobytes()


def sketch(text: str | None, shingle: int) -> tuple:
    """(node, fp, parity, n, prefix) of one whole text."""
    node, hashes = shingle_set(text, shingle)
    n = len(hashes)
    prefix = hashes[: min(KEYS, n - -(-4 * n // 5) + 2)].astype(np.int64)
    return node, int(_simhash(hashes)), parities(hashes), n, prefix


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of at least 4/5."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


class _Shards:
    """The rows of a group of units, sorted by unit, size and node."""

    def __init__(self, part: pd.DataFrame):
        part = part.sort_values(["unit", "n", "node"], kind="stable")
        unit = part["unit"].to_numpy()
        self.node, self.fp, self.n = part["node"].to_numpy(), part["fp"].to_numpy().astype(np.uint64), part["n"].to_numpy()
        self.parity = np.frombuffer(b"".join(part["parity"]), np.uint64).reshape(-1, 8)
        self.comp = part["comp"].to_numpy() if "comp" in part else None
        cuts = np.flatnonzero(unit[1:] != unit[:-1]) + 1
        self.lo, self.hi = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(unit)]))

    def alike(self, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
        """Which of the pairs of rows i < j of a unit can be similar."""
        ok = np.flatnonzero((np.bitwise_count(self.fp[i] ^ self.fp[j]) <= radius) & (4 * self.n[j] <= 5 * self.n[i]) & (self.node[i] != self.node[j]))
        i, j = i[ok], j[ok]
        near = 9 * np.bitwise_count(self.parity[i] ^ self.parity[j]).sum(axis=1, dtype=np.int64) <= self.n[i] + self.n[j]
        return ok[near]

    def few(self):
        """All pairs of rows of the small units, in arrays of bounded length."""
        size = self.hi - self.lo
        for gap in range(1, _FEW):
            units = np.flatnonzero((size > gap) & (size <= _FEW))
            if not len(units):
                return
            count = size[units] - gap
            first = np.repeat(self.lo[units] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            yield first, first + gap

    def many(self):
        """(first, end) of the larger units."""
        for u in np.flatnonzero(self.hi - self.lo > _FEW).tolist():
            yield int(self.lo[u]), int(self.hi[u])


def _stars(part: pd.DataFrame) -> pd.DataFrame:
    """For each node a like node before it; a node that has none before it leads."""
    s = _Shards(part)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in s.few():
        ok = s.alike(a, b, STAR_RADIUS)
        i.append(a[ok])
        j.append(b[ok])
    for lo, hi in s.many():
        left = np.arange(lo, hi)
        while len(left) > 1:
            lead, left = left[:1], left[1:]
            taken = s.alike(np.repeat(lead, len(left)), left, STAR_RADIUS)
            i.append(np.repeat(lead, len(taken)))
            j.append(left[taken])
            left = np.delete(left, taken)
    i, j = np.concatenate(i), np.concatenate(j)
    out = pd.DataFrame({"a": s.node[i], "b": s.node[j], "n": s.n[i]})
    return out.sort_values(["b", "n", "a"], kind="stable").drop_duplicates("b")


def _cross(part: pd.DataFrame) -> pd.DataFrame:
    """All candidate pairs of nodes of different components."""
    s = _Shards(part)
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in s.few():
        apart = s.comp[a] != s.comp[b]
        a, b = a[apart], b[apart]
        ok = s.alike(a, b, RADIUS)
        i.append(a[ok])
        j.append(b[ok])
    for lo, hi in s.many():
        comp = s.comp[lo:hi]
        if (comp == comp[0]).all():
            continue
        for item, hits in BKTree(s.fp[lo:hi]).within(s.fp[lo:hi], RADIUS):
            hits = hits[(hits > item) & (comp[hits] != comp[item])]
            if len(hits):
                a, b = np.full(len(hits), lo + item), lo + hits
                ok = s.alike(a, b, RADIUS)
                i.append(a[ok])
                j.append(b[ok])
    i, j = np.concatenate(i), np.concatenate(j)
    a, b = s.node[i], s.node[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def confirmed(pairs: DataFrame, docs: DataFrame, marked: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; ``docs`` has (th, text), ``marked`` has (th, node)."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle)[1].astype(np.int64) for t in texts])

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similar(x, y) for x, y in zip(left, right)], dtype=bool)

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = marked.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("th").alias("th"))
    sets = docs.join(named, "th").dropDuplicates(["node"]).select("node", hashes("text").alias("set"))
    sets = materialise(sets, "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("left")), sets.select(F.col("node").alias("b"), F.col("set").alias("right"))
    out = materialise(pairs.join(left, "a").join(right, "b").filter(alike("left", "right")).select("a", "b"), "confirmed")
    discard(sets)
    return out


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, th, component) of every row: its id, a hash of its text, and the group of its node."""

    @F.pandas_udf("node long, fp long, parity binary, n long, prefix array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketch(t, shingle) for t in texts], columns=["node", "fp", "parity", "n", "prefix"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    marked = materialise(rows.select("id", "th", sketched("text").alias("s")).select("id", "th", "s.*"), "sketches")
    nodes = materialise(marked.groupBy("node").agg(F.first(F.struct("fp", "parity", "n", "prefix")).alias("s")).select("node", "s.*"), "nodes")
    keyed = nodes.select("node", F.explode("prefix").alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("all")).filter("all > 1")
    shards = keyed.join(counts, "key").join(nodes, "node")
    second = F.when(F.col("all") <= shard_rows, F.array(F.lit(0).cast("long"))).when(F.size("prefix") == 1, F.array("key")).otherwise(F.array_remove("prefix", F.col("key")))
    shards = materialise(shards.select("node", "fp", "parity", "n", "key", "all", F.explode(second).alias("second")), "shards")
    key = ["key", "second"]
    large = shards.filter(F.col("all") > shard_rows).groupBy(*key).count().filter(F.col("count") > shard_rows)
    units = row_blocks(shards.join(large, key, "left"), key, shard_rows)
    units = units.select("node", "fp", "parity", "n", F.xxhash64(*key, "lo", "hi").alias("unit"), (F.col("lo") == F.col("hi")).alias("own"))
    groups = max(1, -(-shards.count() // shard_rows))
    units = units.withColumn("grp", F.pmod("unit", F.lit(groups)))
    texts, names = rows.select("th", "text"), marked.select("th", "node")
    stars = units.filter("own").groupBy("grp").applyInPandas(_stars, "a long, b long, n long")
    stars = materialise(stars.groupBy("b").agg(F.min(F.struct("n", "a")).alias("least")).select("least.a", "b"), "candidates")
    links = confirmed(stars, texts, names, shingle)
    parts = materialise(connected_components(links), "parts")
    known = units.join(parts, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    cross = materialise(known.groupBy("grp").applyInPandas(_cross, "a long, b long").distinct(), "candidates")
    more = confirmed(cross, texts, names, shingle)
    parts = connected_components(links.union(more))
    for used in (nodes, shards, stars, cross):
        discard(used)
    return marked.join(parts, "node", "left").select("id", "th", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One input row of each group: the one of the smallest (id, hash of text).

    Rows that repeat it stay one row; rows of null id link others but are all kept, as nothing names them.
    """
    groups = similar_groups(docs, id_col, text_col, shingle).filter("id is not null")
    kept = groups.groupBy("component").agg(F.min(F.struct("id", "th")).alias("k")).select(F.col("k.id").alias("__id"), F.col("k.th").alias("__th"))
    named = docs.withColumn("__text", F.xxhash64(text_col)).join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__text") == F.col("__th")), "left_semi")
    return named.dropDuplicates([id_col, "__text"]).drop("__text").unionByName(docs.filter(F.col(id_col).isNull()))
