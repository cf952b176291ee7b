"""Sentence encoder: WordPiece and a small BERT forward pass in numpy, fed by Arrow batches.

Weights are supplied by the user (none are shipped): a vocabulary list and a dict of arrays by their usual names
(``embeddings.word_embeddings.weight``, ``encoder.layer.0.attention.self.query.weight`` ...).  Their size is fixed by
the model, not by the data, so they go to the workers by one broadcast.  Each distinct text is encoded once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_PIECES, WORD_CAP = 128, 64


def basic_tokens(text: str) -> list[str]:
    """Lower-case runs of ASCII letters and digits, at most 64 long, and single printable symbols."""
    out, word = [], ""
    for b in text.encode("utf-8", "surrogatepass"):
        c = chr(b)
        if b < 128 and c.isalnum():
            word += c.lower() if len(word) < WORD_CAP else ""
            continue
        if word:
            out.append(word)
            word = ""
        if 32 < b < 127:
            out.append(c)
    return [*out, word] if word else out


def word_pieces(text: str, vocabulary: dict[str, int], limit: int = MAX_PIECES) -> list[int]:
    """Ids with [CLS] and [SEP]: longest match first, a word with an unknown part is [UNK] from there on."""
    ids = [vocabulary["[CLS]"]]
    for word in basic_tokens(text):
        if len(ids) >= limit - 1:
            break
        if word in vocabulary:
            ids.append(vocabulary[word])
            continue
        start = 0
        while start < len(word) and len(ids) < limit:
            end = next((e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in vocabulary), None)
            if end is None:
                ids.append(vocabulary["[UNK]"])
                break
            ids.append(vocabulary[("##" if start else "") + word[start:end]])
            start = end
    return ids[:limit] + ([vocabulary["[SEP]"]] if len(ids) < limit else [])


def spread(ids: list[int], limit: int = MAX_PIECES) -> list[int]:
    """At most ``limit`` ids: the ends, and the ones between them taken evenly."""
    if len(ids) <= limit:
        return ids
    inner, span = limit - 2, len(ids) - 2
    return [ids[0], *(ids[1 + j * span // inner] for j in range(inner)), ids[-1]]


def _layer_norm(x: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + 1e-12) * g + b


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(0.7978845608 * (x + 0.044715 * x**3)))


def pooled(x: np.ndarray) -> np.ndarray:
    v = x.mean(axis=0)
    size = np.sqrt((v * v).sum())
    return v / size if size > 0 else v


def encode(ids: list[int], weights: dict[str, np.ndarray], heads: int = 12, taps: tuple[int, ...] = (0, 2, 4, 6)) -> list[np.ndarray]:
    """Unit sentence vectors after the embedding layer (0) and after the layers named in ``taps``."""
    w = weights
    x = w["embeddings.word_embeddings.weight"][ids] + w["embeddings.position_embeddings.weight"][: len(ids)] + w["embeddings.token_type_embeddings.weight"][0]
    x = _layer_norm(x, w["embeddings.LayerNorm.weight"], w["embeddings.LayerNorm.bias"])
    n, width = x.shape
    found = {0: pooled(x)}
    for layer in range(max(taps)):
        def linear(v: np.ndarray, name: str, at: str = f"encoder.layer.{layer}.") -> np.ndarray:
            return v @ w[f"{at}{name}.weight"].T + w[f"{at}{name}.bias"]

        split = lambda v: v.reshape(n, heads, width // heads).transpose(1, 0, 2)
        q, k, v = (split(linear(x, f"attention.self.{part}")) for part in ("query", "key", "value"))
        scores = q @ k.transpose(0, 2, 1) / np.sqrt(width // heads)
        share = np.exp(scores - scores.max(axis=-1, keepdims=True))
        share /= share.sum(axis=-1, keepdims=True)
        context = (share @ v).transpose(1, 0, 2).reshape(n, width)
        at = f"encoder.layer.{layer}."
        x = _layer_norm(x + linear(context, "attention.output.dense"), w[at + "attention.output.LayerNorm.weight"], w[at + "attention.output.LayerNorm.bias"])
        inner = linear(_gelu(linear(x, "intermediate.dense")), "output.dense")
        x = _layer_norm(x + inner, w[at + "output.LayerNorm.weight"], w[at + "output.LayerNorm.bias"])
        found[layer + 1] = pooled(x)
    return [found[t] for t in taps]


def sentence_vectors(texts: DataFrame, vocabulary: dict[str, int], weights: dict[str, np.ndarray], text_col: str = "text", heads: int = 12, taps: tuple[int, ...] = (0, 2, 4, 6), span: int = 1) -> DataFrame:
    """(text, vecs): unit vectors of each distinct text at the tapped depths; empty vectors for null."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, weights))

    @F.pandas_udf("array<array<float>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words, arrays = shared.value
        for batch in batches:
            out = []
            for text in batch:
                ids = spread(word_pieces(text or "", words, MAX_PIECES * span))
                out.append([v.astype(np.float32).tolist() for v in encode(ids, arrays, heads, taps)])
            yield pd.Series(out)

    return texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct().withColumn("vecs", run("text"))


def similarities(triples: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, ca, c2, c4, cb, cq): dots of ground truth and answer at each depth, and of answer and question at the last."""
    from .vectors import unit_dot

    rows = triples.select("id", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("q", "gt", "a")))
    for c in ("q", "gt", "a"):
        rows = rows.join(vectors.select(F.col("text").alias(c), F.col("vecs").alias("v_" + c)), c, "left")
    at = lambda i, x="gt": unit_dot(F.col("v_" + x)[i], F.col("v_a")[i])
    return rows.select("id", at(0).alias("ca"), at(1).alias("c2"), at(2).alias("c4"), at(3).alias("cb"), F.when(F.col("q") == "", at(3)).otherwise(at(3, "q")).alias("cq"))
