"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, the neighbouring pairs and the pairs with one word
between them, hashed into a fixed number of places; a feature is there or not.
FTRL keeps two numbers per place: its own learning rate, and an L1 threshold
that leaves most weights at zero, so the weights that scoring sends to the
tasks are few and never more than the places.

The classifier is fitted on a bounded sample of labelled rows (``max_rows``,
drawn by a hash of the id from all labelled training rows); everything else
runs over all rows. Inputs of a score: the text alone, so equal texts have
equal scores.

Defined results: null and empty texts score as the intercept; labelled rows
without a text count as empty; null labels and null ids are not learned from;
several labels for one id count as toxic if one says so; repeated documents
repeat their score; without any labelled row every score is 0.5; an empty table gives no
rows. Only the id and text columns of ``docs`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text import rows

PLACES_LOG2 = 20
# ASCII punctuation to space: words are compared without the marks around them.
_FOLD = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
_PAIR, _SKIP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def features(text: str | None, log2: int = PLACES_LOG2) -> np.ndarray:
    """Sorted places of the distinct features of a text; place 0 is the intercept."""
    words = (text or "").lower().encode().translate(_FOLD).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    keys = np.concatenate([h * _MIX, (h[:-1] * _PAIR) ^ (h[1:] * _MIX), (h[:-2] * _SKIP) ^ (h[2:] * _MIX) ^ np.uint64(1)])
    keys ^= keys >> np.uint64(29)
    places = (keys * _PAIR) >> np.uint64(64 - log2)
    return np.unique(np.concatenate([[0], places.astype(np.int64)]))


def fit_ftrl(
    examples: list[tuple[np.ndarray, int]], log2: int, epochs: int, alpha: float, beta: float, l1: float, l2: float, min_rows: int, max_share: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that are not zero.

    A feature is included from ``min_rows`` examples on, up to ``max_share`` of
    them: what one example alone has would only be learned by heart.
    """
    z, n = np.zeros(1 << log2), np.zeros(1 << log2)
    seen = np.zeros(1 << log2, np.int64)
    for at, _ in examples:
        seen[at] += 1
    included = (seen >= min_rows) & (seen <= max_share * len(examples))
    included[0] = True
    examples = [(at[included[at]], label) for at, label in examples]

    def weight(zi: np.ndarray, ni: np.ndarray, at: np.ndarray) -> np.ndarray:
        soft = np.where(at == 0, 0.0, l1)  # the intercept is not thinned
        return np.where(np.abs(zi) <= soft, 0.0, (np.sign(zi) * soft - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for at, label in examples:
            zi, ni = z[at], n[at]
            w = weight(zi, ni, at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    everywhere = np.arange(1 << log2)
    w = weight(z, n, everywhere)
    kept = np.flatnonzero(w)
    return kept, w[kept]


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = 16_000, log2: int = PLACES_LOG2, epochs: int = 5,
    alpha: float = 1.5, beta: float = 1.0, l1: float = 10.0, l2: float = 0.0, min_rows: int = 6, max_share: float = 1.0,
) -> dict[str, np.ndarray]:
    """``place`` and ``weight`` arrays, at most 2 ** log2 of each; rows of the first fold are not learned from."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    usable = usable.filter(remainder(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    there = usable.count()
    wide = 1 << 40
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < int(wide * min(1.0, max_rows / max(1, there))))
    # About max_rows rows of two numbers, whatever the size of the input: small enough for every task.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "toxic").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = [(zlib.crc32(str(i).encode()), i, features(t, log2).astype(np.int32), int(y)) for i, t, y in rows(batches, ("doc_id", "text", "toxic"))]
        examples.sort(key=lambda e: (e[0], e[1], e[3], len(e[2])))
        place, weight = fit_ftrl([e[2:] for e in examples], log2, epochs, alpha, beta, l1, l2, min_rows, max_share)
        yield pa.record_batch({"place": pa.array(place, pa.int64()), "weight": pa.array(weight, pa.float64())})

    found = sample.mapInArrow(run, "place bigint, weight double").toArrow()
    return {name: found.column(name).to_numpy() for name in ("place", "weight")}


def scored(docs: DataFrame, model: dict[str, np.ndarray], log2: int = PLACES_LOG2, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << log2)
        weights[sent.value["place"]] = sent.value["weight"]
        for batch in batches:
            scores = [1 / (1 + np.exp(-np.clip(weights[features(t, log2)].sum(), -35, 35))) for (t,) in rows([batch], ("_scored_text",))]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch([*columns, pa.array(scores, pa.float64())], names=[*keep, "score"])

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_scored_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{fields}, score double")
