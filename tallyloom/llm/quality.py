"""Quality by a byte-level convolutional network in numpy.

Bytes become short vectors, learned filters slide over them, and every filter
is max-pooled over chunks of ``2 * BLOCK`` bytes that overlap by half and cover
the whole text. The mean, the maximum and the minimum of the chunks' pooled
values are combined into one probability.

The network is fitted by Adam on a bounded sample of labelled rows (at most about
``max_rows`` rows and ``max_bytes`` bytes of whole texts, drawn by a hash of the
id from all labelled training rows); everything else runs over all rows. The
gradient passes through the pooled places only. Inputs of a score: the text
alone, cut at fixed places, so equal texts have equal scores.

Defined results: null and empty texts score as one chunk of padding; null labels
and null ids are not learned from; several labels for one id count as good if
one says so; of several texts with one id the smallest is learned from;
repeated documents repeat their score; without any labelled row every score is
0.5; an empty table gives no rows. Only the id and text columns are read, and
the ``keep`` columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text import rows
from tallyloom.llm.toxicity import remainder

DEPTH, WIDTH, FILTERS = 6, 5, 40  # numbers per byte, bytes per filter, filters
BLOCK = 256  # half a chunk
PIECE = 64  # blocks whose windows are multiplied at once
PAD = 256  # the byte after the end

Net = dict[str, np.ndarray]


def start(seed: int = 1) -> Net:
    draw = np.random.default_rng(seed)
    return {
        "bytes": draw.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32),
        "filters": draw.normal(0, (WIDTH * DEPTH) ** -0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": draw.normal(0, 0.1, 3 * FILTERS).astype(np.float32),
        "offset": np.zeros(1, np.float32),
    }


def padded(text: str | None) -> np.ndarray:
    """Bytes of a text, filled up to whole blocks and by the overhang of the last window."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    blocks = max(1, -(-len(data) // BLOCK))
    codes = np.full(blocks * BLOCK + WIDTH - 1, PAD, np.int16)
    codes[: len(data)] = data
    return codes


def pooled(net: Net, codes: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Per block and filter the largest response of a window that starts there, and where it is."""
    blocks = (len(codes) - WIDTH + 1) // BLOCK
    tops, found = np.empty((blocks, FILTERS), np.float32), np.empty((blocks, FILTERS), np.int64) if places else None
    for low in range(0, blocks, PIECE):
        high = min(blocks, low + PIECE)
        vectors = net["bytes"][codes[low * BLOCK : high * BLOCK + WIDTH - 1]]
        windows = np.lib.stride_tricks.sliding_window_view(vectors.reshape(-1), WIDTH * DEPTH)[::DEPTH]
        responses = (np.ascontiguousarray(windows) @ net["filters"]).reshape(high - low, BLOCK, FILTERS)
        tops[low:high] = responses.max(axis=1)
        if places:
            found[low:high] = responses.argmax(axis=1) + np.arange(low, high)[:, None] * BLOCK
    return tops, found


def chunked(tops: np.ndarray) -> np.ndarray:
    """Pooled values of the chunks: two neighbouring blocks each, or the only block."""
    return np.maximum(tops[:-1], tops[1:]) if len(tops) > 1 else tops


def combined(net: Net, tops: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The log-odds, the chunks' activations and the text's features."""
    active = np.maximum(chunked(tops) + net["bias"], 0)
    features = np.concatenate([active.mean(axis=0), active.max(axis=0), active.min(axis=0)])
    return float(features @ net["out"] + net["offset"][0]), active, features


def probability(net: Net, text: str | None) -> float:
    odds = combined(net, pooled(net, padded(text))[0])[0]
    return float(1 / (1 + np.exp(-np.clip(odds, -35, 35))))


def gradient(net: Net, codes: np.ndarray, label: int, total: Net) -> None:
    """Adds the gradient of the log loss of one text to ``total``."""
    tops, places = pooled(net, codes, places=True)
    odds, active, features = combined(net, tops)
    error = 1 / (1 + np.exp(-np.clip(odds, -35, 35))) - label
    total["out"] += error * features
    total["offset"] += error
    mean_part, top_part, low_part = (error * net["out"]).reshape(3, FILTERS)
    back = np.repeat(mean_part[None] / len(active), len(active), axis=0)
    back[active.argmax(axis=0), np.arange(FILTERS)] += top_part
    back[active.argmin(axis=0), np.arange(FILTERS)] += low_part
    back *= active > 0
    total["bias"] += back.sum(axis=0)
    block, filt = np.arange(len(active))[:, None], np.arange(FILTERS)
    if len(tops) > 1:
        block = block + (tops[1:] > tops[:-1])
    hit = codes[places[block, filt][..., None] + np.arange(WIDTH)]
    total["filters"] += np.einsum("cfk,cf->kf", net["bytes"][hit].reshape(*back.shape, -1), back)
    moved = (net["filters"].T * back[..., None]).reshape(-1, DEPTH)
    for k in range(DEPTH):
        total["bytes"][:, k] += np.bincount(hit.ravel(), moved[:, k], PAD + 1)


def fit(examples: list[tuple[np.ndarray, int]], epochs: int, batch: int, rate: float, seed: int = 1) -> Net:
    """Adam over the examples in a shuffled order that the seed fixes."""
    net = start(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    draw, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = draw.permutation(len(examples))
        for low in range(0, len(order), batch):
            total = {k: np.zeros_like(v) for k, v in net.items()}
            chosen = order[low : low + batch]
            for k in chosen:
                gradient(net, *examples[k], total)
            step += 1
            for k, g in total.items():
                g /= len(chosen)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net[k] = net[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def train(
    docs: DataFrame, labels: DataFrame, folds: int = 5, max_rows: int = 3000, max_bytes: int = 8 << 20, epochs: int = 4, batch: int = 16, rate: float = 0.01
) -> Net | None:
    """The fitted network, a few thousand numbers; None without a labelled row. Rows of the first fold are not learned from."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna()
    usable = usable.filter(remainder(F.col("doc_id"), folds) != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    there, wide = usable.count(), 1 << 40
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(wide)) < int(wide * min(1.0, max_rows / max(1, there))))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # About max_rows rows of two numbers, whatever the size of the input: small enough for every task.
    sample = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    ordered = sample.repartition(1).sortWithinPartitions(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id")
    names = list(start())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, room = [], max_bytes
        for text, label in rows(batches, ("text", "quality")):
            codes = padded(text)
            if len(codes) <= room:
                examples.append((codes, int(label)))
                room -= len(codes)
        if examples:
            net = fit(examples, epochs, batch, rate)
            yield pa.record_batch({"name": pa.array(names), "numbers": pa.array([net[k].ravel().tolist() for k in names], pa.list_(pa.float32()))})

    found = {r["name"]: r["numbers"] for r in ordered.mapInArrow(run, "name string, numbers array<float>").collect()}
    return {k: np.array(found[k], np.float32).reshape(v.shape) for k, v in start().items()} if found else None


def scored(docs: DataFrame, net: Net | None, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [0.5 if net is None else probability(net, t) for (t,) in rows([batch], ("_scored_text",))]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*keep, "score"])

    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("_scored_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[: len(keep)])
    return picked.mapInArrow(run, f"{fields}, score double")
