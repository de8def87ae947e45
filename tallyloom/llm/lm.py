"""LM scoring by deleted interpolation of unigrams and bigrams.

p(w | h) = a2 c(h w) / c(h) + a1 c(w) / N + a0 / (V + 1), with weights per
bucket of the context's frequency (a bucket per doubling). The weights are
learned by expectation-maximisation on held-out counts: one tenth of the
training documents is deleted from the counts and explained by the rest.

Spark carries packed blocks instead of a row per token. A block is a bounded
run of documents: token ids into its own word list. For words, and then for
word pairs, every block sends its distinct sorted keys with their counts, cut
by key range; a task per range adds them up and answers each block in the
block's own order. So a word or pair that is very frequent is one entry per
block. Blocks and answers are stored in the shared folder; a range's size
follows the size of a block, and the number of ranges the number of blocks.

A pair's key is a hash with 20 bits more than the corpus has tokens, at most
64, so that about one pair in a million shares its key with another.

Defined results: a null or empty text has one token, its end; null ids count as
the empty string when folds are drawn; repeated rows count and are scored one
by one; without training rows every token has the uniform share; an empty table
gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text import lowered_words, rows
from tallyloom.scratch import materialise

BLOCK_CHARS = 10 << 20
END = b" "  # no word has a space; the end of one text is also the context of the next one's first word
TEST, DELETED = 0, 9  # folds: not learned from; held out while weights are learned
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(values: np.ndarray, sort: bool = False) -> bytes:
    """Whole numbers as compressed byte planes; sorted ones as differences."""
    v = np.ascontiguousarray(values, np.uint64)
    if sort and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    planes = v.view(np.uint8).reshape(-1, 8).T
    used = 8 if not len(v) else max(1, (int(v.max()).bit_length() + 7) // 8)
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def unpack(blob: bytes, sort: bool = False) -> np.ndarray:
    used = blob[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8).reshape(used, -1)
    v = np.zeros((planes.shape[1], 8), np.uint8)
    v[:, :used] = planes.T
    v = v.reshape(-1).view(np.uint64)
    return np.cumsum(v, dtype=np.uint64) if sort else v


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _block(name: str, held: list[tuple]) -> dict:
    ids = _Ids({END: 0})
    runs, lengths, folds = [], [], []
    for doc_id, text in held:
        run = np.fromiter(map(ids.__getitem__, lowered_words(text)), np.int64)
        runs += [run, np.zeros(1, np.int64)]
        lengths.append(len(run) + 1)
        folds.append(zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 10)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
    order = np.argsort(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    tokens, fold = place[np.concatenate(runs)], np.repeat(folds, lengths)
    counted = [np.bincount(tokens[m], minlength=len(order)) for m in (fold != TEST, fold == DELETED)]
    return {
        "block": name, "doc_ids": [d for d, _ in held], "lengths": pack(np.array(lengths)), "folds": pack(np.array(folds)), "tokens": pack(tokens),
        "last": int(place[0]), "keys": pack(hashes[order], True), "train": pack(counted[0]), "deleted": pack(counted[1]),
    }


BLOCK_SCHEMA = "block string, doc_ids array<bigint>, lengths binary, folds binary, tokens binary, last bigint, keys binary, train binary, deleted binary"
ASK_SCHEMA = "part int, block string, keys binary, train binary, deleted binary, of_context binary, of_word binary"
ANSWER_SCHEMA = "kind string, block string, part int, train binary, deleted binary, n_keys bigint, n_train bigint, n_deleted bigint, cells array<bigint>, weights array<bigint>"


def _batch(found: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    return pa.record_batch([pa.array([x.get(n) for x in found], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def _table(found: list[dict], schema: str) -> pa.Table:
    return pa.Table.from_batches([_batch(found, schema)])


def blocks(docs: DataFrame, chars: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, made, task = [], 0, 0, TaskContext.get().partitionId()
        for doc_id, text in rows(batches, ("doc_id", "text")):
            held.append((doc_id, text))
            size += len(text or "") + 16
            if size >= chars:
                yield _batch([_block(f"{task}-{made}", held)], BLOCK_SCHEMA)
                held, size, made = [], 0, made + 1
        if held:
            yield _batch([_block(f"{task}-{made}", held)], BLOCK_SCHEMA)

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _cut(keys: np.ndarray, parts_log2: int, bits: int, columns: dict[str, np.ndarray], block: str) -> Iterator[dict]:
    """A row per key range, with the block's sorted keys of that range."""
    edges = np.searchsorted(keys, np.arange(1, 1 << parts_log2, dtype=np.uint64) << np.uint64(bits - parts_log2)) if parts_log2 else []
    for part, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)])):
        if b > a:
            yield {"part": part, "block": block, "keys": pack(keys[a:b], True), **{n: pack(v[a:b]) for n, v in columns.items()}}


def ask_words(stored: DataFrame, parts_log2: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, keys, train, deleted in rows(batches, ("block", "keys", "train", "deleted"), 1):
            yield _batch(list(_cut(unpack(keys, True), parts_log2, 64, {"train": unpack(train), "deleted": unpack(deleted)}, block)), ASK_SCHEMA)

    return stored.select("block", "keys", "train", "deleted").mapInArrow(run, ASK_SCHEMA)


def quarter(counts: np.ndarray) -> np.ndarray:
    """Counts by quarter octaves, one byte."""
    return np.round(4 * np.log2(counts.astype(float) + 1)).astype(np.uint64)


def count(asked: DataFrame, kind: str) -> DataFrame:
    """Totals of every key, as an answer to each block that asked, and the cells that weights are learned from."""

    def run(group: pa.Table) -> pa.Table:
        found = group.to_pylist()
        keys = [unpack(x["keys"], True) for x in found]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = [np.bincount(at, np.concatenate([unpack(x[c]) for x in found]).astype(float), len(distinct)).astype(np.uint64) for c in ("train", "deleted")]
        out, begin = [], 0
        for x, own in zip(found, keys):
            places = at[begin : begin + len(own)]
            begin += len(own)
            answer = {"kind": kind, "block": x["block"], "part": x["part"], "train": pack(totals[0][places]), "deleted": pack(totals[1][places]), "n_keys": 0, "n_train": 0, "n_deleted": 0}
            if x["of_context"] is not None:
                held = unpack(x["deleted"])
                some = held > 0
                kept = quarter((totals[0] - totals[1])[places[some]])
                cell = unpack(x["of_context"]) << np.uint64(32) | unpack(x["of_word"]) << np.uint64(16) | kept
                cells, where = np.unique(cell, return_inverse=True)
                answer |= {"cells": cells.astype(np.int64).tolist(), "weights": np.bincount(where, held[some].astype(float), len(cells)).astype(np.int64).tolist()}
            out.append(answer)
        out[0] |= {"n_keys": int((totals[0] > 0).sum()), "n_train": int(totals[0].sum()), "n_deleted": int(totals[1].sum())}
        return _table(out, ANSWER_SCHEMA)

    return asked.groupBy("part").applyInArrow(run, ANSWER_SCHEMA)


def _answers(table: pa.Table, kind: str) -> list[np.ndarray]:
    found = sorted((x for x in table.select(["kind", "part", "train", "deleted"]).to_pylist() if x["kind"] == kind), key=lambda x: x["part"])
    return [np.concatenate([unpack(x[c]) for x in found]) if found else np.zeros(0, np.uint64) for c in ("train", "deleted")]


def _pairs(block: dict, bits: int) -> tuple[np.ndarray, ...]:
    """Contexts and words of every token by place, the distinct pair keys, the key of every token, and the fold of every token."""
    words, tokens = unpack(block["keys"], True), unpack(block["tokens"]).astype(np.int64)
    contexts = np.concatenate([[block["last"]], tokens[:-1]])  # the end of a text comes before the first word of the next
    mixed = (words[contexts] * _A) ^ ((words[tokens] * _B) >> np.uint64(7)) ^ (words[tokens] << np.uint64(32))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _B
    keys, at = np.unique(mixed >> np.uint64(64 - bits), return_inverse=True)
    fold = np.repeat(unpack(block["folds"]), unpack(block["lengths"]).astype(np.int64))
    return contexts, tokens, keys, at, fold


def ask_pairs(stored: DataFrame, answers: DataFrame, bits: int, parts_log2: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        train, deleted = _answers(right, "word")
        contexts, tokens, keys, at, fold = _pairs(block, bits)
        counted = [np.bincount(at[m], minlength=len(keys)) for m in (fold != TEST, fold == DELETED)]
        first = np.zeros(len(keys), np.int64)
        first[at] = np.arange(len(at))
        kept = quarter(train - deleted)
        out = []
        for part in _cut(keys, parts_log2, bits, {"train": counted[0], "deleted": counted[1], "first": first}, block["block"]):
            where = unpack(part.pop("first")).astype(np.int64)[unpack(part["deleted"]) > 0]
            out.append(part | {"of_context": pack(kept[contexts[where]]), "of_word": pack(kept[tokens[where]])})
        return _table(out, ASK_SCHEMA)

    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, ASK_SCHEMA)


def learn_weights(cells: dict[int, int], kept_tokens: int, distinct: int, rounds: int = 40) -> np.ndarray:
    """a2, a1, a0 for every bucket of the context's frequency, by expectation-maximisation."""
    weights = np.tile([0.3, 0.6, 0.1], (64, 1))
    if not cells:
        return weights
    code, n = np.array(list(cells), np.int64), np.array(list(cells.values()), float)
    context, word, pair = (2 ** (((code >> s) & 0xFFFF) / 4) - 1 for s in (32, 16, 0))
    bucket = np.floor(np.log2(context + 1) + 1e-9).astype(np.int64)
    parts = np.stack([np.minimum(1, pair / np.maximum(context, 1)), word / max(1, kept_tokens), np.full(len(n), 1 / (distinct + 1))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * parts
        share *= (n / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, share[:, k], 64) for k in range(3)], axis=1)
        total += [1e-3, 1e-3, 1e-3]
        learned = total / total.sum(axis=1, keepdims=True)
        seen = np.bincount(bucket, n, 64) > 0
        weights[seen] = learned[seen]
    return weights


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stored = materialise(blocks(picked, chars), "lm-blocks")
    parts_log2 = max(0, math.ceil(math.log2(max(1, stored.count()))))
    words = materialise(count(ask_words(stored, parts_log2), "word"), "lm-words")
    n_train, n_deleted, distinct = (x or 0 for x in words.agg(F.sum("n_train"), F.sum("n_deleted"), F.sum("n_keys")).first())
    bits = min(64, 20 + max(1, n_train).bit_length())
    pairs = materialise(count(ask_pairs(stored, words, bits, parts_log2), "pair"), "lm-pairs")
    # Cells are a grid of quarter octaves of three counts: its size is bounded by the logarithms of the counts.
    summed = pairs.select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).groupBy("x.cells").agg(F.sum("x.weights").alias("n"))
    weights = learn_weights({c: n for c, n in summed.collect()}, n_train - n_deleted, distinct)
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        of_word, _ = _answers(right, "word")
        of_pair, _ = _answers(right, "pair")
        contexts, tokens, _, at, _ = _pairs(block, bits)
        lengths = unpack(block["lengths"]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        word, context, pair = of_word[tokens].astype(float), of_word[contexts].astype(float), of_pair[at].astype(float)
        base = np.log10((word + 0.1) / (n_train + 0.1 * (distinct + 1)))
        w = weights[np.floor(np.log2(context + 1)).astype(np.int64)]
        p = w[:, 0] * np.minimum(1, pair / np.maximum(context, 1)) + w[:, 1] * word / max(1, n_train) + w[:, 2] / (distinct + 1)
        return pa.table({
            "doc_id": pa.array(block["doc_ids"], pa.int64()), "held_out": pa.array(unpack(block["folds"]) == TEST), "n_tokens": pa.array(lengths),
            "n_known": pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)), "train_tokens": pa.array(np.full(len(lengths), n_train, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, starts)), "score": pa.array(np.add.reduceat(np.log10(p), starts)),
        })

    answers = words.unionByName(pairs).select("kind", "block", "part", "train", "deleted")
    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
