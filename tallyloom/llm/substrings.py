"""Exact removal of long repeated substrings with a distributed sparse suffix array.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts
earlier. Every such string has one anchor: the position of its smallest
``GRAM``-byte hash, the leftmost of equals. Anchors depend on the string alone,
so equal strings have anchors at equal distances, and only suffixes at anchors
need to be sorted.

1. Documents are stored as compressed blocks of bounded size. Every block asks
   how often its anchors' grams occur anywhere; grams that occur once are done.
2. A block sorts the suffixes at its remaining anchors, settles repeats inside
   the block, and sends the rest as front-coded sorted runs, cut by a hash of
   the gram. A gram with very many occurrences is cut by the longer stretch of
   bytes around it that all strings at about the same distance share, so that a
   passage in a third of all documents does not meet in one task.
3. A task merges its runs with a loser tree that keeps, for every run's head,
   the length of the prefix it shares with the last output, and compares only
   the bytes after it. The merged order and its shared prefixes, together with
   the same for the bytes before the anchors, name equal strings; all but the
   earliest are reported to their blocks.
4. Every block joins the reported stretches of each document.

The order of strings is document id, then start. Defined results: a null text
is empty; null ids come last; rows with one id are ordered by where they were
read; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.lm import _batch, _cut, _table, pack, unpack
from tallyloom.llm.text import rows
from tallyloom.scratch import materialise

LENGTH, GRAM = 100, 24
REACH = LENGTH - GRAM  # the farthest that an anchor is from the start of its string
STEPS = REACH + 1
BLOCK_BYTES, PIECE = 4 << 20, 1 << 18
HOT, CHUNK = 4096, 11
LAST_ID = np.iinfo(np.int64).max
_P, _M = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Mixed polynomial hashes of every ``size`` bytes."""
    powers, have = {1: data.astype(np.uint64) + np.uint64(1)}, 1
    while have * 2 <= size:
        half = powers[have]
        powers[have * 2] = half[:-have] * np.uint64(pow(_P, have, 1 << 64)) + half[have:]
        have *= 2
    h, done = powers[have], have
    for part in sorted(powers, reverse=True):
        if part != have and size - done >= part:
            n = len(data) - done - part + 1
            h = h[:n] * np.uint64(pow(_P, part, 1 << 64)) + powers[part][done : done + n]
            done += part
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place in ``data``, least and greatest distance from a string's start, and gram hash, of every anchor.

    ``data`` holds documents one after the other; strings that cross from one to the next are left out.
    """
    found = []
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.repeat(bounds[1:], lengths)
    for low in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        piece = data[low : low + PIECE + LENGTH - 1]
        h = _hashes(piece, GRAM)
        ranked = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        least, width = ranked, 1
        while width * 2 <= STEPS:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        count = len(piece) - LENGTH + 1
        least = np.minimum(least[:count], least[STEPS - width : STEPS - width + count])
        starts = np.flatnonzero(np.arange(low, low + count) + LENGTH <= ends[low : low + count])
        if not len(starts):
            continue
        at = (least[starts] & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
        last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
        found.append((at[new] + low, at[new] - starts[last], at[new] - starts[new], h[at[new]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _shared(sorted_rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it."""
    n, width = sorted_rows.shape
    out = np.zeros(n, np.int64)
    if n > 1:
        differ = sorted_rows[1:] != sorted_rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return out


def _order(matrix: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(matrix).view(f"S{matrix.shape[1]}").ravel(), kind="stable")


def repeated(order: np.ndarray, shared: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every item and distance from the start: whether that string has an earlier equal.

    ``order`` and ``shared``: items by the bytes from the anchor on; ``left``: the
    bytes before it, backward; ``rank``: items from the earliest string on.
    """
    n = len(order)
    left_order = _order(left)
    left_shared = _shared(left[left_order])
    position = np.empty(n, np.int64)
    position[rank] = np.arange(n)
    marks, names = np.zeros((n, STEPS), bool), np.empty((2, n), np.int64)
    low, high = low[rank], high[rank]
    for step in range(STEPS):
        active = np.flatnonzero((low <= step) & (step <= high))
        if len(active) < 2:
            continue
        names[0, position[order]] = np.cumsum(shared < LENGTH - step)
        names[1, position[left_order]] = np.cumsum(left_shared < step)
        pair = names[0, active] * (n + 1) + names[1, active]
        _, first, at = np.unique(pair, return_index=True, return_inverse=True)
        later = active[first[at] != np.arange(len(active))]
        marks[rank[later], step] = True
    return marks


def stretches(marks: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first byte and end of each run of repeated strings."""
    wide = np.zeros((len(marks), STEPS + 2), np.int8)
    wide[:, 1:-1] = marks
    turn = np.diff(wide, axis=1)
    item, first = np.nonzero(turn == 1)
    _, last = np.nonzero(turn == -1)
    return item, place[item] - (last - 1), place[item] - first + LENGTH


def _common(a: bytes, b: bytes, known: int) -> int:
    """Bytes that ``a`` and ``b`` share, given that they share ``known``."""
    if a == b:
        return len(a)
    low, high = known, len(a)
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Items of sorted runs in one order, numbered run after run, and the bytes each shares with the one before.

    ``runs`` hold strings of one length with the bytes that each shares with the
    one before it in its run. A loser tree: a node keeps the run that lost there
    with the bytes that its head shares with the winner. Heads that share
    different lengths with the last output are told apart without a look at them.
    """
    offsets = np.cumsum([0, *(len(r[0]) for r in runs)]).tolist()
    total, k = offsets[-1], 1
    while k < len(runs):
        k *= 2
    head = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known, at = [0] * k, [0] * k

    def meet(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; the loser's shared length is told against the winner."""
        if head[a] is None:
            return b, a
        if head[b] is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = head[a], head[b]
        same = _common(x, y, known[a])
        if same == len(x) or x[same] < y[same]:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    losers, winners = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = meet(winners[2 * node], winners[2 * node + 1])
    champion = winners[1] if k > 1 else 0
    items, shared = np.empty(total, np.int64), np.empty(total, np.int64)
    for out in range(total):
        items[out], shared[out] = offsets[champion] + at[champion], known[champion]
        at[champion] += 1
        strings, lengths = runs[champion]
        if at[champion] < len(strings):
            head[champion], known[champion] = strings[at[champion]], lengths[at[champion]]
        else:
            head[champion] = None
        node = (champion + k) // 2
        while node:
            champion, losers[node] = meet(champion, losers[node])
            node //= 2
    return items, shared


BLOCK_SCHEMA = "block string, sequence bigint, doc_ids array<bigint>, lengths binary, data binary"
ASK_SCHEMA = "part int, block string, keys binary, train binary"
COUNT_SCHEMA = "block string, part int, train binary"
RUN_SCHEMA = "part int, block string, shared binary, rest binary, lefts binary, low binary, high binary, doc binary, at binary, doc_id array<bigint>, sequence bigint, local_doc binary, local_from binary, local_to binary"
FOUND_SCHEMA = "block string, doc binary, begin binary, until binary"


def blocks(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, have, made, task = [], [], 0, 0, TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            row = {"block": f"{task}-{made}", "sequence": task << 20 | made, "doc_ids": ids, "lengths": pack(np.array([len(t) for t in texts])), "data": data}
            return _batch([row], BLOCK_SCHEMA)

        for doc_id, text in rows(batches, ("doc_id", "text")):
            ids.append(doc_id)
            texts.append((text or "").encode())
            have += len(texts[-1]) + 16
            if have >= size:
                yield block()
                ids, texts, have, made = [], [], 0, made + 1
        if ids:
            yield block()

    return docs.mapInArrow(run, BLOCK_SCHEMA)


def _opened(block: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(block["data"]), np.uint8) if block["data"] else np.zeros(0, np.uint8), unpack(block["lengths"]).astype(np.int64)


def ask_grams(stored: DataFrame, parts_log2: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, lengths, data in rows(batches, ("block", "lengths", "data"), 1):
            keys, counts = np.unique(anchors(*_opened({"data": data, "lengths": lengths}))[3], return_counts=True)
            yield _batch(list(_cut(keys, parts_log2, 64, {"train": counts}, block)), ASK_SCHEMA)

    return stored.select("block", "lengths", "data").mapInArrow(run, ASK_SCHEMA)


def count_grams(asked: DataFrame, hot: int) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        found = group.to_pylist()
        keys = [unpack(x["keys"], True) for x in found]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, np.concatenate([unpack(x["train"]) for x in found]).astype(float), len(distinct)).astype(np.int64)
        cuts = np.cumsum([0, *map(len, keys)])
        answers = [np.minimum(totals[at[a:b]], hot + 1) for a, b in zip(cuts, cuts[1:])]
        return _table([{"block": x["block"], "part": x["part"], "train": pack(a)} for x, a in zip(found, answers)], COUNT_SCHEMA)

    return asked.groupBy("part").applyInArrow(run, COUNT_SCHEMA)


def send_runs(stored: DataFrame, counts: DataFrame, parts_log2: int, hot: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        data, lengths = _opened(block)
        place, low, high, key = anchors(data, lengths)
        answers = sorted(right.select(["part", "train"]).to_pylist(), key=lambda x: x["part"])
        times = np.concatenate([unpack(x["train"]) for x in answers]) if answers else np.zeros(0, np.uint64)
        distinct = np.unique(key)
        times = times[np.searchsorted(distinct, key)].astype(np.int64) if len(key) else np.zeros(0, np.int64)
        again = times > 1
        if not again.any():
            return _table([], RUN_SCHEMA)
        place, low, high, key, times = (x[again] for x in (place, low, high, key, times))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.searchsorted(bounds, place, "right") - 1
        padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        around = np.lib.stride_tricks.sliding_window_view(padded, REACH + LENGTH)
        doc_ids = np.array([LAST_ID if d is None else d for d in block["doc_ids"]], np.int64)

        def sides(which: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Bytes from the anchors on and backward before them, zero where no string of the item reaches."""
            found = around[which]
            ahead, behind = found[:, REACH:].copy(), found[:, REACH - 1 :: -1].copy()
            ahead[np.arange(LENGTH) >= (LENGTH - lo)[:, None]] = 0
            behind[np.arange(REACH) >= hi[:, None]] = 0
            return ahead, behind

        ahead, behind = sides(place, low, high)
        order = _order(ahead)
        rank = np.lexsort((place, doc, doc_ids[doc]))
        marks = repeated(order, _shared(ahead[order]), behind, low, high, rank)
        item, begin, until = stretches(marks, place)
        base = bounds[doc]
        local = {"local_doc": pack(doc[item]), "local_from": pack(begin - base[item]), "local_to": pack(until - base[item])}
        steps = np.arange(STEPS)
        unsettled = (steps >= low[:, None]) & (steps <= high[:, None]) & ~marks
        kept = unsettled.any(axis=1)
        low, high = np.where(kept, unsettled.argmax(axis=1), 0), np.where(kept, REACH - unsettled[:, ::-1].argmax(axis=1), 0)
        place, low, high, key, times, doc = (x[kept] for x in (place, low, high, key, times, doc))
        if (times > hot).any():  # cut by the bytes that all strings of a chunk of distances share
            core = _hashes(padded, LENGTH - CHUNK + 1)
            pieces = [tuple(x[times <= hot] for x in (place, low, high, key, doc))]
            for first in range(0, STEPS, CHUNK):
                there = (times > hot) & (low < first + CHUNK) & (high >= first)
                lo, hi = np.maximum(low[there], first), np.minimum(high[there], first + CHUNK - 1)
                pieces.append((place[there], lo, hi, core[place[there] + REACH - first] ^ np.uint64(first), doc[there]))
            place, low, high, key, doc = (np.concatenate(x) for x in zip(*pieces))
        part = (key * _M >> np.uint64(64 - parts_log2)).astype(np.int64) if parts_log2 else np.zeros(len(key), np.int64)
        out = [{"part": int(block["sequence"] % (1 << parts_log2)), "block": block["block"], **local}]
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            ahead, behind = sides(place[own], low[own], high[own])
            order = _order(ahead)
            own, ahead, behind = own[order], ahead[order], behind[order]
            shared = _shared(ahead)
            squeeze = zstandard.ZstdCompressor(level=1).compress
            out.append({
                "part": int(p), "block": block["block"], "shared": pack(shared), "rest": squeeze(ahead[np.arange(LENGTH) >= shared[:, None]].tobytes()),
                "lefts": squeeze(behind.tobytes()), "low": pack(low[own]), "high": pack(high[own]), "doc": pack(doc[own]), "at": pack(place[own] - bounds[doc[own]]),
                "doc_id": doc_ids[doc[own]], "sequence": block["sequence"],
            })
        return _table(out, RUN_SCHEMA)

    return stored.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, RUN_SCHEMA)


def _strings(run: dict) -> tuple[list[bytes], list[int]]:
    shared = unpack(run["shared"]).astype(np.int64).tolist()
    rest, at, last, out = zstandard.ZstdDecompressor().decompress(run["rest"]) if run["rest"] else b"", 0, b"", []
    for same in shared:
        last = last[:same] + rest[at : at + LENGTH - same]
        at += LENGTH - same
        out.append(last)
    return out, shared


def merge_found(sent: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        found = group.to_pylist()
        out = [{"block": x["block"], "doc": x["local_doc"], "begin": x["local_from"], "until": x["local_to"]} for x in found if x["local_doc"] is not None]
        runs = [x for x in found if x["shared"] is not None]
        if runs:
            order, shared = merge_runs([_strings(x) for x in runs])
            left = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x["lefts"]), np.uint8).reshape(-1, REACH) for x in runs])
            low, high, doc, at = (np.concatenate([unpack(x[c]) for x in runs]).astype(np.int64) for c in ("low", "high", "doc", "at"))
            doc_id = np.concatenate([np.array(x["doc_id"], np.int64) for x in runs])
            of = np.repeat(np.arange(len(runs)), [len(x["doc_id"]) for x in runs])
            sequence = np.array([x["sequence"] for x in runs])[of]
            marks = repeated(order, shared, left, low, high, np.lexsort((at, doc, sequence, doc_id)))
            item, begin, until = stretches(marks, at)
            for k, x in enumerate(runs):
                own = of[item] == k
                if own.any():
                    out.append({"block": x["block"], "doc": pack(doc[item[own]]), "begin": pack(begin[own]), "until": pack(until[own])})
        return _table(out, FOUND_SCHEMA)

    return sent.groupBy("part").applyInArrow(run, FOUND_SCHEMA)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``with_kept`` the remaining bytes."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stored = materialise(blocks(picked, block_bytes), "repeat-blocks")
    parts_log2 = max(0, (stored.count() - 1).bit_length())
    counts = materialise(count_grams(ask_grams(stored, parts_log2), hot), "repeat-counts")
    found = merge_found(send_runs(stored, counts, parts_log2, hot))
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_kept else "")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        data, lengths = _opened(block)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        depth = np.zeros(len(data) + 1, np.int32)
        for x in right.select(["doc", "begin", "until"]).to_pylist():
            doc, begin, until = (unpack(x[c]).astype(np.int64) for c in ("doc", "begin", "until"))
            np.add.at(depth, bounds[doc] + begin, 1)
            np.add.at(depth, bounds[doc] + until, -1)
        gone = np.cumsum(depth[:-1]) > 0
        out = []
        for doc_id, a, b in zip(block["doc_ids"], bounds[:-1], bounds[1:]):
            own = gone[a:b]
            kept = data[a:b][~own].tobytes()
            spans = int(own[:1].sum() + (own[1:] & ~own[:-1]).sum())
            out.append({"doc_id": doc_id, "n_bytes": int(b - a), "n_removed": int(own.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
        return _table(out, schema)

    return stored.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, schema)
