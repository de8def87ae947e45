"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation works on arrays. A table maps code points to four classes
(letter, number, white space, other). Read from left to right, each character's
transition function either opens a token or stays in the open one; such
functions compose to "the last one that opened", so the token of every
character is a running maximum over the opening positions - an associative scan
- and every opening is decided by the classes of a character and its neighbours:

* a non-space opens unless the class stays the same or a plain space before it
  already opened its token;
* white space opens at the start of its run, and again at the run's last
  character if text follows;
* an apostrophe that opens a token and is followed by s, t, m, d, re, ve or ll
  takes these letters, and the next character opens.

The slices between openings go through a bounded cache of merged pieces. Token
lengths give the byte offset of each token, and decoding copies every token's
bytes to its offset.

Defined results: null and empty texts have no tokens and decode to nothing;
repeated rows stay rows; an empty table gives no rows; only the id and text
columns are read. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.text import rows

OTHER, LETTER, NUMBER, SPACE = range(4)
CACHED_PIECES, CACHED_CHARS = 150_000, 64
LONG_PIECE = 48
NO_PAIR = 1 << 30
GROUP_BYTES = 4 << 20

_classes: np.ndarray | None = None


def class_table() -> np.ndarray:
    """Class of every code point, built once per process from the Unicode properties."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        everything = "".join(map(chr, range(0x110000)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for run in regex.finditer(pattern, everything):
                table[run.start() : run.end()] = kind
        _classes = table
    return _classes


def openings(text: str) -> np.ndarray:
    """True for every code point of a text (not empty) that opens a token."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = class_table()[points]
    space = kind == SPACE
    opens = np.ones(len(points), bool)
    opens[1:] = np.where(space[1:], ~space[:-1], (kind[1:] != kind[:-1]) & (points[:-1] != 32))
    opens[:-1] |= space[:-1] & ~space[1:]
    marks = np.flatnonzero((points == 39) & opens)
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        one, two = padded[marks + 1], padded[marks + 2]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        taken, size = marks[short | long], np.where(short, 2, 3)[short | long]
        opens[taken + 1] = False
        after = taken + size
        opens[after[after < len(points)]] = True
    return opens


def pieces(text: str) -> list[str]:
    if not text:
        return []
    cuts = np.flatnonzero(openings(text)).tolist()
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the pair with the lowest rank is joined first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > LONG_PIECE:
        return _merge_long(parts, ranks)
    worst = len(ranks) + 1
    pairs = [ranks.get(a + b, worst) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = min(pairs)
        if best == worst:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], worst)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], worst)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs over a linked list, for pieces of any length."""
    n = len(parts)
    alive, following, leading = [True] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and following[i] < n:
            r = ranks.get(parts[i] + parts[following[i]])
            if r is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[following[i]]))

    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = following[i]
        if not alive[i] or j >= n or parts[i] is not left or parts[j] is not right:
            continue
        parts[i] = left + right
        alive[j] = False
        following[i] = following[j]
        if following[i] < n:
            leading[following[i]] = i
        offer(leading[i])
        offer(i)
    return [ranks[p] for p, a in zip(parts, alive) if a]


class PairTable:
    """Every joinable pair of token ids with the id it becomes, for lookups of whole arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int32)

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_PAIR where it does not join. Padding is negative."""
        if not len(self.keys):
            return np.full(left.shape, NO_PAIR, np.int32)
        key = np.where(right < 0, -1, left.astype(np.int64) << 32 | right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], np.int32(NO_PAIR))


def merge_many(found: Sequence[bytes], table: PairTable, byte_ids: np.ndarray) -> list[bytes]:
    """Packed ids of many short pieces: each round joins the best pair of every piece at once."""
    lengths = np.array([len(p) for p in found])
    width = int(lengths.max())
    ids = np.full((len(found), width + 1), -1, np.int32)
    inside = np.arange(width) < lengths[:, None]
    ids[:, :-1][inside] = byte_ids[np.frombuffer(b"".join(found), np.uint8)]
    best = table.joined(ids[:, :-1], ids[:, 1:])
    open_rows, columns = np.arange(len(found)), np.arange(width)
    while len(open_rows):
        at = best[open_rows].argmin(axis=1)
        rank = best[open_rows, at]
        going = rank < NO_PAIR
        open_rows, at, rank = open_rows[going], at[going], rank[going]
        if not len(open_rows):
            break
        shift = columns + (columns > at[:, None])  # drop the right half of the pair
        row = np.take_along_axis(ids[open_rows], np.concatenate([shift, np.full((len(shift), 1), width)], axis=1), axis=1)
        pair = np.take_along_axis(best[open_rows], np.minimum(columns + (columns >= at[:, None]), width - 1), axis=1)
        k = np.arange(len(open_rows))
        row[k, at] = rank
        pair[:, -1] = NO_PAIR
        pair[k, at] = table.joined(rank, row[k, at + 1])
        before = np.maximum(at - 1, 0)
        pair[k, before] = np.where(at > 0, table.joined(row[k, before], rank), pair[k, before])
        ids[open_rows], best[open_rows] = row, pair
    kept = ids[:, :-1] >= 0
    packed, ends = ids[:, :-1][kept].astype("<u4").tobytes(), (np.cumsum(kept.sum(axis=1)) * 4).tolist()
    return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Merged(dict):
    """Pieces met so far with their ids as little-endian 32-bit numbers, in two generations of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.table, self.older = ranks, PairTable(ranks), {}
        self.single = {token: struct.pack("<I", rank) for token, rank in ranks.items()}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def __missing__(self, piece: str) -> bytes:  # long pieces, which are not kept
        return np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()

    def learn(self, wanted: set[str]) -> None:
        """Make the short pieces of ``wanted`` known, all new ones together."""
        if len(self) > CACHED_PIECES:
            self.older = dict(self)
            self.clear()
        fresh: dict[int, list[tuple[str, bytes]]] = {}
        older, single = self.older, self.single
        for piece in wanted.difference(self):
            if piece in older:
                self[piece] = older[piece]
            elif len(piece) <= CACHED_CHARS:
                raw = piece.encode()
                if raw in single:
                    self[piece] = single[raw]
                else:
                    fresh.setdefault((len(raw) + 2) // 3, []).append((piece, raw))
        for group in fresh.values():
            for k in range(0, len(group), 1 << 13):
                part, raws = zip(*group[k : k + (1 << 13)])
                self.update(zip(part, merge_many(raws, self.table, self.byte_ids)))


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}
        self.merged = Merged(self.ranks)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        cut = [pieces(t) if t else [] for t in texts]
        self.merged.learn(set().union(*cut))
        return [b"".join(map(self.merged.__getitem__, found)) for found in cut]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token, and the number of bytes at the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, piece: int = 1 << 16) -> bytes:
        out = []
        for k in range(0, len(ids), piece):
            part = ids[k : k + piece]
            at = self.offsets(part)
            out.append(self.flat[np.arange(at[-1]) + np.repeat(self.starts[part] - at[:-1], self.lengths[part])].tobytes())
        return b"".join(out)


def groups(batch: pa.RecordBatch, most: int = GROUP_BYTES) -> Iterator[tuple[list, list]]:
    """Ids and texts of a batch, a bounded number of bytes (or one text) at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in rows([batch], ("doc_id", "text")):
        ids.append(doc_id)
        texts.append(text)
        size += len(text or "")
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def encoded(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, and with ``with_ids`` the token ids and their byte offsets.

    The rank file is read on the driver and sent to the tasks; a vocabulary has a fixed size.
    """
    with open(rank_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint"
    schema += ", ids array<int>, offsets array<bigint>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(sent.value)
        for batch in batches:
            for doc_ids, texts in groups(batch):
                out: dict[str, list] = {name.split()[0]: [] for name in schema.split(", ")}
                for doc_id, packed in zip(doc_ids, coder.encode_many(texts)):
                    ids = np.frombuffer(packed, "<u4")
                    decoded = coder.decode(ids)
                    values = [doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded)]
                    values += [ids.astype(np.int32), coder.offsets(ids)[:-1]] if with_ids else []
                    for column, value in zip(out.values(), values):
                        column.append(value)
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.record_batch({name: pa.array(column, kind) for (name, column), kind in zip(out.items(), types)})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, schema)
