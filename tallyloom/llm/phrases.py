"""Phrase mining by Toivonen's method: a sample proposes, full passes decide.

Phrases are contiguous words inside a piece of a text, so a frequent phrase has
a frequent head (without its last word) and tail (without its first). A sample
of the documents, counted against a lowered threshold, proposes the frequent
phrases. A full pass counts these and their negative border exactly: everything
whose head and tail are proposed, proposed itself or not. A border phrase that
turns out frequent is a failure of the sample; it is added, and a further pass
counts what this admits, until nothing is missing. Counts are exact whatever
the sample holds; a bad sample only costs passes.

The proposed set travels as a Bloom filter of bounded size. What it lets
through by mistake is counted too, and exactly, so it costs time and never a
result.

Tasks cut blocks of text with byte classes in numpy, number the words of the
block and count pairs and triples of numbers; what is shuffled is one row per
phrase and block, and partial sums again. Frequent words meet their phrases in
joins that Spark splits where a word is hot.

Defined results: null and empty texts have no words; a null language is
``und`` and shares the counts of that name; a null doc_id counts like any
other; repeated rows count again; an empty table gives no rows. Only the id,
language and text columns are read. A piece never spans two documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.llm.text import rows
from tallyloom.scratch import materialise

LONGEST = 3
BLOCK_BYTES = 1 << 19
PROBES = 3
LEAST_BITS, MOST_BITS = 16, 28  # logarithms: the filter has 8 KiB to 32 MiB

# Byte classes: parts of words, blanks between words, ends of pieces.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2

_FIRST, _NEXT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _scattered(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(33))) * _STEP
    return keys ^ (keys >> np.uint64(29))


def joined_key(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of a phrase from the key of its head and that of its last word."""
    return _scattered(left * _FIRST + word * _NEXT)


def word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def phrase_keys(lang: str, phrases: list[str]) -> np.ndarray:
    """Keys of phrases given as words joined by blanks."""
    split = [p.encode().split(b" ") for p in phrases]
    known = {w: k for k, w in enumerate({w for words in split for w in words})}
    keys = word_keys(lang, list(known))
    found = np.array([keys[known[w[0]]] for w in split], np.uint64)
    for at in range(1, LONGEST):
        longer = [k for k, w in enumerate(split) if len(w) > at]
        found[longer] = joined_key(found[longer], np.array([keys[known[split[k][at]]] for k in longer], np.uint64))
    return found


def places(keys: np.ndarray, log2: int) -> np.ndarray:
    """The bits of a key in a filter of 2 ** log2 bits, one row per probe."""
    step = (_scattered(keys + _FIRST)) | np.uint64(1)
    return np.stack([((keys + np.uint64(k) * step) >> np.uint64(64 - log2)).astype(np.int64) for k in range(PROBES)])


class Proposed:
    """A set of phrases as a Bloom filter: ``words`` has 64 bits each."""

    def __init__(self, words: np.ndarray):
        self.words, self.log2 = words, int(len(words) * 64).bit_length() - 1

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in places(keys, self.log2):
            found &= (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return found


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of every word occurrence, and the number of its piece."""
    data = b"\n".join(texts).lower()
    codes = np.frombuffer(data, np.uint8)
    kind = _KIND[codes]
    inside = kind == 0
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(codes[inside])])
    numbered = packed.dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(starts) else np.zeros(0, np.int32)
    return numbered.dictionary, numbered.indices.to_numpy().astype(np.int64), piece


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, their number in order of ``keys``, and how often each occurs."""
    coded = pa.array(keys).dictionary_encode()
    numbers = coded.indices.to_numpy().astype(np.int64)
    return coded.dictionary.to_numpy(), numbers, np.bincount(numbers, minlength=len(coded.dictionary))


def block_counts(lang: str, texts: list[bytes], proposed: Proposed | None, before: Proposed | None, first: bool) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Length, phrases and counts of one block.

    A phrase of two or three words is counted if head and tail are in ``proposed``,
    unless the pass with ``before`` has counted it; without ``proposed`` all are.
    Words are counted if ``first``.
    """
    words, at, piece = words_of(texts)
    if not len(at):
        return
    if first:
        yield 1, words.cast(pa.large_string()), np.bincount(at, minlength=len(words))
    keys = word_keys(lang, words.to_pylist()) if proposed is not None else np.zeros(len(words), np.uint64)
    # Phrases of the last length: number of each occurrence, where it starts, and the keys of the distinct ones.
    number, start, distinct = at, np.arange(len(at)), keys
    # What an earlier pass has counted: a phrase whose head and tail it counted and held.
    seen = np.full(len(words), before is not None)
    parts = [np.arange(len(words))]
    for length in range(2, LONGEST + 1):
        longer = np.flatnonzero((start + length - 1 < len(at)) & (piece[np.minimum(start + length - 1, len(at) - 1)] == piece[start]))
        # The tail of an occurrence is the phrase of the last length that starts one word later.
        follows = np.full(len(at) + 1, -1, np.int64)
        follows[start] = number
        head, tail = number[longer], follows[start[longer] + 1]
        present = tail >= 0
        longer, head, tail = longer[present], head[present], tail[present]
        if proposed is not None:
            held = proposed.holds(distinct)
            kept = held[head] & held[tail]
            old = seen & before.holds(distinct) if before is not None else seen
            longer, head, tail = longer[kept], head[kept], tail[kept]
        last = at[start[longer] + length - 1]
        found, number, counts = _counted(head * len(words) + last)
        start = start[longer]
        heads, lasts = found // len(words), found % len(words)
        tails = np.zeros(len(found), np.int64)
        tails[number] = tail
        parts = [p[heads] for p in parts] + [lasts]
        fresh = np.ones(len(found), bool)
        if proposed is not None:
            seen = old[heads] & old[tails]
            fresh = ~seen
            distinct = joined_key(distinct[heads], keys[lasts])
        if fresh.any():
            spelled = pc.binary_join_element_wise(*[words.take(pa.array(p[fresh])).cast(pa.large_string()) for p in parts], pa.scalar(" ", pa.large_string()))
            yield length, spelled, counts[fresh]


def counted(docs: DataFrame, proposed: Proposed | None = None, before: Proposed | None = None, first: bool = True) -> DataFrame:
    """length, lang, phrase, f over all of ``docs`` (lang, text), for the phrases that ``block_counts`` names."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((proposed.words if proposed else None, before.words if before else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, old = (None if w is None else Proposed(w) for w in sent.value)
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def flushed(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for length, phrases, counts in block_counts(lang, held.pop(lang), now, old, first):
                n = len(phrases)
                for low in range(0, n, 20_000):
                    part = phrases.slice(low, 20_000)
                    columns = [pa.array(np.full(len(part), length, np.int32)), pa.array([lang]).take(pa.array(np.zeros(len(part), np.int64))), part.cast(pa.string())]
                    yield pa.record_batch([*columns, pa.array(counts[low : low + 20_000], pa.int64())], names=["length", "lang", "phrase", "f"])

        for lang, text in rows(batches, ("lang", "text")):
            data = text.encode()
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data)
            if sizes[lang] >= BLOCK_BYTES:
                yield from flushed(lang)
            elif sum(sizes.values()) >= 4 * BLOCK_BYTES:  # many small languages
                yield from flushed(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flushed(lang)

    per_block = docs.select("lang", "text").mapInArrow(run, "length int, lang string, phrase string, f bigint")
    return per_block.groupBy("length", "lang", "phrase").agg(F.sum("f").alias("f"))


def filter_bits(phrases: DataFrame, log2: int) -> np.ndarray:
    """The filter of ``phrases`` (lang, phrase) as 2 ** (log2 - 6) words of 64 bits; the driver sees words that are not zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, phrase in rows([batch], ("lang", "phrase")):
                by_lang.setdefault(lang, []).append(phrase)
            at = np.concatenate([places(phrase_keys(lang, found), log2).ravel() for lang, found in by_lang.items()] or [np.zeros(0, np.int64)])
            at = np.unique(at)
            word, first = np.unique(at >> 6, return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first)
                yield pa.record_batch({"word": pa.array(word), "bits": pa.array(bits.view(np.int64))})

    found = phrases.select("lang", "phrase").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (log2 - 6), np.uint64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words


def absent(frequent: DataFrame, proposed: Proposed) -> DataFrame:
    """The rows of ``frequent`` (length, lang, phrase, f) that the proposed set lacks."""
    sent = frequent.sparkSession.sparkContext.broadcast(proposed.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Proposed(sent.value)
        for batch in batches:
            langs, phrases = batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()
            lacks = np.zeros(len(langs), bool)
            for lang in set(langs):
                at = [k for k, x in enumerate(langs) if x == lang]
                lacks[at] = ~known.holds(phrase_keys(lang, [phrases[k] for k in at]))
            yield batch.filter(pa.array(lacks))

    return frequent.select("length", "lang", "phrase", "f").mapInArrow(run, "length int, lang string, phrase string, f bigint")


def texts_of(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def frequencies(docs: DataFrame, least: int = 10, share: float = 0.125, lowered: int = 2) -> tuple[DataFrame, int]:
    """Stored length, lang, phrase, f of all words and of every phrase of two or three words with f >= ``least``, and the number of full passes.

    ``docs``: id, lang, text. The sample holds the ids whose hash is in the
    ``share``; a phrase is proposed from ``lowered`` occurrences in it on.
    """
    wide = 1 << 40
    sample = docs.filter(F.pmod(F.xxhash64("id"), F.lit(wide)) < int(wide * share))
    found = materialise(counted(sample).filter((F.col("f") >= lowered) & (F.col("length") < LONGEST)), "phrases-proposed")
    log2 = min(MOST_BITS, max(LEAST_BITS, int(16 * found.count()).bit_length()))
    proposed, before, passes = Proposed(filter_bits(found, log2)), None, 0
    known = None
    while True:
        passes += 1
        counts = counted(docs, proposed, before, first=before is None)
        new = materialise(counts.filter((F.col("length") == 1) | (F.col("f") >= least)), "phrases-counted")
        known = new if known is None else known.unionByName(new)
        missing = materialise(absent(known.filter((F.col("f") >= least) & (F.col("length") < LONGEST)), proposed), "phrases-missing")
        if missing.isEmpty():
            return known, passes
        before, proposed = proposed, Proposed(proposed.words | filter_bits(missing, log2))


def score(a, l, r):
    """floor(1000000 a a / (l r)), exact beyond 64 bits."""
    a, l, r = (c.cast("decimal(19,0)") for c in (a, l, r))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, l * r)


def _words(phrase: str, low, length):
    return F.array_join(F.slice(F.split(phrase, " "), low, length), " ")


def collocations(known: DataFrame, least: int = 10, covered: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one covers with ``covered`` percent of their occurrences.

    ``known`` as from ``frequencies``. Every cut of a candidate meets the counts
    of both parts; the lowest score counts, then the smallest cut.
    """
    frequent = known.filter(F.col("f") >= least)
    parts = materialise(frequent.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part")), "phrases-parts")
    candidates = frequent.filter("length > 1").select("length", "lang", "phrase", F.col("f").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _words("phrase", 1, F.col("k")).alias("part"), _words("phrase", F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    left = cuts.join(parts, ["lang", "part"]).select("lang", "phrase", "a", "k", F.col("of_part").alias("l"), F.col("rest").alias("part"))
    both = left.join(parts, ["lang", "part"]).withColumnRenamed("of_part", "r")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    inner = candidates.filter("length > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    inner = inner.withColumn("low", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
    inner = inner.groupBy("lang", _words("phrase", F.col("low"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    open_ = lowest.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered))
    return open_.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def best(scored: DataFrame, top: int = 2000, spread: int = 32) -> DataFrame:
    """The first ``top`` of every language with their rank; groups of a language are cut first, so its last task sees ``spread * top`` rows."""
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    group = F.pmod(F.xxhash64("phrase"), F.lit(spread))
    near = scored.withColumn("group", group).withColumn("place", F.row_number().over(W.partitionBy("lang", "group").orderBy(*order))).filter(F.col("place") <= top)
    return near.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top).drop("group", "place")


def mined(
    docs: DataFrame, top: int = 2000, least: int = 10, covered: int = 50, share: float = 0.125, lowered: int = 2,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    known, _ = frequencies(texts_of(docs, id_col, text_col, lang_col), least, share, lowered)
    totals = materialise(known.filter("length = 1").groupBy("lang").agg(F.sum("f").alias("n")), "phrases-totals")
    return best(collocations(known, least, covered), top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
