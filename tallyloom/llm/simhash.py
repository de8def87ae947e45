"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into so few segments that two fingerprints within
``max_bits`` differ by at most one bit in one of them: with s segments and
2 s > max_bits, one segment holds at most one of the differing bits. Every
segment is indexed by its variants with one bit deleted; fingerprints that
share a variant are verified on all 64 bits.

Links are needed for components only, so a bucket of near copies is not
expanded into all pairs: its members are verified against two pivots first,
components are formed, and only members that are still outside the first
pivot's component meet the rest of their bucket.

Defined results: a null or empty text has fingerprint zero and links like any
other; equal texts share a fingerprint; a null doc_id takes part but never names
a component; repeated rows stay rows; an empty table gives no rows. Only the id
and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.components import components
from tallyloom.llm.tables import bit_array, has_bit
from tallyloom.llm.text import lowered_words, rows
from tallyloom.scratch import materialise

BITS, SEED = 64, 42
FILTER_LOG2 = 20
PIECE = 1 << 16  # shingles whose bits are unpacked at once


def fingerprint(text: str | None, shingle: int) -> int:
    """64 bits: one where more than half of the shingle hashes have a one."""
    words = lowered_words(text)
    if not words:
        return 0
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :])), "<u8", last)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, last, PIECE):
        ones += np.unpackbits(hashes[k : k + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", keys: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), and ``keys``, further columns of longs."""
    keys = keys or {}
    names = tuple(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, shingle) for (t,) in rows([batch], ("text",))]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(np.array(prints, np.uint64).view(np.int64)), **{k: batch.column(k) for k in names}})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(k) for k, c in keys.items()])
    return picked.mapInArrow(run, "doc_id bigint, fp bigint" + "".join(f", {k} bigint" for k in names))


def _masks(max_bits: int) -> list[tuple[int, int]]:
    """For every bit: the bit, and the other bits of its segment as a signed long."""
    segments = max_bits // 2 + 1
    cuts = [BITS * k // segments for k in range(segments + 1)]
    masks = []
    for low, high in zip(cuts, cuts[1:]):
        whole = (1 << high) - (1 << low)
        masks += [(bit, whole & ~(1 << bit)) for bit in range(low, high)]
    return [(bit, mask - (1 << 64) if mask >> 63 else mask) for bit, mask in masks]


def _near(x: str, y: str, max_bits: int):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= max_bits


def near_components(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``fp``, ``root`` for every fingerprint that has a neighbour within ``max_bits``; ``prints`` has distinct ``fp``."""
    variants = F.array(*[F.struct(F.lit(bit).alias("bit"), F.col("fp").bitwiseAND(F.lit(mask)).alias("rest")) for bit, mask in _masks(max_bits)])
    indexed = prints.select("fp", F.inline(variants))
    counted = indexed.groupBy("bit", "rest").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high"))
    buckets = materialise(counted.filter((F.col("n") > 2) | (F.col("n") == 2) & _near("low", "high", max_bits)), "simhash-buckets")
    pairs = buckets.filter("n = 2").select(F.col("high").alias("a"), F.col("low").alias("b"))
    larger = buckets.filter("n > 2")
    # A filter of fixed size spares most variants the shuffle; the join that follows is exact whatever it lets through.
    place = F.xxhash64("bit", "rest").bitwiseAND((1 << FILTER_LOG2) - 1)
    likely = indexed.filter(has_bit(bit_array(larger.select(place.alias("position")), FILTER_LOG2), place))
    members = materialise(likely.join(larger, ["bit", "rest"]), "simhash-members")
    to_low = members.filter((F.col("fp") != F.col("low")) & _near("fp", "low", max_bits)).select(F.col("fp").alias("a"), F.col("low").alias("b"))
    to_high = members.filter((F.col("fp") != F.col("high")) & _near("fp", "high", max_bits)).select(F.col("fp").alias("a"), F.col("high").alias("b"))
    first = materialise(components(pairs.union(to_low).union(to_high)), "simhash-first")

    # A bucket of two is one pair. In larger ones, whoever is not with the first pivot meets the others of other components.
    known = first.withColumnRenamed("node", "fp")
    crowded = members.select("bit", "rest", "fp", "low").join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    leaders = known.select(F.col("fp").alias("low"), F.col("root").alias("low_root"))
    placed = materialise(crowded.join(leaders, "low", "left").withColumn("low_root", F.coalesce("low_root", "low")), "simhash-placed")
    apart = placed.filter("root <> low_root").select("bit", "rest", F.col("fp").alias("x"), F.col("root").alias("a"))
    others = placed.select("bit", "rest", F.col("fp").alias("y"), F.col("root").alias("b"))
    late = apart.join(others, ["bit", "rest"]).filter((F.col("a") != F.col("b")) & _near("x", "y", max_bits)).select("a", "b").distinct()
    joined = materialise(components(late), "simhash-late")
    renamed = joined.select(F.col("node").alias("root"), F.col("root").alias("last"))
    rooted = first.select(F.col("node").alias("fp"), "root").join(renamed, "root", "left").select("fp", F.coalesce("last", "root").alias("root"))
    alone = joined.join(first.select("node"), "node", "left_anti").select(F.col("node").alias("fp"), "root")
    return rooted.union(alone)


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, itself included)."""
    prints = materialise(fingerprints(docs, shingle, id_col, text_col), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    of_print = materialise(_named(distinct, max_bits).withColumnRenamed("first", "component_id"), "simhash-named")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def _named(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``fp`` and the smallest ``first`` of its component; ``distinct`` (stored) has one row per fingerprint."""
    linked = materialise(near_components(distinct.select("fp"), max_bits), "simhash-linked")
    rooted = distinct.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(named, "root").select("fp", "first")


SUSPECT_LOG2 = 26


def representatives(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One whole row of ``docs`` per component: the smallest doc_id (null ids last), then an arbitrary but fixed one.

    Rows are told apart by 128 bits of a hash of all their columns, so null and
    repeated ids lose nothing, and of rows that are equal throughout one stays.
    Texts do not move: a bit table of bounded size (2 ** 20 words, so small
    enough for every task) marks the rows that may have to go, and only these
    are shuffled to meet the exact list. Whatever the table marks by mistake
    stays. Columns of map type cannot be hashed and raise.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = {"k1": F.xxhash64(*columns), "k2": F.xxhash64(F.lit(1), *columns)}
    prints = fingerprints(docs, shingle, id_col, text_col, keys)
    rows_ = materialise(prints.groupBy("k1", "k2").agg(F.first("fp").alias("fp"), F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    distinct = materialise(rows_.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    of_print = materialise(_named(distinct, max_bits).select("fp", F.col("first.k1").alias("w1"), F.col("first.k2").alias("w2")), "simhash-named")
    goes = (F.col("k1") != F.col("w1")) | (F.col("k2") != F.col("w2"))
    listed = materialise(rows_.join(of_print, "fp").select("k1", "k2", goes.alias("goes"), "n").filter("goes or n > 1"), "simhash-listed")

    place = F.col("k1").bitwiseAND((1 << SUSPECT_LOG2) - 1)
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    marks = materialise(listed.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")), "simhash-marks")
    keyed = docs.select(F.struct(*columns).alias("row"), *[c.alias(k) for k, c in keys.items()])
    looked = keyed.withColumn("word", word).join(F.broadcast(marks), "word", "left")
    suspect = F.coalesce(F.col("bits"), F.lit(0)).bitwiseAND(bit) != 0
    clear = looked.filter(~suspect).select("row.*")
    checked = looked.filter(suspect).select("row", "k1", "k2").join(listed.select("k1", "k2", "goes"), ["k1", "k2"], "left")
    staying = checked.filter("goes is null or not goes").dropDuplicates(["k1", "k2"]).select("row.*")
    return clear.union(staying)
