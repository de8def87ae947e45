"""I-Match fingerprints with DataFrame functions only.

A term is kept if its inverse document frequency lies in a band, and the
distinct kept terms are sorted. Several randomised subsets of the lexicon each
give one hash of the sorted kept terms that are in the subset; subsets come in
three densities, so that short and long texts both have subsets with a few
terms. The likeness of two fingerprints is the share of equal hashes among the
subsets that hold a term of either text.

Document frequencies are counted over all documents on 2 ** ``LOG2`` hashed
terms, so the lexicon has a fixed size (a bit per hashed term) whatever the
corpus. Terms far below the band that share a place with each other stay below
it, because the band is relative to the number of documents.

The next document in descending id is found with one shuffle of the texts: ids
are cut into ranges at quantiles, the head of each range is also sent to the
range above, and a window looks inside a range.

Defined results: a null text is empty; an empty text has an empty lexicon part
and its fingerprint is all zeros; two fingerprints without any term are alike
(1) if both are; rows with one id follow each other by text; null ids come
last; a single document is its own next one; an empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.llm.tables import bit_array, has_bit
from tallyloom.scratch import materialise

LOG2, DRAWS, DENSITIES, BUCKETS = 18, 10, (3, 5, 7), 256


def places(text: Column) -> Column:
    """Places of the distinct terms of a text: words of letters and digits in lower case."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w).bitwiseAND((1 << LOG2) - 1)))


def lexicon(docs: DataFrame, low: float, high: float) -> Column:
    """Places whose share of documents lies in the band, as bits; counted over all documents."""
    terms = docs.select(F.explode(places(F.col("text"))).alias("position"))
    counts = materialise(terms.groupBy("position").agg(F.count(F.lit(1)).alias("n")), "imatch-df")
    total = docs.count()
    return bit_array(counts.filter(F.col("n").between(max(2, low * total), max(2, high * total))), LOG2)


def fingerprint(text: Column, bits: Column) -> Column:
    """One 32-bit hash per subset, zero where the subset has no term of the text."""
    kept = F.array_sort(F.filter(places(text), lambda t: has_bit(bits, t)))
    # Terms move to spread-out 64-bit numbers, whose bit groups decide the subsets they are in.
    spread = F.transform(kept, lambda t: F.xxhash64(t, F.lit("subset")))
    subsets = [(draw, density) for draw in range(DRAWS) for density in DENSITIES]

    def part(terms: Column, draw: int, density: int) -> Column:
        inside = F.filter(terms, lambda t: F.shiftright(t, 5 * draw).bitwiseAND((1 << density) - 1) == 0)
        return F.when(F.size(inside) > 0, F.greatest(F.xxhash64(inside).bitwiseAND(0xFFFFFFFF), F.lit(1))).otherwise(F.lit(0))

    return F.transform(F.array(spread), lambda terms: F.array(*[part(terms, *s) for s in subsets]))[0]


def likeness(a: Column, b: Column) -> Column:
    used = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x != 0) & (x == y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(used > 0, same / used).otherwise(F.lit(1.0))


def id_ranges(rows: DataFrame, ranges: int) -> Column:
    """Number of the range of ids a row falls in, rising with the id; -1 for null ids.

    Ids are cut at quantiles first, so that ids far away from the others do not stretch the ranges, and evenly between them.
    """
    quantiles = [q / BUCKETS for q in range(BUCKETS + 1)]
    edges = sorted(set(rows.agg(F.percentile_approx("doc_id", quantiles, 100 * BUCKETS)).first()[0] or [0]))
    inside = -(-ranges // len(edges))
    # Ids may span all 64 bits, their differences more.
    number = lambda c: c.cast("decimal(20,0)")
    lows, highs = (F.array(*[F.lit(e).cast("long") for e in x]) for x in (edges, edges[1:] + edges[-1:]))
    at = F.greatest(F.size(F.filter(lows, lambda e: e <= F.col("doc_id"))), F.lit(1))
    width = F.floor((number(F.get(highs, at - 1)) - number(F.get(lows, at - 1))) / inside).cast("decimal(20,0)") + 1
    step = F.floor((number(F.col("doc_id")) - number(F.get(lows, at - 1))) / width).cast("long")
    # The least and the greatest id are exact quantiles; ids that an approximate one leaves outside go to the nearest range.
    step = F.least(F.greatest(step, F.lit(0)), F.lit(inside - 1))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(((at - 1) * inside + step).cast("int"))


def with_next(rows: DataFrame, ranges: int) -> DataFrame:
    """``rows`` (doc_id, text, ...) with ``next``: a struct of the row that follows in descending id, the first after the last."""
    carried = rows.columns
    piece = id_ranges(rows, ranges)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    heads = rows.select(piece.alias("piece"), "doc_id").groupBy("piece").agg(F.max("doc_id").alias("head"))
    # One row per range: its head is the next document of the range above, the head of all follows the last range.
    above = F.coalesce(F.lag("piece").over(W.orderBy(F.col("piece").desc())), F.min("piece").over(W.partitionBy()))
    # Stored, so that Spark knows the size before it chooses the join.
    heads = materialise(heads.select(F.col("piece").alias("head_piece"), "head", above.alias("goes_to")), "imatch-heads")
    placed = rows.withColumn("piece", piece).join(heads, (F.col("piece") == F.col("head_piece")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    copies = F.when(F.col("goes_to").isNotNull(), F.array(F.struct(F.col("piece").alias("of"), F.lit(0).alias("extra")), F.struct(F.col("goes_to").alias("of"), F.lit(1).alias("extra"))))
    copies = F.coalesce(copies, F.array(F.struct(F.col("piece").alias("of"), F.lit(0).alias("extra"))))
    dealt = placed.select(*carried, F.inline(copies))
    window = W.partitionBy("of").orderBy("extra", *order)
    linked = dealt.withColumn("next", F.lead(F.struct(*carried)).over(window))
    return linked.filter("extra = 0").select(*carried, "next")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = 0.0005, high: float = 0.05, range_rows: int = 4096) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The edited text has its last half replaced by the beginning of the next document.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    bits = lexicon(texts, low, high)
    printed = texts.withColumn("print", fingerprint(F.col("text"), bits))
    linked = with_next(printed, max(1, texts.count() // range_rows))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.char_length("text") - half), F.substring(F.col("next.text"), F.lit(1), half))
    both = linked.select("doc_id", "text", "print", edited.alias("edited"), F.col("next.print").alias("next_print"))
    both = both.withColumn("edited_print", fingerprint(F.col("edited"), bits))
    written = lambda p: F.array_join(F.transform(p, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return both.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("print")).alias("fingerprint"), written(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
