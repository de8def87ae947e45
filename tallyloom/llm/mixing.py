"""Mixing sources to target weights, with DataFrame functions only.

The words of every source are summed, each source gets a target, and the
repetition rate of a source is target / words. A document is taken floor(rate)
times, and once more with a probability equal to the fraction, decided by a
hash of its id: reruns agree, whatever the partitioning.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own and comes last; rows with one id share one
decision; an empty table gives an empty result. Columns of the input other
than id, text and source pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyloom.scratch import materialise

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source, source_size, target.

    Targets are in proportion to the weights unless a source stops at ``cap``
    times its size; then the rest is shared again. The fixed point of that
    resharing is found in one pass: sources in order of cap / weight are
    stopped one after the other, and the first one that its share does not
    exceed tells the words per weight of all that follow. The windows run over
    one row per source, not over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    limit = F.lit(cap) * F.col("source_size")
    everyone = W.partitionBy()
    before = W.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    nothing = F.lit(0.0)
    shared = (
        totals.withColumn("weight", weight.cast("double")).withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("budget", F.lit(share) * F.sum("source_size").over(everyone))
        .withColumn("stopped", F.coalesce(F.sum("limit").over(before), nothing))
        .withColumn("left", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), nothing))
        .withColumn("per_weight", (F.col("budget") - F.col("stopped")) / F.col("left"))
        .withColumn("level", F.min(F.when(F.col("per_weight") <= F.col("ratio"), F.struct("ratio", "per_weight"))).over(everyone)["per_weight"])
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return shared.select("source", "source_size", target.alias("target"))


def rates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """doc_id, size, source_size, target, copies: one row per row of ``docs``.

    The source table is stored first, so Spark knows its true size and sends it
    to the documents if it is small, and joins by shuffle with splitting of hot
    sources if it is not.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sources = materialise(source_targets(sized, weights, share, cap), "mix-sources").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (uniform(seed, F.col("doc_id")) < rate - F.floor(rate)).cast("long")
    return sized.join(sources, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "doc_id", "size", "source_size", "target", (F.floor(rate) + extra).alias("copies")
    )


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it; the columns stay."""
    weights, share, cap = options.get("weights", (5, 2, 1)), options.get("share", 1.5), options.get("cap", 2.0)
    sized = docs.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sources = materialise(source_targets(sized, weights, share, cap), "mix-sources")
    plan = sources.select(
        F.col("source").alias("_mix_of"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("_mix_rate"),
    )
    rate = F.col("_mix_rate")
    extra = (uniform(options.get("seed", "mix"), F.col(id_col)) < rate - F.floor(rate)).cast("long")
    copies = F.when(word_count(F.col(text_col)) > 0, F.floor(rate) + extra).otherwise(F.lit(0))
    kept = docs.join(plan, F.col(source_col).eqNullSafe(F.col("_mix_of")), "left").withColumn("_mix_copies", copies.cast("int"))
    repeated = kept.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).filter("_mix_copies > 0")
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
