"""Small tables of a fixed size as arrays that expressions can look into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_array(entries: DataFrame, size: int, kind: str) -> Column:
    """``entries`` (i from 0, v) as one constant array of ``size`` values, zero where there is no entry.

    The driver sees at most ``size`` rows, a number that the caller fixes. The
    values travel as one text that Spark folds into a constant (higher-order
    functions take constants, not subqueries).
    """
    values = ["0"] * size
    for i, v in entries.select("i", F.col("v").cast("string")).collect():
        values[i] = v
    return F.split(F.lit(",".join(values)), ",").cast(f"array<{kind}>")


def bit_array(positions: DataFrame, log2: int) -> Column:
    """A set of positions (column ``position``, below 2 ** log2) as an array of 64-bit words."""
    words = positions.groupBy(F.shiftright("position", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(position & 63 as int))")).alias("v"))
    return dense_array(words, 1 << (log2 - 6), "bigint")


def has_bit(bits: Column, position: Column) -> Column:
    word = F.element_at(bits, (F.shiftright(position, 6) + 1).cast("int"))
    return F.call_function("shiftrightunsigned", word, position.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
