"""Column expressions shared by the jobs. All are built from JVM-side functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucketise(value: Column | str, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the first bound the value lies below; the last label takes the rest, nulls included."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("need one label more than bounds")
    value = as_column(value)
    chain = F.when(value < bounds[0], labels[0])
    for bound, label in zip(bounds[1:], labels[1:]):
        chain = chain.when(value < bound, label)
    return chain.otherwise(labels[-1])


def two_way(condition: Column, yes: str, no: str) -> Column:
    """``yes`` where the condition holds, ``no`` where it is false or unknown."""
    return F.when(condition, yes).otherwise(no)


def total(*columns: Column | str) -> Column:
    """Left-to-right sum of columns; null if any is null."""
    result = as_column(columns[0])
    for c in columns[1:]:
        result = result + as_column(c)
    return result


def day(value: Column | str, strict: bool = True) -> Column:
    """Date of a ``y-m-d`` string, padded or not. ``strict=False`` gives null for bad input."""
    return F.to_date(as_column(value)) if strict else as_column(value).try_cast("date")


def label_with(prefix: str, value: Column | str) -> Column:
    return F.concat(F.lit(prefix), as_column(value).cast("string"))


# --- repeatable pseudo-random values --------------------------------------
# Each value depends only on a key and a salt, never on the partitioning, so a
# retried task or another cluster size gives the same table.


# The hash needs only whole-number arithmetic below 2^63, so any SQL engine can
# state it and give the same values, row by row.

MODULUS = 2**31 - 1
ROUNDS = [(13, 1597334677), (15, 1812433253)]


def spread_sql(key: str, salt: int | str) -> str:
    """SQL text of the hash before its mixing rounds; the salt is a number or the SQL text of one."""
    if isinstance(salt, int):
        offset = str((salt * 1103515245 + 12345) % MODULUS)
    else:
        offset = f"(CAST({salt} AS bigint) * 1103515245 + 12345) % {MODULUS}"
    wide = f"CAST({key} AS bigint)"
    return f"(({wide} & {MODULUS}) * 48271 + (shiftright({wide}, 31) % {MODULUS} + {MODULUS}) * 40692 + {offset}) % {MODULUS}"


def round_sql(x: str, shift: int, factor: int) -> str:
    return f"(({x}) ^ shiftright({x}, {shift})) * {factor} % {MODULUS}"


def uniform_sql(key: str, salt: int | str) -> str:
    """SQL text of a double in [0, 1) made from a 31-bit hash of the whole-number key column and the salt."""
    x = spread_sql(key, salt)
    for shift, factor in ROUNDS:
        x = round_sql(x, shift, factor)
    return f"(({x}) / {MODULUS}.0D)"


def uniform(key: str, salt: int) -> Column:
    return F.expr(uniform_sql(key, salt))


def uniform_int(key: str, salt: int, low: int, high: int) -> Column:
    """Whole number in low..high, both included."""
    return F.expr(f"CAST({low} + floor({uniform_sql(key, salt)} * {high - low + 1}) AS int)")


def uniform_real(key: str, salt: int, low: float, high: float) -> Column:
    return F.expr(f"{float(low)!r}D + {uniform_sql(key, salt)} * {float(high - low)!r}D")


def normal(key: str, salt: int) -> Column:
    """Standard normal value by the Box-Muller transform of two hashed uniforms."""
    radius = F.expr(f"sqrt(-2.0D * ln(1.0D - {uniform_sql(key, salt)}))")
    return radius * F.cos(uniform(key, salt + 1_000_003) * 6.283185307179586)


def bernoulli(key: str, salt: int, p: float = 0.5) -> Column:
    return (uniform(key, salt) < p).cast("int")


def choice(key: str, salt: int, values: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    """One of ``values``; equal odds unless weights are given."""
    if weights is None:
        return F.get(F.array(*[F.lit(v) for v in values]), uniform_int(key, salt, 0, len(values) - 1))
    u, whole, upto = uniform(key, salt), float(sum(weights)), 0.0
    chain = F
    for value, weight in zip(values[:-1], weights[:-1]):
        upto += weight / whole
        chain = chain.when(u < upto, value)
    return chain.otherwise(values[-1])
