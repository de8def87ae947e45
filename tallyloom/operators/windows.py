"""Running averages and their neighbours.

A window over raw rows puts a whole partition key into one task. The running
average depends on a row only through its key and its order value, so the rows
are first summed per (key, order value). Prefix sums over those sums run in two
levels: a range partitioning by (keys, order) cuts them at quantiles that Spark
samples, windows run inside the blocks, and one offset per key and block is
carried on from the blocks before. A key with very many order values is spread
over its blocks; no argument is needed for it. Row-level results come from
joining the small result back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.scratch import materialise

_FIRST, _LAST, _BLANK, _BLOCK, _SEVERAL = "_first", "_last", "_blank", "_block", "_several"


def _per_order_value(
    df: DataFrame, keys: Sequence[str], order: str, value: str, tie: Column | None = None, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    ends = [] if tie is None else [F.min(tie).alias(_FIRST), F.max(tie).alias(_LAST), F.max(tie.isNull()).alias(_BLANK)]
    ends += [F.sum(c).alias(name) for name, c in (sums or {}).items()]
    return df.groupBy(*keys, order).agg(
        F.coalesce(F.sum(value), F.lit(0)).alias("_s"),
        F.count(value).alias("_c"),
        F.count("*").alias("_rows"),
        *ends,
    )


def in_blocks(sums: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``sums`` stored with ``_block``, which never decreases with the order value of a key.

    Block limits are the limits of a range partitioning, so blocks are about
    equal whatever the keys; adaptive execution merges those of a small table.
    """
    placed = sums.repartitionByRange(*keys, order).withColumn(_BLOCK, F.spark_partition_id())
    return materialise(placed, "running-sums")


def _running(sums: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Add ``running``, ``before`` and ``after``: the running average at, before and after an order value."""
    columns = sums.columns
    sums = in_blocks(sums, keys, order)
    local_keys = [*keys, _BLOCK]
    w = Window.partitionBy(*local_keys).orderBy(order)
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = sums.select(
        "*",
        F.sum("_s").over(upto).alias("_su"),
        F.sum("_c").over(upto).alias("_cu"),
        F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_sa"),
        F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_ca"),
        F.lead(F.struct("_s", "_c")).over(w).alias("_next"),
    )
    # A block border cuts one key, so at most two rows per block belong to a key that needs an offset.
    limits = sums.groupBy(*local_keys).agg(F.sum("_s").alias("_bs"), F.sum("_c").alias("_bc"), F.min(order).alias("_low"), F.max(F.col(order).isNull()).alias("_null"))
    limits = limits.withColumn("_blocks", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("_blocks > 1")
    # The first order value of a block: a null one comes before all others.
    low = F.when(F.col("_null"), F.lit(None)).otherwise(F.col("_low"))
    heads = limits.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(local_keys)], low.alias("_hl"))
    at_head = [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(local_keys)] + [F.col(order).eqNullSafe(F.col("_hl"))]
    headed = sums.join(heads, at_head).select(*local_keys, F.struct("_s", "_c").alias("_head"))
    renamed = headed.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(local_keys)], "_head")
    limits = limits.join(renamed, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(local_keys)])
    wb = Window.partitionBy(*keys).orderBy(_BLOCK)
    behind = wb.rowsBetween(Window.unboundedPreceding, -1)
    offsets = limits.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(local_keys)],
        F.sum("_bs").over(behind).alias("_os"),
        F.sum("_bc").over(behind).alias("_oc"),
        F.lead("_head").over(wb).alias("_nexthead"),
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(local_keys)]
    carried, passed = F.coalesce("_os", F.lit(0)), F.coalesce("_oc", F.lit(0))
    local = local.join(offsets, same, "left").withColumns(
        {
            "_su": F.col("_su") + carried,
            "_cu": F.col("_cu") + passed,
            "_sa": F.col("_sa") + carried,
            "_ca": F.col("_ca") + passed,
            "_next": F.coalesce("_next", "_nexthead"),
        }
    )
    return local.select(
        *columns,
        F.try_divide("_su", "_cu").alias("running"),
        F.try_divide("_sa", "_ca").alias("before"),
        F.try_divide(F.col("_su") + F.col("_next._s"), F.col("_cu") + F.col("_next._c")).alias("after"),
    )


def _join_back(df: DataFrame, right: DataFrame, keys: Sequence[str], *results: Column) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[c for c in right.columns if c not in keys],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, same, "inner").select(*[F.col(c) for c in df.columns], *results)


def running_average(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str = "running_avg") -> DataFrame:
    """Average of all rows of the key up to the row's order value, rows with the same value included."""
    run = _running(_per_order_value(df, keys, order, value), keys, order)
    slim = run.select(*keys, order, "running")
    return _join_back(df, slim, [*keys, order], F.col("running").alias(name))


def running_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    tie: Sequence[str],
    name: str = "running_avg",
    previous: str = "prev_avg",
    following: str = "next_avg",
    unique_tie: bool = False,
) -> DataFrame:
    """Running average with its lag and lead over the rows ordered by (order, tie).

    Rows sharing an order value share their running average, so only the first
    of them looks back to the value before, and only the last one ahead. First
    and last are found by the first column of ``tie``; where several rows share
    it, the other columns decide, and of rows that repeat the whole ``tie`` one
    is taken, as a window would. For that the rows are stored once and numbered.
    ``unique_tie`` promises that the first column of ``tie`` is enough, and
    spares the storing.
    """
    mark = F.col(tie[0])
    run = _running(_per_order_value(df, keys, order, value, mark), keys, order)
    slim = run.select(*keys, order, "running", "before", "after", _FIRST, _LAST, _BLANK, "_rows")
    # A null tie comes before all others.
    first = F.when(F.col(_BLANK), mark.isNull()).otherwise(mark == F.col(_FIRST)).alias(_FIRST)
    last = mark.eqNullSafe(F.col(_LAST)).alias(_LAST)
    several = (F.col("_rows") > 1).alias(_SEVERAL)
    found = _join_back(df, slim, [*keys, order], F.col("running"), F.col("before"), F.col("after"), first, last, several)
    if not unique_tie:
        found = _one_each(found, [*keys, order], tie)
    return found.select(
        *[F.col(c) for c in df.columns],
        F.col("running").alias(name),
        F.when(F.col(_FIRST), F.col("before")).otherwise(F.col("running")).alias(previous),
        F.when(F.col(_LAST), F.col("after")).otherwise(F.col("running")).alias(following),
    )


def _one_each(found: DataFrame, group: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """``found`` with one first and one last row per group, decided by the whole ``tie`` and then by the number of the stored row.

    Only groups with several candidates are looked at again, and only the rows of
    groups of several rows are shuffled for it; everything is grouped with
    partial results, so a tie that very many rows share is no hot task.
    """
    stored = materialise(found.withColumn("_row", F.monotonically_increasing_id()), "running-rows")
    single, stored = stored.filter(~F.col(_SEVERAL)), stored.filter(_SEVERAL)
    edges = stored.filter(F.col(_FIRST) | F.col(_LAST))
    firsts, lasts = (F.sum(F.col(c).cast("int")) for c in (_FIRST, _LAST))
    crowded = edges.groupBy(*group).agg(firsts.alias("_firsts"), lasts.alias("_lasts")).filter("_firsts > 1 or _lasts > 1")
    crowded = crowded.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)])
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(group)]
    place = F.struct(*tie, "_row")
    picked = edges.join(crowded, same, "left_semi").groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group)]).agg(
        F.min(F.when(F.col(_FIRST), place)).alias("_low"), F.max(F.when(F.col(_LAST), place)).alias("_high")
    )
    picked = materialise(picked.select("*", F.col("_low._row").alias("_at_first"), F.col("_high._row").alias("_at_last")).drop("_low", "_high"), "running-picked")
    chosen = stored.join(picked, same, "left").withColumns({
        _FIRST: F.when(F.col("_at_first").isNull(), F.col(_FIRST)).otherwise(F.col("_row") == F.col("_at_first")),
        _LAST: F.when(F.col("_at_last").isNull(), F.col(_LAST)).otherwise(F.col("_row") == F.col("_at_last")),
    })
    return chosen.select(single.columns).union(single)


def neighbour_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    previous: str = "total_prev",
    following: str = "total_next",
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Per key, the sums of the lag and of the lead of the running average.

    Of the n rows with one order value, n-1 see their own running average and
    one sees the neighbour's, so the row-level window is not needed. ``sums``
    names further columns to add up on the way, in the same pass over the rows.
    The sums per order value are stored, because cutting them into blocks reads
    them twice; the further ones are added up from there and not windowed.
    """
    stored = materialise(_per_order_value(df, keys, order, value, sums=sums), "order-sums")
    run = _running(stored.select(*keys, order, "_s", "_c", "_rows"), keys, order)

    def summed(neighbour: str) -> Column:
        inner = F.when(F.col("_rows") > 1, (F.col("_rows") - 1) * F.col("running"))
        seen = F.coalesce(inner, F.lit(0.0)) + F.coalesce(F.col(neighbour), F.lit(0.0))
        return F.sum(F.when(inner.isNotNull() | F.col(neighbour).isNotNull(), seen))

    near = run.groupBy(*keys).agg(summed("before").alias(previous), summed("after").alias(following))
    if not sums:
        return near
    whole = stored.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in sums])
    return _join_back(whole, near, keys, F.col(previous), F.col(following))
