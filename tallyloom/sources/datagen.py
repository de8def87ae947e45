"""Synthetic tables.

Every generator takes a table with a whole-number key and adds columns that
depend on that key alone. Give it ``spark.range(n)`` for n new rows, or the keys
of a stored table. There is one projection per table, however wide it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.scalars import (
    MODULUS, ROUNDS, bernoulli, choice, label_with, normal, round_sql, spread_sql, uniform, uniform_int, uniform_real, uniform_sql,
)

# Lowest and highest value of each banking column.
BANKING_RANGES = {
    "age": (10, 100),
    "credit_card_balance": (100, 30000),
    "bank_account_balance": (0.01, 100000),
    "mortgage_balance": (0.01, 1000000),
    "sec_bank_account_balance": (0.01, 100000),
    "savings_account_balance": (0.01, 500000),
    "sec_savings_account_balance": (0.01, 500000),
    "total_est_nworth": (10000, 500000),
    "primary_loan_balance": (0.01, 5000),
    "secondary_loan_balance": (0.01, 500000),
    "uni_loan_balance": (0.01, 10000),
    "longitude": (-180, 180),
    "latitude": (-90, 90),
    "transaction_amount": (0.01, 30000),
}
BANKING_FEATURES = list(BANKING_RANGES)

# The categories of the wide table and the range of its numbers.
WIDE_CATEGORIES = list("ABCDEFGHIJKLMNO")
WIDE_RANGE = (1, 50_000_000)


def _steps(uniform: str, given: str, low: float, high: float) -> str:
    """SQL text of low, low + 1, low + 2, ... with equal odds, never above high; null where ``given`` is null."""
    value = f"least({float(low)!r}D + floor({uniform} * {float(high - low + 1)!r}D), {float(high)!r}D)"
    return f"if({given} IS NULL, NULL, CAST({value} AS float))"


def banking(base: DataFrame, key: str = "id") -> DataFrame:
    columns = [f"{_steps(uniform_sql(key, i), key, low, high)} AS {name}" for i, (name, (low, high)) in enumerate(BANKING_RANGES.items())]
    return base.selectExpr(*columns, f"CAST({uniform_sql(key, 100)} >= 0.9D AS int) AS fraud_trx")


def _hashed(base: DataFrame, key: str, salts: list[int] | list[str], kept: list[str]) -> DataFrame:
    """Columns ``_0``, ``_1``, ... with one hash per salt.

    One projection per round keeps the text of every column short: a round uses
    its argument twice, and thousands of columns are parsed in one call.
    """
    made = base.selectExpr(*kept, *[f"{spread_sql(key, salt)} AS _{i}" for i, salt in enumerate(salts)])
    for shift, factor in ROUNDS:
        made = made.selectExpr(*kept, *[f"{round_sql(f'_{i}', shift, factor)} AS _{i}" for i in range(len(salts))])
    return made


def _wide_value(hashed: str) -> str:
    return _steps(f"({hashed} / {MODULUS}.0D)", hashed, *WIDE_RANGE)


def _wide_labels(key: str, id_range: int) -> list[str]:
    categories = ", ".join(f"'{c}'" for c in WIDE_CATEGORIES)
    return [
        f"concat('ID', CAST(1 + floor({uniform_sql(key, 0)} * {id_range}) AS bigint)) AS unique_id",
        f"get(array({categories}), CAST(pmod({key}, {len(WIDE_CATEGORIES)}) AS int)) AS col1",
    ]


def wide(base: DataFrame, key: str = "id", columns: int = 10_000, id_range: int = 50_000_000) -> DataFrame:
    """``unique_id`` (drawn with replacement), ``col1`` and float columns up to ``columns`` in all."""
    hashed = _hashed(base, key, list(range(2, columns)), [key])
    return hashed.selectExpr(
        *_wide_labels(key, id_range), *[f"{_wide_value(f'_{i}')} AS col{i + 2}" for i in range(columns - 2)]
    )


def wide_cells(base: DataFrame, key: str = "id", columns: int = 10_000, tasks: int | None = None) -> DataFrame:
    """The number columns of the wide table as ``key, column_number, value``: equal to those of :func:`wide`.

    The column's number is data, so one expression is compiled however wide the
    table is. The keys are dealt out to tasks first, as each becomes thousands
    of rows.
    """
    tasks = tasks or 4 * base.sparkSession.sparkContext.defaultParallelism
    numbers = F.explode(F.sequence(F.lit(2), F.lit(columns - 1))).alias("column_number")
    cells = base.select(key).repartition(tasks).select(key, numbers)
    hashed = _hashed(cells, key, ["column_number"], [key, "column_number"])
    return hashed.selectExpr(key, "column_number", f"{_wide_value('_0')} AS value")


def column_sums(cells: DataFrame) -> DataFrame:
    """Rows and sum of every column: partial sums per task, one row per column and task is shuffled."""
    return cells.groupBy("column_number").agg(F.count("value").alias("n_rows"), F.sum("value").alias("total"))


def _some_day(key: str, salt: int) -> Column:
    return F.concat_ws("-", F.lit("2022"), uniform_int(key, salt, 1, 12).cast("string"), uniform_int(key, salt + 1, 1, 28).cast("string"))


def retail_sales(base: DataFrame, key: str = "id", products: int | None = None, customers: int = 10_000) -> DataFrame:
    """Sales rows. ``products`` limits the product numbers, so that products repeat; by default each row has its own."""
    product = F.col(key) if products is None else uniform_int(key, 10, 0, products - 1)
    return base.select(
        label_with("s_", key).alias("sales_id"),
        label_with("Product_", product).alias("product_name"),
        uniform_real(key, 1, 1, 10).alias("price"),
        uniform_int(key, 2, 1, 10).alias("quantity_sold"),
        _some_day(key, 3).alias("date_of_sale"),
        label_with("c_", uniform_int(key, 5, 1, customers)).alias("customer_id"),
    )


def retail_stock(base: DataFrame, key: str = "id") -> DataFrame:
    return base.select(
        label_with("Product_", key).alias("product_name"),
        uniform_int(key, 20, 1, 365).alias("shelf_life"),
        F.concat(uniform_int(key, 21, 0, 10).cast("string"), F.lit(" % off")).alias("contains_promotion"),
        uniform_int(key, 22, 1, 100).alias("quantity_in_stock"),
        label_with("Location_", uniform_int(key, 23, 1, 100)).alias("location"),
        _some_day(key, 24).alias("date_received"),
    )


def retail_supplier(base: DataFrame, key: str = "id") -> DataFrame:
    return base.select(
        label_with("s_", key).alias("sup_id"),
        label_with("Product_", key).alias("product_name"),
        uniform_int(key, 30, 1, 100).alias("quantity_ordered"),
        uniform_real(key, 31, 1, 10).alias("price"),
        _some_day(key, 32).alias("date_ordered"),
    )


def retail_customer(base: DataFrame, key: str = "id") -> DataFrame:
    return base.select(
        label_with("c_", key).alias("customer_id"),
        label_with("Customer_", key).alias("customer_name"),
        uniform_int(key, 40, 20, 70).alias("age"),
        choice(key, 41, ["male", "female"]).alias("gender"),
        uniform_int(key, 42, 1, 100).alias("purchase_history"),
        F.concat(label_with("email_", key), F.lit("@gmail.com")).alias("contact_info"),
    )


def retail_market(base: DataFrame, key: str = "id") -> DataFrame:
    return base.select(
        label_with("Product_", key).alias("product_name"),
        uniform_real(key, 50, 1, 100).alias("competitor_price"),
        uniform_int(key, 51, 1, 100).alias("sales_trend"),
        uniform_int(key, 52, 1, 100).alias("demand_forecast"),
    )


def retail_logistic(base: DataFrame, key: str = "id") -> DataFrame:
    return base.select(
        label_with("Product_", key).alias("product_name"),
        uniform_real(key, 60, 1, 10).alias("shipping_cost"),
        uniform_real(key, 61, 1, 10).alias("transportation_cost"),
        uniform_real(key, 62, 1, 10).alias("warehouse_cost"),
    )


def retail_tables(spark: SparkSession, scale: float = 1.0, products: int | None = None) -> dict[str, DataFrame]:
    """The six retail tables; ``scale`` 1 gives 1,000,000 sales."""

    def rows(n: int) -> DataFrame:
        return spark.range(max(1, int(n * scale)))

    return {
        "sales": retail_sales(rows(1_000_000), products=products),
        "stock": retail_stock(rows(50_000)),
        "supplier": retail_supplier(rows(50_000)),
        "customer": retail_customer(rows(1_000)),
        "market": retail_market(rows(500_000)),
        "logistic": retail_logistic(rows(500_000)),
    }


def key_values(base: DataFrame, key: str = "id", parts: int = 2) -> DataFrame:
    """``part_id, key, value``: a fair coin and a standard normal value per row, the same in every part."""
    copies = base.select(key, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part_id"))
    return copies.select("part_id", bernoulli(key, 70).alias("key"), normal(key, 71).alias("value"))


def join_inputs(spark: SparkSession, rows: int = 10_000_000, keys: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """The two sides of the join benchmark, by number of rows."""
    left = spark.range(rows).select(
        "id", (F.col("id") % keys).alias("join_key"), (uniform("id", 42) * 100).alias("data_value")
    )
    return left, category_dimension(spark, keys)


def category_dimension(spark: SparkSession, keys: int = 1_000) -> DataFrame:
    return spark.range(keys).withColumnRenamed("id", "join_key").withColumn("category", label_with("Category_", "join_key"))
