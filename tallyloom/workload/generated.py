"""Generators, keyed by the rows of the stored tables.

SQL states the hash and every column anew, so generated rows are compared value
by value; the profiles check row counts, ranges and even spread beside that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.plans import fraud
from tallyloom.sources import datagen
from tallyloom.workload.registry import query, table


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))


# The same values in DuckDB's SQL, over ``k(id)``.
_KEYS = "WITH k AS (SELECT o_orderkey AS id FROM orders)"


def _u(salt: int | str) -> str:
    x = f"((id & 2147483647) * 48271 + ((id >> 31) % 2147483647 + 2147483647) * 40692 + ({salt} * 1103515245::BIGINT + 12345) % 2147483647) % 2147483647"
    x = f"(xor({x}, ({x}) >> 13) * 1597334677) % 2147483647"
    return f"(CAST((xor({x}, ({x}) >> 15) * 1812433253) % 2147483647 AS DOUBLE) / 2147483647)"


def _int(salt: int, low: int, high: int) -> str:
    return f"CAST({low} + floor({_u(salt)} * {high - low + 1}) AS INTEGER)"


def _real(salt: int, low: float, high: float) -> str:
    return f"({low} + {_u(salt)} * {high - low})"


def _float(salt: int | str, low: float, high: float) -> str:
    return f"CAST(least(CAST('{low}' AS DOUBLE) + floor({_u(salt)} * CAST('{high - low + 1!r}' AS DOUBLE)), {high}) AS FLOAT)"


def _day(salt: int) -> str:
    return f"'2022-' || {_int(salt, 1, 12)} || '-' || {_int(salt + 1, 1, 28)}"


_BANKING = ", ".join(f"{_float(i, low, high)} AS {name}" for i, (name, (low, high)) in enumerate(datagen.BANKING_RANGES.items()))
_BANKING = f"{_KEYS} SELECT {_BANKING}, CAST({_u(100)} >= 0.9 AS INTEGER) AS fraud_trx FROM k"
_WIDE_LABELS = f"'ID' || CAST(1 + floor({_u(0)} * 50000000) AS BIGINT) AS unique_id, substr('ABCDEFGHIJKLMNO', CAST(id % 15 AS INTEGER) + 1, 1) AS col1"
_WIDE_ROWS = f"{_KEYS} SELECT {_WIDE_LABELS}, {', '.join(f'{_float(i, 1, 50_000_000)} AS col{i}' for i in range(2, 40))} FROM k"
# The columns of the retail tables.
_RETAIL_ROWS = {
    "sales": f"""'s_' || id AS sales_id, 'Product_' || id AS product_name, {_real(1, 1, 10)} AS price, {_int(2, 1, 10)} AS quantity_sold,
        {_day(3)} AS date_of_sale, 'c_' || {_int(5, 1, 10_000)} AS customer_id""",
    "stock": f"""'Product_' || id AS product_name, {_int(20, 1, 365)} AS shelf_life, {_int(21, 0, 10)} || ' % off' AS contains_promotion,
        {_int(22, 1, 100)} AS quantity_in_stock, 'Location_' || {_int(23, 1, 100)} AS location, {_day(24)} AS date_received""",
    "supplier": f"""'s_' || id AS sup_id, 'Product_' || id AS product_name, {_int(30, 1, 100)} AS quantity_ordered,
        {_real(31, 1, 10)} AS price, {_day(32)} AS date_ordered""",
    "customer": f"""'c_' || id AS customer_id, 'Customer_' || id AS customer_name, {_int(40, 20, 70)} AS age,
        CASE {_int(41, 0, 1)} WHEN 0 THEN 'male' ELSE 'female' END AS gender, {_int(42, 1, 100)} AS purchase_history,
        'email_' || id || '@gmail.com' AS contact_info""",
    "market": f"""'Product_' || id AS product_name, {_real(50, 1, 100)} AS competitor_price, {_int(51, 1, 100)} AS sales_trend,
        {_int(52, 1, 100)} AS demand_forecast""",
    "logistic": f"""'Product_' || id AS product_name, {_real(60, 1, 10)} AS shipping_cost, {_real(61, 1, 10)} AS transportation_cost,
        {_real(62, 1, 10)} AS warehouse_cost""",
}
_RETAIL_ROWS = {name: f"{_KEYS} SELECT {columns} FROM k" for name, columns in _RETAIL_ROWS.items()}


def _profile(df: DataFrame, ranges: dict[str, tuple[float, float]], spread: float = 0.05) -> DataFrame:
    """Per column: rows, rows inside the range, and whether the mean is near the middle."""
    figures: list[Column] = []
    for name, (low, high) in ranges.items():
        # The bounds are compared as the column stores them.
        kind = df.schema[name].dataType
        inside = F.col(name).between(F.lit(low).cast(kind), F.lit(high).cast(kind))
        near = F.abs(F.avg(name) - (low + high) / 2) < spread * (high - low)
        figures.append(F.struct(F.lit(name).alias("column_name"), F.count(name).alias("n_rows"), F.count_if(inside).alias("n_inside"), near.alias("mean_ok")))
    return df.agg(F.array(*figures).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def _profile_sql(names: list[str], base: str = "orders") -> str:
    values = ", ".join(f"('{n}')" for n in names)
    return f"SELECT column_name, (SELECT count(*) FROM {base}) AS n_rows, (SELECT count(*) FROM {base}) AS n_inside, true AS mean_ok FROM (VALUES {values}) AS t(column_name)"


@query(_BANKING)
def gen_banking(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.banking(_base(spark, sf))


@query(_profile_sql(datagen.BANKING_FEATURES))
def gen_banking_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(datagen.banking(_base(spark, sf)), datagen.BANKING_RANGES)


@query("SELECT count(*) AS n_rows, CAST(2 AS BIGINT) AS n_labels, true AS share_ok FROM orders")
def gen_banking_labels(spark: SparkSession, sf: str) -> DataFrame:
    label = datagen.banking(_base(spark, sf))
    return label.agg(
        F.count("*").alias("n_rows"), F.count_distinct("fraud_trx").alias("n_labels"),
        F.avg("fraud_trx").between(0.07, 0.13).alias("share_ok"),
    )


@query(
    f"""WITH g AS ({_BANKING}),
        f AS (SELECT *, CASE WHEN age < 30 THEN '18-29' WHEN age < 45 THEN '30-44' WHEN age < 60 THEN '45-59' ELSE '60+' END AS age_bucket,
              (bank_account_balance + sec_bank_account_balance + savings_account_balance + sec_savings_account_balance)
              - (credit_card_balance + mortgage_balance + primary_loan_balance + secondary_loan_balance + uni_loan_balance) AS net_worth FROM g),
        m AS (SELECT age_bucket, fraud_trx, count(*) AS n, sum(transaction_amount) AS amount, avg(net_worth) AS worth FROM f GROUP BY ALL)
        SELECT fraud_trx, CAST(sum(n) AS BIGINT) AS total_txns, round(sum(amount), 2) AS total_amount, round(avg(worth), 3) AS overall_avg_net_worth
        FROM m GROUP BY fraud_trx"""
)
def gen_banking_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The fraud summary over generated transactions."""
    return fraud.banking_summary(datagen.banking(_base(spark, sf))).withColumns(
        {"total_amount": F.round("total_amount", 2), "overall_avg_net_worth": F.round("overall_avg_net_worth", 3)}
    )


@query(_WIDE_ROWS)
def gen_wide(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.wide(_base(spark, sf), columns=40)


_WIDE = {f"col{i}": (1, 50_000_000) for i in range(2, 40)}


@query(_profile_sql(list(_WIDE)))
def gen_wide_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(datagen.wide(_base(spark, sf), columns=40), _WIDE)


@query("SELECT substr('ABCDEFGHIJKLMNO', CAST(o_orderkey % 15 AS INTEGER) + 1, 1) AS col1, count(*) AS n_rows, count(*) AS n_ids FROM orders GROUP BY 1")
def gen_wide_categories(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.wide(_base(spark, sf), columns=3).groupBy("col1").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("unique_id").rlike("^ID[1-9][0-9]*$")).alias("n_ids")
    )


@query(
    f"""WITH k AS (SELECT c_custkey AS id FROM customer)
        SELECT CAST(c AS INTEGER) AS column_number, count(*) AS n_rows, CAST(sum({_float('c', 1, 50_000_000)}) AS DOUBLE) AS total
        FROM k CROSS JOIN range(2, 10000) AS r(c) GROUP BY c"""
)
def gen_wide_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The sum of every number column of the table of 10,000 columns, one row per customer."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return datagen.column_sums(datagen.wide_cells(base, columns=10_000))


@query(_RETAIL_ROWS["sales"])
def gen_retail_sales(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.retail_sales(_base(spark, sf))


@query(_RETAIL_ROWS["stock"])
def gen_retail_stock(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.retail_stock(_base(spark, sf))


@query(_RETAIL_ROWS["supplier"])
def gen_retail_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.retail_supplier(_base(spark, sf))


@query(_RETAIL_ROWS["customer"])
def gen_retail_customer(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.retail_customer(_base(spark, sf))


@query(_RETAIL_ROWS["market"])
def gen_retail_market(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.retail_market(_base(spark, sf))


@query(_RETAIL_ROWS["logistic"])
def gen_retail_logistic(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.retail_logistic(_base(spark, sf))


# The number ranges of the retail tables.
_RETAIL = {
    "sales": {"price": (1, 10), "quantity_sold": (1, 10)},
    "stock": {"shelf_life": (1, 365), "quantity_in_stock": (1, 100)},
    "supplier": {"quantity_ordered": (1, 100), "price": (1, 10)},
    "customer": {"age": (20, 70), "purchase_history": (1, 100)},
    "market": {"competitor_price": (1, 100), "sales_trend": (1, 100), "demand_forecast": (1, 100)},
    "logistic": {"shipping_cost": (1, 10), "transportation_cost": (1, 10), "warehouse_cost": (1, 10)},
}


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, * FROM ({_profile_sql(list(cols))})" for t, cols in _RETAIL.items()
    )
)
def gen_retail_profile(spark: SparkSession, sf: str) -> DataFrame:
    base = _base(spark, sf)
    makers = {
        "sales": datagen.retail_sales, "stock": datagen.retail_stock, "supplier": datagen.retail_supplier,
        "customer": datagen.retail_customer, "market": datagen.retail_market, "logistic": datagen.retail_logistic,
    }
    profiles = [_profile(make(base), _RETAIL[t]).select(F.lit(t).alias("table_name"), "*") for t, make in makers.items()]
    whole = profiles[0]
    for p in profiles[1:]:
        whole = whole.unionByName(p)
    return whole


@query(
    f"""{_KEYS} SELECT CAST(p.range AS INTEGER) AS part_id, CAST({_u(70)} < 0.5 AS INTEGER) AS key,
        round(sqrt(-2 * ln(1 - {_u(71)})) * cos({_u(1_000_074)} * 6.283185307179586), 6) AS value
        FROM k CROSS JOIN range(2) p"""
)
def gen_key_value(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.key_values(_base(spark, sf)).withColumn("value", F.round("value", 6))


@query(
    """SELECT CAST(p.range AS INTEGER) AS part_id, count(*) AS n_rows, true AS coin_ok, true AS mean_ok, true AS std_ok
       FROM orders CROSS JOIN range(2) p GROUP BY 1"""
)
def gen_key_value_profile(spark: SparkSession, sf: str) -> DataFrame:
    return datagen.key_values(_base(spark, sf)).groupBy("part_id").agg(
        F.count("*").alias("n_rows"), F.avg("key").between(0.45, 0.55).alias("coin_ok"),
        F.avg("value").between(-0.1, 0.1).alias("mean_ok"), F.stddev_pop("value").between(0.9, 1.1).alias("std_ok"),
    )
