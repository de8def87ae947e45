"""The retail jobs, on retail-shaped views of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators.aggregates import group_by_dict
from tallyloom.operators.joins import left_join, left_join_chain
from tallyloom.operators.windows import running_average, running_neighbours
from tallyloom.plans import retail
from tallyloom.workload.registry import query, table

# The views give names blanks and mixed case, repeat rows, and leave some
# products and customers out, so that every cleaning step has work to do.
_VIEWS_SQL = """
WITH sales AS (
  SELECT DISTINCT concat('s_', l_orderkey, '_', l_linenumber) AS sales_id, upper(trim(concat(' Product_', l_partkey, ' '))) AS product_name,
         floor(l_extendedprice) AS price, CAST(l_quantity AS INTEGER) AS quantity_sold, CAST(l_shipdate AS DATE) AS date_of_sale,
         concat('c_', l_suppkey) AS customer_id FROM lineitem),
stock AS (
  SELECT concat('PRODUCT_', p_partkey) AS product_name, p_size AS shelf_life, concat(p_size % 11, CASE WHEN p_type = 'PROMO' THEN '% off' ELSE ' % off' END) AS contains_promotion,
         p_size * 2 AS quantity_in_stock, upper(p_brand) AS location, make_date(2022, 1 + p_size % 12, 1 + p_size % 28) AS date_received
  FROM part WHERE p_type <> 'SMALL'),
sup AS (
  SELECT concat('s_', p_size) AS sup_id, concat('PRODUCT_', p_partkey) AS product_name, p_size + 1 AS quantity_ordered,
         make_date(2022, 1 + p_size % 12, 1 + p_size % 28) AS date_ordered
  FROM part WHERE p_type <> 'LARGE'),
cust AS (
  SELECT concat('c_', c_custkey) AS customer_id, upper(c_name) AS customer_name, 20 + c_nationkey AS age,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'female' ELSE 'male' END AS gender,
         c_nationkey AS purchase_history, concat(c_custkey, '@mail') AS contact_info
  FROM customer WHERE c_mktsegment NOT IN ('MACHINERY')),
market AS (
  SELECT concat('PRODUCT_', p_partkey) AS product_name, p_retailprice AS competitor_price, p_size AS sales_trend, p_size AS demand_forecast FROM part),
logistic AS (
  SELECT concat('PRODUCT_', p_partkey) AS product_name, p_retailprice / 8 AS shipping_cost, p_retailprice / 4 AS transportation_cost,
         p_retailprice / 2 AS warehouse_cost FROM part WHERE p_retailprice > 950),
data AS (
  SELECT * FROM sales LEFT JOIN stock USING (product_name) LEFT JOIN sup USING (product_name) LEFT JOIN market USING (product_name)
  LEFT JOIN logistic USING (product_name) LEFT JOIN cust USING (customer_id))
"""


def _views(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    part, customer, lineitem = (table(spark, sf, n) for n in ("part", "customer", "lineitem"))

    def text(*parts) -> F.Column:
        return F.concat(*[p if isinstance(p, F.Column) else F.lit(p) for p in parts])

    def number(name: str) -> F.Column:
        return F.col(name).cast("string")

    some_day = text("2022-", (1 + F.col("p_size") % 12).cast("string"), "-", (1 + F.col("p_size") % 28).cast("string"))
    product = text("Product_", number("p_partkey"))
    return {
        "sales": lineitem.select(
            text("s_", number("l_orderkey"), "_", number("l_linenumber")).alias("sales_id"),
            text(" Product_", number("l_partkey"), " ").alias("product_name"),
            F.floor("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("int").alias("quantity_sold"),
            F.date_format("l_shipdate", "yyyy-M-d").alias("date_of_sale"), text("c_", number("l_suppkey")).alias("customer_id"),
        ),
        "stock": part.select(
            product.alias("product_name"), F.col("p_size").alias("shelf_life"),
            text((F.col("p_size") % 11).cast("string"), F.when(F.col("p_type") == "PROMO", "% off").otherwise(" % off")).alias("contains_promotion"),
            (F.col("p_size") * 2).alias("quantity_in_stock"), text(" ", F.col("p_brand")).alias("location"),
            F.when(F.col("p_type") != "SMALL", some_day).alias("date_received"),
        ),
        "supplier": part.select(
            text("s_", number("p_size")).alias("sup_id"), text(product, " ").alias("product_name"),
            (F.col("p_size") + 1).alias("quantity_ordered"), F.when(F.col("p_type") != "LARGE", F.col("p_retailprice")).alias("price"),
            some_day.alias("date_ordered"),
        ),
        "customer": customer.select(
            text("c_", number("c_custkey")).alias("customer_id"), text(" ", F.col("c_name")).alias("customer_name"),
            (20 + F.col("c_nationkey")).alias("age"),
            F.when(F.col("c_mktsegment") == "BUILDING", "female").when(F.col("c_mktsegment") == "MACHINERY", "other").otherwise("male").alias("gender"),
            F.col("c_nationkey").alias("purchase_history"), text(number("c_custkey"), "@mail").alias("contact_info"),
        ),
        "market": part.select(
            product.alias("product_name"), F.col("p_retailprice").alias("competitor_price"),
            F.col("p_size").alias("sales_trend"), F.col("p_size").alias("demand_forecast"),
        ),
        "logistic": part.select(
            text(" ", product).alias("product_name"), (F.col("p_retailprice") / 8).alias("shipping_cost"),
            (F.col("p_retailprice") / 4).alias("transportation_cost"),
            F.when(F.col("p_retailprice") > 950, F.col("p_retailprice") / 2).alias("warehouse_cost"),
        ),
    }


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    return retail.clean_and_join(_views(spark, sf))


_COLUMNS = [
    "customer_id", "product_name", "sales_id", "price", "quantity_sold", "date_of_sale", "shelf_life", "contains_promotion",
    "quantity_in_stock", "location", "date_received", "sup_id", "quantity_ordered", "date_ordered", "competitor_price",
    "sales_trend", "demand_forecast", "shipping_cost", "transportation_cost", "warehouse_cost", "customer_name", "age",
    "gender", "purchase_history", "contact_info",
]


@query(_VIEWS_SQL + "SELECT " + ", ".join(_COLUMNS) + " FROM data")
def retail_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(spark, sf).select(*_COLUMNS)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, p_name, p_size, p_retailprice, s_name, o_custkey, c_name
       FROM lineitem
       LEFT JOIN (SELECT p_partkey AS l_partkey, p_name, p_size FROM part WHERE p_size <= 30) USING (l_partkey)
       LEFT JOIN (SELECT p_partkey AS l_partkey, p_retailprice FROM part WHERE p_type <> 'PROMO') USING (l_partkey)
       LEFT JOIN (SELECT s_suppkey AS l_suppkey, s_name FROM supplier WHERE s_acctbal > 0) USING (l_suppkey)
       LEFT JOIN (SELECT o_orderkey AS l_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') USING (l_orderkey)
       LEFT JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_mktsegment <> 'MACHINERY') USING (o_custkey)"""
)
def retail_join(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "l_partkey")
    supplier = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    customer = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    lineitem = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return left_join_chain(
        lineitem,
        [
            (part.where("p_size <= 30").select("l_partkey", "p_name", "p_size"), "l_partkey"),
            (part.where("p_type <> 'PROMO'").select("l_partkey", "p_retailprice"), "l_partkey"),
            (supplier.where("s_acctbal > 0").select("l_suppkey", "s_name"), "l_suppkey"),
            (orders.where("o_orderstatus = 'F'").select("l_orderkey", "o_custkey"), "l_orderkey"),
            (customer.where("c_mktsegment <> 'MACHINERY'").select("o_custkey", "c_name"), "o_custkey"),
        ],
    )


@query(
    """WITH d AS (SELECT CASE WHEN p_size <= 30 THEN 'yes' ELSE 'no' END AS perishable, CASE WHEN l_quantity > 25 THEN 'good' ELSE 'bad' END AS sales_status
                  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_type <> 'SMALL')
       SELECT 'perishable' AS report, perishable AS label, count(perishable) AS n_rows FROM d GROUP BY 2
       UNION ALL SELECT 'sales_status', sales_status, count(sales_status) FROM d GROUP BY 2"""
)
def sales_flags(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").where("p_type <> 'SMALL'").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("shelf_life"))
    sales = table(spark, sf, "lineitem").select("l_partkey", F.col("l_quantity").alias("quantity_sold"))
    data = retail.add_flags(left_join(sales, part, "l_partkey"), good_above=25)

    def report(counts: DataFrame, name: str) -> DataFrame:
        return counts.select(F.lit(name).alias("report"), F.col(name).alias("label"), F.col(f"count({name})").alias("n_rows"))

    return report(retail.perishable_counts(data), "perishable").unionByName(report(retail.status_counts(data), "sales_status"))


@query(
    """SELECT l_suppkey, round(avg(l_extendedprice), 4) AS avg_price, CAST(sum(l_quantity) AS DOUBLE) AS total_quantity FROM lineitem GROUP BY l_suppkey"""
)
def supplier_prices(spark: SparkSession, sf: str) -> DataFrame:
    stats = group_by_dict(table(spark, sf, "lineitem"), ["l_suppkey"], {"l_extendedprice": "avg", "l_quantity": "sum"})
    return stats.select("l_suppkey", F.round("avg(l_extendedprice)", 4).alias("avg_price"), F.col("sum(l_quantity)").alias("total_quantity"))


@query(
    _VIEWS_SQL
    + """SELECT sup_id, round(avg(price), 4) AS avg_price, CAST(sum(quantity_in_stock) AS BIGINT) AS total_stock, round(sum(price), 2) AS total_price
         FROM data GROUP BY sup_id"""
)
def retail_supplier_report(spark: SparkSession, sf: str) -> DataFrame:
    data = _joined(spark, sf)
    prices = retail.price_by_supplier(data).withColumnRenamed("sup_id", "_id")
    stock = retail.stock_by_supplier(data)
    return stock.join(prices, stock["sup_id"].eqNullSafe(prices["_id"])).select(
        "sup_id", F.round("avg(price)", 4).alias("avg_price"), F.col("sum(quantity_in_stock)").alias("total_stock"),
        F.round("sum(price)", 2).alias("total_price"),
    )


@query(_VIEWS_SQL + "SELECT count(*) AS n_rows FROM data WHERE contains(contains_promotion, '10% off')")
def promo_count(spark: SparkSession, sf: str) -> DataFrame:
    return retail.promotion_count(_joined(spark, sf))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship_day,
              round(avg(l_quantity) OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE)), 6) AS running_avg
       FROM lineitem"""
)
def running_avg(spark: SparkSession, sf: str) -> DataFrame:
    sales = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship_day"), "l_quantity"
    )
    return running_average(sales, ["l_partkey"], "ship_day", "l_quantity").withColumn("running_avg", F.round("running_avg", 6)).drop("l_quantity")


@query(
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey, l_partkey, l_shipdate,
              round(avg(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate), 6) AS running_avg
       FROM lineitem"""
)
def running_avg_few_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Three keys hold all rows; their sums are accumulated in blocks."""
    sales = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_partkey", "l_shipdate", "l_quantity"
    )
    return running_average(sales, ["l_returnflag"], "l_shipdate", "l_quantity").withColumn("running_avg", F.round("running_avg", 6)).drop("l_quantity")


_TIE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_quantity"]


@query(
    f"""WITH r AS (SELECT *, avg(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS ra FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(ra, 6) AS rolling_avg_sales,
               round(lag(ra) OVER w, 6) AS prev_sales, round(lead(ra) OVER w, 6) AS next_sales
        FROM r WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, {", ".join(_TIE)})"""
)
def prev_next_sales(spark: SparkSession, sf: str) -> DataFrame:
    sales = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", *_TIE)
    names = ["rolling_avg_sales", "prev_sales", "next_sales"]
    found = running_neighbours(sales, ["l_partkey"], "l_shipdate", "l_quantity", _TIE, *names)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[F.round(c, 6).alias(c) for c in names])


@query(
    """WITH r AS (SELECT *, avg(floor(o_totalprice)) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS ra FROM orders)
       SELECT o_orderkey, o_orderpriority, round(ra, 4) AS running_avg, round(lag(ra) OVER w, 4) AS prev_avg, round(lead(ra) OVER w, 4) AS next_avg
       FROM r WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)"""
)
def prev_next_few_keys(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderdate", F.floor("o_totalprice").alias("o_totalprice")
    )
    found = running_neighbours(orders, ["o_orderpriority"], "o_orderdate", "o_totalprice", ["o_orderkey"], unique_tie=True)
    return found.select("o_orderkey", "o_orderpriority", *[F.round(c, 4).alias(c) for c in ("running_avg", "prev_avg", "next_avg")])


@query(
    _VIEWS_SQL
    + """, r AS (SELECT *, avg(quantity_sold) OVER (PARTITION BY product_name ORDER BY date_of_sale) AS ra FROM data),
         f AS (SELECT *, lag(ra) OVER w AS prev_sales, lead(ra) OVER w AS next_sales FROM r
               WINDOW w AS (PARTITION BY product_name ORDER BY date_of_sale, sales_id, price, quantity_sold, customer_id))
         SELECT product_name, CAST(sum(quantity_in_stock) AS BIGINT) AS total_quantity_in_stock, round(avg(price), 4) AS average_price,
                CAST(sum(quantity_ordered) AS BIGINT) AS total_quantity_ordered, CAST(sum(quantity_sold) AS BIGINT) AS total_quantity_sold,
                round(sum(price * quantity_sold), 2) AS total_sales, round(sum(prev_sales), 4) AS total_prev_sales, round(sum(next_sales), 4) AS total_next_sales
         FROM f GROUP BY product_name"""
)
def product_totals(spark: SparkSession, sf: str) -> DataFrame:
    digits = {"average_price": 4, "total_sales": 2, "total_prev_sales": 4, "total_next_sales": 4}
    return retail.product_totals(_joined(spark, sf)).withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    _VIEWS_SQL
    + """SELECT product_name, location, round(sum(price), 2) AS total_price, CAST(sum(quantity_ordered) AS BIGINT) AS total_quantity_sold,
                round(avg(quantity_sold), 4) AS avg_quantity_sold FROM data GROUP BY product_name, location"""
)
def product_location_totals(spark: SparkSession, sf: str) -> DataFrame:
    return retail.product_location_totals(_joined(spark, sf)).withColumns(
        {"total_price": F.round("total_price", 2), "avg_quantity_sold": F.round("avg_quantity_sold", 4)}
    )
