"""Fraud figures, text lines, cleaning, casts and projections on the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.scalars import bucketise, day
from tallyloom.operators.clean import clean_data, keep_known, keep_members, normalise_strings
from tallyloom.operators.joins import derived_dimension, inner_join
from tallyloom.operators.partitions import replicate_rows
from tallyloom.operators.topk import first_rows, top_k
from tallyloom.plans import fraud
from tallyloom.plans.text_etl import split_lines, words_of
from tallyloom.scratch import scratch_path
from tallyloom.sources.readers import lines_of, literal_table, read_text
from tallyloom.workload.registry import query, table

QUANTITY = fraud.Columns(
    key="l_quantity", label="l_returnflag", amount="l_extendedprice",
    bounds=[15, 30, 45], labels=["1-14", "15-29", "30-44", "45+"], bucket="quantity_bucket",
)

_BUCKET = """CASE WHEN l_quantity < 15 THEN '1-14' WHEN l_quantity < 30 THEN '15-29'
             WHEN l_quantity < 45 THEN '30-44' ELSE '45+' END"""

_METRICS = f"""
WITH f AS (SELECT *, l_extendedprice - (l_extendedprice * l_discount + l_extendedprice * l_tax) AS net_worth FROM lineitem),
dim AS (SELECT DISTINCT l_quantity, {_BUCKET} AS quantity_bucket FROM lineitem),
m AS (SELECT quantity_bucket, l_returnflag, count(*) AS txn_count, sum(l_extendedprice) AS total_trx_amount,
             avg(l_extendedprice) AS avg_trx_amount, avg(net_worth) AS avg_net_worth, stddev_samp(l_extendedprice) AS trx_stddev
      FROM f JOIN dim USING (l_quantity) GROUP BY quantity_bucket, l_returnflag)
"""

_METRICS_ROUNDED = _METRICS + """
SELECT quantity_bucket, l_returnflag, txn_count, round(total_trx_amount, 2) AS total_trx_amount,
       round(avg_trx_amount, 4) AS avg_trx_amount, round(avg_net_worth, 4) AS avg_net_worth, round(trx_stddev, 4) AS trx_stddev
FROM m"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return fraud.add_net_worth(
        table(spark, sf, "lineitem"),
        assets=["l_extendedprice"],
        liabilities=[F.col("l_extendedprice") * F.col("l_discount"), F.col("l_extendedprice") * F.col("l_tax")],
    )


def _rounded_metrics(metrics: DataFrame) -> DataFrame:
    digits = {"total_trx_amount": 2, "avg_trx_amount": 4, "avg_net_worth": 4, "trx_stddev": 4}
    return metrics.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 4) AS total_assets,
              round(l_extendedprice * l_discount + l_extendedprice * l_tax, 4) AS total_liabilities,
              round(l_extendedprice - (l_extendedprice * l_discount + l_extendedprice * l_tax), 4) AS net_worth
       FROM lineitem"""
)
def fraud_features(spark: SparkSession, sf: str) -> DataFrame:
    figures = ["total_assets", "total_liabilities", "net_worth"]
    return _features(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(c, 4).alias(c) for c in figures])


@query(f"SELECT DISTINCT l_quantity, {_BUCKET} AS quantity_bucket FROM lineitem")
def quantity_dim(spark: SparkSession, sf: str) -> DataFrame:
    label = bucketise("l_quantity", QUANTITY.bounds, QUANTITY.labels)
    return derived_dimension(table(spark, sf, "lineitem"), "l_quantity", label, "quantity_bucket")


@query(_METRICS_ROUNDED)
def fraud_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_metrics(fraud.fraud_metrics(_features(spark, sf), QUANTITY))


@query(_METRICS_ROUNDED)
def fraud_metrics_joined(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded_metrics(fraud.fraud_metrics(_features(spark, sf), QUANTITY, join=True))


@query(
    _METRICS
    + """SELECT l_returnflag, CAST(sum(txn_count) AS BIGINT) AS total_txns, round(sum(total_trx_amount), 2) AS total_amount,
                round(avg(avg_net_worth), 4) AS overall_avg_net_worth
         FROM m GROUP BY l_returnflag"""
)
def fraud_summary(spark: SparkSession, sf: str) -> DataFrame:
    metrics = fraud.fraud_metrics(_features(spark, sf), QUANTITY)
    return fraud.final_summary(metrics, "l_returnflag").withColumns(
        {"total_amount": F.round("total_amount", 2), "overall_avg_net_worth": F.round("overall_avg_net_worth", 4)}
    )


_LINES = r"SELECT doc_id, unnest(regexp_split_to_array(text, '\r\n|\n|\r')) AS value FROM documents"


@query(
    f"""SELECT doc_id, value, replace(value, ' ', '|') AS words, CAST(len(string_split(value, ' ')) AS INTEGER) AS n_words
        FROM ({_LINES}) WHERE regexp_matches(value, '(?i)ther') AND NOT contains(value, 'Apache') AND len(string_split(value, ' ')) > 2"""
)
def text_etl(spark: SparkSession, sf: str) -> DataFrame:
    lines = lines_of(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return split_lines(lines, pattern="(?i)ther", excluded="Apache").select(
        "doc_id", "value", F.array_join("words_array", "|").alias("words"), F.size("words_array").alias("n_words")
    )


@query(
    f"""SELECT CAST(len(string_split(value, ' ')) AS INTEGER) AS n_words, count(*) AS n_lines
        FROM ({_LINES}) WHERE regexp_matches(value, '(?i)en') AND NOT contains(value, 'apache') AND len(string_split(value, ' ')) > 2
        GROUP BY 1"""
)
def text_file_etl(spark: SparkSession, sf: str) -> DataFrame:
    """The same steps on text files: the documents are stored as lines first."""
    path = scratch_path(spark, "lines")
    lines_of(table(spark, sf, "documents").select("text"), "text").write.text(path)
    words = words_of(read_text(spark, path), pattern="(?i)en")
    return words.groupBy(F.size("words_array").alias("n_words")).agg(F.count("*").alias("n_lines"))


@query(
    """SELECT DISTINCT c_custkey, upper(trim('  ' || lower(c_name) || ' ')) AS c_name, c_mktsegment, c_acctbal
       FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AND c_acctbal > 0"""
)
def clean_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Every row arrives twice, with padded lower-case names and nulls for negative balances."""
    raw = replicate_rows(table(spark, sf, "customer"), 2).select(
        "c_custkey",
        F.concat(F.lit("  "), F.lower("c_name"), F.lit(" ")).alias("c_name"),
        "c_mktsegment",
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"),
    )
    clean = normalise_strings(clean_data(raw), {"c_name": ("upper", "trim")})
    return keep_members(keep_known(clean, "c_name"), "c_mktsegment", ["BUILDING", "HOUSEHOLD"])


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_day, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
              CAST(NULL AS INTEGER) AS bad_number FROM orders"""
)
def typed_cast(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    unpadded = F.concat_ws("-", *[part("o_orderdate").cast("string") for part in (F.year, F.month, F.dayofmonth)])
    return orders.select(
        "o_orderkey", day(unpadded).alias("order_day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderpriority").try_cast("int").alias("bad_number"),
    )


@query("SELECT o_orderkey AS order_id, o_custkey AS buyer, o_totalprice * 2 AS twice FROM orders")
def project_rename(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumns({"twice": F.col("o_totalprice") * 2})
    return orders.withColumnRenamed("o_orderkey", "order_id").select(
        "order_id", F.col("o_custkey").alias("buyer"), "o_orderstatus", "twice"
    ).drop("o_orderstatus", "no_such_column")


@query(
    """SELECT event_id, round(sin(value), 6) AS sin_v, round(cos(value), 6) AS cos_v, round(sqrt(abs(value)), 6) AS sqrt_v,
              round(tanh(value / 100), 6) AS tanh_v, round(value * value, 4) AS square_v, event_id % 7 AS rest FROM events"""
)
def scalar_math(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.round(F.sin(v), 6).alias("sin_v"), F.round(F.cos(v), 6).alias("cos_v"),
        F.round(F.sqrt(F.abs(v)), 6).alias("sqrt_v"), F.round(F.tanh(v / 100), 6).alias("tanh_v"),
        F.round(F.pow(v, F.lit(2)), 4).alias("square_v"), (F.col("event_id") % 7).alias("rest"),
    )


@query(
    """WITH w(o_orderstatus, weight) AS (VALUES ('F', 1), ('O', 2), ('P', 3))
       SELECT o_orderstatus, weight, count(*) AS n_orders FROM orders JOIN w USING (o_orderstatus) GROUP BY ALL"""
)
def literal_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = literal_table(spark, [("F", 1), ("O", 2), ("P", 3)], "o_orderstatus string, weight int")
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n_orders"))
    return inner_join(counts, weights, "o_orderstatus").select("o_orderstatus", "weight", "n_orders")


@query("SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def top_customers(spark: SparkSession, sf: str) -> DataFrame:
    return top_k(table(spark, sf, "customer"), 10, "c_acctbal", "c_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def head_rows(spark: SparkSession, sf: str) -> DataFrame:
    return first_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 5, "o_orderkey")
