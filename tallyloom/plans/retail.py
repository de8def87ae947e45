"""Retail: clean six tables, join them, and analyse the result."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.scalars import two_way
from tallyloom.operators.aggregates import group_by_dict, group_stats
from tallyloom.operators.clean import clean_data, keep_containing, keep_known, keep_members, normalise_strings, parse_days
from tallyloom.operators.joins import left_join_chain
from tallyloom.operators.topk import sort_descending
from tallyloom.operators.windows import neighbour_totals, running_average, running_neighbours
from tallyloom.sinks.writers import write_parquet
from tallyloom.sources.readers import load, with_row_key

# How each table is stored and the types of its columns.
FORMATS = {"sales": "csv", "stock": "json", "supplier": "json", "customer": "csv", "market": "csv", "logistic": "csv"}
SCHEMAS = {
    "sales": "sales_id string, product_name string, price double, quantity_sold int, date_of_sale string, customer_id string",
    "stock": "product_name string, shelf_life int, contains_promotion string, quantity_in_stock int, location string, date_received string",
    "supplier": "sup_id string, product_name string, quantity_ordered int, price double, date_ordered string",
    "customer": "customer_id string, customer_name string, age int, gender string, purchase_history int, contact_info string",
    "market": "product_name string, competitor_price double, sales_trend int, demand_forecast int",
    "logistic": "product_name string, shipping_cost double, transportation_cost double, warehouse_cost double",
}


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: load(spark, fmt, f"{root}/{name}/", SCHEMAS[name]) for name, fmt in FORMATS.items()}


def clean_tables(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows without nulls or repeats, dates parsed, names in upper case and trimmed.

    Repeats are removed before the names are changed, so rows that differ only
    in case or blanks both stay. The product name of ``stock`` is not trimmed.
    """
    t = {name: clean_data(df) for name, df in tables.items()}
    both = ("upper", "trim")
    sales = normalise_strings(parse_days(t["sales"], "date_of_sale"), {"product_name": both})
    stock = normalise_strings(parse_days(t["stock"], "date_received"), {"product_name": ("upper",), "location": both})
    supplier = normalise_strings(parse_days(t["supplier"], "date_ordered"), {"product_name": both})
    customer = normalise_strings(t["customer"], {"customer_name": both})
    market = normalise_strings(t["market"], {"product_name": both})
    logistic = normalise_strings(t["logistic"], {"product_name": both})
    return {
        "sales": keep_known(sales, "product_name"),
        "stock": keep_known(stock, "location"),
        "supplier": supplier.drop("price"),
        "customer": keep_members(customer, "gender", ["male", "female"]),
        "market": keep_known(market, "product_name").drop("price"),
        "logistic": keep_known(logistic, "product_name"),
    }


def join_tables(clean: Mapping[str, DataFrame]) -> DataFrame:
    """Every sale with what is known about its product and its customer."""
    by_product = [(clean[name], "product_name") for name in ("stock", "supplier", "market", "logistic")]
    return left_join_chain(clean["sales"], [*by_product, (clean["customer"], "customer_id")])


def clean_and_join(tables: Mapping[str, DataFrame]) -> DataFrame:
    return join_tables(clean_tables(tables))


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    """The stored join with a ``row_key`` that tells equal rows apart."""
    return with_row_key(spark.read.parquet(path))


def add_flags(data: DataFrame, shelf_limit: int = 30, good_above: int = 50) -> DataFrame:
    return data.withColumns(
        {
            "perishable": two_way(F.col("shelf_life") <= shelf_limit, "yes", "no"),
            "sales_status": two_way(F.col("quantity_sold") > good_above, "good", "bad"),
        }
    )


_BY_PRODUCT = {"keys": ["product_name"], "order": "date_of_sale", "value": "quantity_sold"}


def add_running_sales(data: DataFrame) -> DataFrame:
    return running_average(data, **_BY_PRODUCT, name="rolling_avg_sales")


def add_forecast(data: DataFrame, tie: list[str]) -> DataFrame:
    """Running average of the quantity with its value one row before and one row after.

    ``tie`` orders the sales of one product and day and must tell them apart.
    """
    return running_neighbours(
        data, **_BY_PRODUCT, tie=tie, name="rolling_avg_sales", previous="prev_sales", following="next_sales"
    )


def price_by_supplier(data: DataFrame) -> DataFrame:
    return group_by_dict(data, ["sup_id"], {"price": "avg"})


def stock_by_supplier(data: DataFrame) -> DataFrame:
    return group_by_dict(data, ["sup_id"], {"quantity_in_stock": "sum", "price": "sum"})


def perishable_counts(data: DataFrame) -> DataFrame:
    return group_by_dict(data, ["perishable"], {"perishable": "count"})


def status_counts(data: DataFrame) -> DataFrame:
    return group_by_dict(data, ["sales_status"], {"sales_status": "count"})


def promotion_count(data: DataFrame, text: str = "10% off") -> DataFrame:
    return keep_containing(data, "contains_promotion", text).agg(F.count("*").alias("n_rows"))


def product_location_totals(data: DataFrame) -> DataFrame:
    totals = group_stats(
        data, ["product_name", "location"],
        total_price=F.sum("price"), total_quantity_sold=F.sum("quantity_ordered"), avg_quantity_sold=F.avg("quantity_sold"),
    )
    return sort_descending(totals, "total_price")


def product_totals(data: DataFrame) -> DataFrame:
    """Totals per product, with the sums of the neighbouring running averages, largest sales first.

    Everything is summed per product and day in one pass; the running averages
    and the totals are made from those sums.
    """
    sums = {
        "total_quantity_in_stock": F.col("quantity_in_stock"),
        "_price": F.col("price"),
        "_prices": F.col("price").isNotNull().cast("int"),
        "total_quantity_ordered": F.col("quantity_ordered"),
        "total_quantity_sold": F.col("quantity_sold"),
        "total_sales": F.col("price") * F.col("quantity_sold"),
    }
    totals = neighbour_totals(data, **_BY_PRODUCT, previous="total_prev_sales", following="total_next_sales", sums=sums)
    return sort_descending(
        totals.select(
            "product_name", "total_quantity_in_stock", F.try_divide("_price", "_prices").alias("average_price"),
            "total_quantity_ordered", "total_quantity_sold", "total_sales", "total_prev_sales", "total_next_sales",
        ),
        "total_sales",
    )


def run(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Both steps from files to files; returns the reports."""
    write_parquet(clean_and_join(read_tables(spark, root)), f"{root}/cleaned/")
    data = add_flags(read_cleaned(spark, f"{root}/cleaned/"))
    reports = {
        "price_by_supplier": price_by_supplier(data),
        "stock_by_supplier": stock_by_supplier(data),
        "perishable": perishable_counts(data),
        "sales_status": status_counts(data),
        "promotions": promotion_count(data),
    }
    write_parquet(product_totals(data), f"{root}/app/data.parquet")
    write_parquet(product_location_totals(data), f"{root}/app1/data.parquet")
    return reports
