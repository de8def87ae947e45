import datetime as dt

import pytest

from tallyloom.plans import retail

TABLES = {
    "sales": [
        ("s1", " p1 ", 2.0, 3, "2022-3-7", "c1"),
        ("s2", "P1", 3.0, 7, "2022-11-28", "c2"),
        ("s3", "P2", 5.0, 60, "2022-1-1", "c9"),
        ("s4", "P1", 1.0, 50, "2022-11-28", "c1"),
        ("s5", "P3", 4.0, 51, "2022-2-2", "c3"),
        ("s5", "P3", 4.0, 51, "2022-2-2", "c3"),
        ("s6", None, 4.0, 1, "2022-2-2", "c3"),
    ],
    "stock": [
        ("p1", 30, "10% off", 5, " north ", "2022-1-5"),
        ("P2", 31, "10 % off", 6, "South", "2022-1-6"),
        (" P3", 10, "10% off", 7, "East", "2022-1-7"),
        ("P9", 10, None, 7, "East", "2022-1-7"),
    ],
    "supplier": [("u1", "P1 ", 11, 9.0, "2022-1-1"), ("u3", "p3", 13, 9.0, "2022-1-3"), ("u2", "P2", 12, None, "2022-1-2")],
    "customer": [
        ("c1", " ann ", 30, "female", 1, "a@x"), ("c2", "Bob", 31, "male", 2, "b@x"), ("c3", "Cy", 32, "other", 3, "c@x"),
        ("c4", None, 33, "male", 4, "d@x"),
    ],
    "market": [("P1", 1.5, 1, 2), ("p1", 1.5, 1, 2), ("P3", 2.5, 3, 4), ("P2", None, 3, 4)],
    "logistic": [("P1", 0.1, 0.2, 0.3), ("P2", 0.4, 0.5, 0.6), ("P3", None, 0.5, 0.6)],
}


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.createDataFrame(r, retail.SCHEMAS[n]) for n, r in TABLES.items()}


@pytest.fixture(scope="module")
def joined(tables):
    return retail.clean_and_join(tables).persist()


def test_cleaning(tables, rows):
    clean = retail.clean_tables(tables)
    assert rows(clean["sales"], "sales_id", "product_name") == [("s1", "P1"), ("s2", "P1"), ("s3", "P2"), ("s4", "P1"), ("s5", "P3")]
    # Blanks stay in the product names of the stock table.
    assert rows(clean["stock"], "product_name", "location") == [(" P3", "EAST"), ("P1", "NORTH"), ("P2", "SOUTH")]
    assert rows(clean["customer"], "customer_id", "customer_name") == [("c1", "ANN"), ("c2", "BOB")]
    # Rows that differ in case only are told apart when repeats are removed.
    assert rows(clean["market"], "product_name") == [("P1",), ("P1",), ("P3",)]
    assert "price" not in clean["supplier"].columns
    assert clean["sales"].schema["date_of_sale"].dataType.typeName() == "date"
    assert rows(clean["sales"].where("sales_id = 's1'"), "date_of_sale") == [(dt.date(2022, 3, 7),)]


def test_joined_rows(joined, rows):
    got = rows(joined, "sales_id", "shelf_life", "sup_id", "competitor_price", "shipping_cost", "customer_name")
    assert got == [
        ("s1", 30, "u1", 1.5, 0.1, "ANN"), ("s1", 30, "u1", 1.5, 0.1, "ANN"),
        ("s2", 30, "u1", 1.5, 0.1, "BOB"), ("s2", 30, "u1", 1.5, 0.1, "BOB"),
        ("s3", 31, None, None, 0.4, None),
        ("s4", 30, "u1", 1.5, 0.1, "ANN"), ("s4", 30, "u1", 1.5, 0.1, "ANN"),
        ("s5", None, "u3", 2.5, None, None),
    ]


def test_chain_equals_plain_joins(tables, rows):
    clean = retail.clean_tables(tables)
    plain = clean["sales"]
    for name in ("stock", "supplier", "market", "logistic"):
        plain = plain.join(clean[name], "product_name", "left")
    plain = plain.join(clean["customer"], "customer_id", "left")
    ours = retail.join_tables(clean)
    assert sorted(ours.columns) == sorted(plain.columns)
    assert rows(ours, *plain.columns) == rows(plain)


def test_golden_running_average(spark, rows):
    sales = [("P1", 3, dt.date(2022, 3, 7), "a"), ("P1", 7, dt.date(2022, 11, 28), "b"), ("P2", 60, dt.date(2022, 1, 1), "c")]
    df = spark.createDataFrame(sales, "product_name string, quantity_sold int, date_of_sale date, sales_id string")
    found = retail.add_forecast(df.withColumn("shelf_life", df["quantity_sold"]), ["sales_id"])
    flags = retail.add_flags(found)
    assert rows(flags, "sales_id", "rolling_avg_sales", "prev_sales", "next_sales", "sales_status") == [
        ("a", 3.0, None, 5.0, "bad"), ("b", 5.0, 3.0, None, "bad"), ("c", 60.0, None, None, "good"),
    ]
    assert rows(retail.add_running_sales(df), "sales_id", "rolling_avg_sales") == [("a", 3.0), ("b", 5.0), ("c", 60.0)]


def test_flags_and_reports(joined, rows):
    data = retail.add_flags(joined)
    # An unknown shelf life counts as not perishable.
    assert rows(retail.perishable_counts(data)) == [("no", 2), ("yes", 6)]
    assert rows(retail.status_counts(data)) == [("bad", 6), ("good", 2)]
    assert rows(retail.promotion_count(data)) == [(6,)]
    assert rows(retail.promotion_count(data, "10 % off")) == [(1,)]
    assert ("u1", 2.0) in rows(retail.price_by_supplier(data))


def test_files_to_reports(spark, tables, tmp_path, rows):
    for name, fmt in retail.FORMATS.items():
        writer = tables[name].coalesce(1).write
        target = str(tmp_path / name)
        writer.option("header", True).csv(target) if fmt == "csv" else writer.json(target)
    reports = retail.run(spark, str(tmp_path))
    assert rows(reports["promotions"]) == [(6,)]
    stored = spark.read.parquet(str(tmp_path / "app" / "data.parquet"))
    by_name = {r["product_name"]: r for r in stored.collect()}
    assert by_name["P1"]["total_sales"] == 2 * (2 * 3 + 3 * 7 + 1 * 50)
    assert by_name["P2"]["total_prev_sales"] is None
    assert spark.read.parquet(str(tmp_path / "app1" / "data.parquet")).count() == 3
    cleaned = retail.read_cleaned(spark, str(tmp_path / "cleaned"))
    assert cleaned.select("row_key").distinct().count() == cleaned.count() == 8
