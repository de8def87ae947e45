import pytest
from pyspark.sql import functions as F

from tallyloom import scratch, session
from tallyloom.operators import clean, topk
from tallyloom.operators.partitions import union_of_conditions, union_parts, union_totals
from tallyloom.sinks import tables, writers
from tallyloom.sources import readers


def test_append_or_create(spark, rows):
    tables.create_database(spark, "bank")
    batch = spark.createDataFrame([(1, "a")], "id int, name string")
    assert tables.append_or_create(batch, "bank.trx") == "created"
    assert tables.append_or_create(batch.select("name", (F.col("id") + 1).alias("id")), "bank.trx") == "appended"
    assert rows(readers.read_table(spark, "bank.trx"), "id", "name") == [(1, "a"), (2, "a")]
    # A batch that does not fit must not replace the table.
    with pytest.raises(Exception):
        tables.append_or_create(batch.select("id"), "bank.trx")
    assert spark.table("bank.trx").count() == 2
    tables.overwrite_table(batch, "bank.trx")
    assert spark.table("bank.trx").count() == 1
    assert [r["tableName"] for r in tables.list_tables(spark, "bank").collect()] == ["trx"]
    assert "bank" in [r[0] for r in tables.list_databases(spark, "ba*").collect()]
    assert tables.table_exists(spark, "bank.trx") and not tables.table_exists(spark, "bank.none")


def test_formats(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a,b", 0.1), (2, 'q"x', -2.5), (3, None, None)], "id int, name string, v double")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert rows(readers.load(spark, "csv", str(tmp_path / "csv"), df.schema)) == rows(df)
    assert rows(readers.read_csv(spark, str(tmp_path / "csv"), "id int, name string, v double")) == rows(df)
    writers.write_json(df, str(tmp_path / "json"))
    assert rows(readers.load(spark, "json", str(tmp_path / "json"), df.schema)) == rows(df)
    writers.write_parquet(df, str(tmp_path / "parquet"))
    assert rows(readers.load(spark, "parquet", str(tmp_path / "parquet"))) == rows(df)
    with pytest.raises(ValueError):
        readers.load(spark, "csv", str(tmp_path / "csv"))
    df.select("id").write.csv(str(tmp_path / "plain"))
    assert rows(readers.read_csv_untyped(spark, str(tmp_path / "plain"))) == [("1",), ("2",), ("3",)]


def test_json_array_file(spark, tmp_path, rows):
    (tmp_path / "stock.json").write_text('[{"product_name":"P1","shelf_life":3},{"product_name":"P2","shelf_life":4}]')
    df = readers.read_json(spark, str(tmp_path / "stock.json"), "product_name string, shelf_life int")
    assert rows(df) == [("P1", 3), ("P2", 4)]


def test_sorted_write_and_rank(spark, tmp_path):
    df = spark.range(5000).select("id", (F.col("id") * 7919 % 5000).alias("v"))
    writers.write_sorted(df, str(tmp_path / "s"), F.desc("v"))
    ranked = writers.stored_rank(spark.read.parquet(str(tmp_path / "s")))
    assert ranked.where(F.col("stored_rank") != 5000 - F.col("v")).isEmpty()
    assert len(spark.read.parquet(str(tmp_path / "s")).inputFiles()) >= 1


def test_scratch_is_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    stored = scratch.materialise(spark.range(10).withColumn("n", F.lit(None).cast("int")), "t")
    assert all(shared in f for f in stored.inputFiles()) and stored.count() == 10
    assert "Range" not in writers.plan_text(stored)
    other = scratch.materialise(spark.range(3).toDF("id"), "t")
    scratch.discard(spark, stored)
    assert other.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(stored.inputFiles()[0]).count()


def test_discard_spares_other_folders(spark, tmp_path):
    path = str(tmp_path / "mine")
    writers.write_parquet(spark.range(3).toDF("id"), path)
    scratch.discard(spark, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3


def test_session_presets():
    assert session.shuffle_partitions_for(1 << 40) == 4096 and session.shuffle_partitions_for(1, cores=8) == 8
    assert session.CLUSTER["spark.sql.shuffle.partitions"] == "20000"


def test_cleaning_and_topk(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "B ")], "id int, name string")
    assert rows(clean.clean_data(df)) == [(1, "a"), (3, "B ")]
    assert rows(clean.normalise_strings(df, {"name": ("upper", "trim")}), "name") == [("A",), ("A",), ("B",), (None,)]
    assert rows(topk.top_k(df, 2, "id", "name"), "id") == [(2,), (3,)]
    assert topk.first_rows(df, 2).count() == 2
    assert [r["id"] for r in topk.sort_descending(df, "id").collect()] == [3, 2, 1, 1]
    assert rows(df.drop("nothing")) == rows(df)


def test_append_refuses_other_columns(spark):
    batch = spark.range(3).withColumn("name", F.lit("x"))
    tables.create_database(spark, "strict")
    tables.append_or_create(batch, "strict.rows")
    with pytest.raises(ValueError, match="extra"):
        tables.append_or_create(batch.withColumn("extra", F.lit(1)), "strict.rows")
    assert spark.table("strict.rows").count() == 3


def test_gather_refuses_to_cut(spark):
    assert len(writers.gather(spark.range(5), 5)) == 5
    with pytest.raises(ValueError, match="more than 4"):
        writers.gather(spark.range(5), 4)


def test_union_of_conditions_in_one_scan(spark, rows):
    made = spark.createDataFrame([(1, "a", 1.0), (2, None, None), (2, "a", 4.0), (None, "b", 8.0)], "n int, k string, v double")
    parts = {"two": F.col("n") == 2, "any": F.lit(True), "a": F.col("k") == "a", "none": F.lit(False)}
    literal = union_parts([made.where(test).withColumn("part", F.lit(name)) for name, test in parts.items()])
    tagged = union_of_conditions(made, parts)
    assert rows(tagged, "part", "n", "k", "v") == rows(literal, "part", "n", "k", "v")
    expected = literal.groupBy("part", "k").agg(F.count("*").alias("n_rows"), F.sum("v").alias("v"))
    assert rows(union_totals(made, parts, ["k"], ["v"]), "part", "k", "n_rows", "v") == rows(expected, "part", "k", "n_rows", "v")
    assert union_totals(made.limit(0), parts, ["k"], ["v"]).isEmpty()


def test_json_arrays(spark, rows, tmp_path):
    made = spark.createDataFrame([(1, 'a "quoted",\nline', 1.5), (2, None, None), (None, "[x]", -0.0), (2, None, None)], "n int, s string, v double")
    path = str(tmp_path / "arrays")
    writers.write_json_arrays(made.repartition(2), path)
    assert rows(readers.read_json(spark, path, made.schema)) == rows(made)
    assert all(r["value"].startswith("[{") and r["value"].endswith("}]") for r in readers.read_text(spark, path).collect())
    writers.write_json_arrays(made.limit(0), path)
    assert readers.read_json(spark, path, made.schema).isEmpty()
