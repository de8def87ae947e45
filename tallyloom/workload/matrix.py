"""Matrix queries on the stored embeddings: one row per vector, 64 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators import tiles
from tallyloom.operators.tiles import TileMatrix
from tallyloom.plans import matrix_jobs
from tallyloom.scratch import materialise
from tallyloom.workload.registry import query, table

COLS = 64

_CELLS = """SELECT vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"""
_GRAM = f"SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.i = b.i GROUP BY ALL"


def _matrix(spark: SparkSession, sf: str) -> TileMatrix:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return tiles.from_rows(vectors, "vec_id", "embedding", vectors.count(), COLS)


def _cells(x: TileMatrix, digits: int = 6) -> DataFrame:
    return tiles.to_coordinates(x).withColumn("v", F.round("v", digits))


def _scaled_gram(spark: SparkSession, sf: str) -> TileMatrix:
    vectors = table(spark, sf, "embeddings").select("embedding")
    n = vectors.count()
    cells = tiles.gram(vectors, "embedding", COLS).select("i", "j", (F.col("v") / n).alias("v"))
    return tiles.stored(tiles.from_coordinates(cells, COLS, COLS, 24, 24, unique=True))


@query(f"SELECT i, j, round((v + 1) * 2, 6) AS v FROM ({_CELLS})")
def matrix_elementwise(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(matrix_jobs.shifted_double(_matrix(spark, sf)))


@query(f"SELECT i, j, round(sqrt(v * v + 50), 6) AS v FROM ({_CELLS})")
def matrix_blockmap(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(tiles.map_blocks(_matrix(spark, sf), tiles.root_rounds(50)))


@query(f"SELECT i, j, CAST(1 AS DOUBLE) AS v FROM ({_CELLS})")
def matrix_sin_cos(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(tiles.map_blocks(_matrix(spark, sf), tiles.sin_cos_rounds(20)))


@query(f"WITH c AS ({_CELLS}) SELECT i, j, round(v, 6) AS v FROM ({_GRAM})")
def matrix_gram(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return tiles.gram(vectors, "embedding", COLS).withColumn("v", F.round("v", 6))


@query(f"WITH c AS ({_CELLS}) SELECT i, j, round(v, 6) AS v FROM ({_GRAM})")
def matrix_multiply(spark: SparkSession, sf: str) -> DataFrame:
    """The product of the transpose and the matrix, joined tile by tile."""
    x = tiles.stored(tiles.rechunk(_matrix(spark, sf), 100, 24))
    return _cells(tiles.matmul(tiles.transpose(x), x, small_limit=0))


@query(
    f"""WITH c AS ({_CELLS}), g AS ({_GRAM})
        SELECT c.i, g.j, round(sum(c.v * g.v), 5) AS v FROM c JOIN g ON c.j = g.i GROUP BY ALL"""
)
def matrix_multiply_small(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix times a small square one, which every task holds."""
    cells = tiles.gram(table(spark, sf, "embeddings"), "embedding", COLS)
    return _cells(tiles.matmul(_matrix(spark, sf), tiles.from_coordinates(cells, COLS, COLS, 32, 32, unique=True)), 5)


@query(f"SELECT j AS i, i AS j, round(v, 6) AS v FROM ({_CELLS})")
def matrix_transpose(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(tiles.transpose(_matrix(spark, sf)))


@query(
    f"""WITH n AS (SELECT count(*) AS rows FROM embeddings)
        SELECT i // 120 AS bi, j // 25 AS bj, CAST(least(120, max(rows) - (i // 120) * 120) AS INTEGER) AS n,
               CAST(least(25, 64 - (j // 25) * 25) AS INTEGER) AS m, count(*) AS n_values, round(sum(v), 5) AS total, round(sum(v * (i + 2 * j)), 3) AS placed
        FROM ({_CELLS}) CROSS JOIN n GROUP BY i // 120, j // 25"""
)
def matrix_rechunk(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per new tile, one of them weighted with the place of every value."""
    x = tiles.rechunk(_matrix(spark, sf), 120, 25)
    row = F.col("bi") * 120 + F.floor(F.col("p") / F.col("m"))
    col = F.col("bj") * 25 + F.col("p") % F.col("m")
    values = x.tiles.select("bi", "bj", "n", "m", F.posexplode("data").alias("p", "v"))
    return values.groupBy("bi", "bj", "n", "m").agg(
        F.count("*").alias("n_values"), F.round(F.sum("v"), 5).alias("total"), F.round(F.sum(F.col("v") * (row + 2 * col)), 3).alias("placed")
    )


@query(f"SELECT round(sum(v), 6) AS total, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std FROM ({_CELLS})")
def matrix_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = tiles.matrix_stats(_matrix(spark, sf))
    return stats.select(F.round("total", 6).alias("total"), F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


ITERATIONS = 6


def _iterate_sql(rounds: int) -> str:
    parts = [f"WITH c AS ({_CELLS})", f"x0 AS MATERIALIZED (SELECT i, j, v / (SELECT count(*) FROM embeddings) AS v FROM ({_GRAM}))"]
    for k in range(rounds):
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT a.i, b.i AS j, tanh(sum(a.v * b.v)) AS v FROM x{k} a JOIN x{k} b ON a.j = b.j GROUP BY a.i, b.i)")
    return ",\n".join(parts) + f"\nSELECT i, j, round(v, 9) AS v FROM x{rounds}"


@query(_iterate_sql(ITERATIONS))
def matrix_iterate(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(tiles.tanh_gram_rounds(_scaled_gram(spark, sf), ITERATIONS, small_limit=0), 9)


@query(f"SELECT round(sum(v + 1), 5) AS total, round(sum((v + 1) * (v + 1)), 5) AS squares FROM ({_CELLS})")
def persist_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Two sums over one persisted matrix."""
    with tiles.persisted(tiles.elementwise(_matrix(spark, sf), lambda v: v + 1)) as y:
        total = materialise(tiles.matrix_stats(y).select("total"), "total")
        squares = materialise(tiles.matrix_stats(matrix_jobs.squares_of_shifted(y)).select(F.col("total").alias("squares")), "squares")
    both = total.select(F.lit(1).alias("k"), "total").join(squares.select(F.lit(1).alias("k"), "squares"), "k")
    return both.select(F.round("total", 5).alias("total"), F.round("squares", 5).alias("squares"))


@query(
    """WITH c AS (SELECT 3 * vec_id AS i, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT j, (SELECT 3 * max(vec_id) + 1 FROM embeddings) AS n_rows, count(*) FILTER (WHERE v <> 0) AS n_filled, round(sum(v), 6) AS total FROM c GROUP BY j"""
)
def matrix_sparse_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of a matrix from ids with gaps: every third row is given, the others are zeros."""
    vectors = table(spark, sf, "embeddings").select((3 * F.col("vec_id")).alias("id"), "embedding")
    cells = tiles.to_coordinates(tiles.from_sparse_rows(vectors, "id", "embedding", COLS))
    return cells.groupBy("j").agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("v") != 0, 1)).alias("n_filled"), F.round(F.sum("v"), 6).alias("total"))
