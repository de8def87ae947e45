import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import tiles
from tallyloom.plans import matrix_jobs

rng = np.random.default_rng(7)


def dense(x):
    out = np.full((x.rows, x.cols), np.nan)
    for t in x.tiles.collect():
        r, c = t["bi"] * x.tile_rows, t["bj"] * x.tile_cols
        out[r : r + t["n"], c : c + t["m"]] = np.array(t["data"]).reshape(t["n"], t["m"])
    return out


def matrix(spark, values, tile_rows, tile_cols):
    return tiles.from_lists(spark, values.tolist(), tile_rows, tile_cols)


def test_literal_with_ragged_edges(spark, rows):
    x = tiles.from_lists(spark, [[1, 2, 3], [4, 5, 6], [7, 8, 9]], 2, 2)
    assert x.tiles.count() == 4
    assert dense(matrix_jobs.shifted_double(x)).tolist() == [[4, 6, 8], [10, 12, 14], [16, 18, 20]]
    assert rows(tiles.to_coordinates(x))[:4] == [(0, 0, 1.0), (0, 1, 2.0), (0, 2, 3.0), (1, 0, 4.0)]


def test_missing_and_repeated_cells(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (2, 1, 5.0)], "i int, j int, v double")
    x = tiles.from_coordinates(cells, 3, 2, 3, 2)
    assert dense(x).tolist() == [[3, 0], [0, 0], [0, 5]]


def test_kernels(spark):
    v = rng.random((5, 7))
    x = matrix(spark, v, 2, 3)
    assert np.allclose(dense(tiles.map_blocks(x, tiles.sin_cos_rounds(20))), 1)
    assert np.allclose(dense(tiles.map_blocks(x, tiles.root_rounds(50))), np.sqrt(v**2 + 50))
    assert np.allclose(dense(tiles.transpose(x)), v.T)


@pytest.mark.parametrize("small_limit", [0, tiles.SMALL_MATRIX])
@pytest.mark.parametrize("a_tile,b_tile", [((3, 4), (4, 2)), ((3, 4), (5, 6)), ((100, 100), (1, 100)), ((1, 11), (11, 1))])
def test_matmul(spark, small_limit, a_tile, b_tile):
    a, b = rng.random((9, 11)), rng.random((11, 8))
    got = tiles.matmul(matrix(spark, a, *a_tile), matrix(spark, b, *b_tile), fan_in=2, small_limit=small_limit)
    assert got.rows == 9 and got.cols == 8
    assert np.allclose(dense(got), a @ b)


def test_shuffled_values_are_at_most_tasks_times_result(spark):
    """40 inner blocks in few tasks: a task passes on one tile per place, not one per place and inner block."""
    a, b = rng.random((6, 80)), rng.random((80, 4))
    x, y = matrix(spark, a, 3, 2), matrix(spark, b, 2, 2)
    met = tiles.partial_products(x, y).withColumn("task", F.spark_partition_id())
    per_task = met.groupBy("task").agg(F.sum(F.col("n") * F.col("m")).alias("values"), F.count("*").alias("tiles")).collect()
    assert all(r["values"] <= 6 * 4 and r["tiles"] <= 4 for r in per_task)
    assert sum(r["tiles"] for r in per_task) < 40 * 4
    assert np.allclose(dense(tiles.matmul(x, y, fan_in=3, small_limit=0)), a @ b)


@pytest.mark.parametrize("limit", [1, 5, 24])
def test_sums_inside_a_task_are_bounded(limit):
    dots = [(bi, bj, k, np.full((1, 2), 10.0**k)) for k in range(4) for bi in range(3) for bj in range(2)]
    made = list(tiles._accumulated(((bi, bj, k, t.copy()) for bi, bj, k, t in dots), limit))
    assert len({(bi, bj, k) for bi, bj, k, _ in made}) == len(made)
    total = {}
    for bi, bj, _, t in made:
        total[bi, bj] = total.get((bi, bj), 0) + t
    assert all(v.tolist() == [[1111.0, 1111.0]] for v in total.values()) and len(total) == 6
    assert len(made) == (6 if limit == 24 else 24)


def test_copies_are_bounded_by_bytes(spark):
    tall, square = tiles.TileMatrix(None, 10**6, 100, 1000, 100), tiles.TileMatrix(None, 100, 100, 100, 100)
    assert tiles._copies(tall, square, 500) == 500
    assert tiles._copies(square, square, 500) == 1  # one block has nothing to spread
    wide = tiles.TileMatrix(None, 10_000, 10_000, 100, 100)
    assert tiles._copies(wide, wide, 20_000) == tiles.COPY_FACTOR


def test_matmul_with_a_single_inner_block_uses_all_tasks(spark):
    a = rng.random((12, 2))
    x = matrix(spark, a, 1, 2)
    assert np.allclose(dense(tiles.matmul(x, tiles.transpose(x), small_limit=0)), a @ a.T)
    with pytest.raises(ValueError):
        tiles.matmul(x, x)


@pytest.mark.parametrize("shape", [(1, 1), (4, 3), (100, 2), (3, 100)])
def test_rechunk(spark, shape):
    v = rng.random((10, 9))
    x = matrix(spark, v, 3, 4)
    y = tiles.rechunk(x, *shape)
    assert np.array_equal(dense(y), v)
    assert y.tiles.count() == y.row_blocks * y.col_blocks
    assert abs(matrix_jobs.rechunked_std(x, *shape).first()["std"] - v.std()) < 1e-12


def test_rows_gram_and_stats(spark):
    v = rng.random((40, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id bigint, e array<float>").repartition(5)
    x = tiles.from_rows(df, "id", "e", 40, 6)
    assert np.array_equal(dense(x), v.astype(float))
    g = np.zeros((6, 6))
    for r in tiles.gram(df, "e", 6).collect():
        g[r["i"], r["j"]] = r["v"]
    assert np.allclose(g, v.astype(float).T @ v.astype(float))
    s = tiles.matrix_stats(x).first()
    assert np.allclose([s["total"], s["mean"], s["std"]], [v.sum(dtype=float), v.mean(dtype=float), v.std(dtype=float)])


@pytest.mark.parametrize("options", [{"band": 4}, {"band": 4, "values": 32}, {"band": 4, "values": 1, "fan_in": 2}, {"band": 64}])
def test_gram_of_many_columns(spark, options):
    v = rng.random((30, 11))
    df = spark.createDataFrame([(r.tolist(),) for r in v] + [(None,)], "e array<double>").repartition(3)
    cells = tiles.gram(df, "e", 11, **options).collect()
    g = np.full((11, 11), np.nan)
    for r in cells:
        g[r["i"], r["j"]] = r["v"]
    assert len(cells) == 121 and np.allclose(g, v.T @ v)
    assert tiles.gram(df.limit(0), "e", 11, **options).count() == 0


def test_gram_of_wide_rows_in_one_scan(spark):
    """2,100 columns are 15 pairs of bands and one scan; a task sends one row per pair, not one per cell."""
    v = rng.random((12, 2100))
    df = spark.createDataFrame([(r.tolist(),) for r in v], "e array<double>").repartition(3)
    made = tiles.gram_tiles(df, "e", 2100)
    plan = made.tiles._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Generate" not in plan
    assert len(tiles._band_pairs(10_000, tiles.BAND, tiles.GRAM_VALUES)) == 1
    assert np.allclose(dense(made), v.T @ v)
    with pytest.raises(Exception, match="2100 values, 7 expected"):
        tiles.gram(df, "e", 7).collect()


def test_both_multiply_forms_give_the_same_tiles(spark):
    a, b = rng.random((5, 7)), rng.random((7, 6))
    forms = [tiles.matmul(matrix(spark, a, 2, 3), matrix(spark, b, 3, 4), small_limit=n) for n in (0, 1 << 22)]
    shapes = [sorted((r["bi"], r["bj"], r["n"], r["m"]) for r in f.tiles.collect()) for f in forms]
    assert shapes[0] == shapes[1] and len(shapes[0]) == 6 and forms[0].tile_cols == forms[1].tile_cols


def test_iterated_map(spark):
    v = rng.random((6, 6)) / 8
    want = v
    for _ in range(3):
        want = np.tanh(want @ want.T)
    x = matrix(spark, v, 4, 4)
    assert np.allclose(dense(tiles.tanh_gram_rounds(x, 3, small_limit=0)), want)
    assert abs(matrix_jobs.iterated_mean(x, 3).first()["mean"] - want.mean()) < 1e-12


def test_random_matrix_is_repeatable(spark):
    x = tiles.random_matrix(spark, 7, 5, 3, 2, seed=1)
    a, b = dense(x), dense(tiles.random_matrix(spark, 7, 5, 3, 2, seed=1))
    assert np.array_equal(a, b) and a.min() >= 0 and a.max() < 1 and len(np.unique(a)) == 35
    y = tiles.random_matrix(spark, 5, 7, 2, 3, seed=2)
    assert abs(matrix_jobs.product_total(x, y, small_limit=0).first()["total"] - (a @ dense(y)).sum()) < 1e-9
    assert abs(matrix_jobs.root_mean(x, 5, 4, 4).first()["mean"] - np.sqrt(a**2 + 5).mean()) < 1e-12


def test_persisted_is_released(spark):
    x = tiles.random_matrix(spark, 4, 4, 2, 2)
    with tiles.persisted(tiles.elementwise(x, lambda v: v + F.lit(1.0))) as y:
        assert y.tiles.is_cached
        total = tiles.matrix_stats(matrix_jobs.squares_of_shifted(y)).first()["total"]
    assert not y.tiles.is_cached
    assert abs(total - ((dense(x) + 1) ** 2).sum()) < 1e-9


def test_rows_from_ids_with_gaps(spark):
    df = spark.createDataFrame([(4, [1.0, 2.0]), (0, [3.0, 4.0]), (7, [5.0, 6.0])], "id bigint, e array<double>")
    x = tiles.from_sparse_rows(df, "id", "e", 2)
    want = np.zeros((8, 2))
    want[[4, 0, 7]] = [[1, 2], [3, 4], [5, 6]]
    assert (x.rows, x.cols) == (8, 2) and np.array_equal(dense(x), want)
    assert tiles.matrix_stats(x).first()["mean"] == pytest.approx(want.mean())
    assert tiles.from_sparse_rows(df.limit(0), "id", "e", 2).tiles.count() == 0


@pytest.mark.parametrize("ids", [[0, 0, 2], [-1, 0], [None, 0]])
def test_ids_that_number_no_rows(spark, ids):
    df = spark.createDataFrame([(i, [1.0]) for i in ids], "id bigint, e array<double>")
    with pytest.raises(ValueError):
        tiles.from_sparse_rows(df, "id", "e", 1)


@pytest.mark.parametrize("row", [(1, [1.0]), (1, [1.0, 2.0, 3.0]), (1, None), (1, [None, 1.0]), (9, [1.0, 2.0]), (None, [1.0, 2.0])])
def test_ill_formed_rows_raise(spark, row):
    df = spark.createDataFrame([(0, [1.0, 2.0]), row], "id bigint, e array<double>")
    with pytest.raises(Exception, match="no row of a 2 x 2 matrix"):
        tiles.from_rows(df, "id", "e", 2, 2).tiles.collect()
