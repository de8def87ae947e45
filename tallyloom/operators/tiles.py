"""Dense matrices as tables of tiles.

A tile is a row ``bi, bj, n, m, data``: block position, shape and the values in
row order. Spark places, joins and groups the tiles; numpy works inside one
tile (or one Arrow batch of tiles) at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.scratch import discard, materialise

TILE = "bi bigint, bj bigint, n int, m int, data array<double>"

# Largest right-hand matrix (in values) that is sent to every executor: 32 MiB.
SMALL_MATRIX = 1 << 22


@dataclass(frozen=True)
class TileMatrix:
    """Tiles and the shape they make up. Edge tiles may be smaller than the rest."""

    tiles: DataFrame
    rows: int
    cols: int
    tile_rows: int
    tile_cols: int

    @property
    def row_blocks(self) -> int:
        return -(-self.rows // self.tile_rows)

    @property
    def col_blocks(self) -> int:
        return -(-self.cols // self.tile_cols)


# --- inside a task ----------------------------------------------------------


def _column_arrays(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        return [a for chunk in column.chunks for a in _column_arrays(chunk)]
    ends = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[ends[i] : ends[i + 1]] for i in range(len(column))]


def _list_column(arrays: Sequence[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([a.size for a in arrays], out=ends[1:])
    flat = np.concatenate([a.ravel() for a in arrays]) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.float64, copy=False)))


def _batch(columns: dict[str, object]) -> pa.RecordBatch:
    arrays = [
        v if isinstance(v, pa.Array) else pa.array(np.asarray(v, dtype=np.int64 if name in ("bi", "bj", "k") else np.int32))
        for name, v in columns.items()
    ]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _packed(pieces: Iterable[tuple], values: int = 1 << 22) -> Iterator[list[tuple]]:
    """Lists of pieces (their last item is an array) of about ``values`` values, made as they are needed."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += piece[-1].size
        if size >= values:
            yield held
            held, size = [], 0
    if held:
        yield held


def _piece_batch(names: Sequence[str], pieces: Sequence[tuple]) -> pa.RecordBatch:
    """Pieces as rows: the named numbers, the shape, the values."""
    arrays = [p[-1] for p in pieces]
    numbers = {name: [p[i] for p in pieces] for i, name in enumerate(names)}
    return _batch(
        {**numbers, "n": [a.shape[0] for a in arrays], "m": [a.shape[1] for a in arrays], "data": _list_column(arrays)}
    )


def _tile_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    shape = zip(*[batch.column(c).to_pylist() for c in ("bi", "bj", "n", "m")])
    for (bi, bj, n, m), flat in zip(shape, _column_arrays(batch.column("data"))):
        yield bi, bj, flat.reshape(n, m)


def _tile_batch(tiles: Sequence[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return _piece_batch(("bi", "bj"), tiles)


# --- building ---------------------------------------------------------------


def _checked(row: Column, vector: Column, rows: int, cols: int) -> Column:
    """The vector as doubles; an error for an id outside 0..rows-1, a null vector or value, or another length."""
    fits = row.between(0, rows - 1) & (F.size(vector) == cols) & F.forall(vector, lambda v: v.isNotNull())
    text = F.concat(F.lit(f"no row of a {rows} x {cols} matrix: id "), F.coalesce(row.cast("string"), F.lit("null")))
    return F.when(fits, vector.cast("array<double>")).otherwise(F.raise_error(text).cast("array<double>"))


def from_rows(df: DataFrame, row: str, vector: str, rows: int, cols: int) -> TileMatrix:
    """Matrix whose tiles are the rows of a table with an array column; nothing is moved.

    ``row`` numbers the rows from 0, each number once. Ids out of range, nulls and vectors of another length raise when
    the matrix is read; gaps and repeated ids are not looked for, see ``from_sparse_rows``.
    """
    tiles = df.select(
        F.col(row).cast("bigint").alias("bi"), F.lit(0).cast("bigint").alias("bj"), F.lit(1).alias("n"), F.lit(cols).alias("m"),
        _checked(F.col(row).cast("bigint"), F.col(vector), rows, cols).alias("data"),
    )
    return TileMatrix(tiles, rows, cols, 1, cols)


def from_sparse_rows(df: DataFrame, row: str, vector: str, cols: int) -> TileMatrix:
    """Matrix of max id + 1 rows; ids that the table lacks are rows of zeros. Vectors are not moved, only ids are.

    Repeated, negative and null ids raise here, ill-formed vectors when the matrix is read. An empty table has no rows.
    """
    ids = df.select(F.col(row).cast("bigint").alias("id"))
    low, high, n, nulls = ids.agg(F.min("id"), F.max("id"), F.count(F.lit(1)), F.count(F.when(F.col("id").isNull(), 1))).first()
    if nulls or low is not None and low < 0:
        raise ValueError(f"{row} holds {nulls} nulls, least id {low}")
    rows = 0 if high is None else high + 1
    lacking = materialise(df.sparkSession.range(rows).join(ids, "id", "left_anti"), "matrix-gaps")
    if n + lacking.count() != rows:
        raise ValueError(f"{row} holds ids more than once")
    zeros = lacking.select(F.col("id").alias(row), F.array_repeat(F.lit(0.0), cols).alias(vector))
    given = df.select(row, F.col(vector).cast("array<double>").alias(vector))
    return from_rows(given.unionByName(zeros), row, vector, rows, cols)


def from_coordinates(
    cells: DataFrame, rows: int, cols: int, tile_rows: int, tile_cols: int, unique: bool = False
) -> TileMatrix:
    """Matrix from ``i, j, v``. Cells that are missing are 0, repeated ones are added up.

    With ``unique=True`` the cells are taken to be distinct and the adding-up is skipped.
    """
    if not unique:
        cells = cells.groupBy("i", "j").agg(F.sum("v").alias("v"))
    placed = cells.select(
        F.floor(F.col("i") / tile_rows).alias("bi"),
        F.floor(F.col("j") / tile_cols).alias("bj"),
        (F.col("i") % tile_rows).cast("int").alias("r"),
        (F.col("j") % tile_cols).cast("int").alias("c"),
        F.col("v").cast("double").alias("v"),
    )

    def fill(key: tuple, group: pa.Table) -> pa.Table:
        bi, bj = key[0].as_py(), key[1].as_py()
        tile = np.zeros((min(tile_rows, rows - bi * tile_rows), min(tile_cols, cols - bj * tile_cols)))
        tile[group["r"].to_numpy(), group["c"].to_numpy()] = group["v"].to_numpy()
        return pa.Table.from_batches([_tile_batch([(bi, bj, tile)])])

    # At most tile_rows * tile_cols cells meet in one group.
    tiles = placed.groupBy("bi", "bj").applyInArrow(fill, TILE)
    return TileMatrix(tiles, rows, cols, tile_rows, tile_cols)


def from_lists(spark: SparkSession, values: Sequence[Sequence[float]], tile_rows: int, tile_cols: int) -> TileMatrix:
    """A small matrix written down in the program."""
    cells = [(i, j, float(v)) for i, line in enumerate(values) for j, v in enumerate(line)]
    frame = spark.createDataFrame(cells, "i int, j int, v double")
    return from_coordinates(frame, len(values), len(values[0]), tile_rows, tile_cols, unique=True)


def random_matrix(spark: SparkSession, rows: int, cols: int, tile_rows: int, tile_cols: int, seed: int = 0) -> TileMatrix:
    """Values uniform in [0, 1); each tile depends on the seed and its position only."""
    shape = TileMatrix(None, rows, cols, tile_rows, tile_cols)
    across = shape.col_blocks

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("id").to_pylist():
                bi, bj = divmod(block, across)
                size = (min(tile_rows, rows - bi * tile_rows), min(tile_cols, cols - bj * tile_cols))
                yield _tile_batch([(bi, bj, np.random.default_rng([seed, bi, bj]).random(size))])

    tiles = spark.range(shape.row_blocks * across).mapInArrow(draw, TILE)
    return replace(shape, tiles=tiles)


def to_coordinates(x: TileMatrix) -> DataFrame:
    cells = x.tiles.select("bi", "bj", "m", F.posexplode("data").alias("p", "v"))
    return cells.select(
        (F.col("bi") * x.tile_rows + F.floor(F.col("p") / F.col("m"))).alias("i"),
        (F.col("bj") * x.tile_cols + F.col("p") % F.col("m")).alias("j"),
        "v",
    )


# --- tile by tile -----------------------------------------------------------


def elementwise(x: TileMatrix, fn: Callable[[Column], Column]) -> TileMatrix:
    """Apply a column expression to every value."""
    return replace(x, tiles=x.tiles.withColumn("data", F.transform("data", fn)))


def map_blocks(x: TileMatrix, fn: Callable[[np.ndarray], np.ndarray]) -> TileMatrix:
    """Apply a numpy function that treats every value alike.

    It is called once per Arrow batch, on the values of all its tiles together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles = _column_arrays(batch.column("data"))
            ends = np.cumsum([0] + [t.size for t in tiles]).astype(np.int32)
            values = fn(np.concatenate(tiles)) if tiles else np.zeros(0)
            data = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.asarray(values, dtype=np.float64)))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("bi", "bj", "n", "m")], data], names=["bi", "bj", "n", "m", "data"]
            )

    return replace(x, tiles=x.tiles.mapInArrow(run, TILE))


def sin_cos_rounds(rounds: int = 20) -> Callable[[np.ndarray], np.ndarray]:
    """``sin(x)^2 + cos(x)^2``, repeated."""

    def kernel(values: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            values = np.sin(values) ** 2 + np.cos(values) ** 2
        return values

    return kernel


def root_rounds(rounds: int = 50) -> Callable[[np.ndarray], np.ndarray]:
    """``sqrt(x^2 + 1)``, repeated."""

    def kernel(values: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            values = np.sqrt(values * values + 1)
        return values

    return kernel


def transpose(x: TileMatrix) -> TileMatrix:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _packed((bj, bi, tile.T) for bi, bj, tile in _tile_rows(batch)):
                yield _tile_batch(some)

    return TileMatrix(x.tiles.mapInArrow(run, TILE), x.cols, x.rows, x.tile_cols, x.tile_rows)


# --- moving tiles -----------------------------------------------------------


def rechunk(x: TileMatrix, tile_rows: int, tile_cols: int) -> TileMatrix:
    """The same matrix in tiles of another shape.

    Every tile is cut along the new borders, and a new tile is put together
    from the pieces that overlap it: one shuffle of whole pieces.
    """
    old_rows, old_cols, rows, cols = x.tile_rows, x.tile_cols, x.rows, x.cols

    def cuts(start: int, length: int, step: int) -> Iterator[tuple[int, int, int, int]]:
        """New block, offset inside it, and the range of the old tile that goes there."""
        at = start
        while at < start + length:
            upto = min((at // step + 1) * step, start + length)
            yield at // step, at % step, at - start, upto - start
            at = upto

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = (
                (ni, nj, r, c, tile[r0:r1, c0:c1])
                for bi, bj, tile in _tile_rows(batch)
                for ni, r, r0, r1 in cuts(bi * old_rows, tile.shape[0], tile_rows)
                for nj, c, c0, c1 in cuts(bj * old_cols, tile.shape[1], tile_cols)
            )
            for some in _packed(pieces):
                yield _piece_batch(("bi", "bj", "r", "c"), some)

    def assemble(key: tuple, group: pa.Table) -> pa.Table:
        bi, bj = key[0].as_py(), key[1].as_py()
        tile = np.zeros((min(tile_rows, rows - bi * tile_rows), min(tile_cols, cols - bj * tile_cols)))
        places = zip(*[group[c].to_pylist() for c in ("r", "c", "n", "m")])
        for (r, c, n, m), flat in zip(places, _column_arrays(group["data"])):
            tile[r : r + n, c : c + m] = flat.reshape(n, m)
        return pa.Table.from_batches([_tile_batch([(bi, bj, tile)])])

    pieces = x.tiles.mapInArrow(cut, "bi bigint, bj bigint, r int, c int, n int, m int, data array<double>")
    tiles = pieces.groupBy("bi", "bj").applyInArrow(assemble, TILE)
    return TileMatrix(tiles, rows, cols, tile_rows, tile_cols)


def _sum_products(products: DataFrame, blocks: int, fan_in: int) -> DataFrame:
    """Add up the tiles of one place, ``fan_in`` at a time, so no group outgrows a task."""

    def add(key: tuple, group: pa.Table) -> pa.Table:
        n, m = group["n"][0].as_py(), group["m"][0].as_py()
        whole = np.zeros(n * m)
        for flat in _column_arrays(group["data"]):
            whole += flat
        bi, bj, k = (part.as_py() for part in key)
        return pa.Table.from_batches([_batch({"bi": [bi], "bj": [bj], "k": [k], "n": [n], "m": [m], "data": _list_column([whole])})])

    while blocks > 1:
        blocks = -(-blocks // fan_in)
        products = (
            products.withColumn("k", F.floor(F.col("k") / fan_in))
            .groupBy("bi", "bj", "k")
            .applyInArrow(add, "bi bigint, bj bigint, k bigint, n int, m int, data array<double>")
        )
    return products.select("bi", "bj", "n", "m", "data")


# A spread may copy the smaller side until the copies hold so many times the values of the larger side.
COPY_FACTOR = 4
PRODUCT = "bi bigint, bj bigint, k bigint, n int, m int, data array<double>"


def _accumulated(dots: Iterable[tuple], values: int = SMALL_MATRIX) -> Iterator[tuple]:
    """Products (bi, bj, k, tile) added up by place, as long as the sums hold at most ``values`` values.

    A sum bears the inner block of its first product, so the sums of one place
    differ in it. Where the places of a task fit the bound, one tile per place
    leaves the task, however many inner blocks it has seen.
    """
    held: dict[tuple[int, int], list] = {}
    size = 0
    for bi, bj, k, tile in dots:
        found = held.get((bi, bj))
        if found:
            found[1] += tile
            continue
        if held and size + tile.size > values:
            yield from ((*place, first, whole) for place, (first, whole) in held.items())
            held, size = {}, 0
        held[bi, bj] = [k, tile]
        size += tile.size
    yield from ((*place, first, whole) for place, (first, whole) in held.items())


def _copies(a: TileMatrix, b: TileMatrix, wanted: int) -> int:
    """Over how many copies of the smaller side the larger one is spread: enough for ``wanted`` tasks, bounded by what is copied."""
    left, right = a.rows * a.cols, b.rows * b.cols
    spare = a.row_blocks if left >= right else b.col_blocks
    affordable = COPY_FACTOR * max(left, right) // max(1, min(left, right))
    return max(1, min(spare, affordable, -(-wanted // a.col_blocks)))


def partial_products(a: TileMatrix, b: TileMatrix) -> DataFrame:
    """bi, bj, k, n, m, data: tiles that add up to those of ``a @ b``; at most one per task and place unless a task's sums outgrow their bound."""
    wanted = int(a.tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = a.tiles.select("bi", F.col("bj").alias("k"), "n", F.col("m").alias("inner"), F.col("data").alias("left"))
    right = b.tiles.select(F.col("bi").alias("k"), "bj", "m", F.col("data").alias("right"))
    spread_left, copies = a.rows * a.cols >= b.rows * b.cols, _copies(a, b, wanted)
    every = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    left = left.withColumn("salt", F.col("bi") % copies if spread_left else every)
    right = right.withColumn("salt", every if spread_left else F.col("bj") % copies)

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            place = zip(*[batch.column(c).to_pylist() for c in ("bi", "bj", "k", "n", "inner", "m")])
            pairs = zip(_column_arrays(batch.column("left")), _column_arrays(batch.column("right")))
            for (bi, bj, k, n, inner, m), (x, y) in zip(place, pairs):
                yield bi, bj, k, x.reshape(n, inner) @ y.reshape(inner, m)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _packed(_accumulated(dots(batches))):
            yield _piece_batch(("bi", "bj", "k"), some)

    met = left.join(right, ["k", "salt"]).select("bi", "bj", "k", "n", "inner", "m", "left", "right")
    return met.mapInArrow(multiply, PRODUCT)


def matmul(a: TileMatrix, b: TileMatrix, fan_in: int = 32, small_limit: int = SMALL_MATRIX) -> TileMatrix:
    """``a @ b``.

    A right-hand side of at most ``small_limit`` values (known from its shape)
    is sent to the executors and ``a`` stays where it is; the result has the same
    tiles either way. Otherwise the tiles meet in a join on the inner block; when
    there are fewer inner blocks than tasks, the larger side is spread over copies
    of the smaller one. Tasks add up what belongs to one place before anything is
    shuffled, and the sums of the tasks are added in a tree.
    """
    if a.cols != b.rows:
        raise ValueError(f"shapes do not match: {a.rows}x{a.cols} @ {b.rows}x{b.cols}")
    if b.rows * b.cols <= small_limit:
        return _matmul_small(a, b, fan_in)
    if a.tile_cols != b.tile_rows:
        b = rechunk(b, a.tile_cols, b.tile_cols)
    return TileMatrix(_sum_products(partial_products(a, b), a.col_blocks, fan_in), a.rows, b.cols, a.tile_rows, b.tile_cols)


def _matmul_small(a: TileMatrix, b: TileMatrix, fan_in: int) -> TileMatrix:
    spark = a.tiles.sparkSession
    dense = np.zeros((b.rows, b.cols))
    # Bounded: the caller has checked rows * cols.
    for t in b.tiles.toLocalIterator():
        r, c = t["bi"] * b.tile_rows, t["bj"] * b.tile_cols
        dense[r : r + t["n"], c : c + t["m"]] = np.asarray(t["data"]).reshape(t["n"], t["m"])
    shared = spark.sparkContext.broadcast(dense)
    step, across, width = a.tile_cols, b.cols, b.tile_cols

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for bi, bj, tile in _tile_rows(batch):
                for low in range(0, across, width):
                    yield bi, low // width, bj, tile @ shared.value[bj * step : bj * step + tile.shape[1], low : low + width]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _packed(_accumulated(dots(batches))):
            yield _piece_batch(("bi", "bj", "k"), some)

    products = a.tiles.mapInArrow(multiply, PRODUCT)
    return TileMatrix(_sum_products(products, a.col_blocks, fan_in), a.rows, across, a.tile_rows, width)


# Columns of a band, and the values that the blocks of one task may hold: 512 MiB, enough for 11,585 columns in one scan.
BAND = 512
GRAM_VALUES = 1 << 26


def _band_pairs(cols: int, band: int, values: int) -> list[list[tuple[int, int]]]:
    """All pairs of bands on and above the diagonal, in as few lists as hold at most ``values`` values of blocks each."""
    count = -(-cols // band)
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    step = max(1, values // (band * band))
    return [pairs[k : k + step] for k in range(0, len(pairs), step)]


def gram_tiles(df: DataFrame, vector: str, cols: int, fan_in: int = 32, band: int = BAND, values: int = GRAM_VALUES) -> TileMatrix:
    """``X.T @ X``, where X has the arrays of a column as its rows.

    The rows are not shuffled: each task adds its rows into the blocks on and
    above the diagonal, sends every block on once, and the blocks of the tasks
    are added in a tree. The lower half is mirrored at the end. One scan does for
    all blocks that ``values`` values hold; wider matrices take several.
    """
    spark = df.sparkSession
    slots = max(fan_in, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def partial(pairs: list[tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                rows = _column_arrays(batch.column(0))
                if not rows:
                    continue
                x = np.stack(rows).astype(np.float64, copy=False)
                if x.shape[1] != cols:
                    raise ValueError(f"vectors of {x.shape[1]} values, {cols} expected")
                for i, j in pairs:
                    product = x[:, i * band : (i + 1) * band].T @ x[:, j * band : (j + 1) * band]
                    blocks[i, j] = blocks[i, j] + product if (i, j) in blocks else product
            task = TaskContext.get().partitionId() % slots
            for some in _packed((i, j, task, block) for (i, j), block in blocks.items()):
                yield _piece_batch(("bi", "bj", "k"), some)

        return run

    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("row"))
    scans = [rows.mapInArrow(partial(pairs), PRODUCT) for pairs in _band_pairs(cols, band, values)]
    upper = _sum_products(reduce(DataFrame.unionByName, scans), slots, fan_in)

    def mirrored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _packed(t for bi, bj, tile in _tile_rows(batch) for t in ([(bi, bj, tile)] + ([(bj, bi, tile.T)] if bi != bj else []))):
                yield _tile_batch(some)

    return TileMatrix(upper.mapInArrow(mirrored, TILE), cols, cols, band, band)


def gram(df: DataFrame, vector: str, cols: int, **options) -> DataFrame:
    """The values of :func:`gram_tiles` as ``i, j, v``; a table without rows has none."""
    return to_coordinates(gram_tiles(df, vector, cols, **options))


# --- reducing, iterating, reusing -------------------------------------------


def matrix_stats(x: TileMatrix) -> DataFrame:
    """Sum, mean and population standard deviation of all values, as one row."""
    cells = x.tiles.select(F.explode("data").alias("v"))
    return cells.agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def stored(x: TileMatrix, label: str = "tiles") -> TileMatrix:
    """The matrix as a table in the shared folder, with no lineage behind it."""
    return replace(x, tiles=materialise(x.tiles, label))


def tanh_gram_rounds(x: TileMatrix, rounds: int = 6, **options) -> TileMatrix:
    """``x = tanh(x @ x.T)``, repeated; each round is stored before the next one."""
    spark, previous = x.tiles.sparkSession, None
    for _ in range(rounds):
        x = stored(map_blocks(matmul(x, transpose(x), **options), np.tanh))
        if previous is not None:
            discard(spark, previous)
        previous = x.tiles
    return x


@contextmanager
def persisted(x: TileMatrix) -> Iterator[TileMatrix]:
    """Keep the tiles while several results are made from them."""
    kept = x.tiles.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield replace(x, tiles=kept)
    finally:
        kept.unpersist()
