"""The matrix jobs, each from its inputs to its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tallyloom.operators import tiles
from tallyloom.operators.tiles import TileMatrix


def shifted_double(x: TileMatrix) -> TileMatrix:
    return tiles.elementwise(x, lambda v: (v + 1) * 2)


def product_total(x: TileMatrix, y: TileMatrix, **options) -> DataFrame:
    return tiles.matrix_stats(tiles.matmul(x, y, **options)).select("total")


def rechunked_std(x: TileMatrix, tile_rows: int, tile_cols: int) -> DataFrame:
    return tiles.matrix_stats(tiles.rechunk(x, tile_rows, tile_cols)).select("std")


def iterated_mean(x: TileMatrix, rounds: int = 6, **options) -> DataFrame:
    return tiles.matrix_stats(tiles.tanh_gram_rounds(x, rounds, **options)).select("mean")


def squares_of_shifted(x: TileMatrix) -> TileMatrix:
    def square(v: Column) -> Column:
        return v * v

    return tiles.elementwise(x, square)


def root_mean(x: TileMatrix, rounds: int, tile_rows: int, tile_cols: int) -> DataFrame:
    mapped = tiles.map_blocks(x, tiles.root_rounds(rounds))
    return tiles.matrix_stats(tiles.rechunk(mapped, tile_rows, tile_cols)).select("mean")
