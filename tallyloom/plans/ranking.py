"""Rank the vertices of a stored graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.operators.graph import directed_graph, pagerank, top_vertices, undirected_graph
from tallyloom.sources.mtx import read_mtx


def rank_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """PageRank of the directed, unweighted graph in a MatrixMarket file."""
    return pagerank(directed_graph(read_mtx(spark, path)), **options)


def rank_weighted(edges: DataFrame, combine: str = "min", **options) -> DataFrame:
    """PageRank of an undirected, weighted edge list ``src, dst, weight``."""
    return pagerank(undirected_graph(edges, weight="weight", combine=combine), **options)


def top_personalised(edges: DataFrame, personalisation: DataFrame, k: int = 3, **options) -> DataFrame:
    return top_vertices(rank_weighted(edges, personalisation=personalisation, **options), k)
