"""Edge tables and PageRank.

A graph is an edge table ``src, dst, weight`` with one row per pair.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyloom.scratch import discard, materialise, partitions_for, shuffles_end_with_their_query

_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}


def _triples(edges: DataFrame, src: str, dst: str, weight: str | None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return edges.select(
        F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"), w.alias("weight")
    ).where("src is not null and dst is not null")


def directed_graph(
    edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, combine: str = "sum"
) -> DataFrame:
    """Directed edges; repeated pairs are combined (without a weight every pair counts once)."""
    how = _COMBINE["max" if weight is None else combine]
    return _triples(edges, src, dst, weight).groupBy("src", "dst").agg(how("weight").alias("weight"))


def undirected_graph(
    edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, combine: str = "min"
) -> DataFrame:
    """Both directions of every edge. A self-loop is kept once; repeated pairs are combined."""
    how = _COMBINE["max" if weight is None else combine]
    # Combine per unordered pair first: half the rows reach the shuffle.
    pairs = (
        _triples(edges, src, dst, weight)
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight")
        .groupBy("a", "b")
        .agg(how("weight").alias("weight"))
    )
    ways = F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b"))).otherwise(
        F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    )
    return pairs.select(F.explode(ways).alias("e"), "weight").select(
        F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "weight"
    )


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("vertex")).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    """Entries and total weight per source vertex."""
    return edges.groupBy("src").agg(F.count("*").alias("out_degree"), F.sum("weight").alias("out_weight"))


def row_normalise(edges: DataFrame) -> DataFrame:
    """Weights divided by the total of their source, so the out-edges of a vertex sum to 1.

    The edges are stored first: both sides of the join read them, and making
    them may be an aggregation over far more rows.
    """
    edges = materialise(edges.select("src", "dst", "weight"), "edges")
    totals = edges.groupBy("src").agg(F.sum("weight").alias("_total"))
    return edges.join(totals, "src").select("src", "dst", (F.col("weight") / F.col("_total")).alias("weight"))


def graph_summary(edges: DataFrame) -> DataFrame:
    """Vertex count, edge count, self-loops and total weight, as one row."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("vertex"), F.lit(1).alias("edge"), (F.col("src") == F.col("dst")).cast("int").alias("loop"), "weight"),
                F.struct(F.col("dst").alias("vertex"), F.lit(0).alias("edge"), F.lit(0).alias("loop"), F.lit(0.0).alias("weight")),
            )
        ).alias("e")
    ).select("e.*")
    per_vertex = ends.groupBy("vertex").agg(*[F.sum(c).alias(c) for c in ("edge", "loop", "weight")])
    return per_vertex.agg(
        F.count("*").alias("n_vertices"),
        F.sum("edge").alias("n_edges"),
        F.sum("loop").alias("n_self_loops"),
        F.sum("weight").alias("total_weight"),
    )


def check_personalisation(vertices: DataFrame, personalisation: DataFrame) -> DataFrame:
    """The personalisation rows (``vertex, value``) with a flag telling whether the vertex exists."""
    known = vertices.select("vertex", F.lit(True).alias("_known"))
    return personalisation.join(known, "vertex", "left").select(
        F.col("vertex").cast("bigint").alias("vertex"),
        F.col("value").cast("double").alias("value"),
        F.coalesce("_known", F.lit(False)).alias("known"),
    )


@dataclass(frozen=True)
class RankRun:
    """Ranks (``vertex, pagerank``) and how the iteration ended."""

    ranks: DataFrame
    iterations: int
    delta: float | None
    converged: bool


def _one_value_per_vertex(given: DataFrame, vertices: DataFrame, what: str) -> tuple[DataFrame, float]:
    """Known vertices of a ``vertex, value`` table with positive values, and their total."""
    kept = (
        check_personalisation(vertices, given)
        .where("known and value > 0")
        .groupBy("vertex")
        .agg(F.sum("value").alias("value"))
    )
    whole = kept.agg(F.sum("value")).first()[0]
    if not whole:
        raise ValueError(f"no vertex of the {what} is in the graph")
    return kept, whole


def _vertex_table(edges: DataFrame, n_edges: int) -> DataFrame:
    """Every vertex with the total weight of its out-edges (null if all edges it has are out-edges without a weight).

    Each task sends the distinct ends of a bounded number of edges, packed, to
    buckets of about ``_BUCKET_EDGES`` edges.
    """
    cores = edges.sparkSession.sparkContext.defaultParallelism
    buckets = min(max(ceil(n_edges / _BUCKET_EDGES), min(cores, ceil(n_edges / _LEAST_EDGES)), 1), _MOST_BUCKETS)
    ends = edges.select("src", "dst", "weight").mapInArrow(_ends(buckets), "bucket int, ids binary, out_weight binary, known binary")
    return ends.groupBy("bucket").applyInArrow(_add_ends, "vertex bigint, out_weight double")


def _lay_out(edges: DataFrame, nodes: DataFrame, pieces: int, partitions: int | None = None) -> tuple[DataFrame, list[str]]:
    """Edges partitioned by the columns the shares are joined on, and those columns.

    Usually that is the source. If some source has too many out-edges for one
    task, a ``salt`` cuts the edges of each such source into its number of pieces.
    """
    keys = ["src"]
    # From the stored edges: after the join Spark would guess the product of both sides.
    partitions = partitions or partitions_for(edges)
    if pieces > 1:
        heavy = materialise(nodes.where("pieces > 1").selectExpr("vertex AS src", "pieces"), "heavy-sources")
        edges = edges.join(heavy, "src", "left").selectExpr(
            "src", "dst", "weight", "CAST(pmod(xxhash64(dst), coalesce(pieces, 1)) AS int) AS salt"
        )
        keys = ["src", "salt"]
    return edges.repartition(partitions, *keys), keys


# A block of vertices is one row that holds its columns as packed numbers, in the
# order of the vertices. The edges of a cell are rows of packed positions of
# sources, positions of targets and weights.

_MOST_VERTICES, _MOST_EDGES, _EDGES_PER_ROW, _LEAST_EDGES = 1 << 18, 1 << 20, 1 << 18, 500_000
_PLACED_EDGES, _ADDED_EDGES = 1 << 22, 1 << 20
_BUCKET_EDGES, _MOST_BUCKETS, _NEAR = 1 << 20, 1 << 14, 12
_STATE = "block int, rank binary, teleport binary, out_weight binary, way binary, stuck double, step double"
_FIRST_STATE = "block int, ids binary, rank binary, teleport binary, out_weight binary, way binary, stuck double, step double"
_RAW_ROWS = "task int, slice int, src binary, dst binary, weight binary"
_PLACED_ROWS = "task int, sources binary, targets binary, weight binary, blocks binary, sizes binary"
_ON, _STUCK = 1, 2  # the way of a rank: on along the edges, or stuck for want of any


@dataclass(frozen=True)
class _Grid:
    """Vertices lie in ``blocks`` by hash; the edges between blocks in ``rows`` x ``columns`` cells, one task each."""

    blocks: int
    rows: int
    columns: int

    def block(self, vertex: str) -> str:
        return f"CAST(pmod(xxhash64({vertex}), {self.blocks}) AS int)"

    def cell(self, src: str, dst: str) -> str:
        return f"{self.block(src)} % {self.rows} * {self.columns} + {self.block(dst)} % {self.columns}"


def _grid(n_vertices: int, n_edges: int, edges_per_task: int, cores: int) -> _Grid:
    """A nearly square grid: a share goes to one row of cells, and a vertex has its sums from one column."""
    cells = max(ceil(n_edges / edges_per_task), min(cores, ceil(n_edges / _LEAST_EDGES)), 1)
    rows = isqrt(cells)
    columns = ceil(cells / rows)
    return _Grid(max(ceil(n_vertices / _MOST_VERTICES), 16 * columns if cells > 1 else 1), rows, columns)


@dataclass(frozen=True)
class _Tasks:
    """The tasks of the cells: one each, or ``pieces`` for a cell with far more edges than the others."""

    grid: _Grid
    pieces: list[int]

    def _first(self) -> list[int]:
        return np.cumsum([0, *self.pieces]).tolist()

    def number(self) -> int:
        return sum(self.pieces)

    def task(self, src: str, dst: str) -> str:
        """The task of an edge."""
        cell = self.grid.cell(src, dst)
        if max(self.pieces) == 1:
            return f"CAST({cell} AS int)"
        at = lambda values: f"element_at(array({', '.join(map(str, values))}), {cell} + 1)"
        return f"CAST({at(self._first()[:-1])} + pmod(xxhash64({src}, {dst}), {at(self.pieces)}) AS int)"

    def _meeting(self, block: str, lines: list[list[int]]) -> str:
        first = self._first()
        tasks = [[t for cell in line for t in range(first[cell], first[cell + 1])] for line in lines]
        return f"explode(element_at(array({', '.join(f'array{tuple(t)}' if len(t) > 1 else f'array({t[0]})' for t in tasks)}), {block} % {len(lines)} + 1))"

    def of_sources(self, block: str) -> str:
        """The tasks of the row of cells that a block's out-edges lie in."""
        rows, columns = self.grid.rows, self.grid.columns
        return self._meeting(block, [[r * columns + c for c in range(columns)] for r in range(rows)])

    def of_targets(self, block: str) -> str:
        """The tasks of the column of cells that a block's in-edges lie in."""
        rows, columns = self.grid.rows, self.grid.columns
        return self._meeting(block, [[r * columns + c for r in range(rows)] for c in range(columns)])


def _tasks(edges: DataFrame, n_edges: int, grid: _Grid, edges_per_task: int) -> _Tasks:
    """Cells with over twice as many edges as a task should have (hubs do that) are cut into pieces."""
    pieces = [1] * (grid.rows * grid.columns)
    if len(pieces) > 1:
        most = max(edges_per_task, ceil(n_edges / len(pieces)))
        for cell, n in edges.groupBy(F.expr(grid.cell("src", "dst"))).count().collect():
            pieces[cell] = ceil(n / most) if n > 2 * most else 1
    return _Tasks(grid, pieces)


def _numbers(cell: pa.BinaryScalar, kind: type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def _binary(*values: np.ndarray) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers of 8 bytes as compressed byte planes, without the planes that are all zero; ascending ones as differences."""
    v = np.ascontiguousarray(values).view(np.uint64)
    if ascending:
        v = np.diff(v, prepend=np.uint64(0))
    used = int(np.bitwise_or.reduce(v)).to_bytes(8, "little") if len(v) else bytes(8)
    planes = v.view(np.uint8).reshape(-1, 8)
    kept = [np.ascontiguousarray(planes[:, i]) for i in range(8) if used[i]]
    mask = sum(1 << i for i in range(8) if used[i])
    raw = np.concatenate(kept) if kept else np.empty(0, np.uint8)
    return struct.pack("<BQ", mask, len(v)) + (pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True) if kept else b"")


def _unpacked(cell: pa.BinaryScalar, kind: type = np.int64, ascending: bool = False) -> np.ndarray:
    data = cell.as_buffer()
    mask, n = struct.unpack("<BQ", data[:9])
    kept = [i for i in range(8) if mask >> i & 1]
    v = np.zeros((n, 8), np.uint8)
    if kept:
        planes = np.frombuffer(pa.Codec("zstd").decompress(data[9:], n * len(kept)), np.uint8).reshape(-1, n)
        for plane, i in zip(planes, kept):
            v[:, i] = plane
    v = v.reshape(-1).view(np.uint64)
    return (np.cumsum(v, dtype=np.uint64) if ascending else v).view(kind)


def _ascending(blocks: np.ndarray) -> np.ndarray:
    """Stable order of block numbers; numpy sorts those of 16 bits by radix."""
    return np.argsort(blocks.astype(np.uint16) if blocks.max() < 1 << 16 else blocks, kind="stable")


def _bounded(step: Callable[[pa.Table], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` on the edges of a task, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _MOST_EDGES:
                whole, held, n = pa.Table.from_batches(held), [], 0
                yield step(whole)
        if n:
            yield step(pa.Table.from_batches(held))

    return run


def _ends(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Distinct ends of edges per bucket, with the weight that leaves them and whether any of it is known."""

    def step(edges: pa.Table) -> pa.RecordBatch:
        weight = edges["weight"]
        there = weight.is_valid().to_numpy()
        ids, at = np.unique(np.concatenate([edges["src"].to_numpy(), edges["dst"].to_numpy()]), return_inverse=True)
        sources, targets = np.split(at, 2)
        out_weight = np.bincount(sources, weight.fill_null(0.0).to_numpy(), len(ids))
        known = np.zeros(len(ids), np.int64)
        known[targets] = 1
        known[sources[there]] = 1
        # Ids that lie near each other share a bucket, so their differences are short.
        bucket = ((ids >> _NEAR).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
        order = _ascending(bucket)
        cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=np.uint64(buckets))), len(order))
        rows = [order[a:b] for a, b in zip(cuts, cuts[1:])]
        columns = [[_packed(ids[r], True) for r in rows], [_packed(out_weight[r]) for r in rows], [_packed(known[r]) for r in rows]]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[order][cuts[:-1]].astype(np.int32)), *[pa.array(c, pa.binary()) for c in columns]],
            ["bucket", "ids", "out_weight", "known"],
        )

    return _bounded(step)


def _add_ends(rows: pa.Table) -> pa.Table:
    """The vertices of a bucket."""
    ids, at = np.unique(np.concatenate([_unpacked(x, ascending=True) for x in rows["ids"]]), return_inverse=True)
    out_weight = np.bincount(at, np.concatenate([_unpacked(x, np.float64) for x in rows["out_weight"]]), len(ids))
    known = np.zeros(len(ids), bool)
    known[at[np.concatenate([_unpacked(x) for x in rows["known"]]) > 0]] = True
    return pa.table({"vertex": ids, "out_weight": pa.array(out_weight, mask=~known)})


def _first_state(table: pa.Table) -> pa.Table:
    """The vertices of a block as one row, ascending."""
    order = np.argsort(table["vertex"].to_numpy())
    ids, rank, teleport, out_weight, way = (table[c].to_numpy()[order] for c in ("vertex", "rank", "teleport", "out_weight", "way"))
    packed = {"ids": _packed(ids, True), "teleport": _packed(teleport), "out_weight": _packed(out_weight), "way": _packed(way.astype(np.int64))}
    return pa.table({
        "block": table["block"].slice(0, 1), "ids": pa.array([packed["ids"]]), "rank": _binary(rank),
        **{c: pa.array([packed[c]]) for c in ("teleport", "out_weight", "way")},
        "stuck": pa.array([float(rank[way == _STUCK].sum())]), "step": pa.array([None], pa.float64()),
    })


def _pack(slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Some edges at a time as one row per task, ascending by source. The rows are dealt to slices in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId()

        def step(edges: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            task, *columns = (edges[c].to_numpy() for c in ("task", "src", "dst", "weight"))
            order = np.argsort(columns[0])
            order = order[_ascending(task[order])]
            task = task[order]
            cuts = np.append(np.flatnonzero(np.diff(task, prepend=-1)), len(task))
            rows = [order[a:b] for a, b in zip(cuts, cuts[1:])]
            packed = [pa.array([_packed(c[r], c is columns[0]) for r in rows], pa.binary()) for c in columns]
            dealt = pa.array(np.full(len(rows), made % slices, np.int32))
            return pa.RecordBatch.from_arrays([pa.array(task[cuts[:-1]]), dealt, *packed], ["task", "slice", "src", "dst", "weight"])

        yield from _bounded(step)(batches)

    return run


def _place(edges: pa.Table, vertices: pa.Table) -> pa.Table:
    """The edges of a slice of a task with positions in place of ids.

    Positions count through the blocks of the cell's row, or column, by number.
    Edges are opened a bounded number at a time.
    """
    found: list[pa.RecordBatch] = []
    known, layout = {}, {}
    for end in ("src", "dst") if edges.num_rows else ():
        own = sorted(((b.as_py(), ids) for e, b, ids in zip(vertices["end"], vertices["block"], vertices["ids"]) if e.as_py() == end), key=lambda x: x[0])
        blocks = [_unpacked(ids, ascending=True) for _, ids in own]
        layout[end] = [_packed(np.array(x, np.int64)) for x in ([b for b, _ in own], [len(ids) for ids in blocks])]
        ids = np.concatenate(blocks)
        order = np.argsort(ids)
        known[end] = ids[order], order

    def give(held: list[tuple]) -> None:
        sources, targets, weight = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(sources)
        row = [_packed(sources[order], True), _packed(targets[order]), _packed(weight[order]), *layout["dst"]]
        found.append(pa.RecordBatch.from_arrays([edges["task"].chunk(0).slice(0, 1), *[pa.array([x], pa.binary()) for x in row]], schema=schema))

    schema = pa.schema([("task", pa.int32()), *[(c, pa.binary()) for c in ("sources", "targets", "weight", "blocks", "sizes")]])
    held, n = [], 0
    for src, dst, weight in zip(*[edges[c] for c in ("src", "dst", "weight")]):
        placed = [order[np.searchsorted(ids, _unpacked(cell, ascending=end == "src"))] for (end, (ids, order)), cell in zip(known.items(), (src, dst))]
        held.append((*placed, _unpacked(weight, np.float64)))
        n += len(placed[0])
        if n >= _EDGES_PER_ROW:
            give(held)
            held, n = [], 0
    if n:
        give(held)
    return pa.Table.from_batches(found, schema)  # sent back row by row


def _edge_blocks(edges: DataFrame, ids: DataFrame, tasks: _Tasks, n_edges: int) -> tuple[DataFrame, list[str]]:
    """The packed edges in their cells, and the columns that name a cell.

    The edges travel once with their ids, and once as positions. Positions are
    looked up in slices of about ``_PLACED_EDGES`` edges of a task.
    """
    slices = ceil(n_edges / (tasks.number() * _PLACED_EDGES)) or 1
    numbered = edges.where("weight IS NOT NULL").selectExpr(f"{tasks.task('src', 'dst')} AS task", "src", "dst", "weight")
    rows = numbered.mapInArrow(_pack(slices), _RAW_ROWS)
    own = ids.selectExpr(f"{tasks.of_sources('block')} AS task", "'src' AS end", "block", "ids").union(
        ids.selectExpr(f"{tasks.of_targets('block')} AS task", "'dst' AS end", "block", "ids")
    ).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    keys = ["task", "slice"]
    placed = rows.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(_place, _PLACED_ROWS).selectExpr(
        "task AS src", "0 AS dst", "struct(sources, targets, weight, blocks, sizes) AS weight"
    )
    # Far more partitions than cells, so that two cells seldom share one.
    laid_out, keys = _lay_out(placed, ids, 1, 8 * tasks.number())
    return laid_out.select(*keys, "weight.*").sortWithinPartitions(*keys), keys


def pagerank_run(
    edges: DataFrame,
    alpha: float = 0.85,
    max_iter: int = 100,
    tol: float | None = 1e-5,
    personalisation: DataFrame | None = None,
    nstart: DataFrame | None = None,
    vertices: DataFrame | None = None,
    edges_per_task: int = 32_000_000,
) -> RankRun:
    """Weighted PageRank by power iteration.

    ``personalisation`` and ``nstart`` are tables ``vertex, value``; the first
    one is where a walk restarts (and where walks from vertices without
    out-edges go on), the second one where the iteration starts. Vertices that
    the graph does not have are left out, and so are missing ends of edges.
    Stops when the ranks move by less than ``tol`` in total, or after
    ``max_iter`` rounds; ``tol=None`` runs them all.

    Vertices are cut into blocks and edges into a grid of cells, which stay where
    they are and hold positions in the blocks. A round sends each block of shares
    to one row of cells, adds up inside the cells, and sends one packed sum per
    cell and block back: what travels grows with the vertices and the side of
    the grid, not with the edges. The state is written to the shared folder
    after every round, and the shuffle files of a round are deleted after it.
    """
    spark = edges.sparkSession
    with shuffles_end_with_their_query(spark):
        edges = materialise(edges.where("src IS NOT NULL AND dst IS NOT NULL").selectExpr(
            "CAST(src AS bigint) AS src", "CAST(dst AS bigint) AS dst", "CAST(weight AS double) AS weight"
        ), "edges", compression="zstd")
        n_edges = edges.count()
        nodes = _vertex_table(edges, n_edges)
        if vertices is not None:
            alone = vertices.where("vertex IS NOT NULL").selectExpr("CAST(vertex AS bigint) AS vertex", "0.0D AS out_weight")
            nodes = nodes.union(alone).groupBy("vertex").agg(F.max("out_weight").alias("out_weight"))
        nodes = materialise(nodes, "vertices")
        counts = nodes.agg(F.count("*").alias("n"), F.count_if(F.col("out_weight") <= 0).alias("dangling")).first()
        if not counts["n"]:
            raise ValueError("the graph has no vertices")
        grid = _grid(counts["n"], n_edges, edges_per_task, spark.sparkContext.defaultParallelism)

        start = F.lit(1.0 / counts["n"])
        state = nodes.select("vertex", start.alias("rank"), start.alias("teleport"), "out_weight")
        for given, column, what in ((personalisation, "teleport", "personalisation"), (nstart, "rank", "start vector")):
            if given is not None:
                kept, whole = _one_value_per_vertex(given, nodes, what)
                state = (
                    state.drop(column).join(kept, "vertex", "left")
                    .withColumn(column, F.coalesce(F.col("value") / whole, F.lit(0.0))).drop("value")
                )
        way = f"CAST(CASE WHEN out_weight > 0 THEN {_ON} WHEN out_weight <= 0 THEN {_STUCK} ELSE 0 END AS tinyint) AS way"
        placed = state.selectExpr(
            f"{grid.block('vertex')} AS block", "vertex", "rank", "teleport", "coalesce(out_weight, 0.0D) AS out_weight", way
        )
        first = materialise(placed.groupBy("block").applyInArrow(_first_state, _FIRST_STATE), "ranks")
        ids, state = first.select("block", "ids"), first.drop("ids")

        tasks = _tasks(edges, n_edges, grid, edges_per_task)
        # Laid out once; every round then moves only the shares and the sums. On disk: a cell is read
        # once a round, in order, and in memory the cells would take the place that tasks need.
        laid_out, keys = _edge_blocks(edges, ids, tasks, n_edges)
        resident = laid_out.persist(StorageLevel.DISK_ONLY)

        rounds, delta, converged = 0, None, False
        stuck, _ = _progress(state) if counts["dangling"] else (0.0, None)
        try:
            while rounds < max_iter and not converged:
                before, state = state, materialise(_next_round(state, resident, keys, tasks, alpha, stuck), "ranks")
                if rounds:  # the first state has the ids
                    discard(spark, before)
                rounds += 1
                if counts["dangling"] or tol is not None:
                    stuck, delta = _progress(state)
                converged = tol is not None and delta < tol
        finally:
            resident.unpersist()
    ranks = ids.join(state.select("block", "rank"), "block").select("ids", "rank").mapInArrow(_unpack, "vertex bigint, pagerank double")
    return RankRun(ranks, rounds, delta, converged)


def _progress(state: DataFrame) -> tuple[float, float]:
    """Rank held by vertices without out-edges, and how far the ranks moved in the last round.

    Two numbers per block of the stored ranks are read. An ``Observation`` of the write would
    spare that, but a session that has used one can no longer fit a forest: its
    tasks then fail with "ObservationManager is not serializable" (Spark 4.1).
    """
    row = state.agg(F.sum("stuck"), F.sum("step")).first()
    return row[0] or 0.0, row[1] or 0.0


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What every vertex of a block sends along an edge of weight 1."""
    for batch in batches:
        for block, rank, out_weight, way in zip(*[batch[c] for c in ("block", "rank", "out_weight", "way")]):
            rank, on = _numbers(rank, np.float64), _unpacked(way) == _ON
            share = np.divide(rank, _unpacked(out_weight, np.float64), out=np.zeros_like(rank), where=on)
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int32()), _binary(share)], ["block", "share"])


def _cell_sums(edges: pa.Table, shares: pa.Table) -> pa.Table:
    """The inflow of the vertices from the edges of one task, per block."""
    if not edges.num_rows:
        return pa.table({"block": pa.array([], pa.int32()), "inflow": pa.array([], pa.binary())})
    sent = sorted(zip(shares["block"].to_pylist(), shares["share"]), key=lambda x: x[0])
    share = np.concatenate([_numbers(values, np.float64) for _, values in sent])
    blocks, sizes = (_unpacked(edges[c][0]) for c in ("blocks", "sizes"))
    inflow = np.zeros(int(sizes.sum()))
    held, n = [], 0
    for row, (sources, targets, weight) in enumerate(zip(*[edges[c] for c in ("sources", "targets", "weight")]), 1):
        held.append((_unpacked(targets), share[_unpacked(sources, ascending=True)] * _unpacked(weight, np.float64)))
        n += len(held[-1][0])
        if n >= _ADDED_EDGES or row == edges.num_rows:
            inflow += np.bincount(*(np.concatenate(c) for c in zip(*held)), len(inflow))
            held, n = [], 0
    return pa.table({"block": pa.array(blocks.astype(np.int32)), "inflow": _binary(*np.split(inflow, np.cumsum(sizes)[:-1]))})


def _next_round(state: DataFrame, edges: DataFrame, keys: list[str], tasks: _Tasks, alpha: float, stuck: float) -> DataFrame:
    """One round. ``stuck`` restarts everywhere, as the teleport does."""
    restart = 1.0 - alpha + alpha * stuck

    def move(sums: pa.Table, own: pa.Table) -> pa.Table:
        old, teleport = _numbers(own["rank"][0], np.float64), _unpacked(own["teleport"][0], np.float64)
        inflow = np.zeros_like(old)
        for got in sums["inflow"]:
            inflow += _numbers(got, np.float64)
        rank = alpha * inflow + restart * teleport
        held = float(rank[_unpacked(own["way"][0]) == _STUCK].sum())
        return pa.table({
            "block": own["block"], "rank": _binary(rank), **{c: own[c] for c in ("teleport", "out_weight", "way")},
            "stuck": pa.array([held]), "step": pa.array([float(np.abs(rank - old).sum())]),
        })

    shares = state.select("block", "rank", "out_weight", "way").mapInArrow(_shares, "block int, share binary")
    sent = shares.selectExpr("block", "share", f"{tasks.of_sources('block')} AS {keys[0]}")
    sums = edges.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_cell_sums, "block int, inflow binary")
    own = state.select("block", "rank", "teleport", "out_weight", "way")
    return sums.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(move, _STATE)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, rank in zip(batch["ids"], batch["rank"]):
            yield pa.RecordBatch.from_arrays([pa.array(_unpacked(ids, ascending=True)), pa.array(_numbers(rank, np.float64))], ["vertex", "pagerank"])


def pagerank(edges: DataFrame, **options) -> DataFrame:
    """The ranks of :func:`pagerank_run`, as ``vertex, pagerank``."""
    return pagerank_run(edges, **options).ranks


def top_vertices(ranks: DataFrame, k: int = 3) -> DataFrame:
    return ranks.orderBy(F.desc("pagerank"), F.asc("vertex")).limit(k)
