import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import graph
from tallyloom.plans import ranking
from tallyloom.scratch import materialise, partitions_for
from tallyloom.sinks.writers import plan_text
from tallyloom.sources.mtx import read_mtx, write_mtx

EDGES = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 0.5), (1, 1, 0.5), (1, 0, 0.5), (1, 0, 0.5), (3, 0, 5.0)]
PERSONAL = [(0, 0.25), (1, 0.75)]

# Converged ranks of the four-vertex graph.
GOLDEN = {
    ("directed", "sum", False): [0.342110, 0.278750, 0.132275, 0.246865],
    ("directed", "sum", True): [0.325277, 0.357619, 0.121590, 0.195514],
    ("undirected", "min", False): [0.167721, 0.298930, 0.297942, 0.235407],
    ("undirected", "min", True): [0.170425, 0.378307, 0.265850, 0.185417],
    ("undirected", "sum", False): [0.360425, 0.196936, 0.126649, 0.315991],
    ("undirected", "sum", True): [0.361399, 0.269958, 0.100611, 0.268032],
}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src bigint, dst bigint, weight double")


@pytest.fixture(scope="module")
def personal(spark):
    return spark.createDataFrame(PERSONAL, "vertex bigint, value double")


def ranks_of(df):
    return {r["vertex"]: r["pagerank"] for r in df.collect()}


def reference(edges, n_iter, alpha=0.85, teleport=None):
    """Power iteration on plain dictionaries."""
    nodes = sorted({v for s, d, _ in edges for v in (s, d)})
    t = teleport or {v: 1 / len(nodes) for v in nodes}
    out = {}
    for s, _, w in edges:
        out[s] = out.get(s, 0) + w
    rank = {v: 1 / len(nodes) for v in nodes}
    for _ in range(n_iter):
        stuck = sum(r for v, r in rank.items() if v not in out)
        new = {v: (1 - alpha + alpha * stuck) * t.get(v, 0) for v in nodes}
        for s, d, w in edges:
            new[d] += alpha * rank[s] * w / out[s]
        rank = new
    return rank


@pytest.mark.parametrize("kind,combine,personalised", list(GOLDEN))
def test_golden_ranks_stay_put(spark, edges, personal, kind, combine, personalised):
    """The ranks are the one vector a round does not move."""
    build = graph.directed_graph if kind == "directed" else graph.undirected_graph
    golden = GOLDEN[(kind, combine, personalised)]
    run = graph.pagerank_run(
        build(edges, weight="weight", combine=combine), tol=1e-5, personalisation=personal if personalised else None,
        nstart=spark.createDataFrame(list(enumerate(golden)), "vertex bigint, value double"),
    )
    assert run.converged and run.iterations == 1 and run.delta < 1e-5
    got = ranks_of(run.ranks)
    assert all(abs(got[v] - want) < 2e-6 for v, want in enumerate(golden))


def test_converges_to_golden_ranks(edges):
    run = graph.pagerank_run(graph.directed_graph(edges, weight="weight"), tol=1e-4)
    assert run.converged and 5 < run.iterations < 60
    got = ranks_of(run.ranks)
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[v] - want) < 1e-3 for v, want in enumerate(GOLDEN[("directed", "sum", False)]))


def test_unknown_personalisation(spark, edges, personal):
    g = graph.undirected_graph(edges, weight="weight")
    unknown = spark.createDataFrame([(100, 0.25), (26, 0.75)], "vertex bigint, value double")
    flags = graph.check_personalisation(graph.vertices_of(g), unknown.unionByName(personal))
    assert {r["vertex"]: r["known"] for r in flags.collect()} == {100: False, 26: False, 0: True, 1: True}
    with pytest.raises(ValueError):
        graph.pagerank(g, personalisation=unknown)
    both = graph.pagerank(g, max_iter=5, tol=None, personalisation=unknown.unionByName(personal))
    alone = graph.pagerank(g, max_iter=5, tol=None, personalisation=personal)
    a, b = ranks_of(both), ranks_of(alone)
    assert a.keys() == b.keys() and all(abs(a[v] - b[v]) < 1e-12 for v in a)


def test_hub_dangling_and_pieces(spark):
    """A hub holds most edges both ways; many vertices have no way out."""
    made = [(0, i, 1.0 + i % 3) for i in range(1, 200)] + [(i, 0, 1.0) for i in range(1, 60)] + [(5, 6, 2.0), (7, 7, 1.0)]
    want = reference(made, 6)
    df = spark.createDataFrame(made, "src bigint, dst bigint, weight double")
    for limit in (1_000_000, 16):
        run = graph.pagerank_run(df, max_iter=6, tol=None, edges_per_task=limit)
        got = ranks_of(run.ranks)
        assert run.iterations == 6 and got.keys() == want.keys()
        assert all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_isolated_vertices_and_uniform_start(spark, edges):
    g = graph.directed_graph(edges, weight="weight")
    equal = graph.vertices_of(g).withColumn("value", F.lit(3.0))
    plain, started = (ranks_of(graph.pagerank(g, max_iter=4, tol=None, **o)) for o in ({}, {"nstart": equal, "personalisation": equal}))
    assert all(abs(plain[v] - started[v]) < 1e-12 for v in plain)
    more = ranks_of(graph.pagerank(g, max_iter=6, vertices=spark.createDataFrame([(9,)], "vertex bigint")))
    assert set(more) == {0, 1, 2, 3, 9} and abs(sum(more.values()) - 1) < 1e-9


def test_building(edges, rows):
    assert rows(graph.directed_graph(edges, weight="weight")) == [
        (0, 1, 1.0), (0, 3, 0.5), (1, 0, 1.0), (1, 1, 0.5), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 5.0)
    ]
    assert (1, 0, 1.0) in rows(graph.directed_graph(edges))
    both = rows(graph.undirected_graph(edges, weight="weight", combine="sum"))
    assert both == [
        (0, 1, 2.0), (0, 3, 5.5), (1, 0, 2.0), (1, 1, 0.5), (1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0), (3, 0, 5.5), (3, 2, 1.0)
    ]
    g = graph.directed_graph(edges, weight="weight")
    assert rows(graph.out_degree(g)) == [(0, 2, 1.5), (1, 3, 2.5), (2, 1, 1.0), (3, 1, 5.0)]
    sums = graph.row_normalise(g).groupBy("src").agg(F.sum("weight").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-12 for r in sums.collect())
    assert rows(graph.graph_summary(g)) == [(4, 7, 1, 10.0)]


def test_top_k(edges, personal):
    top = ranking.top_personalised(edges, personal, 3, max_iter=4).collect()
    assert len(top) == 3 and top[0]["vertex"] == 1
    assert [r["pagerank"] for r in top] == sorted((r["pagerank"] for r in top), reverse=True)
    assert "TakeOrderedAndProject" in plan_text(graph.top_vertices(ranking.rank_weighted(edges, max_iter=1)))


def test_mtx_symmetric_pattern(spark, tmp_path, rows):
    path = tmp_path / "g.mtx"
    path.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% a comment\n4 4 3\n2 1\n3 3\n4 2\n")
    assert rows(read_mtx(spark, str(path))) == [(0, 1, 1.0), (1, 0, 1.0), (1, 3, 1.0), (2, 2, 1.0), (3, 1, 1.0)]
    assert len(rows(ranking.rank_file(spark, str(path), max_iter=3))) == 4


def test_mtx_entry_equal_to_the_size_line(spark, tmp_path, rows):
    path = tmp_path / "g.mtx"
    path.write_text("%%MatrixMarket matrix coordinate real general\n3 3 3\n1 2 0.5\n3 3 3\n2 1 7\n")
    assert rows(read_mtx(spark, str(path))) == [(0, 1, 0.5), (1, 0, 7.0), (2, 2, 3.0)]


def test_mtx_in_many_splits(spark, tmp_path, rows):
    made = [(i, (i * 7) % 500, float(i)) for i in range(500)]
    df = spark.createDataFrame(made, "src bigint, dst bigint, weight double").repartition(5)
    whole = write_mtx(df, str(tmp_path / "parts"))
    one = tmp_path / "one.mtx"
    one.write_text("%%MatrixMarket matrix coordinate real general\n500 500 500\n" + "".join(f"{s + 1} {d + 1} {w}\n" for s, d, w in made))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        for path in (whole, str(one)):
            assert rows(read_mtx(spark, path)) == sorted(made)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_mtx_is_scanned_once(spark, tmp_path, rows):
    folder = tmp_path / "a folder"
    folder.mkdir()
    with gzip.open(folder / "part-0.mtx.gz", "wt") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n%\n\n3 3 2\n3 3 2\n")
    (folder / "part-1.mtx").write_text("1 2 4\n")
    edges = read_mtx(spark, str(folder))
    assert rows(edges) == [(0, 1, 4.0), (2, 2, 2.0)]
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan
    (folder / "part-2.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n3 3 0\n")
    with pytest.raises(Exception, match="second %%MatrixMarket"):
        read_mtx(spark, str(folder)).collect()


def test_row_normalise_makes_the_edges_once(spark, rows):
    made = spark.range(60).selectExpr("id % 3 AS a", "id % 5 AS b", "1.0D AS w")
    normal = graph.row_normalise(graph.directed_graph(made, "a", "b", "w"))
    assert "Range" not in normal._jdf.queryExecution().executedPlan().toString()
    assert {r["s"] for r in normal.groupBy("src").agg(F.round(F.sum("weight"), 9).alias("s")).collect()} == {1.0}


@pytest.mark.parametrize("header", ["%%MatrixMarket matrix array real general", "%%MatrixMarket matrix coordinate complex general", "no banner"])
def test_mtx_rejects_other_headers(spark, tmp_path, header):
    path = tmp_path / "g.mtx"
    path.write_text(header + "\n1 1 1\n1 1 1\n")
    with pytest.raises(ValueError):
        read_mtx(spark, str(path))


def test_layout_of_a_hot_source_is_sized_by_the_edges(spark, monkeypatch):
    edges = materialise(spark.range(20_000).selectExpr("id % 50 AS src", "id AS dst", "1.0D AS weight"), "edges")
    nodes = spark.range(50).selectExpr("id AS vertex", "400.0D AS out_weight", "4 AS pieces")
    asked = []
    monkeypatch.setattr(graph, "partitions_for", lambda table: asked.append(table) or partitions_for(table))
    laid_out, keys = graph._lay_out(edges, nodes, 4)
    assert keys == ["src", "salt"] and laid_out.select("src", "salt").distinct().count() == 200
    assert asked == [edges] and laid_out.rdd.getNumPartitions() <= partitions_for(edges)


def test_a_round_moves_packed_blocks_and_not_edges(spark):
    """4,000 edges in 6 cells: what a round shuffles are rows per block."""
    made = [(i % 40, (i * 7 + i // 40) % 300, 1.0 + i % 3) for i in range(4000)]
    pairs = {}
    for s, d, w in made:
        pairs[s, d] = w
    made = [(s, d, w) for (s, d), w in pairs.items()]
    df = spark.createDataFrame(made, "src bigint, dst bigint, weight double")
    grid = graph._grid(300, len(made), -(-len(made) // 6), 4)
    assert (grid.rows, grid.columns) == (2, 3)
    seen = []
    next_round = graph._next_round
    graph._next_round = lambda *a: seen.append(next_round(*a)) or seen[-1]
    try:
        got = ranks_of(graph.pagerank(df, max_iter=3, tol=None, edges_per_task=-(-len(made) // 6)))
    finally:
        graph._next_round = next_round
    want = reference(made, 3)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)
    assert seen[0].count() <= grid.blocks and dict(seen[0].dtypes)["rank"] == "binary"


def test_ranks_with_missing_weights_and_ends(spark):
    made = [(1, 2, 1.0), (2, 1, None), (2, 3, 4.0), (3, 1, None), (None, 1, 1.0), (1, None, 1.0)]
    got = ranks_of(graph.pagerank(spark.createDataFrame(made, "src bigint, dst bigint, weight double"), max_iter=1, tol=None))
    # Vertex 3 has out-edges of no weight: its third restarts everywhere.
    assert {v: round(r, 9) for v, r in got.items()} == {1: 0.144444444, 2: 0.427777778, 3: 0.427777778}


@pytest.mark.parametrize("values,ascending", [
    (np.array([], np.int64), True), (np.array([-5, -5, 0, 3, 2**62]), True), (np.array([7, -1, 0]), False), (np.zeros(9), False),
    (np.array([1.0, float("nan"), -0.0, 2.5e-300]), False), (np.arange(1000) * 1000, True),
])
def test_packed_numbers_come_back(values, ascending):
    blob = pa.scalar(graph._packed(values, ascending), pa.binary())
    got = graph._unpacked(blob, values.dtype.type, ascending)
    assert got.tobytes() == values.tobytes()


def test_edges_travel_and_stay_packed(spark):
    """An edge between vertices of small numbers takes a few bytes, not sixteen or more."""
    made = spark.range(300_000).selectExpr("id % 700 AS src", "id * 7 % 9001 AS dst", "1.0D + id % 50 AS weight")
    seen = []
    next_round = graph._next_round
    graph._next_round = lambda *a: seen.append(a[1].selectExpr("sum(length(sources) + length(targets) + length(weight))").first()[0]) or next_round(*a)
    try:
        graph.pagerank(made, max_iter=1, tol=None, edges_per_task=100_000)
    finally:
        graph._next_round = next_round
    assert seen[0] < 6 * 300_000


def test_cells_of_a_hub_are_cut_into_pieces(spark):
    made = [(i, 0, 1.0 + i % 3) for i in range(1, 2000)] + [(i, i + 1, 1.0) for i in range(1, 300)]
    df = spark.createDataFrame(made, "src bigint, dst bigint, weight double")
    grid = graph._grid(2000, len(made), 300, 4)
    tasks = graph._tasks(df, len(made), grid, 300)
    assert tasks.number() > grid.rows * grid.columns
    sizes = [r["count"] for r in df.groupBy(F.expr(tasks.task("src", "dst"))).count().collect()]
    assert sum(sizes) == len(made) and max(sizes) <= 600
    got, want = ranks_of(graph.pagerank(df, max_iter=4, tol=None, edges_per_task=300)), reference(made, 4)
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-12 for v in want)


def test_rounds_leave_no_shuffles(spark):
    def kept():
        return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    made = spark.createDataFrame([(i % 40, i % 301, 1.0) for i in range(2000)], "src bigint, dst bigint, weight double")
    seen = []
    next_round = graph._next_round
    graph._next_round = lambda *a: seen.append(kept()) or next_round(*a)
    try:
        graph.pagerank(made, max_iter=6, tol=None, edges_per_task=500)
    finally:
        graph._next_round = next_round
    assert seen[-1] <= seen[2] and "true" != spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false")
