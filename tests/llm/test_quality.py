"""The convolutional quality classifier: its forward pass and gradient by hand, odd rows, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from tallyloom.llm import quality
from tallyloom.llm.workload import QUERIES

TEXTS = [None, "", "a", "Çé 中文", "word " * 130, "many words, " * 3000]


def net():
    drawn = quality.start(3)
    drawn["bias"] = drawn["bias"] - 0.2
    return drawn


def by_hand(n, text):
    """The probability, one window at a time, without numpy's matrix product."""
    data, size = (text or "").encode(), quality.BLOCK
    blocks = max(1, -(-len(data) // size))
    codes = list(data) + [quality.PAD] * (blocks * size + quality.WIDTH - 1 - len(data))
    chunks = [(k * size, (k + 2) * size) for k in range(blocks - 1)] or [(0, size)]
    pooled = []
    for low, high in chunks:
        windows = [n["bytes"][codes[k : k + quality.WIDTH]].ravel() for k in range(low, high)]
        pooled.append([max(0.0, max(float((w * n["filters"][:, f]).sum()) for w in windows) + float(n["bias"][f])) for f in range(quality.FILTERS)])
    pooled = np.array(pooled)
    features = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0), pooled.min(axis=0)])
    return 1 / (1 + np.exp(-(features @ n["out"] + n["offset"][0])))


@pytest.mark.parametrize("text", TEXTS[:5])
def test_forward(text):
    assert quality.probability(net(), text) == pytest.approx(by_hand(net(), text), abs=1e-5)


def test_every_byte_counts():
    n, long = net(), "plain text " * 9000
    assert quality.probability(n, long) != quality.probability(n, long[:-5] + "\x00\x01\x02\x03\x04")
    assert quality.chunked(np.arange(4.0)[:, None]).ravel().tolist() == [1, 2, 3]


def test_gradient():
    n, draw = {k: v.astype(np.float64) for k, v in net().items()}, np.random.default_rng(5)
    codes = quality.padded("".join(chr(c) for c in draw.integers(32, 127, 700)))
    total = {k: np.zeros_like(v) for k, v in n.items()}
    quality.gradient(n, codes, 1, total)

    def loss(net_):
        tops, _ = quality.pooled(net_, codes)
        return np.log1p(np.exp(-quality.combined(net_, tops)[0]))

    for name in n:
        for at in draw.integers(0, n[name].size, 12):
            moved = []
            for step in (1e-3, -1e-3):
                other = {k: v.copy() for k, v in n.items()}
                other[name].ravel()[at] += step
                moved.append(loss(other))
            assert total[name].ravel()[at] == pytest.approx((moved[0] - moved[1]) / 2e-3, abs=2e-3)


def test_rows(spark):
    schema = "doc_id long, text string, score double, quality int"
    docs = spark.createDataFrame([(i, t, 0.1, 9) for i, t in enumerate(TEXTS)] + [(None, "word " * 130, 0.2, 8), (4, "word " * 130, 0.2, 8)], schema)
    found = quality.scored(docs, net()).collect()
    assert len(found) == len(TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (4, None)}) == 1
    assert len({r["score"] for r in found if r["doc_id"] in (0, 1)}) == 1
    assert {r["score"] for r in quality.scored(docs, None).collect()} == {0.5}
    assert quality.scored(docs.limit(0), net()).count() == 0
    labels = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    assert quality.train(docs, labels) is None and quality.train(docs.limit(0), labels) is None
    more = spark.createDataFrame([(i, q) for i in range(9) for q in (0, 1)], "doc_id long, quality int")
    assert set(quality.train(docs, more, epochs=1)) == set(quality.start())


def test_bound_on_bytes(spark):
    docs = spark.createDataFrame([(1, "x" * 9000), (2, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert quality.train(docs, labels, max_bytes=100) is None
    assert quality.train(docs, labels, max_bytes=1000, epochs=1) is not None


def test_held_out(spark):
    """Rows that were not learned from: nearly all good ones stay, most others go."""
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = QUERIES["op11_quality"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in found)
    told = [(labels[r["doc_id"]], r["predicted"]) for r in found if r["held_out"] and r["doc_id"] in labels]
    good, bad = [p for q, p in told if q], [p for q, p in told if not q]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.4 * len(bad)
