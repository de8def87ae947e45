"""The next document by descending id, against sorting all rows at once."""

from __future__ import annotations

import hashlib
import random

import pytest

from tallyloom.llm import imatch

FAR = [-(1 << 62) - 5, (1 << 62) + 5, (1 << 63) - 1, -(1 << 63)]


def brute(rows):
    """Id, next id and digest of the edited text of every row."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        out.append((i, hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", [
    FAR, [*range(300), FAR[1]], [7] * 12 + [3, 9, None], [None, None, 5], [1], list(range(0, 4000, 7)) + [10**15 + i for i in range(200)],
], ids=["far", "one far away", "repeats", "nulls", "single", "two clusters"])
@pytest.mark.parametrize("range_rows", [2])
def test_next_document(spark, ids, range_rows):
    draw = random.Random(len(ids))
    rows = [(i, " ".join(draw.choices("alpha beta gamma delta epsilon zeta".split(), k=draw.randrange(1, 12)))) for i in ids]
    found = imatch.compared(spark.createDataFrame(rows, "doc_id long, text string"), range_rows=range_rows)
    assert sorted(((r["doc_id"], r["edited_sha256"]) for r in found.collect()), key=str) == brute(rows)


def test_one_far_id_leaves_the_ranges_even(spark):
    docs = spark.range(20000).selectExpr("id as doc_id").union(spark.createDataFrame([(FAR[1],)], "doc_id long"))
    sizes = [r["count"] for r in docs.groupBy(imatch.id_ranges(docs, 20)).count().collect()]
    assert max(sizes) <= 2000
