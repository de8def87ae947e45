"""The pipeline: each stage on the smallest tables, and ``run`` on odd rows against plain Python."""

import hashlib

import corpus_pipeline
import pytest
import xxhash
from tallyloom.llm import mixing, secrets, simhash
from tallyloom.llm.workload import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_registered():
    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [q for n in range(1, 14) for q in QUERIES if q.startswith(f"op{n}_")]
    assert len(QUERIES) == 13 and set(ORACLES) < set(QUERIES)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        before, after = docs.collect(), out.collect()
        if name != "bpe":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        if name == "near-duplicates":
            found = simhash.near_duplicates(docs).collect()
            assert {r["doc_id"] for r in after} == {r["component_id"] for r in found}
        elif name == "secrets":
            assert len(after) == len(before)
            assert secrets.with_spans(out).filter("size(_base) > 0").count() == 0
        elif name == "mixing":
            assert len(after) == sum(r["copies"] for r in mixing.rates(docs).collect() if r["size"])
        elif name == "bpe":
            assert len(after) == len(before) and all(r["n_tokens"] > 0 for r in after)
        docs = spark.createDataFrame(after, out.schema)


def words(text):
    return (text or "").encode().lower().split()


def print_of(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def odd_rows():
    """Repeats, null and shared ids, null and empty texts, near copies, and one very long text."""
    plain = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "some other words that stand here alone", "lorem ipsum dolor sit amet consectetur"]
    long = " ".join(f"word{k * 7919 % 4001}" for k in range(30000))
    table = [(1, plain[0]), (1, plain[0]), (5, plain[1]), (5, plain[2]), (None, plain[3]), (None, plain[3] + " elit sed"), (None, None), (8, ""), (9, " \n"), (10, long), (11, long + " end"), (12, plain[1])]
    return [(i, t, "en", "s1" if k % 2 else None, len(t or "")) for k, (i, t) in enumerate(table)]


def one_of_each(table):
    """Indexes of the rows that stay: the smallest id of every component, null ids last."""
    parent = list(range(len(table)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    prints = [print_of(r[1]) for r in table]
    for a in range(len(table)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = {}
    for k in range(len(table)):
        groups.setdefault(find(k), []).append(table[k])
    return [sorted(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def test_representatives(spark):
    table = odd_rows()
    docs = spark.createDataFrame(table, DOCS)
    found = [tuple(r) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    groups = one_of_each(table)
    assert len(found) == len(groups)
    for group in groups:
        mine = [r for r in found if r in group]
        assert len(mine) == 1 and mine[0][0] == group[0][0]
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0


def test_representatives_when_the_marks_are_full(spark, monkeypatch):
    """Each row is suspected: the exact list alone decides."""
    monkeypatch.setattr(simhash, "SUSPECT_LOG2", 0)
    docs = spark.createDataFrame([(*r, "x", 1) for r in odd_rows()], DOCS + ", fp string, k1 int")
    found = simhash.representatives(docs)
    assert found.columns == docs.columns
    assert found.count() == len(one_of_each(odd_rows()))


@pytest.mark.parametrize("empty", [False, True])
def test_run(spark, tmp_path, empty):
    """Nothing is labelled as toxic here, so every representative with words is in the mix, at most twice."""
    table = [] if empty else odd_rows()
    spark.createDataFrame(table, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in (1, 5, 8, 9, 10, 11, 12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = [(r["doc_id"], r["decoded_sha256"], r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    groups = one_of_each(table)
    allowed = {(r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for g in groups for r in g if words(r[1])}
    assert {f[:2] for f in found} <= allowed and all(n > 0 for _, _, n in found)
    assert all(found.count(f) <= 2 for f in found)
    # A source's target is at least one and at most two times its size here, so each representative is there.
    assert len({f[:2] for f in found}) == len([g for g in groups if words(g[0][1])])
