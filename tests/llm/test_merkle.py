"""The Merkle manifest against a plain tree in memory."""

import hashlib
import zlib

import pytest

from tallyloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, digest string"
EXTRA = ("x", 7, "clash")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[4].translate({c: c + 32 for c in range(65, 91)}) if lower and row[4] is not None else row[4]
    values = [None if v is None else str(v) for v in (*row[:4], text)]
    return H("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def fold(nodes):
    """All levels of a list of digests, the lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, value):
    siblings = []
    for level in levels[:-1]:
        run, slot = level[at // 8 * 8 : at // 8 * 8 + 8], at % 8
        siblings += run[:slot] + run[slot + 1 :]
        value, at = H(*run[:slot], value, *run[slot + 1 :]), at // 8
    return siblings, value


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    below = {n: fold([leaf(r) for r in sorted(trees[n], key=lambda r: (r[0] is not None, r[0], leaf(r)))]) for n in names}
    top = fold([below[n][-1][0] for n in names])
    found = []
    for k, n in enumerate(names):
        for at, row in enumerate(sorted(trees[n], key=lambda r: (r[0] is not None, r[0], leaf(r)))):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            own, value = climb(below[n], at, leaf(row, changed))
            others, value = climb(top, k, value)
            found.append((row[0], leaf(row), below[n][-1][0], top[-1][0], H(*own, *others), value, value == top[-1][0]))
    return sorted(found, key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    assert sorted(map(tuple, merkle.manifest(docs, **options).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("depth", [1, 3])
def test_manifest(spark, depth):
    rows = [(i, f"s{i % 3}", "en" if i % 3 else "été", i, f"Text {i} With ÄA capitals") for i in range(-5, 150)]
    rows += [(200, None, None, None, None), (201, "", "", 0, ""), (None, "s", "en", 1, "no id"), (None, None, "en", 2, "B"), (7, "s1", "en", 7, "Another text"), (202, "s", "one", 5, "Alone")]
    rows += [(300, "s", "en", 9, "Same row")] * 3 + [(2**62, "s", "en", 9, "Long text, " * 50_000), (-(2**62), "s", "en", 9, "x")]
    check(spark, rows, depth=depth)


def test_many_languages(spark):
    check(spark, [(i, None, f"l{i}", 1, "T") for i in range(30)], depth=1)


def test_one_row_and_none(spark):
    check(spark, [(3, "s", None, 1, "Only")])
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_midstates():
    parent = merkle.Parent([b"a" * 64, b"b" * 64, b"c" * 64])
    assert parent.digest == H("a" * 64, "b" * 64, "c" * 64).encode()
    assert parent.fold(1, b"x" * 64) == H("a" * 64, "x" * 64, "c" * 64).encode()
    assert parent.others(2) == b"a" * 64 + b"b" * 64
