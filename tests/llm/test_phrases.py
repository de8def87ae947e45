"""Phrase mining against plain counting, with samples and filters that fail."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, a long, score double, phrase string"


def texts():
    draw = random.Random(4)
    words = [f"w{k}" for k in range(30)] + ["Été", "\xa0x"]
    made = [" ".join(draw.choice(words[: draw.randint(2, 32)]) + draw.choice(["", "", "", ",", ".\n", "\t"]) for _ in range(draw.randint(1, 60))) for _ in range(150)]
    return [*made, None, "", " \t ", "...", "New York City " * 400, "same same same same same same", "ONE one oNe"]


@pytest.fixture(scope="module")
def table():
    return [(i, t, ("en", "fr", None, "und")[i % 4]) for i, t in enumerate(texts())] + [(None, "w1 w2 w3", "en"), (3, "w1 w2 w3", None), (3, "w1 w2 w3", None)]


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame([(*r, 1, 0.5, "clash") for r in table], SCHEMA)


def plain(table):
    f = {}
    for _, text, lang in table:
        lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            for length in (1, 2, 3):
                for k in range(len(w) - length + 1):
                    key = (lang or "und", tuple(w[k : k + length]))
                    f[key] = f.get(key, 0) + 1
    return f


def brute(table, top, least, covered):
    f, found = plain(table), {}
    for (lang, w), a in f.items():
        if len(w) > 1 and a >= least:
            longer = [g for (x, v), g in f.items() if x == lang and len(v) > len(w) and g >= least and w in [v[k : k + len(w)] for k in range(len(v) - len(w) + 1)]]
            if any(100 * g >= covered * a for g in longer):
                continue
            cut = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            found.setdefault(lang, []).append((cut[0], a, " ".join(w), f[lang, w[: cut[1]]], f[lang, w[cut[1] :]]))
    rows = []
    for lang, some in found.items():
        n = sum(g for (x, v), g in f.items() if x == lang and len(v) == 1)
        some.sort(key=lambda c: (-c[0], -c[1], c[2].encode()))
        rows += [(lang, k + 1, c[2], c[1], c[3], c[4], n, c[0]) for k, c in enumerate(some[:top])]
    return sorted(rows)


@pytest.mark.parametrize(("share", "lowered", "top"), [(0.125, 2, 2000), (0.0, 2, 2000), (0.3, 3, 7), (1.0, 10, 2000)])
def test_mined(docs, table, share, lowered, top):
    found = sorted(map(tuple, phrases.mined(docs, top=top, share=share, lowered=lowered).collect()))
    assert found == brute(table, top, 10, 50)


@pytest.mark.parametrize("bits", [6, 16])
def test_counts_are_exact_whatever_the_filter_lets_through(docs, table, bits, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", bits)
    monkeypatch.setattr(phrases, "MOST_BITS", bits)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 500)
    known, passes = phrases.frequencies(phrases.texts_of(docs, "doc_id", "text", "lang"), share=0.05)
    found = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in known.collect()}
    assert found == {k: g for k, g in plain(table).items() if g >= 10 or len(k[1]) == 1}
    assert passes <= 3


def test_passes_grow_with_the_failures_of_the_sample(docs):
    picked = phrases.texts_of(docs, "doc_id", "text", "lang")
    assert phrases.frequencies(picked, share=1.0, lowered=10)[1] == 1
    assert phrases.frequencies(picked, share=0.0)[1] == 3


def test_filter_has_no_false_negatives(spark):
    held = [("en", f"w{k} v{k % 7}") for k in range(500)] + [("fr", f"w{k}") for k in range(300)] + [("en", "a b c")]
    made = phrases.Proposed(phrases.filter_bits(spark.createDataFrame(held, "lang string, phrase string"), 16))
    for lang in ("en", "fr"):
        assert made.holds(phrases.phrase_keys(lang, [p for x, p in held if x == lang])).all()
    assert made.holds(phrases.phrase_keys("en", [f"x{k}" for k in range(2000)])).mean() < 0.05
    assert not phrases.Proposed(np.zeros(1024, np.uint64)).holds(phrases.phrase_keys("en", ["a"])).any()


def test_score_beyond_64_bits(spark):
    a, l, r = 9_876_543_210_987, 12_345_678_901_234, 9_999_999_999_999
    row = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).first()
    assert row["s"] == 1_000_000 * a * a // (l * r)


def test_empty(docs):
    assert phrases.mined(docs.limit(0)).count() == 0
    assert phrases.mined(docs.filter("trim(text) = ''")).count() == 0
