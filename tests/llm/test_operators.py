"""The text operators on small tables with nulls, empty and long texts, repeats, clashing columns, and empty tables, against brute force."""

import base64
import hashlib
import math
import re
import zlib

import public_tokenizers
import pytest
import tiktoken
import xxhash

from tallyloom.llm import bm25, bpe, html_text, imatch, lm, mixing, secrets, simhash, substrings, toxicity

SCHEMA = "doc_id long, text string, source string, size long, fp string, score double"
LINE = "a passage of more than one hundred bytes that several of the documents share word for word, as a licence line would be"
TEXTS = [
    None, "", "  \n", "One short text.", "One short text.", LINE + " and an end", "start of it " + LINE, "ab" * 400, "xab" + "ab" * 200,
    "say token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "It's 's ''s \n's été 中文 123 !!  ", " ".join(f"word{i % 977}" for i in range(20000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    table = [(i, t, "a" if i % 3 else None, 7, "clash", 0.5) for i, t in enumerate(TEXTS)] + [(None, "no id here", "b", 1, "x", 0.0), (3, "One short text.", "a", 7, "x", 0.1)]
    return spark.createDataFrame(table, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_mixing(docs, nothing):
    found = mixing.rates(docs).collect()
    assert len(found) == len(TEXTS) + 2 and all(r["copies"] <= 2 for r in found)
    assert sum({r["source_size"]: r["target"] for r in found}.values()) == pytest.approx(1.5 * sum(r["size"] for r in found))
    assert {r["doc_id"]: r["size"] for r in found}[11] == 20000
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in found if r["size"])
    assert mixing.rates(nothing).count() == mixing.mix(nothing).count() == 0


def print_of(text):
    w = words(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, nothing):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(TEXTS) + 2
    by_id = {r["doc_id"]: r for r in found}
    assert all(by_id[i]["fp"] % (1 << 64) == print_of(t) for i, t in enumerate(TEXTS))
    assert by_id[2]["component_id"] == 0 and by_id[4]["component_id"] == 3
    assert simhash.near_duplicates(nothing).count() == 0


def test_simhash_finds_every_link_of_crowded_buckets(spark):
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << a) ^ (1 << b) ^ (1 << c) for a in range(0, 64, 5) for b in range(0, 64, 7) for c in range(0, 64, 11)} | {(base * k) % (1 << 63) for k in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rooted = dict(simhash.near_components(spark.createDataFrame([(p,) for p in signed], "fp long")).collect())
    parent = {p: p for p in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = {}
    for p in signed:
        groups.setdefault(find(p), set()).add(p)
    ours = {}
    for p in signed:
        ours.setdefault(rooted.get(p, p), set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, ours.values()))


def test_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {r["doc_id"]: r for r in bpe.encoded(docs, path, with_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        assert found[i]["ids"] == known.encode_ordinary(t or "")
        assert found[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encoded(nothing, path).count() == 0


def test_html():
    page = """<body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies here.</div><article><h1>Head &amp; line</h1>
    <p>First  paragraph with words, and more.<div class="ad">Buy this now!</div><p><b>Second one<br>goes on for a while, too.</p></article>
    <div id="comments"><p>I do not agree with this article, not at all.</p></div><form>name</form><footer>&copy; 2024</footer><script>var a = "<p>";</script>"""
    assert html_text.main_text(page) == "Head & line\nFirst paragraph with words, and more.\nSecond one goes on for a while, too."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<<>>") == ""
    assert len(html_text.main_text("<p>" + "many words, " * 50000)) > 500000


def test_html_cut_is_minimal():
    odds, edges = [2.0, -1.0, 0.5, -3.0], [(0, 1, 1.5), (1, 2, 0.2), (2, 3, 1.0)]

    def cost(labels):
        return sum(abs(o) for o, x in zip(odds, labels) if (o > 0) != x) + sum(w for a, b, w in edges if labels[a] != labels[b])

    best = min(cost([bool(k >> i & 1) for i in range(4)]) for k in range(16))
    assert cost(html_text.min_cut(odds, edges)) == pytest.approx(best)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<p>Some words, in a row.</p>")], "page_id long, url string, html string")
    assert sorted(r["n_chars"] for r in html_text.extracted(pages).collect()) == [0, 0, 21]
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_imatch(docs, nothing, spark):
    found = imatch.compared(docs).collect()
    assert len(found) == len(TEXTS) + 2 and all(0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1 for r in found)
    same = {r["fingerprint"] for r in found if r["doc_id"] in (3, 4)}
    assert len(same) == 1
    top = next(r for r in found if r["doc_id"] == 11)
    half = len(TEXTS[11]) // 2
    assert top["edited_sha256"] == hashlib.sha256((TEXTS[11][: len(TEXTS[11]) - half] + TEXTS[10][:half]).encode()).hexdigest()
    assert imatch.compared(nothing).count() == 0
    alone = imatch.compared(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()


@pytest.mark.parametrize("hot", [4096, 1])
def test_substrings(docs, nothing, hot):
    found = {r["doc_id"]: r for r in substrings.without_repeats(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), block_bytes=600, hot=hot).collect()}
    seen = set()
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        assert (found[i]["n_removed"], found[i]["n_spans"]) == (sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert found[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert substrings.without_repeats(nothing).count() == 0


def test_lm(docs, nothing):
    found = lm.scored(docs, chars=300).collect()
    assert len(found) == len(TEXTS) + 2
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    counts = {}
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            for w in [*words(t), b" "]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = {i: sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), b" "]) for i, t in rows}
    for r in found:
        assert r["train_tokens"] == n and r["base_score"] == pytest.approx(want[r["doc_id"]]) and r["score"] < 0
    assert lm.scored(nothing).count() == 0


def test_secrets(docs, nothing):
    found = {r["doc_id"]: r for r in secrets.with_spans(docs).collect()}
    text = TEXTS[9]
    assert [(s["start"], s["kind"], s["end"]) for s in found[9]["_base"]] == [(4, 0, text.index('" x')), (13, 2, text.index('" x'))]
    assert found[0]["_spans"] == []
    masked = {r["doc_id"]: r["text"] for r in secrets.masked(docs).collect()}
    assert masked[9] == 'say [SECRET]" x' and masked[3] == TEXTS[3] and masked[0] is None
    assert secrets.masked(docs).columns == docs.columns and secrets.with_spans(nothing).count() == 0


def test_toxicity(spark, docs, nothing):
    table = [(i, f"some words number{i} " + ("vile thing" if i % 3 == 0 else "good thing"), int(i % 3 == 0)) for i in range(300)]
    given = spark.createDataFrame([(a, b) for a, b, _ in table], "doc_id long, text string")
    labels = spark.createDataFrame([(a, c) for a, _, c in table] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(given, labels, max_share=0.5)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(given, model).collect()}
    assert all((scores[a] >= 0.5) == bool(c) for a, _, c in table)
    assert len({r["score"] for r in toxicity.scored(docs.filter("doc_id in (3, 4)"), model).collect()}) == 1
    empty = toxicity.train(nothing, labels.limit(0))
    assert {r["score"] for r in toxicity.scored(docs, empty).collect()} == {0.5}
    assert toxicity.scored(nothing, model).count() == 0


def test_bm25(docs, nothing):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    queries = docs.filter("doc_id in (4, 5)").selectExpr("doc_id as query_id", "text")
    found = [(r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in bm25.search(docs, queries, 3, shard_bytes=400).collect()]
    mean = sum(len(words(t)) for _, t in rows) / len(rows)
    want = []
    for q in (4, 5):
        asked, scored = words(TEXTS[q]), []
        for i, t in rows:
            w, s = words(t), 0
            for term in asked:
                df, tf = sum(term in words(x) for _, x in rows), w.count(term)
                if tf:
                    s += math.floor(math.log(1 + (len(rows) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) * 1e6 + 0.5)
            if s and i != q:
                scored.append((-s, i if i is not None else 1 << 62))
        want += [(q, k + 1, i if i < 1 << 62 else None, -s) for k, (s, i) in enumerate(sorted(scored)[:3])]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert bm25.search(nothing, queries, 3).count() == 0
