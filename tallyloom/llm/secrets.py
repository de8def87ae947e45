"""Secret scans with DataFrame functions only: fixed patterns, and character Markov models.

Long tokens that the patterns leave are compared under two Markov models of
neighbouring characters, one of random strings and one of ordinary identifiers.
A token is a secret if its mean log-likelihood ratio is above a threshold and
it has both letters and digits. The models are counted on labelled samples:
ordinary tokens of about ``max_docs`` documents drawn by a hash of the text,
and random strings: what the patterns find in these documents, and digests of
numbers in base 64 and 16.

Positions come from cutting a text at the same pattern: the lengths of gaps and
matches add up to the start of every match, in code points.

Defined results: null and empty texts have no spans; repeated rows stay rows;
an empty table gives no rows. Columns of the input pass through ``with_spans``
and ``masked`` by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.tables import dense_array

# The kinds in the order of the contract, their patterns, and the least length of a value.
KINDS = ("assign", "access", "hex", "random")
PATTERNS = {
    "assign": (r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ORDINARY = r"[A-Za-z0-9+/_=-]{6,}"
PLACES = 128 * 128


def found(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans (start, kind, end) of the matches whose group is long enough, leftmost and not overlapping."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.char_length).alias("size"), F.transform(value, F.char_length).alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        kept = F.when(x["value"] >= least, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    summed = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step)["spans"]
    quick = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}"}.get(KINDS[kind], pattern)  # every span that is kept has this
    return F.when(text.rlike(quick), summed).otherwise(empty)


def _pairs(token: Column) -> Column:
    """Places of the neighbouring character pairs of an ASCII token."""
    codes = F.transform(F.split(token, ""), F.ascii)
    size = F.greatest(F.char_length(token) - 1, F.lit(0))
    return F.zip_with(F.slice(codes, 1, size), F.slice(codes, 2, size), lambda a, b: a * 128 + b)


def markov_ratios(docs: DataFrame, text_col: str = "text", max_docs: int = 2000, strings: int = 4096) -> Column:
    """log P(next | char) under the random model minus the same under the ordinary one, as an array by char * 128 + next."""
    spark: SparkSession = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter("text is not null")
    wide = 1 << 40
    share = int(wide * min(1.0, max_docs / max(1, texts.count())))
    drawn = texts.filter(F.pmod(F.xxhash64("text"), F.lit(wide)) < share)
    assign, access, hexed = (PATTERNS[k] for k in ("assign", "access", "hex"))
    values = F.filter(
        F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g, _ in (assign, access)], F.regexp_extract_all("text", F.lit(r"[0-9a-f]{24,}"), F.lit(0))),
        lambda v: F.char_length(v) >= 16,
    )
    rest = F.regexp_replace(F.regexp_replace("text", assign[0], " "), r"[0-9a-f]{24,}|AKIA[A-Z0-9]{16,}", " ")
    labelled = drawn.select(F.explode(F.concat(
        F.transform(values, lambda v: F.struct(v.alias("token"), F.lit(1).alias("random"))),
        F.transform(F.regexp_extract_all(rest, F.lit(ORDINARY), F.lit(0)), lambda v: F.struct(v.alias("token"), F.lit(0).alias("random"))),
    )).alias("x")).select("x.token", "x.random")
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(strings).select(F.explode(F.array(F.regexp_replace(F.base64(F.unhex(digest)), "=", ""), F.substring(digest, 1, 40))).alias("token"), F.lit(1).alias("random"))
    pairs = labelled.union(made).filter(F.char_length("token") > 1).select("random", F.explode(_pairs(F.col("token"))).alias("i"))
    counts = pairs.groupBy("i").agg(F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o"))
    first = F.floor(F.col("i") / 128).cast("int")
    totals = counts.groupBy(first.alias("c")).agg(F.sum("r").alias("all_r"), F.sum("o").alias("all_o"))
    places = spark.range(PLACES).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").withColumn("c", first).join(totals, "c", "left").na.fill(0)
    ratio = F.log((F.col("r") + 1) / (F.col("all_r") + 128)) - F.log((F.col("o") + 1) / (F.col("all_o") + 128))
    return dense_array(places.select(F.col("i").cast("long").alias("i"), F.round(ratio, 6).alias("v")), PLACES, "double")


def with_spans(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, max_docs: int = 2000) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans``: arrays of (start, kind, end), by start, then kind."""
    ratios = markov_ratios(docs, text_col, max_docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.array_sort(F.concat(*[found(text, *PATTERNS[kind], k) for k, kind in enumerate(KINDS[:3])]))

    def is_random(span: Column) -> Column:
        def likelier(token: Column) -> Column:
            total = F.aggregate(_pairs(token), F.lit(0.0), lambda s, i: s + F.element_at(ratios, i + 1))
            return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (total / (F.char_length(token) - 1) > threshold)

        # An array of one: the token is cut out of the text once, however often the test looks at it.
        return F.exists(F.array(F.substring(text, span["start"] + 1, span["end"] - span["start"])), likelier)

    first = docs.withColumn("_base", base).withColumn("_candidates", found(text, CANDIDATE, 0, 20, 3))
    free = F.filter("_candidates", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])) & is_random(c))
    return first.withColumn("_spans", F.array_sort(F.concat("_base", free))).drop("_candidates")


def joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span in the text replaced by ``mask``; overlapping spans become one."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, s["start"] - done["at"]), F.lit(mask))
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], more).otherwise(done["out"]).alias("out"))

    whole = F.aggregate("_spans", start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.lit(2**31 - 1))))
    cleaned = F.when(F.size("_spans") > 0, whole).otherwise(text)
    return with_spans(docs, text_col, **options).withColumn("_clean", cleaned).select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
