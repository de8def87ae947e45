"""Merkle manifest of a table, with proofs folded from retained SHA-256 midstates.

Every row is a leaf. Per ``lang``, leaves ascend by doc_id and every ``arity``
consecutive nodes become one, until one is left; the roots of the languages
are folded the same way. A parent keeps a copy of its hash state before each
child's slot, so a replaced child costs the matching state, the replacement
and the siblings to its right; nothing to its left is hashed again.

Leaves are hashed where the texts lie and only digests move. Ranks come from a
range partitioning and one number per partition. A task builds a block of
``arity ** depth`` leaves with all levels inside it, whatever the size of the
language, and the roots of the blocks are the leaves of the next stage. On the
way down, a block needs only the siblings of its own root.

Defined results: a null field counts as ``-``; a null doc_id comes before all
others and is never tampered with; rows with one id follow by leaf, and equal
rows are interchangeable; null, empty and very long texts are leaves like any
other; a table of one row has that leaf as its root and an empty proof; an empty
table gives no rows. Only the five named columns are read, so other columns
may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyloom.scratch import materialise, partitions_for

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Parent:
    """A node of the tree: its digest, and the hash state before each of its children."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The digest with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(replacement)
        for sibling in self.children[slot + 1 :]:
            state.update(sibling)
        return state.hexdigest().encode()

    def others(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :])


def levels(nodes: list[bytes], arity: int, depth: int, last: bool) -> list[list[Parent]]:
    """The parents of consecutive nodes, level by level; ``last``: until one node is left, else ``depth`` levels."""
    built: list[list[Parent]] = []
    while len(nodes) > 1 if last else len(built) < depth:
        built.append([Parent(nodes[k : k + arity]) for k in range(0, len(nodes), arity)])
        nodes = [p.digest for p in built[-1]]
    return built


def climb(built: list[list[Parent]], at: int, arity: int) -> Iterator[tuple[Parent, int]]:
    """The parents above node ``at`` and the slot in each."""
    for level in built:
        yield level[at // arity], at % arity
        at //= arity


def _field(name: str, text: Column) -> Column:
    value = text if name == "text" else F.col(f"`{name}`").cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column) -> Column:
    """The digest of a row with ``text`` in place of its text."""
    return F.sha2(F.concat(*[_field(name, text) for name in FIELDS]).cast("binary"), 256)


def _tree(lang: Column) -> Column:
    """The name of a language's tree: never null, in the order of the languages, the null one first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


def leaves(docs: DataFrame, divisor: int = 3) -> DataFrame:
    """doc_id, tree, digest (of the leaf), and ``changed``: the digest after tampering, null where nothing is tampered with."""
    text = F.col("text").cast("string")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 0
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _tree(F.col("lang").cast("string")).alias("tree"), leaf(text).alias("digest"),
        F.when(chosen, leaf(F.translate(text, *LOWER))).alias("changed"),
    )


def ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` (stored) with ``pos``, the number of earlier rows of the same ``tree`` by the columns ``by``, and ``nodes``, the rows of the tree.

    A range partitioning sorts the rows, every partition numbers its own, and
    the rows of earlier partitions are added: one number per partition and tree.
    """
    numbered = nodes.withColumn("row", F.monotonically_increasing_id())
    keys = ["tree", *by, "row"]
    order = [F.col(c).asc_nulls_first() for c in keys]
    placed = numbered.repartitionByRange(partitions_for(nodes, 16 << 20), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, seen = None, 0
        for batch in batches:
            numbers = []
            for t in batch.column("tree").to_pylist():
                if t != tree:
                    tree, seen = t, 0
                numbers.append(seen)
                seen += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "inside"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema.fields)
    stored = materialise(placed.mapInArrow(run, f"{fields}, inside bigint"), "merkle-placed")
    sizes = stored.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("tree").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("tree").alias("of"), F.col("part").alias("in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(W.partitionBy("tree")).alias("nodes"),
    )
    joined = stored.join(materialise(offsets, "merkle-offsets"), (F.col("tree") == F.col("of")) & (F.col("part") == F.col("in")))
    return joined.select(*nodes.columns, (F.col("offset") + F.col("inside")).alias("pos"), "nodes")


def _blocked(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / size).cast("long"))


def _digests(table: pa.Table, name: str, order: list[int]) -> list[bytes]:
    values = table.column(name).to_pylist()
    return [values[k].encode() for k in order]


def _in_order(table: pa.Table) -> list[int]:
    positions = table.column("pos").to_pylist()
    return sorted(range(len(positions)), key=positions.__getitem__)


def above(nodes: DataFrame, arity: int, depth: int) -> DataFrame:
    """The nodes one stage higher: tree, digest, pos, nodes."""
    size = arity**depth

    def run(table: pa.Table) -> pa.Table:
        total = table.column("nodes")[0].as_py()
        digests = _digests(table, "digest", _in_order(table))
        built = levels(digests, arity, depth, total <= size)
        return pa.table({
            "tree": table.column("tree").slice(0, 1).cast(pa.string()), "digest": [(built[-1][0].digest if built else digests[0]).decode()],
            "pos": table.column("block").slice(0, 1), "nodes": pa.array([-(-total // size)], pa.int64()),
        })

    picked = _blocked(nodes.select("tree", "digest", "pos", "nodes"), size)
    return picked.groupBy("tree", "block").applyInArrow(run, "tree string, digest string, pos bigint, nodes bigint")


STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
PATH = "array<struct<left: string, right: string>>"


def below(nodes: DataFrame, higher: DataFrame, arity: int, depth: int) -> DataFrame:
    """tree, pos, path, subroot, root of ``nodes``, whose blocks are the rows of ``higher`` (the same columns).

    A path holds the siblings on both sides, level by level up to the root.
    """
    size = arity**depth

    def run(table: pa.Table, blocks: pa.Table) -> pa.Table:
        order, found = _in_order(table), [None] * table.num_rows
        if order:
            upper = blocks.column("path")[0].as_py()
            built = levels(_digests(table, "digest", order), arity, depth, table.column("nodes")[0].as_py() <= size)
            for at, k in enumerate(order):
                steps = climb(built, at, arity)
                found[k] = [{"left": b"".join(p.children[:s]).decode(), "right": b"".join(p.children[s + 1 :]).decode()} for p, s in steps] + upper
        shared = {c: pa.array([blocks.column(c)[0].as_py()] * len(order) if order else [], pa.string()) for c in ("subroot", "root")}
        return pa.table({"tree": table.column("tree"), "pos": table.column("pos"), "path": pa.array(found, pa.list_(STEP)), **shared})

    left = _blocked(nodes.select("tree", "digest", "pos", "nodes"), size).groupBy("tree", "block")
    right = higher.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    return left.cogroup(right).applyInArrow(run, f"tree string, pos bigint, path {PATH}, subroot string, root string")


RESULT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def proved(rows: DataFrame, higher: DataFrame, arity: int, depth: int) -> DataFrame:
    """The result rows of all leaves; ``higher`` has the path, subroot and root of every block of them."""
    size = arity**depth

    def run(table: pa.Table, blocks: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if table.num_rows:
            order, upper = _in_order(table), blocks.column("path")[0].as_py()
            digests, changed, ids = _digests(table, "digest", order), table.column("changed").to_pylist(), table.column("doc_id").to_pylist()
            built = levels(digests, arity, depth, table.column("nodes")[0].as_py() <= size)
            subroot, root = (blocks.column(c)[0].as_py() for c in ("subroot", "root"))
            # Above the block, the state before its slot is the same for all of its leaves.
            resumed = [(hashlib.sha256(step["left"].encode()), step["right"].encode()) for step in upper]
            rest = b"".join((step["left"] + step["right"]).encode() for step in upper)
            for at, k in enumerate(order):
                proof, folded = hashlib.sha256(), changed[k].encode() if changed[k] else digests[at]
                for parent, slot in climb(built, at, arity):
                    proof.update(parent.others(slot))
                    folded = parent.fold(slot, folded)
                proof.update(rest)
                for before, right in resumed:
                    state = before.copy()
                    state.update(folded)
                    state.update(right)
                    folded = state.hexdigest().encode()
                found.append((ids[k], digests[at].decode(), subroot, root, proof.hexdigest(), folded.decode(), folded.decode() == root))
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        columns = zip(*found, strict=True) if found else [()] * len(types)
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=list(RESULT))

    left = _blocked(rows.select("tree", "digest", "changed", "doc_id", "pos", "nodes"), size).groupBy("tree", "block")
    right = higher.select("tree", F.col("pos").alias("block"), "path", "subroot", "root").groupBy("tree", "block")
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return left.cogroup(right).applyInArrow(run, schema)


def _stages(nodes: DataFrame, arity: int, depth: int) -> list[DataFrame]:
    """``nodes`` and the stored stages above it; the last has one node per tree."""
    stages = [nodes]
    largest = nodes.agg(F.max("nodes")).first()[0] or 0
    while largest > 1:
        stages.append(materialise(above(stages[-1], arity, depth), "merkle-stage"))
        largest = -(-largest // arity**depth)
    return stages


def _paths(stages: list[DataFrame], top: DataFrame, arity: int, depth: int) -> DataFrame:
    """Paths of the second stage from those of the last one."""
    for stage in reversed(stages[1:-1]):
        top = materialise(below(stage, top, arity, depth), "merkle-paths")
    return top


def manifest(docs: DataFrame, arity: int = 8, depth: int = 3, divisor: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``."""
    rows = materialise(ranked(materialise(leaves(docs, divisor), "merkle-leaves"), ["doc_id", "digest"]), "merkle-ranked")
    stages = _stages(rows, arity, depth)
    roots = materialise(stages[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "merkle-subroots")
    named = materialise(ranked(roots, ["name"]), "merkle-names")
    upper = _stages(named, arity, depth)
    nowhere, unnamed = F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot")
    top = upper[-1].select("tree", "pos", nowhere, unnamed, F.col("digest").alias("root"))
    if len(upper) > 1:
        top = below(named, _paths(upper, top, arity, depth), arity, depth)
    tops = top.select("pos", "path", "root").join(named.select("pos", "name", "digest"), "pos")
    tops = tops.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    return proved(rows, _paths(stages, materialise(tops, "merkle-tops"), arity, depth), arity, depth)
