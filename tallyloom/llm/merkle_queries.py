"""Registered query of the Merkle manifest, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.merkle import manifest
from tallyloom.llm.registry import query, table

ARITY, DEPTH, DIVISOR = 8, 3, 3
LEAF_LEVELS, TOP_LEVELS = 7, 2  # levels that the SQL spells out: enough for 8 ** 7 documents a language and 64 languages

# CRC-32 (reflected polynomial EDB88320) of the sixteen half-bytes.
NIBBLES = (
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
)


def _crc32(text: str) -> str:
    def half(state: str, value: str) -> str:
        return f"xor({state} >> 4, {list(NIBBLES)}[((xor({state}, {value})) & 15) + 1])"

    step = half(half("acc", "b"), "(b >> 4)")
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda acc, b: {step}), 4294967295::BIGINT)"


def _levels(start: str, group: str, count: int, name: str) -> str:
    """Chained tables of the nodes (group, pos, h) of every level above ``start``, with the siblings of each node."""
    sql, below = "", start
    for k in range(count):
        here = f"{name}{k}"
        run = f"PARTITION BY {group}, pos // 8 ORDER BY pos"
        whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        sql += f""",
{here}_s AS (SELECT {group}, pos, h, count(*) OVER (PARTITION BY {group}) > 1 AS folds,
    COALESCE(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    COALESCE(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind,
    string_agg(h, '') OVER ({run} {whole}) AS together FROM {below}),
{here} AS (SELECT DISTINCT {group}, pos // 8 AS pos, CASE WHEN folds THEN sha256(together) ELSE h END AS h FROM {here}_s)"""
        below = here
    return sql


def _climb(count: int, name: str, keys: str, start: str, prefix: str) -> str:
    """Chained tables that lead every leaf through the levels, with its proof and its folded value."""
    sql, here = "", start
    for k in range(count):
        sql += f""",
{prefix}{k} AS (SELECT c.* EXCLUDE (spot, proof, folded), c.spot // 8 AS spot,
    CASE WHEN s.folds THEN c.proof || s.before || s.behind ELSE c.proof END AS proof,
    CASE WHEN s.folds THEN sha256(s.before || c.folded || s.behind) ELSE c.folded END AS folded
  FROM {here} c JOIN {name}{k}_s s ON {keys} AND s.pos = c.spot)"""
        here = f"{prefix}{k}"
    return sql


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + f" || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || {text} END)"


LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH leaves AS (
  SELECT doc_id, COALESCE('=' || lang, '') AS tree, {_leaf("text")} AS h,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % {DIVISOR} = 0 THEN {_leaf(LOWERED)} END AS changed FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves){_levels("n", "tree", LEAF_LEVELS, "l")},
tops AS (SELECT '' AS whole, tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM l{LEAF_LEVELS - 1}){_levels("tops", "whole", TOP_LEVELS, "t")},
start AS (SELECT doc_id, tree, h AS leaf, pos AS spot, '' AS proof, COALESCE(changed, h) AS folded FROM n){_climb(LEAF_LEVELS, "l", "s.tree = c.tree", "start", "c")},
named AS (SELECT c.* EXCLUDE (spot), t.pos AS spot, t.h AS subroot, '' AS whole FROM c{LEAF_LEVELS - 1} c JOIN tops t ON t.tree = c.tree){_climb(TOP_LEVELS, "t", "s.whole = c.whole", "named", "d")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = r.h AS verified
FROM d{TOP_LEVELS - 1}, t{TOP_LEVELS - 1} r
"""


@query(SQL)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, its roots, its proof, and the root folded from the tampered row."""
    return manifest(table(spark, sf_dir, "documents"), ARITY, DEPTH, DIVISOR)
