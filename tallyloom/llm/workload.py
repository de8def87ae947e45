"""Imports every module that registers a query of this subpackage."""

from tallyloom.llm import bm25_queries, bpe_queries, html_queries, imatch_queries, lm_queries, merkle_queries, mixing_queries, phrases_queries, quality_queries, secrets_queries, simhash_queries, substring_queries, toxicity_queries  # noqa: F401
from tallyloom.llm.registry import ORACLES, QUERIES  # noqa: F401
