"""Keep lines about a word, split them, and keep the longer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.operators.clean import keep_longer, keep_matching, keep_without


def split_lines(lines: DataFrame, column: str = "value", pattern: str = "(?i)line", excluded: str = "apache",
                separator: str = " ", longer_than: int = 2, words: str = "words_array") -> DataFrame:
    """Lines that match ``pattern`` and do not contain ``excluded``, with their words.

    Empty words count. The filters collapse into one and the literal one reaches
    the text scan.
    """
    kept = keep_without(keep_matching(lines, column, pattern), column, excluded)
    return keep_longer(kept.withColumn(words, F.split(F.col(column), separator)), words, longer_than)


def words_of(lines: DataFrame, **options) -> DataFrame:
    """Only the word arrays of :func:`split_lines`."""
    return split_lines(lines, **options).select(options.get("words", "words_array"))
