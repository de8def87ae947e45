"""Small text helpers that run inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

DOCUMENT = "doc_id bigint, text string"


def lowered_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z in lower case, as UTF-8. Null is empty.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` parts at exactly these six characters.
    """
    return text.encode().lower().split() if text else []


def rows(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], step: int = 256) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, a few at a time so that long texts are not all copied at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)
