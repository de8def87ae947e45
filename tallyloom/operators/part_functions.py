"""Functions of whole parts: one call, one result per part, however many rows it has.

``map_whole_parts`` hands a part to a function as a stream of Arrow batches, in
an order if one is asked for: for functions that must see the rows of a part
one after the other. The part is never in memory as a whole, but one task
reads it.

``fold_parts`` is for functions that can be computed piece by piece and merged.
Every task folds the rows it has, of whatever parts, into one bounded state per
part, and only states are shuffled: a part that holds a third of all rows costs
one state per task. States are merged in the order of the numbers of their
tasks, so the result does not depend on which task ends first.

Defined results: a null part is a part; a part without rows has no result; an
empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# States that a task holds before it passes them on: a bound on its memory, not on the parts.
HELD_STATES = 10_000
STATE = "state binary, task bigint, turn bigint"


def map_whole_parts(
    df: DataFrame, part: str, fn: Callable[[Any, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, order: Sequence[str | Column] = ()
) -> DataFrame:
    """``fn(part value, batches)`` once per part; it yields batches of ``schema``.

    The rows are laid out by the part and sorted once, by (part, order); the
    grouping reuses both.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(key[0].as_py(), batches)

    return df.repartition(part).sortWithinPartitions(part, *order).groupBy(part).applyInArrow(run, schema)


def fold_parts(
    df: DataFrame, part: str, start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], Any], merge: Callable[[Any, Any], Any],
    finish: Callable[[Any], dict[str, Any]], schema: str, held: int = HELD_STATES,
) -> DataFrame:
    """The part column and the columns of ``schema``: one row per part.

    ``start()`` makes a state, ``step(state, batch)`` takes rows of one part in,
    ``merge(a, b)`` joins two states (associative, as the rows are cut anywhere),
    and ``finish(state)`` gives the named values. A state must not grow with the
    number of rows; it travels pickled.
    """
    kind = df.schema[part].dataType.simpleString()
    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[Any, Any] = {}
        task, turn, type_ = TaskContext.get().partitionId(), 0, None

        def passed_on() -> pa.RecordBatch:
            packed = [pickle.dumps(s) for s in states.values()]
            columns = [pa.array(list(states), type_), pa.array(packed, pa.binary()), pa.array([task] * len(packed), pa.int64()), pa.array([turn] * len(packed), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=[part, "state", "task", "turn"])

        for batch in batches:
            type_ = batch.column(part).type
            coded = batch.column(part).dictionary_encode()
            for k, value in enumerate([*coded.dictionary.to_pylist(), None]):
                of_part = pc.equal(coded.indices, k) if k < len(coded.dictionary) else pc.is_null(coded.indices)
                rows = batch.filter(of_part)
                if rows.num_rows:
                    states[value] = step(states[value] if value in states else start(), rows)
            if len(states) >= held:
                yield passed_on()
                states.clear()
                turn += 1
        if states:
            yield passed_on()

    def join(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states = (pickle.loads(packed) for batch in batches for packed in batch.column("state").to_pylist())
        found = finish(reduce(merge, states))
        columns = [pa.array([found[n]], t) for n, t in zip(names, types, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], key[0].type), *columns], names=[part, *names])

    states = df.mapInArrow(fold, f"`{part}` {kind}, {STATE}")
    laid = states.repartition(part).sortWithinPartitions(part, "task", "turn")
    return laid.groupBy(part).applyInArrow(join, f"`{part}` {kind}, {schema}")
