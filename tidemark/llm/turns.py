"""Conversations as streams of their turns: what the chat operators share.

Rows are dealt by conversation and sorted within tasks by Spark's external sort, so a task reads one turn after the
other and holds no table of a group. Turns are ordered by number, nulls first; of equal numbers by role and text, so
results don't depend on how rows are stored. A null conversation id is a conversation of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .store import sliced


def in_order(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, **more: Column) -> DataFrame:
    """(conv, turn, role, text, more) with each conversation in one task, in order."""
    named = {"conv": conv, "turn": turn, "role": role, "text": text, **more}
    x = rows.select(*[c.alias(n) for n, c in named.items()])
    return x.repartition("conv").sortWithinPartitions("conv", x["turn"].asc_nulls_first(), "role", "text")


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Each conversation's id and its rows, without that id, one after the other."""
    rows = (row for batch in sliced(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for conv, own in groupby(rows, key=lambda row: row[0]):
        yield conv, (row[1:] for row in own)


def results(batches: Iterator[pa.RecordBatch], name: str, fields: list[tuple[str, pa.DataType]], found: Callable, weight: Callable, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows that ``found(batches)`` makes, the conversation's id (``name``, of the type it came in) first, as Arrow batches: a new
    one whenever their weights reach ``most``."""
    batches = iter(batches)
    first = next(batches, None)
    if first is None:
        return
    schema = pa.schema([(name, first.schema.field(0).type), *fields])
    held, size = [], 0
    for row in found(chain([first], batches)):
        held.append(row)
        size += weight(row) + 100
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
