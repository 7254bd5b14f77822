"""Python functions over Arrow batches: the path for code that Column expressions cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of output gathered before a batch is passed on.
OUT_ROWS = 8192


def shard_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def columns_of(batch: pa.RecordBatch) -> list[list]:
    return [c.to_pylist() for c in batch.columns]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*columns_of(batch), strict=True) if batch.num_columns else [()] * batch.num_rows


def batches_of(rows: Iterator[tuple], schema: StructType) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(schema)
    waiting: list[tuple] = []
    for row in rows:
        waiting.append(row)
        if len(waiting) >= OUT_ROWS:
            yield _batch(waiting, arrow)
            waiting = []
    if waiting:
        yield _batch(waiting, arrow)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def as_row(value, width: int) -> tuple:
    """What a function returned, as a row of ``width`` columns."""
    if width == 1 and not (isinstance(value, tuple) and len(value) == 1):
        return (value,)
    if not isinstance(value, tuple) or len(value) != width:
        raise ValueError(f"expected {width} columns, got {value!r}")
    return value


def mapped(fn: Callable, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = len(schema.fields)

    def run(batches):
        return batches_of((as_row(fn(*row), width) for row in rows_of(batches)), schema)

    return run


def kept(fn: Callable) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for batch in batches:
            verdicts = [fn(*row) for row in zip(*columns_of(batch), strict=True)]
            wrong = next((v for v in verdicts if not isinstance(v, bool)), None)
            if wrong is not None:
                raise TypeError(f"a predicate must return bool, got {wrong!r}")
            yield batch.filter(pa.array(verdicts, pa.bool_()))

    return run


def flattened(fn: Callable, schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = len(schema.fields)

    def rows(batches):
        for row in rows_of(batches):
            vectors = fn(*row)
            vectors = (vectors,) if width == 1 and not isinstance(vectors, tuple) else vectors
            if len({len(v) for v in vectors}) > 1:
                raise ValueError(f"vectors of unequal length: {[len(v) for v in vectors]}")
            yield from zip(*vectors, strict=True)

    return lambda batches: batches_of(rows(batches), schema)


def key_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Rows sorted by key as (key, its rows), one key at a time."""
    from itertools import groupby

    return groupby(rows_of(batches), key=lambda row: row[:n_keys])
