"""Reduce and fold.

Three ways, from the fastest: built-in aggregates (partial sums before the shuffle, spilling, any key skew); Column
lambdas, which merge the values of a key in lists of bounded size, level by level; Python functions, which see the rows
of a key as a sorted stream, so that no key has to fit in memory.

Nulls, in every way of reduce: a null value is left out; a key with nulls alone has null.  A fold sees them."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types
from ..dataset import Dataset
from . import arrow

#: Names and plain Python functions that stand for a built-in aggregate.
BUILT_IN: dict[object, Callable[[Column], Column]] = {
    "sum": F.sum, "min": F.min, "max": F.max, "any": F.any_value,
    "bool_and": F.bool_and, "bool_or": F.bool_or, "bit_and": F.bit_and, "bit_or": F.bit_or, "bit_xor": F.bit_xor,
    operator.add: F.sum, operator.and_: F.bit_and, operator.or_: F.bit_or, operator.xor: F.bit_xor, min: F.min, max: F.max,
}


#: Products are exact for integers and decimals (by the Python path, overflow is an error); F.product works in doubles.
PRODUCT = ("product", operator.mul)
#: Rows whose values of a key are merged in one list at the first level.
CHUNK_BITS = 13


def _one_value(ds: Dataset, name: str) -> str:
    if len(ds.values) != 1:
        raise types.TypeCheckError(name, f"exactly one value column is needed, there are {len(ds.values)}")
    types.check_keys(ds.schema, ds.prefix, name)
    return ds.values[0]


def reduce(ds: Dataset, fn) -> Dataset:
    """One row per key, its values combined by an associative and commutative ``fn``: a name or plain function of
    BUILT_IN, or any Python function of two values.  No identity is applied: a lone value is returned as it is."""
    value = _one_value(ds, "reduce")
    known = BUILT_IN.get(fn) if isinstance(fn, str) or callable(fn) else None
    kind = ds.schema[value].dataType
    if fn in PRODUCT:
        known, fn = (F.product, fn) if isinstance(kind, (types.T.FloatType, types.T.DoubleType)) else (None, operator.mul)
    if known is not None:
        return ds.with_df(ds.df.groupBy(*ds.keys).agg(known(value).cast(kind).alias(value)), name="reduce")
    types.check_arity(fn, 2, "reduce")
    shape, n = ds.schema, ds.prefix

    def merged(acc, v):
        return acc if v is None else v if acc is None else fn(acc, v)

    def combined(batches):
        """Partial: a table per task, flushed when it grows large."""
        table: dict = {}
        for row in arrow.rows_of(batches):
            k, v = row[:n], row[n]
            table[k] = merged(table.get(k), v)
            if len(table) > 100_000:
                yield from arrow.batches_of(((*k, v) for k, v in table.items()), shape)
                table = {}
        yield from arrow.batches_of(((*k, v) for k, v in table.items()), shape)

    def final(batches):
        def rows():
            for k, group in arrow.key_runs(batches, n):
                acc = None
                for row in group:
                    acc = merged(acc, row[n])
                yield (*k, acc)

        return arrow.batches_of(rows(), shape)

    partial = ds.df.mapInArrow(combined, shape)
    return ds.with_df(partial.repartition(ds.shards, *ds.keys).sortWithinPartitions(*ds.keys).mapInArrow(final, shape), name="reduce")


def _levels(rows: DataFrame, keys: list[str], gather: Callable[[str], Column], merge: Callable[[str], Column]) -> DataFrame:
    """One row per key: the column ``_v``, merged from lists of bounded size.

    First the rows of a key within each 2^CHUNK_BITS neighbouring rows of a partition, then those results within a
    partition, then those of all partitions: so a list holds at most that many rows, or one value per chunk of a partition, or one per partition."""
    chunk, part = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS), F.spark_partition_id()
    level = rows.withColumns({"_chunk": chunk, "_part": part}).groupBy(*keys, "_chunk", "_part").agg(gather("_v").alias("_v"))
    level = level.groupBy(*keys, "_part").agg(F.collect_list("_v").alias("_all")).select(*keys, "_part", merge("_all").alias("_v"))
    return level.groupBy(*keys).agg(F.collect_list("_v").alias("_all")).select(*keys, merge("_all").alias("_v"))


def reduce_expr(ds: Dataset, merge: Callable[[Column, Column], Column]) -> Dataset:
    """As reduce, by an associative and commutative Column function of two Columns; no identity is applied."""
    value = _one_value(ds, "reduce_expr")
    kind = ds.schema[value].dataType

    def merged(column: str | Column) -> Column:
        all_ = F.col(column) if isinstance(column, str) else column
        rest = F.slice(all_, 2, F.greatest(F.size(all_) - 1, F.lit(0)))
        return F.when(F.size(all_) > 0, F.aggregate(rest, F.element_at(all_, 1), lambda a, x: merge(a, x).cast(kind)))  # a list holds no nulls

    out = _levels(ds.df.withColumnRenamed(value, "_v"), ds.keys, lambda c: merged(F.collect_list(c)), merged)
    return ds.with_df(out.withColumnRenamed("_v", value), name="reduce")


def fold(ds: Dataset, fn=None, zero=None, schema=None, keys: int = 1, strict: bool = False, **aggregates: Column) -> Dataset:
    """Group by the first column (``keys`` columns) and fold the other columns.

    ``aggregates``: named aggregate Columns.  Or ``fn(acc, *values) -> acc`` from ``zero()`` (or a plain ``zero``), its
    accumulator's columns given by ``schema``; rows of a key stream through, in no fixed order.  ``strict`` allows only
    string and integer keys."""
    if len(ds.df.columns) < keys + 1:
        raise types.TypeCheckError("fold", "there is no column to fold")
    if ds.prefix > 1 and keys == 1:
        raise types.TypeCheckError("fold", f"the key has {ds.prefix} columns; pass keys={ds.prefix} to fold by all of them")
    types.check_keys(ds.schema, keys, "fold", types.FOLD_KEYS if strict else types.KEYABLE)
    names = ds.df.columns[:keys]
    if aggregates:
        return ds.with_df(ds.df.groupBy(*names).agg(*[c.alias(n) for n, c in aggregates.items()]), name="fold", prefix=keys)
    types.check_arity(fn, 1 + len(ds.df.columns) - keys, "fold")
    acc_schema = types.as_schema(schema) if schema is not None else types.returned(fn, "fold", ["acc"])
    shape = types.T.StructType([*ds.schema.fields[:keys], *acc_schema.fields])
    width = len(acc_schema.fields)

    def run(batches):
        def rows():
            for k, group in arrow.key_runs(batches, keys):
                acc = zero() if callable(zero) else zero
                for row in group:
                    acc = fn(acc, *row[keys:])
                yield (*k, *arrow.as_row(acc, width))

        return arrow.batches_of(rows(), shape)

    grouped = ds.df.repartition(ds.shards, *names).sortWithinPartitions(*names)
    return ds.with_df(grouped.mapInArrow(run, shape), name="fold", prefix=keys)


def fold_expr(
    ds: Dataset, zero: Column, merge: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, name: str = "acc", combine: Callable[[Column, Column], Column] | None = None
) -> Dataset:
    """As fold, by Column functions: merge(acc, row struct) and finish(acc).

    With combine(acc, acc), the rows of a key are folded in bounded lists whose results are combined (``zero`` must be
    neutral for it).  Without it a fold cannot be cut: the rows of a key are gathered, so keys must be of bounded size;
    ``fold`` by a Python function streams them."""
    key = ds.df.columns[0]
    row = F.struct(*ds.df.columns[1:])
    folded = lambda all_: F.aggregate(all_, zero, merge)
    if combine is None:
        acc = ds.df.groupBy(key).agg(F.collect_list(row).alias("_v")).select(key, folded("_v").alias("_v"))
    else:
        acc = _levels(ds.df.select(key, row.alias("_v")), [key], lambda c: folded(F.collect_list(c)), lambda c: F.aggregate(c, zero, combine))
    done = F.element_at(F.transform(F.array("_v"), finish), 1) if finish else F.col("_v")
    return ds.with_df(acc.select(key, done.alias(name)), name="fold", prefix=1)


def distinct(ds: Dataset) -> Dataset:
    return ds.with_df(ds.df.distinct(), name="distinct")


def total(ds: Dataset, **aggregates: Column) -> Dataset:
    """Fold of everything under one constant key: a single row, or none for an empty dataset."""
    grouped = ds.df.withColumn("_unit", F.lit(0)).groupBy("_unit").agg(*[c.alias(n) for n, c in aggregates.items()])
    return ds.with_df(grouped.drop("_unit"), name="total", prefix=min(1, len(aggregates)))


def count(ds: Dataset, name: str = "n") -> Dataset:
    return ds.with_df(ds.df.groupBy(*ds.keys).agg(F.count(F.lit(1)).alias(name)), name="count")
