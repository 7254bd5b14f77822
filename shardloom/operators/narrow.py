"""Operators that work row by row: map, filter, flatmap, head."""

from __future__ import annotations

import builtins

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types
from ..dataset import Dataset
from ..pragma import Pragma, profile
from . import arrow


def _is_expr(x) -> bool:
    return isinstance(x, (Column, str))


def map(ds: Dataset, *exprs, schema=None, pragma: Pragma | None = None) -> Dataset:
    """Row to row.  ``exprs``: Columns (or column names), or one Python function of all columns whose schema is given
    or annotated.  The key goes back to one column."""
    if exprs and builtins.all(_is_expr(e) for e in exprs):
        return ds.narrow(lambda df: df.select(*exprs), "map", 1, pragma)
    fn = _one_function("map", exprs, len(ds.df.columns))
    out = types.as_schema(schema) if schema is not None else types.returned(fn, "map")
    if not out.fields:
        raise types.TypeCheckError("map", "a map must return at least one column")
    return ds.narrow(lambda df: df.mapInArrow(arrow.mapped(fn, out), out, profile=profile(pragma or ds.pragma, ds.spark)), "map", 1, pragma)


def filter(ds: Dataset, predicate, pragma: Pragma | None = None) -> Dataset:
    """Rows for which the predicate holds: a boolean Column, SQL text, or a Python function of all columns."""
    if _is_expr(predicate):
        condition = F.expr(predicate) if isinstance(predicate, str) else predicate
        if not isinstance(ds.df.select(condition).schema[0].dataType, T.BooleanType):
            raise types.TypeCheckError("filter", "the predicate is not boolean")
        return ds.narrow(lambda df: df.where(condition), "filter", pragma=pragma)
    fn = _one_function("filter", (predicate,), len(ds.df.columns))
    shape = ds.schema
    return ds.narrow(lambda df: df.mapInArrow(arrow.kept(fn), shape, profile=profile(pragma or ds.pragma, ds.spark)), "filter", pragma=pragma)


def flatmap(ds: Dataset, *exprs, schema=None, pragma: Pragma | None = None) -> Dataset:
    """Row to any number of rows.  ``exprs``: array Columns of equal length, one per output column (an error at run
    time if the lengths differ), or one Python function that returns such vectors."""
    if exprs and builtins.all(isinstance(e, Column) for e in exprs):
        shape = ds.df.select(*exprs).schema
        for f in shape.fields:
            if not isinstance(f.dataType, T.ArrayType):
                raise types.TypeCheckError("flatmap", f"column {f.name} is no vector")
        names = [f.name for f in shape.fields]

        def step(df):
            if len(exprs) == 1:
                return df.select(F.explode(exprs[0]).alias(names[0]))
            same = F.size(exprs[0])
            checked = [exprs[0], *(F.when(F.size(e) == same, e).otherwise(F.raise_error(F.lit("flatmap: vectors of unequal length"))) for e in exprs[1:])]
            packed = F.arrays_zip(*[e.alias(n) for e, n in zip(checked, names, strict=True)])
            return df.select(F.inline(packed)).toDF(*names)

        return ds.narrow(step, "flatmap", 1, pragma)
    fn = _one_function("flatmap", exprs, len(ds.df.columns))
    if schema is None:
        found = types.returned(fn, "flatmap")
        if not builtins.all(isinstance(f.dataType, T.ArrayType) for f in found.fields):
            raise types.TypeCheckError("flatmap", "the function must return vectors")
        out = types.named([f.dataType.elementType for f in found.fields])
    else:
        out = types.as_schema(schema)
    return ds.narrow(lambda df: df.mapInArrow(arrow.flattened(fn, out), out, profile=profile(pragma or ds.pragma, ds.spark)), "flatmap", 1, pragma)


def head(ds: Dataset, n: int) -> Dataset:
    """The first n rows of each shard; reading stops there."""
    if n <= 0:
        return ds.narrow(lambda df: df.limit(0), "head")
    shape = ds.schema

    def first(batches):
        left = n
        for batch in batches:
            yield batch.slice(0, left)
            left -= batch.num_rows
            if left <= 0:
                return

    return ds.by_shard().narrow(lambda df: df.mapInArrow(first, shape), "head")


def _one_function(operator: str, exprs: tuple, arity: int):
    if len(exprs) != 1:
        raise types.TypeCheckError(operator, "expected Columns, or one function")
    types.check_arity(exprs[0], arity, operator)
    return exprs[0]
