"""Schemas as values: checks made when a dataset is built, and list operations on columns."""

from __future__ import annotations

import inspect
import os
import typing
from collections.abc import Sequence

from pyspark.sql import types as T

_HERE = os.path.dirname(os.path.abspath(__file__))

#: Types that can be keys: hashable and ordered.
KEYABLE = (T.StringType, T.BinaryType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Types that a strict fold takes as its key.
FOLD_KEYS = (T.StringType, T.IntegerType, T.LongType)

_PYTHON = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), type(None): T.NullType()}


class TypeCheckError(TypeError):
    """A dataset was built from things that do not fit; names the caller's line."""

    def __init__(self, operator: str, message: str):
        self.operator = operator
        self.location = call_site()
        super().__init__(f"{self.location}: {operator}: {message}")


def call_site() -> str:
    """file:line of the nearest frame outside this package."""
    for frame in inspect.stack()[1:]:
        if not os.path.abspath(frame.filename).startswith(_HERE + os.sep):
            return f"{frame.filename}:{frame.lineno}"
    return "?:0"


def named(types: Sequence[T.DataType], prefix: str = "c") -> T.StructType:
    """Columns without names of their own: c0, c1, ..."""
    return T.StructType([T.StructField(f"{prefix}{i}", t) for i, t in enumerate(types)])


def spark_type(hint: typing.Any) -> T.DataType:
    """The column type of a Python annotation."""
    if isinstance(hint, T.DataType):
        return hint
    if hint in _PYTHON:
        return _PYTHON[hint]
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (list, Sequence):
        return T.ArrayType(spark_type(args[0]))
    if origin is dict:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if origin is typing.Union or type(hint).__name__ == "UnionType":
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return spark_type(rest[0])
    raise TypeError(f"no column type for {hint!r}")


def returned(fn: typing.Callable, operator: str, names: Sequence[str] | None = None) -> T.StructType:
    """Schema of what ``fn`` returns, from its annotation: one type, or tuple[...] for several columns."""
    try:
        hint = typing.get_type_hints(fn).get("return")
    except (TypeError, NameError):
        hint = None
    if hint is None:
        raise TypeCheckError(operator, "a Python function needs schema= or an annotated return type")
    hints = typing.get_args(hint) if typing.get_origin(hint) is tuple else (hint,)
    try:
        out = named([spark_type(h) for h in hints])
    except TypeError as e:
        raise TypeCheckError(operator, str(e)) from None
    if names:
        out = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, out.fields, strict=True)])
    return out


def as_schema(schema: str | T.StructType | T.DataType | Sequence) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    if isinstance(schema, str):
        found = T._parse_datatype_string(schema)
        return found if isinstance(found, T.StructType) else named([found])
    if isinstance(schema, T.DataType):
        return named([schema])
    return named([spark_type(s) for s in schema])


def check_arity(fn: typing.Callable, n: int, operator: str) -> None:
    """``fn`` must be callable with n positional arguments (variadic functions are)."""
    if not callable(fn):
        raise TypeCheckError(operator, f"expected a function, got {type(fn).__name__}")
    try:
        inspect.signature(fn).bind(*[None] * n)
    except TypeError:
        raise TypeCheckError(operator, f"function {getattr(fn, '__name__', fn)!r} cannot take {n} arguments") from None
    except ValueError:
        pass  # a builtin without a signature


def check_keys(schema: T.StructType, prefix: int, operator: str, allowed: tuple = KEYABLE) -> None:
    for f in schema.fields[:prefix]:
        if not isinstance(f.dataType, allowed):
            raise TypeCheckError(operator, f"column {f.name} of type {f.dataType.simpleString()} cannot be a key")


def assignable(source: T.StructType, target: T.StructType) -> bool:
    return [f.dataType for f in source.fields] == [f.dataType for f in target.fields]


def columns(schema: T.StructType) -> list[T.DataType]:
    return [f.dataType for f in schema.fields]


def concat(*schemas: T.StructType) -> T.StructType:
    return named([t for s in schemas for t in columns(s)])


def append(schema: T.StructType, *types: T.DataType) -> T.StructType:
    return named([*columns(schema), *types])


def cut(schema: T.StructType, start: int, stop: int) -> T.StructType:
    return T.StructType(schema.fields[start:stop])


def signature(arguments: T.StructType, results: T.StructType) -> str:
    show = lambda s: ", ".join(t.simpleString() for t in columns(s))
    return f"({show(arguments)}) -> ({show(results)})"


def describe(schema: T.StructType, prefix: int = 1) -> str:
    names = [t.simpleString() for t in columns(schema)]
    return f"dataset<{', '.join(names[:prefix])}{'; ' if len(names) > prefix else ''}{', '.join(names[prefix:])}>"
