"""N-way cogroup, and the joins that follow from it."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import functions as F

from .. import types
from ..dataset import Dataset

HOW = ("inner", "left", "right", "full", "left_semi", "left_anti")


def _field(groups: str, name: str):
    return F.transform(groups, lambda s: s[name])


def cogroup(*inputs: Dataset) -> Dataset:
    """Full outer grouping by key: each key of any input once, then each value column as an array, empty where its
    input lacks the key.  One shuffle for any number of inputs: rows are tagged, united and grouped once.  A null key
    is a key like others; null values are kept."""
    if not inputs:
        raise types.TypeCheckError("cogroup", "no dataset")
    prefix = inputs[0].prefix
    keys = inputs[0].keys
    for ds in inputs:
        types.check_keys(ds.schema, ds.prefix, "cogroup")
        if ds.prefix != prefix or [f.dataType for f in ds.schema.fields[:prefix]] != [f.dataType for f in inputs[0].schema.fields[:prefix]]:
            raise types.TypeCheckError("cogroup", f"keys differ: {inputs[0]!r} and {ds!r}")
    tagged = None
    columns: list[tuple[str, str]] = []
    taken = {*keys}
    for i, ds in enumerate(inputs):
        part = ds.df.select(*[F.col(a).alias(b) for a, b in zip(ds.keys, keys, strict=True)], F.struct(*ds.values).alias(f"_in{i}") if ds.values else F.struct(F.lit(0)).alias(f"_in{i}"))
        tagged = part if tagged is None else tagged.unionByName(part, allowMissingColumns=True)
        for v in ds.values:
            name = v if v not in taken else f"{v}_{i}"
            while name in taken:
                name += "_"
            taken.add(name)
            columns.append((f"_in{i}", name, v))
    grouped = tagged.groupBy(*keys).agg(*[F.collect_list(f"_in{i}").alias(f"_in{i}") for i in range(len(inputs))])
    out = grouped.select(*keys, *[_field(c, v).alias(name) for c, name, v in columns])
    shards = [ds.num_shards for ds in inputs if ds.num_shards]
    return Dataset(out, prefix, max(shards) if shards else None, functools.reduce(operator.or_, (ds.pragma for ds in inputs)), "cogroup")


def join(left: Dataset, right: Dataset, how: str = "inner") -> Dataset:
    """Equi-join on the key.  Spark chooses the strategy by the sides' sizes and splits skewed partitions; null keys never match."""
    if how not in HOW:
        raise types.TypeCheckError("join", f"how must be one of {', '.join(HOW)}")
    types.check_keys(left.schema, left.prefix, "join")
    if [f.dataType for f in left.schema.fields[: left.prefix]] != [f.dataType for f in right.schema.fields[: right.prefix]]:
        raise types.TypeCheckError("join", f"keys differ: {left!r} and {right!r}")
    names, taken = [], {*left.df.columns}
    for v in right.values:
        while v in taken:
            v += "_right"
        names.append(v)
        taken.add(v)
    other = right.df.toDF(*left.keys, *names)
    return Dataset(left.df.join(other, left.keys, how), left.prefix, left.num_shards, left.pragma | right.pragma, f"join_{how}")


def union(*inputs: Dataset) -> Dataset:
    """All rows of datasets of one shape."""
    out = inputs[0].df
    for ds in inputs[1:]:
        if not types.assignable(ds.schema, inputs[0].schema):
            raise types.TypeCheckError("union", f"columns differ: {inputs[0]!r} and {ds!r}")
        out = out.union(ds.df)
    return inputs[0].with_df(out, name="union")
