"""Where rows go: reshuffle, reshard, repartition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import types
from ..dataset import Dataset
from . import arrow

_SHARD = "_shard_of_row"


def placed(ds: Dataset, shard: Column, n: int, name: str) -> Dataset:
    """Rows in n shards by an integer Column; a number outside 0..n-1 is an error."""
    source = ds.df.withColumn(_SHARD, shard.cast("int"))
    return from_shard_column(source, n, ds, name)


def from_shard_column(source: DataFrame, n: int, like: Dataset, name: str) -> Dataset:
    checked = F.when(F.col(_SHARD).between(0, n - 1), F.col(_SHARD)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: shard out of 0..{n - 1}: "), F.coalesce(F.col(_SHARD).cast("string"), F.lit("null")))).cast("int"))

    def shards_of(shards):
        rows = source if shards is None else source.where(F.col(_SHARD).isin(list(shards)))
        return rows.repartitionById(n, checked).drop(_SHARD)

    return Dataset(shards_of(None), like.prefix, n, like.pragma, name, shards_of)


def reshuffle(ds: Dataset) -> Dataset:
    """Rows of one key in one shard; the number of shards stays."""
    types.check_keys(ds.schema, ds.prefix, "reshuffle")
    return placed(ds, ds.shard_expr(), ds.shards, "reshuffle")


def reshard(ds: Dataset, n: int) -> Dataset:
    """As reshuffle, into n shards; the dataset itself if it has n already."""
    if ds.num_shards == n:
        return ds
    if n < 1:
        raise types.TypeCheckError("reshard", f"{n} shards")
    types.check_keys(ds.schema, ds.prefix, "reshard")
    return placed(ds, F.pmod(F.hash(*[ds.df[k] for k in ds.keys]), F.lit(n)), n, "reshard")


def repartition(ds: Dataset, fn) -> Dataset:
    """Rows where ``fn`` puts them: an integer Column (shard number), or a Python function (number of shards, *columns)."""
    n = ds.shards
    if isinstance(fn, Column):
        kind = ds.df.select(fn).schema[0].dataType.simpleString()
        if kind not in ("tinyint", "smallint", "int", "bigint"):
            raise types.TypeCheckError("repartition", f"a shard number must be an integer, not {kind}")
        return placed(ds, fn, n, "repartition")
    types.check_arity(fn, len(ds.df.columns) + 1, "repartition")
    if n == 1:  # the function is not asked
        return placed(ds, F.lit(0), 1, "repartition")
    import pyarrow as pa

    shape = types.T.StructType([*ds.schema.fields, types.T.StructField(_SHARD, types.T.IntegerType())])

    def number(batches):
        for batch in batches:
            ids = [fn(n, *row) for row in zip(*arrow.columns_of(batch), strict=True)]
            yield pa.record_batch([*batch.columns, pa.array(ids, pa.int32())], names=[*batch.schema.names, _SHARD])

    return from_shard_column(ds.df.mapInArrow(number, shape), n, ds, "repartition")


def sort(ds: Dataset, *order) -> Dataset:
    """All rows in order (by the key unless told otherwise): a range shuffle, sorts that spill, skewed ranges cut by a sample."""
    return ds.with_df(ds.df.orderBy(*(order or ds.keys)), name="sort", num_shards=None)


def top(ds: Dataset, n: int, *order) -> Dataset:
    """The first n rows in order: every task keeps its own n, so no sort of everything."""
    return ds.with_df(ds.df.orderBy(*(order or ds.keys)).limit(n), name="top", num_shards=None)
