"""Literals, generator functions, random keys."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .. import types
from ..dataset import Dataset
from ..pragma import Pragma

_SHARD = "_shard_of_row"
#: Calls of a generator in a row that may give nothing before a warning.
EMPTY_CALLS = 7


def split_evenly(n: int, shards: int) -> list[range]:
    """n rows as ``shards`` contiguous ranges; what is left over goes to the first ones."""
    size, left = divmod(n, shards)
    starts = [k * size + min(k, left) for k in range(shards + 1)]
    return [range(a, b) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def const(spark: SparkSession, num_shards: int, *columns: Sequence, schema=None) -> Dataset:
    """A literal: columns of equal length, cut evenly into shards in their order."""
    if num_shards < 1 or not columns:
        raise types.TypeCheckError("const", "at least one shard and one column are needed")
    if len({len(c) for c in columns}) > 1:
        raise types.TypeCheckError("const", f"columns of unequal length: {[len(c) for c in columns]}")
    if schema is not None:
        shape = types.as_schema(schema)
    else:
        try:
            shape = types.named([types.spark_type(type(c[0])) for c in columns])
        except (IndexError, TypeError):
            raise types.TypeCheckError("const", "the column types cannot be told from the values; pass schema=") from None
    shard = [k for k, r in enumerate(split_evenly(len(columns[0]), num_shards)) for _ in r]
    arrow = to_arrow_schema(shape)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)]
    local = spark.createDataFrame(pa.table([*arrays, pa.array(shard, pa.int32())], names=[*shape.names, _SHARD]))
    local = local.select(*[F.col(f.name).cast(f.dataType) for f in shape.fields], _SHARD)

    def shards_of(shards: Iterable[int] | None):
        rows = local if shards is None else local.where(F.col(_SHARD).isin(list(shards)))
        return rows.repartitionById(num_shards, F.col(_SHARD)).drop(_SHARD)

    rows = local.drop(_SHARD)
    if num_shards == 1:  # in one partition
        values = [tuple(r.values()) for r in pa.table(arrays, names=shape.names).to_pylist()]
        rows = spark.createDataFrame(spark.sparkContext.parallelize(values, 1), shape)
    return Dataset(rows, 1, num_shards, None, "const", shards_of)


class _Shard(InputPartition):
    def __init__(self, shard: int, wanted: bool):
        self.shard, self.wanted = shard, wanted


def reader_func(spark: SparkSession, num_shards: int, fn: Callable[[int, dict], Iterable], schema, pragma: Pragma | None = None) -> Dataset:
    """A generated source: fn(shard, state) is called again and again for its next rows until it returns None.

    It returns an iterable of rows (tuples, or single values for one column); ``state`` is a dict of the shard's own.  A
    run of empty results is reported once it is longer than EMPTY_CALLS, then at powers of two.  fn may instead be a
    generator function of (shard,), whose items are the rows.  Shards are input partitions of a Python data source, so
    only the wanted ones are generated."""
    import inspect

    shape = types.as_schema(schema)
    if num_shards < 1:
        raise types.TypeCheckError("reader_func", f"{num_shards} shards")
    generator = inspect.isgeneratorfunction(fn)
    types.check_arity(fn, 1 if generator else 2, "reader_func")
    width, arrow = len(shape.fields), to_arrow_schema(shape)

    def rows(shard: int) -> Iterator[tuple]:
        from ..operators.arrow import as_row

        if generator:
            yield from (as_row(r, width) for r in fn(shard))
            return
        state: dict = {}
        empty = 0
        while (got := fn(shard, state)) is not None:
            n = 0
            for r in got:
                n += 1
                yield as_row(r, width)
            empty = 0 if n else empty + 1
            if empty > EMPTY_CALLS and empty & (empty - 1) == 0:
                import warnings

                warnings.warn(f"reader_func: shard {shard} gave no rows in {empty} calls", stacklevel=1)

    class Reader(DataSourceReader):
        def __init__(self, wanted):
            self.wanted = wanted

        def partitions(self):
            return [_Shard(k, self.wanted is None or k in self.wanted) for k in range(num_shards)]

        def read(self, partition):
            from ..operators.arrow import batches_of

            if partition.wanted:
                yield from batches_of(rows(partition.shard), shape)

    name = f"generated_{abs(hash((id(fn), num_shards))):x}"

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return shape

        def reader(self, schema):
            listed = self.options.get("shards")
            return Reader(None if listed is None else {int(k) for k in listed.split(",") if k})

    del arrow
    spark.dataSource.register(Source)

    def shards_of(shards: Iterable[int] | None):
        reader = spark.read.format(name)
        return (reader if shards is None else reader.option("shards", ",".join(map(str, shards)))).load()

    return Dataset(shards_of(None), 1, num_shards, pragma, "reader_func", shards_of)


def keyed_generator(spark: SparkSession, num_shards: int, keys_per_shard: int, seed: int = 0) -> Dataset:
    """Every key 0..keys_per_shard-1 once per shard, in an order of the shard's own: (key, value)."""
    rows = spark.range(0, num_shards * keys_per_shard, 1, num_shards)
    shard = (F.col("id") / keys_per_shard).cast("long")
    place = F.pmod(F.col("id"), F.lit(keys_per_shard))
    if keys_per_shard < 1 << 31:  # a prime multiplier permutes the places; products stay below 2^62
        place = place * (2654435761 % keys_per_shard or 1)
    key = F.pmod(place + F.xxhash64(shard, F.lit(seed)) % 1_000_003, F.lit(keys_per_shard))
    return Dataset(rows.select(key.alias("key"), F.xxhash64("id", F.lit(seed)).alias("value")), 1, num_shards, None, "keyed_generator")
