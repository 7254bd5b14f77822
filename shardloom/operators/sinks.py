"""Side effects and stored results: writer_func, scan, cache, cache_partial, text output.

A Python function may run more than once for a shard (retries, speculation, recomputed lineage): what it does to the
outside must be idempotent, for example by writing under an attempt name and renaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .. import types
from ..dataset import Dataset
from . import arrow

#: What a writer gets instead of None in its last call.
EOF = EOFError("end of shard")


def writer_func(ds: Dataset, fn: Callable) -> Dataset:
    """Pass rows through and show every batch to fn(shard, state, err, *columns): columns are lists, ``state`` is a dict
    of the shard's own, and the last call has empty columns and err = EOF.  An error raised by fn fails the task."""
    types.check_arity(fn, 3 + len(ds.df.columns), "writer_func")
    shape, width = ds.schema, len(ds.df.columns)

    def tee(batches):
        shard, state = arrow.shard_id(), {}
        for batch in batches:
            fn(shard, state, None, *arrow.columns_of(batch))
            yield batch
        fn(shard, state, EOF, *[[] for _ in range(width)])

    return ds.by_shard().narrow(lambda df: df.mapInArrow(tee, shape), "writer_func")


def scan(ds: Dataset, fn: Callable) -> Dataset:
    """fn(shard, rows) for every shard, rows being an iterator; the result has no rows and no columns.  Lazy: it runs
    when the result does (``Session.run``, or ``drain``)."""
    types.check_arity(fn, 2, "scan")
    none = StructType([StructField("_none", IntegerType())])

    def visit(batches):
        fn(arrow.shard_id(), arrow.rows_of(batches))
        for _ in batches:  # what fn left unread
            pass
        return iter(())

    by_shard = ds.by_shard()
    return Dataset(by_shard.df.mapInArrow(visit, none).select(), 0, by_shard.num_shards, ds.pragma, "scan")


def drain(ds: Dataset) -> None:
    """Run a dataset for its side effects."""
    ds.df.write.format("noop").mode("overwrite").save()


def write_tsv(ds: Dataset, path: str) -> None:
    ds.df.write.csv(path, sep="\t")


# ------------------------------------------------------------------ cache

_SHARD_DIR = "shard={:04d}-of-{:04d}"


class Store:
    """A cache folder: one Parquet folder per shard, with a mark once it is whole."""

    def __init__(self, spark, prefix: str, n: int, operator: str):
        if not prefix:
            raise types.TypeCheckError(operator, "an empty prefix")
        self.spark, self.prefix, self.n = spark, prefix.rstrip("/"), n
        self.hadoop = spark._jvm.org.apache.hadoop.fs

    def path(self, k: int) -> str:
        return f"{self.prefix}/{_SHARD_DIR.format(k, self.n)}"

    def _file(self, name: str):
        path = self.hadoop.Path(name)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def present(self) -> list[int]:
        system, root = self._file(self.prefix)
        if not system.exists(root):
            return []
        return [k for k in range(self.n) if (lambda f: f[0].exists(f[1]))(self._file(f"{self.path(k)}/_whole"))]

    def missing(self) -> list[int]:
        have = set(self.present())
        return [k for k in range(self.n) if k not in have]

    def write(self, ds: Dataset, shards: list[int] | None) -> None:
        """Store the given shards (all: None).  One job writes every shard's folder under a temporary name; each is then
        moved to its place and marked, so a broken run leaves only whole shards."""
        import uuid

        wanted = list(range(self.n)) if shards is None else shards
        temporary = f"{self.prefix}/_attempt-{uuid.uuid4().hex}"
        ds.shards_of(shards).withColumn("_shard", F.spark_partition_id()).write.partitionBy("_shard").parquet(temporary)
        for k in wanted:
            system, target = self._file(self.path(k))
            system.delete(target, True)
            source = self.hadoop.Path(f"{temporary}/_shard={k}")
            if system.exists(source):
                system.rename(source, target)
            else:  # a shard without rows
                system.mkdirs(target)
            system.create(self.hadoop.Path(target, "_whole"), True).close()
        self._file(temporary)[0].delete(self.hadoop.Path(temporary), True)

    def filled(self, shards: list[int] | None = None) -> list[str]:
        """Folders of the shards that have rows."""
        wanted = [self.path(k) for k in (range(self.n) if shards is None else shards)]
        system = self._file(self.prefix)[0]
        return [p for p in wanted if len(system.listStatus(self.hadoop.Path(p)) or ()) > 1]

    def read(self, like: Dataset | StructType, shards: list[int] | None = None):
        schema = like if isinstance(like, StructType) else like.schema
        filled = self.filled(shards)
        if not filled:
            return self.spark.createDataFrame([], schema)
        # shard numbers come from the folder names
        return self.spark.read.schema(schema).parquet(*filled)


def _stored(ds: Dataset, store: Store, name: str) -> Dataset:
    def shards_of(shards):
        wanted = None if shards is None else list(shards)
        rows = store.read(ds, wanted)
        if not store.filled(wanted):  # no files, so nothing to place
            return rows
        number = F.regexp_extract(rows.metadataColumn("_metadata")["file_path"], r"shard=(\d+)-of-", 1).cast("int")
        return rows.withColumn("_shard_of_row", number).repartitionById(store.n, F.col("_shard_of_row")).drop("_shard_of_row")

    return Dataset(store.read(ds), ds.prefix, store.n, ds.pragma, name, shards_of)


def cache(ds: Dataset, prefix: str) -> Dataset:
    """The stored result if every shard of it is there, else compute and store all.  The caller vouches that the files
    belong to this dataset."""
    by_shard = ds.by_shard()
    store = Store(ds.spark, prefix, by_shard.num_shards, "cache")
    if store.missing():
        store.write(by_shard, None)
    return _stored(ds, store, "cache")


def cache_partial(ds: Dataset, prefix: str) -> Dataset:
    """As cache, but only the missing shards are computed, from their sources up (the dataset must be deterministic)."""
    by_shard = ds.by_shard()
    store = Store(ds.spark, prefix, by_shard.num_shards, "cache_partial")
    missing = store.missing()
    if missing:
        store.write(by_shard, missing)
    return _stored(ds, store, "cache_partial")


def read_cache(spark, schema, num_shards: int, prefix: str) -> Dataset:
    """A stored result on its own; an error if a shard is missing."""
    store = Store(spark, prefix, num_shards, "read_cache")
    missing = store.missing()
    if missing:
        raise FileNotFoundError(f"{prefix}: shards {missing} of {num_shards} are missing")
    shape = types.as_schema(schema)
    return _stored(Dataset(store.read(shape), 1, num_shards), store, "read_cache")
