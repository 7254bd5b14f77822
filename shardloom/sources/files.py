"""Tables, lines, tab-separated files and tar archives."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..types import as_schema
from .generated import reader_func

#: Archives from this size on are streamed from their file system instead of being one value of a row.
WHOLE_BYTES = 512 << 20
ENTRY = "header struct<name:string,size:bigint,mode:bigint,mtime:bigint,uid:bigint,gid:bigint,type:string,linkname:string>, body binary"


def _in_splits(df: DataFrame, prefix: int, num_shards: int | None, name: str) -> Dataset:
    """A file source: its shards are the splits that Spark reads, so head, scan, writer and caches need no shuffle.  Where
    a number of shards is asked for, rows are placed by key instead, where shards are observed."""

    def splits(shards: Iterable[int] | None) -> DataFrame:
        return df if shards is None else df.where(F.spark_partition_id().isin(list(shards)))

    return Dataset(df, prefix, num_shards, None, name, None if num_shards else splits)


def read_table(spark: SparkSession, path: str, prefix: int = 1, num_shards: int | None = None) -> Dataset:
    """A Parquet table; filters and columns are pushed into the scan."""
    return _in_splits(spark.read.parquet(path), prefix, num_shards, "read_table")


def scan_lines(spark: SparkSession, path: str) -> Dataset:
    """Lines of text files, read in splits."""
    return _in_splits(spark.read.text(path).toDF("c0"), 1, None, "scan_lines")


def scan_reader(spark: SparkSession, num_shards: int, opened: Callable[[], io.IOBase]) -> Dataset:
    """Lines of whatever ``opened()`` opens (bytes or text), dealt out in turn: line i to shard i mod num_shards.

    Every shard reads the whole input, so this is for inputs that cannot be read in splits."""

    def lines(shard: int) -> Iterator[str]:
        with opened() as source:
            for i, line in enumerate(source):
                if i % num_shards == shard:
                    text = line.decode() if isinstance(line, bytes) else line
                    yield text.removesuffix("\n").removesuffix("\r")

    return reader_func(spark, num_shards, lines, "c0 string")


def read_tsv(spark: SparkSession, path: str, schema: str, prefix: int = 1) -> Dataset:
    return _in_splits(spark.read.schema(schema).csv(path, sep="\t"), prefix, None, "read_tsv")


def _entry(member: tarfile.TarInfo, archive: tarfile.TarFile) -> tuple:
    body = archive.extractfile(member) if member.isfile() else None
    header = {"name": member.name, "size": member.size, "mode": member.mode, "mtime": int(member.mtime), "uid": member.uid, "gid": member.gid, "type": member.type.decode(), "linkname": member.linkname}
    return header, body.read() if body else b""


def tar_reader(spark: SparkSession, source: str | Callable[[], io.IOBase], num_shards: int | None = None) -> Dataset:
    """Entries of tar archives (plain or compressed): header, body.

    ``source`` is a path or pattern of archives, each read by one task (large ones as a stream, by Arrow's file systems); or an opener, whose archive every shard streams
    through while keeping its own entries (entry i is of shard i mod num_shards)."""
    if callable(source):
        n = num_shards or 1

        def mine(shard: int) -> Iterator[tuple]:
            with opened(source) as archive:
                for i, member in enumerate(archive):
                    if i % n == shard:
                        yield _entry(member, archive)

        return reader_func(spark, n, mine, ENTRY)
    files = spark.read.format("binaryFile").load(source)
    shape = as_schema(ENTRY)

    def entries(opened_one, mode):
        def run(batches):
            from ..operators.arrow import batches_of

            def rows():
                for batch in batches:
                    for value in batch.column(0):
                        with opened_one(value) as stream, tarfile.open(fileobj=stream, mode=mode) as archive:
                            for member in archive:
                                yield _entry(member, archive)

            return batches_of(rows(), shape)

        return run

    def streamed(path):
        system, name = pafs.FileSystem.from_uri(path.as_py().replace("file:/", "file:///", 1) if not path.as_py().startswith("file://") else path.as_py())
        return system.open_input_stream(name)

    small = files.where(F.col("length") < WHOLE_BYTES).select("content")
    large = files.where(F.col("length") >= WHOLE_BYTES).select("path")
    if num_shards:
        small, large = small.repartition(num_shards), large.repartition(num_shards)
    whole = small.mapInArrow(entries(lambda content: pa.BufferReader(content.as_buffer()), "r:*"), ENTRY)
    return Dataset(whole.union(large.mapInArrow(entries(streamed, "r|*"), ENTRY)), 1, None, None, "tar_reader")


def opened(source: Callable[[], io.IOBase]) -> tarfile.TarFile:
    return tarfile.open(fileobj=source(), mode="r|*")


def with_key(ds: Dataset, name: str, key) -> Dataset:
    """Put a derived key before the columns: for key types that are neither hashed nor ordered as they are."""
    return ds.narrow(lambda df: df.select(key.alias(name), *[F.col(c) for c in df.columns]), "with_key", 1)
