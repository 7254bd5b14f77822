"""Shared plumbing of the training-data operators.

* written tables in the shared checkpoint folder (lineage cuts that survive lost executors), deleted when read for the last time,
* Arrow text columns as flat byte arrays, cut into pieces of bounded size,
* vectorised word splitting and 64-bit word hashing on those bytes.

Texts never become Python strings here unless an operator needs them to: a piece
is one ``uint8`` array plus row offsets, and every step is a numpy expression.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; one longer text makes a piece of its own.
PIECE_BYTES = 512 << 10
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only where that is unset, one beside the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


#: With this setting a query's shuffle files are deleted when the query ends, not when the driver's collector finds its plan.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Queries inside leave no shuffle files behind; each ends in a written table or an aggregate, so none is read again."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write to ``path`` and read back: cuts lineage, survives executor loss, keeps column pruning."""
    spark, schema = df.sparkSession, df.schema
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``stored`` in the shared folder, for results that outlive their operator."""
    return stored(df, new_path(df.sparkSession, name))


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Written tables of one run of an operator.  Each is deleted by ``drop``, after its last reader was written, or at the end."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.tables = spark, new_path(spark, name), []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.tables):04d}-{name}"
        out = stored(df, path)
        self.tables.append((out, path))
        return out

    def drop(self, *frames: DataFrame) -> None:
        for table, path in self.tables:
            if any(table is f for f in frames):
                delete(self.spark, path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        delete(self.spark, self.root)


def _trimmer():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library
        return None


def giving_back(run: Callable, *caches) -> Callable:
    """``run`` (a function of batches) so that its worker gives memory back to the system when a task ends, however it
    ends: workers live on for other tasks, and what their allocators keep adds up over the steps of a long job.
    ``caches`` are cleared first."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in (*caches, _powers):
                cache.cache_clear()
            pa.default_memory_pool().release_unused()
            trim = _trimmer()
            if trim is not None:
                trim(0)

    return wrapped


def in_training(id_col: str = "doc_id"):
    """False for the held-out quarter: crc32(id as text) mod 4 = 2.  A null id is in training."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def carried(df: DataFrame, carry: tuple[str, ...]) -> list:
    """The ``carry`` columns as one struct column ``carried`` (in a list, empty if there are none): no name can clash."""
    return [F.struct(*[df[c] for c in carry]).alias("carried")] if carry else []


def texts(df: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, int | tuple[int, str]]:
    """Rows (doc_id, text, carried) and where ``pieces`` finds the text: a text that is carried along is not sent twice,
    the rows are then (doc_id, carried)."""
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    if text_col in carry and dict(df.dtypes)[text_col] == "string":
        return df.select(doc_id, *carried(df, carry)), (1, text_col)
    return df.select(doc_id, F.col(text_col).cast("string").alias("text"), *carried(df, carry)), 1


#: Bytes of the Arrow batches that travel to Python workers: what bounds the buffers on both sides, whatever the texts' lengths.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_arrow(df: DataFrame, run: Callable, schema, *caches) -> DataFrame:
    """``df.mapInArrow`` with ``giving_back`` and batches of BATCH_BYTES.

    A plan reads that bound when it runs, so it is a setting of the session; one that differs from Spark's own (64 MB) is kept."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "64MB").lower() in ("64mb", "64m", "67108864b", "67108864"):
        conf.set(_BATCH, str(BATCH_BYTES))
    return df.mapInArrow(giving_back(run, *caches), schema)


def with_carried(ddl: str, rows: DataFrame):
    """``ddl`` as a schema, with the struct ``carried`` of ``rows`` last if it has one."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = _parse_datatype_string(ddl)
    assert isinstance(schema, StructType)
    return StructType([*schema.fields, *(f for f in rows.schema.fields if f.name == "carried")])


# ------------------------------------------------------------------ text as bytes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and row offsets (from 0); a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
            column = column.cast(pa.string())
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text_col: int | tuple[int, str] = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, their bytes, their offsets), each of about PIECE_BYTES of text and whole rows.  ``text_col``: a column, or a struct column and its field."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(text_col) if isinstance(text_col, int) else batch.column(text_col[0]).field(text_col[1]))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1
            to = min(n, max(at + 1, to))
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


# ------------------------------------------------------------------ words and hashes

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes of the two patterns used here.  Non-ASCII characters are word characters in both, so bytes do.
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = _ALNUM[128:] = True  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
_NONSPACE = np.ones(256, bool)
_NONSPACE[[32, 9, 10, 11, 12, 13]] = False  # [^\x20\x09-\x0D]
WORD_BYTES = {"alnum": _ALNUM, "nonspace": _NONSPACE}

_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * _BASE)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, U64), np.full(n + 1, _BASE_INVERSE, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, (n + 1).bit_length()))


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the words of lower-cased ``data``, and per row the index of its first word (+ total)."""
    inside = WORD_BYTES[kind][data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = False
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = np.unique(cut[inside[cut] & inside[cut - 1]])  # a word ends and one starts where two rows meet
    else:
        cut = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[0::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE_VALUE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def hash_word(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word shingles row by row, and per row the index of its first one (+ total).

    A row of fewer words, but not none, has its whole sequence as its one shingle."""
    counts = np.diff(first)
    n_out = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_first = np.concatenate([[0], np.cumsum(n_out)])
    if not len(words):
        return np.zeros(0, U64), out_first
    full = np.zeros(0, U64)
    if len(words) >= width:
        full = words[: len(words) - width + 1]
        for k in range(1, width):
            full = mix(full * _BASE + words[k : len(words) - width + 1 + k])
    row = np.repeat(np.arange(len(counts)), n_out)
    at = first[:-1][row] + np.arange(out_first[-1]) - out_first[:-1][row]
    long_row = counts[row] >= width
    out = np.empty(out_first[-1], U64)
    out[long_row] = full[at[long_row]]
    for n in range(1, width):  # the short rows, by their number of words
        rows = np.flatnonzero(counts == n)
        h = words[first[rows]] ^ U64(n)
        for k in range(1, n):
            h = mix(h * _BASE + words[first[rows] + k])
        out[out_first[rows]] = h
    return out, out_first
