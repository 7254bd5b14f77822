"""Token-ID output as sorted-string-table shards.

``write_shards`` range-partitions documents by identifier, encodes each whole text and
writes one table file per partition; ``read_shards`` reads every file back block by block;
``Shard`` answers single look-ups (Bloom filter, then binary search over the sparse
block index, then one block read).

File layout (little-endian)::

    block*            entries: varint shared, varint unshared, varint value bytes, key suffix, value
                      then crc32 of the (zstd-compressed) block, 4 bytes
    index             per block: key length u16, first key, offset u64, bytes u32, rows u32, tokens u64
    bloom             bit array; k probes by double hashing
    footer (80 bytes) index offset/bytes, bloom offset/bytes/k, blocks, rows, tokens, magic

A key is the identifier as 8 big-endian bytes with the sign bit flipped, so byte order is
numeric order; a null identifier is the empty key and sorts first.  A value is one width byte
(2 or 4) and the ids in that width.

Defined results: a null or empty text gives just the end id; repeated identifiers are kept, ordered by a
hash of their text (so that the rows of one identifier can lie in several shards); an empty table gives no shard and
no rows; other columns are ignored.
Files are written under an attempt name and renamed, so a retried task replaces its own file.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"SLSST001"
FOOTER = struct.Struct("<QQQQQQQQQ8s")  # index at/bytes, bloom at/bytes/k, blocks, rows, tokens, format, magic
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY, BLOOM_PROBES = 10, 7
#: Bytes of the table (as stored) aimed at in one shard; a smaller table is cut into as many shards as there are task
#: slots, but into none of less than LEAST_SHARD.
SHARD_BYTES, LEAST_SHARD = 256 << 20, 2 << 20
#: Distinct pieces that a worker remembers in a task (some 40 bytes each), and of those the ones kept apart as new.
MOST_PIECES, MOST_NEW = 1_500_000, 60_000
#: Manifest rows whose starts are summed together.
BAND = 1000

MANIFEST = "shard long, path string, n_docs long, n_tokens long, bytes long"
ROWS = "doc_id long, shard long, at long, n_tokens long, ids_crc32 long"


# ------------------------------------------------------------------ encoding


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_CHECK_BASE = np.uint64(0xD1B54A32D192ED03)
_CHECK_INVERSE = np.uint64(pow(0xD1B54A32D192ED03, -1, 1 << 64))


def _like_space(data: np.ndarray) -> np.ndarray:
    """Bytes of white space, and of characters that may be white space outside ASCII (some are only near it in the code)."""
    space = _SPACE[data]
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    lead = lead[lead + 1 < len(data)]
    if len(lead):
        a, b = data[lead], data[lead + 1]
        two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        three = lead[((a == 0xE1) & (b == 0x9A)) | ((a == 0xE2) & ((b == 0x80) | (b == 0x81))) | ((a == 0xE3) & (b == 0x80))]
        for at in (two, two + 1, three, three + 1, three + 2):
            space[at[at < len(data)]] = True
    return space


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the texts can be cut without a token lying across.

    The byte-level splitter opens a token at every space, and makes one of every line feed, that stands alone between
    characters that are not white space; and a comma or full stop between a letter or digit and white space is a token."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    space = _like_space(data)
    before, after = np.ones(n, bool), np.ones(n, bool)  # the neighbours are white space, or there is none
    before[1:], after[:-1] = space[:-1], space[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge] = True
    after[edge - 1] = True
    cut = ((data == 32) | (data == 10)) & ~before & ~after
    stop = np.flatnonzero(_STOP[data] & after)
    stop = stop[stop > 0]
    stop = stop[_ALNUM[data[stop - 1]] & ~before[stop]]
    cut[stop] = True
    cut[0] = True
    cut[edge] = True
    return np.flatnonzero(cut)


def can_cut(vocabulary: str) -> bool:
    """Whether ``piece_starts`` suits a vocabulary file: nothing rewrites the text, byte-level splitting by its regex with
    no space put before, BPE of whole pieces, and no added token that takes white space along or lies across a cut."""
    with open(vocabulary, encoding="utf-8") as f:
        made = json.load(f)
    split, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
    plain = made.get("normalizer") is None and made.get("truncation") is None and made.get("padding") is None
    plain &= split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    plain &= model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    for token in made.get("added_tokens") or ():
        text = np.frombuffer(token["content"].encode(), np.uint8)
        around = np.concatenate([[120], text, [120]]).astype(np.uint8)
        plain &= not any(token.get(k) for k in ("lstrip", "rstrip", "single_word")) and len(piece_starts(around, np.array([0, len(around)]))) == 1
        # white space and stops at its ends could be cut off by what stands beside it
        plain &= len(text) > 0 and not _like_space(text)[[0, -1]].any() and not _STOP[text[[0, -1]]].any()
    return bool(plain)


class Pieces:
    """Pieces by hash: a second hash that is compared, and where their ids lie.  Sorted arrays; new ones are merged in by and by."""

    def __init__(self):
        self.main = self.new = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))

    def __len__(self) -> int:
        return len(self.main[0]) + len(self.new[0])

    @staticmethod
    def _merged(one: tuple, two: tuple) -> tuple:
        at = np.searchsorted(one[0], two[0])
        return tuple(np.insert(a, at, b) for a, b in zip(one, two, strict=True))

    def add(self, *columns: np.ndarray) -> None:
        self.new = self._merged(self.new, columns)
        if len(self.new[0]) > MOST_NEW:
            self.main, self.new = self._merged(self.main, self.new), tuple(c[:0] for c in self.new)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Known or not, second hash, start and length of each."""
        known = np.zeros(len(hashes), bool)
        out = [np.zeros(len(hashes), c.dtype) for c in self.main[1:]]
        for part in (self.main, self.new):
            if len(part[0]):
                at = np.minimum(np.searchsorted(part[0], hashes), len(part[0]) - 1)
                here = part[0][at] == hashes
                known |= here
                for column, values in zip(out, part[1:], strict=True):
                    column[here] = values[at[here]]
        return known, *out


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library, which encodes each distinct piece once.

    Texts are cut where no token can lie across (``piece_starts``); a piece is known by a 64-bit hash and a second
    one that is compared, and texts in which two pieces share the first are encoded whole.  Known pieces are
    forgotten all at once when they are more than MOST_PIECES.  Where the vocabulary's rules do not suit the cuts
    (``can_cut``), every text is encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = can_cut(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.forget()

    def forget(self) -> None:
        self.pieces, self.tokens, self.used = Pieces(), np.zeros(1 << 16, self.kind), 0

    def _hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = common.span_hashes(data, starts, ends)
        up, down = _check_powers(1 << max(12, (len(data) + 1).bit_length()))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        return first, (sums[ends] - sums[starts]) * down[starts]

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int32, len(got))
        total = int(lengths.sum())
        while self.used + total > len(self.tokens):
            self.tokens = np.concatenate([self.tokens, np.zeros_like(self.tokens)])
        self.tokens[self.used : self.used + total] = np.fromiter(chain.from_iterable(got), self.kind, total)
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.pieces.add(hashes, checks, starts, lengths)

    def _whole(self, data: np.ndarray, offsets: np.ndarray, end: bytes) -> list[bytes]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        return [np.array(e.ids, self.kind).tobytes() + end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def bytes_of(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> list[bytes]:
        """Per text its ids as packed integers of ``width`` bytes, the end id last."""
        end = np.array([end_id], self.kind).tobytes()
        if not self.cuts:
            return self._whole(data, offsets, end)
        if len(self.pieces) > MOST_PIECES:
            self.forget()
        starts = piece_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes, checks = self._hashes(data, starts, ends)
        distinct, where, of = np.unique(hashes, return_index=True, return_inverse=True)
        known, check, _, _ = self.pieces.find(distinct)
        if (checks[where][of] != checks).any() or (check[known] != checks[where[known]]).any():
            return self._whole(data, offsets, end)
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            self._learn(distinct[new], checks[where[new]], [raw[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        _, _, start, length = self.pieces.find(distinct)
        lengths = length[of]
        out = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ids = self.tokens[np.repeat(start[of] - out[:-1], lengths) + np.arange(out[-1])] if len(of) else self.tokens[:0]
        bounds = out[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b].tobytes() + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def batch(self, texts: list[str | None], end_id: int) -> list[bytes]:
        return self.bytes_of(*common.text_bytes(pa.array(texts, pa.string())), end_id)


@lru_cache(2)
def _check_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _CHECK_BASE, np.uint64), np.full(n + 1, _CHECK_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One per worker process, kept over its tasks; what it remembers is forgotten when a task ends."""
    return Encoder(path)


# ------------------------------------------------------------------ the file format


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    a = zlib.crc32(key)
    b = zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class ShardWriter:
    """Appends rows in key order; memory is one block, the sparse index and the keys for the Bloom filter."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.rows = self.tokens = self.blocks = 0
        self.pack = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self):
        self.block, self.first, self.last, self.block_rows, self.block_tokens = bytearray(), None, b"", 0, 0

    def add(self, key: bytes, ids: bytes) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = len(os.path.commonprefix([key, self.last]))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) + 1) + key[shared:] + bytes([self.width]) + ids
        self.last = key
        self.keys.append(key)
        self.block_rows += 1
        self.block_tokens += len(ids) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.first is None:
            return
        data = self.pack.compress(bytes(self.block))
        self.out.write(data + struct.pack("<I", zlib.crc32(data)))
        self.index.append(struct.pack("<H", len(self.first)) + self.first + struct.pack("<QIIQ", self.at, len(data) + 4, self.block_rows, self.block_tokens))
        self.at += len(data) + 4
        self.rows += self.block_rows
        self.tokens += self.block_tokens
        self.blocks += 1
        self._open()

    def close(self) -> None:
        self.flush()
        index = b"".join(self.index)
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.out.write(index + bytes(bloom) + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), BLOOM_PROBES, self.blocks, self.rows, self.tokens, 1, MAGIC))
        self.size = self.at + len(index) + len(bloom) + FOOTER.size


class Shard:
    """One table file, read by ranges: footer and index first, blocks on demand."""

    def __init__(self, path: str):
        system, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.file = system.open_input_file(name)
        size = self.file.size()
        at, n, self.bloom_at, self.bloom_bytes, _, _, self.rows, self.tokens, _, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        data, p = self.file.read_at(n, at), 0
        self.first_keys, self.blocks = [], []
        while p < len(data):
            (k,) = struct.unpack_from("<H", data, p)
            self.first_keys.append(data[p + 2 : p + 2 + k])
            self.blocks.append(struct.unpack_from("<QIIQ", data, p + 2 + k))
            p += 2 + k + 24
        self._bloom: bytes | None = None

    def entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, n, _, _ = self.blocks[block]
        raw = self.file.read_at(n, at)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        data, p, key = zstandard.ZstdDecompressor().decompress(raw[:-4]), 0, b""
        while p < len(data):
            shared, p = _read_varint(data, p)
            fresh, p = _read_varint(data, p)
            size, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + fresh]
            p += fresh
            yield key, np.frombuffer(data, f"<u{data[p]}", (size - 1) // data[p], p + 1)
            p += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for b in range(len(self.blocks)):
            yield from self.entries(b)

    def may_hold(self, doc_id: int | None) -> bool:
        if self._bloom is None:
            self._bloom = self.file.read_at(self.bloom_bytes, self.bloom_at)
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), len(self._bloom) * 8))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier, in file order."""
        if not self.may_hold(doc_id):
            return []
        key = key_of(doc_id)
        b = max(0, bisect.bisect_left(self.first_keys, key) - 1)
        found = []
        while b < len(self.blocks) and self.first_keys[b] <= key:
            found += [ids for k, ids in self.entries(b) if k == key]
            b += 1
        return found

    def close(self) -> None:
        self.file.close()


# ------------------------------------------------------------------ Spark


def _writer(folder: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        out = sink = None
        encode = encoder(vocabulary)
        try:
            for rows, data, offsets in common.pieces(batches):
                if sink is None:
                    system, root = pafs.FileSystem.from_uri(folder)
                    name = f"{root}/shard-{shard:06d}.sst"
                    attempt = f"{root}/_attempt-{shard:06d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(attempt)
                    sink = ShardWriter(out, encode.width)
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode.bytes_of(data, offsets, end_id), strict=True):
                    sink.add(key_of(doc_id), ids)
        finally:
            encode.forget()
        if sink is not None:
            sink.close()
            out.close()
            system.move(attempt, name)
            yield pa.record_batch([pa.array([v]) for v in (shard, f"{folder}/shard-{shard:06d}.sst", sink.rows, sink.tokens, sink.size)], names=["shard", "path", "n_docs", "n_tokens", "bytes"])

    return write


def stored_bytes(rows: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as its leaves tell without a job; where a leaf does not know, those of the texts."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if max(sizes, default=0) < 1 << 60:
        return sum(sizes)
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def shard_count(size: int, slots: int) -> int:
    return max(1, min(-(-size // LEAST_SHARD), max(slots, -(-size // SHARD_BYTES))))


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and write shards in ascending identifier order.

    Returns the manifest (written): shard, path, n_docs, n_tokens, bytes, start, where start is
    the number of ids in all earlier shards.  One range shuffle of the texts (its bounds come from a sample of the
    identifiers); the number of shards comes from the size of the tables read, at 256 MB a shard, so 100 TB are some
    400,000 files.  Starts are summed in bands of BAND shards, then over the bands."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = shard_count(stored_bytes(rows), spark.sparkContext.defaultParallelism)
    folder = folder or common.new_path(spark, "token-shards")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    folder = system.makeQualified(path).toString()
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    parts = rows.withColumn("text_hash", F.xxhash64("text")).repartitionByRange(n, "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text").drop("text_hash")
    manifest = common.written(common.in_arrow(parts, _writer(folder, vocabulary, end_id), MANIFEST, _check_powers), "token-manifest")
    manifest = manifest.withColumn("band", F.floor(F.col("shard") / BAND))
    earlier = lambda window: F.coalesce(F.sum("n_tokens").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = manifest.groupBy("band").agg(F.sum("n_tokens").alias("n_tokens")).select("band", earlier(Window.orderBy("band")).alias("before"))
    return manifest.withColumn("start", earlier(Window.partitionBy("band").orderBy("shard"))).join(bands, "band").select(*(f.split()[0] for f in MANIFEST.split(", ")), (F.col("start") + F.col("before")).alias("start"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, path, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            table = Shard(path)
            for b in range(len(table.blocks)):
                out: list[tuple] = []
                for key, ids in table.entries(b):
                    out.append((id_of(key), shard, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                columns = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "shard", "at", "n_tokens", "ids_crc32"])
            table.close()


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shard files: doc_id, shard, at (ids before it), n_tokens, ids_crc32."""
    spread = manifest.select("shard", "path", "start").repartition("shard")
    return common.in_arrow(spread, _reader, ROWS)
