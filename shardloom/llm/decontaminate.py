"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items (``width`` consecutive words; an item of fewer
words, but not none, is one window).  For each pattern length there is a block shift table: a
block is the last two words of the text window under the search head, and its shift says how far
the head may skip because no pattern holds that block nearer its end.  A zero shift selects the
bucket of patterns with that suffix block (ordered inside by a hash of the window), and the words
themselves are compared.

The benchmark is cut into blocks of at most BLOCK_WORDS words, counted as the search counts them; an item
longer than what is left of a block goes on in the next, by ``width`` - 1 words earlier, so that every window
stands whole in one.  Blocks are broadcast as plain text (their size is that bound) and turned into tables, some 30
bytes a word, by the workers.  One Python stage searches all blocks: it holds HOLD_BYTES of texts and runs them
against block after block, so its memory is one block's tables and those texts, however large the benchmark is.
No shuffle at any size.

Defined results: null or empty texts have no words and no hits; repeated rows each get their own
result; an empty benchmark hits nothing; an item without an identifier marks words but is not
listed; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of benchmark text in one broadcast block.
BLOCK_WORDS = 500_000
#: Text bytes that are searched for one block before the next is taken, where there are several.
HOLD_BYTES = 16 << 20

#: A stretch of an item: its identifier and the words (lower-case, one space between).
Stretch = tuple[str | None, bytes]

HITS, ITEMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
RESULT = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>"


def _block_hashes(words: np.ndarray, block: int) -> np.ndarray:
    return words if block == 1 else common.mix(words[:-1] * common._BASE + words[1:]) if len(words) > 1 else words[:0]


class Patterns:
    """Shift table and suffix buckets for the windows of one length, as sorted arrays."""

    def __init__(self, length: int, text: Text, first: np.ndarray, item: np.ndarray):
        """``first``: word index in ``text`` of every window's first word; ``item``: its item."""
        self.length, self.text = length, text
        self.block = min(2, length)
        self.furthest = length - self.block + 1
        blocks = text.blocks(self.block)
        # the least distance of each block from the end of a window
        held = np.concatenate([blocks[first + j] for j in range(self.furthest)])
        away = np.repeat(np.arange(self.furthest)[::-1], len(first))
        order = np.lexsort((away, held))
        held, away = held[order], away[order]
        new = np.ones(len(held), bool)
        new[1:] = held[1:] != held[:-1]
        self.held, self.away = held[new], away[new].astype(np.uint8 if self.furthest < 256 else np.int64)
        key = self.bucket_keys(text, first)
        order = np.argsort(key, kind="stable")
        self.key, self.first, self.item = key[order], first[order], item[order]

    def bucket_keys(self, text: Text, first: np.ndarray) -> np.ndarray:
        """Of windows of ``text``: their suffix block's hash, refined by that of all their words."""
        h = text.hashes[first]
        for k in range(1, self.length):
            h = common.mix(h * common._BASE + text.hashes[first + k])
        return common.mix(text.blocks(self.block)[first + self.length - self.block]) ^ h

    def shifts(self, blocks: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.held, blocks), len(self.held) - 1)
        return np.where(self.held[at] == blocks, self.away[at], self.furthest)


class Text:
    """Lower-cased rows as words: their places, hashes and bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = common.lowered(data)
        self.starts, self.ends, self.word_at = common.word_spans(data, offsets, "alnum")
        self.hashes, self.raw = common.span_hashes(data, self.starts, self.ends), data.tobytes()
        self._blocks: dict[int, np.ndarray] = {}

    def blocks(self, size: int) -> np.ndarray:
        if size not in self._blocks:
            self._blocks[size] = _block_hashes(self.hashes, size)
        return self._blocks[size]

    def window(self, first: int, length: int) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.starts[first : first + length].tolist(), self.ends[first : first + length].tolist(), strict=True)]


class Block:
    """The tables of one block of the benchmark."""

    def __init__(self, stretches: list[Stretch], width: int):
        self.names = [item for item, _ in stretches]
        texts = [words for _, words in stretches]
        self.text = Text(np.frombuffer(b"\n".join(texts), np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts[:-1]), len(texts[-1])]) if texts else np.zeros(1, np.int64))
        counts = np.diff(self.text.word_at)
        lengths = np.minimum(counts, width)
        self.tables = []
        for length in np.unique(lengths[lengths > 0]).tolist():
            mine = np.flatnonzero(lengths == length)
            n = counts[mine] - length + 1
            first = np.repeat(self.text.word_at[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            self.tables.append(Patterns(length, self.text, first, np.repeat(mine, n)))


def heads(shift: list[int], lo: int, hi: int) -> Iterator[int]:
    """Where the search head meets a zero shift between lo and hi, skipping as the others tell."""
    head = lo
    while head < hi:
        step = shift[head]
        if step:
            head += step
        else:
            yield head
            head += 1


def scan(patterns: Patterns, text: Text) -> Iterator[tuple[int, int, int]]:
    """(row, word index, item) of every occurrence of a pattern in the rows of ``text``."""
    blocks, back = text.blocks(patterns.block), patterns.length - patterns.block
    if not len(blocks):
        return
    shift = patterns.shifts(blocks).tolist()
    bounds = text.word_at.tolist()
    met, rows = [], []
    for r, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if hi - lo >= patterns.length:
            found = list(heads(shift, lo + back, hi - patterns.block + 1))
            met += found
            rows += [r] * len(found)
    first = np.array(met, np.int64) - back
    key = patterns.bucket_keys(text, first) if len(first) else np.zeros(0, np.uint64)
    a, b = np.searchsorted(patterns.key, key), np.searchsorted(patterns.key, key, side="right")
    for k in np.flatnonzero(a < b).tolist():
        words = text.window(met[k] - back, patterns.length)
        for p in range(a[k], b[k]):
            if patterns.text.window(int(patterns.first[p]), patterns.length) == words:
                yield rows[k], met[k] - back, int(patterns.item[p])


def _searcher(shared: list, width: int, text_at):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, Text, list, list]] = []
        size, order, block = 0, list(range(len(shared))), None

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal size, order, block
            for k in order:
                if block is None or block[0] != k:
                    block = None  # one at a time
                    block = (k, Block(shared[k].value, width))
                for _, text, places, names in held:
                    for table in block[1].tables:
                        for r, at, item in scan(table, text):
                            at -= int(text.word_at[r])
                            places[r].append((at, at + table.length))
                            if block[1].names[item] is not None:
                                names[r].add(block[1].names[item])
            order = order[::-1]  # the last block is at hand for the next texts
            for rows, text, places, names in held:
                rest = [c for c in rows.schema.names if c == "carried"]
                yield pa.record_batch(
                    [rows.column(0), pa.array(np.diff(text.word_at), pa.int64()), pa.array([merged(p) for p in places], HITS), pa.array([sorted(n) for n in names], ITEMS), *(rows.column(c) for c in rest)],
                    names=["doc_id", "n_words", "hits", "items", *rest],
                )
            held.clear()
            size = 0

        for rows, data, offsets in common.pieces(batches, text_at):
            held.append((rows, Text(data, offsets), [[] for _ in range(rows.num_rows)], [set() for _ in range(rows.num_rows)]))
            size += len(data)
            if size >= HOLD_BYTES or len(shared) < 2:
                yield from finish()
        yield from finish()

    return search


def merged(intervals: list[tuple[int, int]]) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(b, out[-1]["end"])
        else:
            out.append({"start": a, "end": b})
    return out


def item_blocks(items: Iterable[tuple[str | None, str | None]], width: int) -> Iterator[list[Stretch]]:
    """The items as blocks of at most BLOCK_WORDS words (or ``width``, if that is more)."""
    most = max(BLOCK_WORDS, width)
    block, room = [], most
    for item, text in items:
        data = (text or "").encode()
        found = Text(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        n, at = len(found.starts), 0
        while n and (at == 0 or at + width - 1 < n):
            least = min(width, n - at)  # less would hold no window
            if room < least:
                yield block
                block, room = [], most
            to = min(n, at + room)
            block.append((item, b" ".join(found.window(at, to - at))))
            room -= to - at
            at = to - width + 1 if to < n else n
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, n_words, hits (merged word intervals inside occurrences), items (sorted as strings);
    then the ``carry`` columns as a struct ``carried``."""
    rows, text_at = common.texts(docs, id_col, text_col, carry)
    items = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string")).toLocalIterator()
    shared = [docs.sparkSession.sparkContext.broadcast(block) for block in item_blocks(items, width)]
    return common.in_arrow(rows, _searcher(shared, width, text_at), common.with_carried(RESULT, rows))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of the registered query."""
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )
