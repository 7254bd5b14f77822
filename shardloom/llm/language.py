"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes, A-Z lower-cased (orders 3 down to 0, then a
uniform order -1 over all 256 byte values).  A symbol seen c times in a context of n symbols, d of them
distinct, costs -log2(c / (n + d)); an unseen one pays the escape -log2(d / (n + d)) and is coded in the next
shorter context with the symbols already offered excluded, so every context codes a proper distribution.
Statistics are frozen after training, and a text's code length under a language is the exact sum over
its bytes.  The shortest code names the language; the score is its posterior under equal priors.

Exclusion makes an escape's cost depend on the context alone, so a tree is kept as the bits of every symbol
seen in a context and the bits of every context's escape, sorted by context: memory follows what the trees hold,
not what they could hold.  Training counts come from a bounded sample of labelled rows (``per_language`` in
expectation for each language); every language that ``lang`` names is learned, and everything else covers all rows.

Defined results: a null text, an empty one or one without a letter is ``und`` with score 0; with nothing
to learn from, all are; ties go to the first language in string order; repeated rows each get their own
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 3
SYMBOLS = 256
#: Bits a byte of the uniform code that every tree ends in.
BITS = 8
UNDETERMINED = "und"
_SAMPLE_UNITS = 1 << 20
#: Languages up to which their shares of the sample are broadcast, so that texts are not shuffled to be sampled.
BROADCAST_LANGUAGES = 100_000

SCHEMA = "doc_id long, lang_pred string, score double, bits_per_byte double"


def grams_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per byte a number of ORDER + 1 bytes: those before it (spaces before the first of a row), then its own, which is the lowest."""
    n_rows = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(1, n_rows + 1) * ORDER, np.diff(offsets))
    padded = np.full(len(data) + ORDER * n_rows, 32, np.uint32)
    padded[at] = common.lowered(data)
    out = padded.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= padded[:-k] << np.uint32(8 * k)
    return out[at]


def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n): how often the bytes of a gram follow each other in a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.pieces(batches):
            gram = grams_of(data, offsets)
            of_row = rows.column(0).dictionary_encode()
            code = np.repeat(of_row.indices.to_numpy(), np.diff(offsets)).astype(np.uint64)
            both, n = np.unique(code << np.uint64(32) | gram, return_counts=True)
            langs = of_row.dictionary.take(pa.array(both >> np.uint64(32)))
            yield pa.record_batch([langs, pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return common.in_arrow(sample, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Tree:
    """Frozen statistics of one language: per order, longest last, the grams with their bits and the contexts with the bits of their escapes."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        shorter = lambda found: np.full(len(found), 1.0 / SYMBOLS)
        for k in range(ORDER + 1):
            seen, at = np.unique(gram & np.uint32((1 << 8 * (k + 1)) - 1), return_inverse=True)
            count = np.bincount(at, n, len(seen))
            context, of = np.unique(seen >> np.uint32(8), return_inverse=True)
            total, distinct = np.bincount(of, count), np.bincount(of).astype(float)
            left = 1.0 - np.bincount(of, shorter(seen))  # what the next shorter context offers besides
            every = distinct == SYMBOLS  # nothing to escape to
            p = count / (total + np.where(every, 0.0, distinct))[of]
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(every, 0.0, -np.log2(distinct / (total + distinct) / np.maximum(left, 1e-300)))
            self.orders.append((seen, -np.log2(p), context, escape))
            mask = np.uint32((1 << 8 * (k + 1)) - 1)
            shorter = lambda found, seen=seen, p=p, mask=mask: p[np.searchsorted(seen, found & mask)]  # noqa: E731  (a suffix of a seen gram is seen)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram in the context of the others."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            seen, bits, context, escape = self.orders[k]
            mine = gram[open_] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(seen, mine), len(seen) - 1)
            hit = seen[at] == mine
            out[open_[hit]] += bits[at[hit]]
            open_, mine = open_[~hit], mine[~hit] >> np.uint32(8)
            at = np.minimum(np.searchsorted(context, mine), len(context) - 1)
            known = context[at] == mine
            out[open_[known]] += escape[at[known]]
        out[open_] += BITS
        return out


class Model:
    """Gram counts of all languages; the trees are built where they are used."""

    def __init__(self, grams: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(grams)
        self.grams = [grams[lang] for lang in self.languages]
        self._trees = None

    def __getstate__(self):
        return {**self.__dict__, "_trees": None}

    def trees(self) -> list[Tree]:
        if self._trees is None:
            self._trees = [Tree(gram, n) for gram, n in self.grams]
        return self._trees

    def forget(self) -> None:
        self._trees = None


def fit(labelled: DataFrame, per_language: int = 2000, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> Model | None:
    """Learn from rows with a language and a text.  ``per_language`` bounds the expected sample of each language
    (rows are picked by a hash of their identifier), and so the model: what the driver and each worker hold is
    at most one gram per byte of the sample."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id")).where("lang is not null and text is not null")
    share = rows.groupBy("lang").agg((F.least(F.lit(1.0), F.lit(per_language) / F.count(F.lit(1))) * _SAMPLE_UNITS + 1).alias("share"))
    share = common.written(share, "language-shares")
    if share.count() <= BROADCAST_LANGUAGES:
        share = F.broadcast(share)
    picked = F.pmod(F.xxhash64(F.lit("language sample"), F.col("doc_id")), F.lit(_SAMPLE_UNITS)) < F.col("share")
    with common.shuffles_dropped(labelled.sparkSession):
        got = gram_counts(rows.join(share, "lang").where(picked).select("lang", "text")).toArrow()
    if not got.num_rows:
        return None
    langs = got["lang"].combine_chunks().dictionary_encode()
    code, gram, n = langs.indices.to_numpy(), got["gram"].to_numpy().astype(np.uint32), got["n"].to_numpy()
    order = np.lexsort((gram, code))
    cuts = np.searchsorted(code[order], np.arange(len(langs.dictionary) + 1))
    return Model({lang: (gram[order[a:b]], n[order[a:b]]) for lang, a, b in zip(langs.dictionary.to_pylist(), cuts[:-1], cuts[1:], strict=True)})


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each row under each language (rows x languages)."""
    trees = model.trees()
    out = np.zeros((len(offsets) - 1, len(trees)))
    filled = np.flatnonzero(np.diff(offsets))
    if len(filled):
        met = pa.array(grams_of(data, offsets)).dictionary_encode()  # each distinct gram is coded once
        gram, of = met.dictionary.to_numpy(), met.indices.to_numpy()
        for k, tree in enumerate(trees):
            out[filled, k] = np.add.reduceat(tree.bits(gram)[of], offsets[filled])
    return out


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
    out = total[offsets[1:]] > total[offsets[:-1]]
    for r in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document row: doc_id, lang_pred, score, bits_per_byte (of the shortest code; null for ``und``); then the
    ``carry`` columns as a struct ``carried``."""
    rows, text_at = common.texts(docs, id_col, text_col, carry)
    if model is None:
        nothing = (F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
        return rows.select("doc_id", *nothing, *(["carried"] if carry else []))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        names = np.array([*frozen.languages, UNDETERMINED], object)
        try:
            for piece, data, offsets in common.pieces(batches, text_at):
                rest = [piece.column("carried")] if carry else []
                yield pa.record_batch([piece.column(0), *_decide(frozen, names, data, offsets), *rest], names=["doc_id", "lang_pred", "score", "bits_per_byte", "carried"][: 4 + len(rest)])
        finally:
            frozen.forget()

    return common.in_arrow(rows, run, common.with_carried(SCHEMA, rows))


def _decide(model: Model, names: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    bits = code_lengths(model, data, offsets)
    best = bits.argmin(1)
    least = bits[np.arange(len(best)), best]
    score = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    known = has_letter(data, offsets)
    pred = np.where(known, best, len(model.languages))
    per_byte = least / np.maximum(1, np.diff(offsets))
    return [pa.array(names[pred].tolist(), pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(per_byte, mask=~known)]
