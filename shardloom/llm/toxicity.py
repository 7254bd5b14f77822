"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams (4, 6 and 8 characters of the lower-cased text, code points of any
script, one space before and after it).  Per bucket the log-count ratio r = log(P(bucket | toxic) / P(bucket | clean)) is counted over
**all** labelled training rows; the ``features`` buckets whose ratio stands out most from chance are kept.
A logistic regression with an L2 penalty is then fitted on r * presence over a bounded sample of labelled
rows (``per_class`` in expectation for each label), its intercept shifted back to the corpus's class odds.

Scoring is one pass over whole texts with a broadcast table of one float per bucket (fixed size).

Defined results: null and empty texts score by the intercept and the padding alone; without both labels
to learn from every score is the base rate (0 if unknown); repeated labels each count; labels other than
0 and 1 are ignored; repeated rows each get their own result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAMS = (4, 6, 8)
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
_SAMPLE_UNITS = 1 << 20
#: Label rows up to which the label side of the training join is broadcast (16 bytes each).
BROADCAST_ROWS = 2_000_000

SCHEMA = "doc_id long, score double"


def characters(text: bytes) -> np.ndarray:
    """Code points of a text, lower-cased, with a space before and after."""
    return np.frombuffer(f" {text.decode('utf-8', 'replace').lower()} ".encode("utf-32-le", "replace"), np.uint32)


def buckets(x: np.ndarray) -> np.ndarray:
    """Bucket of every n-gram of the characters of one text."""
    h = x[:-1] ^ x[1:] * np.uint32(0x85EBCA6B) if len(x) > 1 else x[:0]
    out = []
    for n in range(3, GRAMS[-1] + 1):
        if len(x) < n:
            break
        h = (h[: len(x) - n + 1] ^ (h[: len(x) - n + 1] >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + x[n - 1 :] * np.uint32(0x297A2D39)
        if n in GRAMS:
            out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def rows_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The characters of each row."""
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield characters(raw[a:b])


class Distinct:
    """First occurrences in an array of buckets, by one scatter instead of a sort."""

    def __init__(self):
        self.slot = np.zeros(BUCKETS, np.int64)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        at = np.arange(len(found))
        self.slot[found] = at
        return found[self.slot[found] == at]


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, text) -> per bucket the clean and toxic documents that have it; bucket -1 counts all documents."""
    counts, distinct, n = np.zeros((2, BUCKETS), np.int64), Distinct(), [0, 0]
    for rows, data, offsets in common.pieces(batches):
        for label, x in zip(rows.column(0).to_pylist(), rows_of(data, offsets), strict=True):
            counts[label, distinct(buckets(x))] += 1
            n[label] += 1
    used = np.flatnonzero(counts.any(0))
    yield pa.record_batch(
        [pa.array(np.concatenate([[-1], used]), pa.int64()), *(pa.array(np.concatenate([[n[c]], counts[c, used]]), pa.int64()) for c in (0, 1))],
        names=["bucket", "clean", "toxic"],
    )


def _sparse(shared):
    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, distinct = shared.value, Distinct()
        for rows, data, offsets in common.pieces(batches):
            found = []
            for x in rows_of(data, offsets):
                f = keep[distinct(buckets(x))]
                found.append(f[f >= 0].astype(np.int32))
            yield pa.record_batch([rows.column(0), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    return sparse


def logistic(found: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, penalty: float, steps: int = 80) -> tuple[np.ndarray, float]:
    """L-BFGS on sparse presence rows scaled by ``ratio``; returns weights (of the scaled features) and intercept."""
    cols = np.concatenate(found) if found else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
    vals = ratio[cols]
    n, m = len(ratio), max(1, len(y))

    def loss(w):
        z = np.bincount(rows, vals * w[cols], len(y)) + w[n]
        e = 1 / (1 + np.exp(-z)) - y
        value = (np.logaddexp(0, z) - y * z).sum() / m + 0.5 * penalty * (w[:n] @ w[:n])
        return value, np.append(np.bincount(cols, vals * e[rows], n) / m + penalty * w[:n], e.sum() / m)

    w = np.zeros(n + 1)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = grad.copy(), []
        for s, g in reversed(past):
            a = (s @ d) / (s @ g)
            kept.append(a)
            d -= a * g
        if past:
            s, g = past[-1]
            d *= (s @ g) / (g @ g)
        for (s, g), a in zip(past, reversed(kept), strict=True):
            d += s * (a - (g @ d) / (s @ g))
        step, slope = 1.0 if past else min(1.0, 1 / (np.abs(grad).sum() + 1e-12)), grad @ d
        while True:
            next_w = w - step * d
            next_value, next_grad = loss(next_w)
            if next_value <= value - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, g = next_w - w, next_grad - grad
        if s @ g > 1e-12:
            past = [*past[-9:], (s, g)]
        done = value - next_value < 1e-8
        w, value, grad = next_w, next_value, next_grad
        if done:
            break
    return w[:n], float(w[n])


class Model:
    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights, intercept  # one float32 per bucket


def fit(
    labelled: DataFrame, per_class: int = 3000, features: int = 3000, penalty: float = 3e-4, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id"
) -> Model:
    """Learn from rows (identifier, text, label).  Ratios count every row; the regression sees a sample of
    ``per_class`` rows of each label in expectation, picked by a hash of the identifier."""
    rows = labelled.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id")).where("label in (0, 1)")
    counted = common.in_arrow(rows.select("label", "text"), _presence, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    bucket, clean, toxic = (counted.column(i).to_numpy() for i in range(3))
    n0, n1 = (int(x[bucket == -1].sum()) for x in (clean, toxic))
    weights = np.zeros(BUCKETS, np.float32)
    if not n0 or not n1:
        return Model(weights, 40.0 if n1 else -40.0)
    real = bucket >= 0
    bucket, clean, toxic = bucket[real], clean[real], toxic[real]
    ratio = np.log((toxic + 1) / (n1 + 2)) - np.log((clean + 1) / (n0 + 2))
    chance = np.abs(ratio) / np.sqrt(1 / (toxic + 1) + 1 / (clean + 1))
    best = np.lexsort((bucket, -chance))[:features]
    keep = np.full(BUCKETS, -1, np.int32)
    keep[bucket[best]] = np.arange(len(best))
    unit = F.pmod(F.xxhash64(F.lit("toxicity sample"), F.col("doc_id")), F.lit(_SAMPLE_UNITS))
    share = F.when(F.col("label") == 1, int(min(1.0, per_class / n1) * _SAMPLE_UNITS) + 1).otherwise(int(min(1.0, per_class / n0) * _SAMPLE_UNITS) + 1)
    sample = common.in_arrow(rows.where(unit < share).select("label", "text"), _sparse(labelled.sparkSession.sparkContext.broadcast(keep)), "label int, found array<int>").toArrow()
    y = sample.column(0).to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(weights, float(np.log(n1 / n0)))
    lists = sample.column(1).combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    w, b = logistic([values[a:z] for a, z in zip(offsets[:-1], offsets[1:], strict=True)], y, ratio[best], penalty)
    weights[bucket[best]] = w * ratio[best]
    return Model(weights, b + float(np.log(n1 / n0) - np.log(y.sum() / (len(y) - y.sum()))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text") -> DataFrame:
    """Documents with their labels; the label side is broadcast only while its row count is within BROADCAST_ROWS."""
    side = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(side, "doc_id")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, score (probability of label 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen, distinct = shared.value, Distinct()
        for rows, data, offsets in common.pieces(batches):
            z = np.full(rows.num_rows, frozen.intercept)
            for r, x in enumerate(rows_of(data, offsets)):
                found = buckets(x)
                w = frozen.weights[found]
                some = w != 0
                z[r] += frozen.weights[distinct(found[some])].sum(dtype=np.float64)
            yield pa.record_batch([rows.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return common.in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)
