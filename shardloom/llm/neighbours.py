"""Embedding near-duplicates by cross-polytope hashing.

A vector is turned by fast pseudo-random rotations (three rounds of sign flips and a Hadamard transform); its
hash is the signed axis it then lies nearest to.  A bucket of a table is ``hashes`` such axes together with the
label, and each vector is also filed under its ``probes`` next likely buckets (multiprobe).  Vectors that meet
where at least one is at home are compared exactly, in double precision.

* Equal vectors of a label are one row with a multiplicity first (partial aggregation), so a vector that a third
  of the rows share costs one row.
* A pair that meets in several buckets is counted in the first of them only: both sides' buckets follow from the
  vectors, so the task knows.  So no pair is ever written; a task gives each vector's number of links and
  a spanning set of its links.
* Buckets of one vector are dropped before vectors travel.  Large buckets are compared as pairs of sub-blocks of
  CELL rows, so no task holds an unbounded bucket, and none is cut short.

Recall against brute force is measured in the tests (over 0.99 at the default settings); found pairs are exact.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with a null label or
null identifier link with nothing; vectors of different lengths do not link with each other, each length is hashed
and compared by itself; repeated rows are further vectors of that identifier and link with each other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: Rows of one side of a sub-block.
CELL = 512
#: Tables by number of hashes: a bucket of more axes is met more seldom, so that more tables keep the recall level.
TABLES = {2: 8, 3: 8, 4: 12, 5: 24}
#: Pairs looked at together.
PAIRS = 1 << 21


class Hasher:
    """Bucket codes of unit vectors: ``tables`` x (home and probes)."""

    def __init__(self, dim: int, tables: int, hashes: int, probes: int, seed: int = 7):
        self.dim, self.tables, self.hashes, self.probes = dim, tables, hashes, probes
        self.width = 1 << max(2, (dim - 1).bit_length())
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0], np.float32), (tables, hashes, 3, self.width))

    def _rotated(self, x: np.ndarray, signs: np.ndarray) -> np.ndarray:
        for s in signs:
            x = x * s
            h = 1
            while h < self.width:
                y = x.reshape(len(x), -1, 2, h)
                x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), self.width)
                h *= 2
            x = x / np.float32(np.sqrt(self.width))
        return x

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """int64 [rows, tables, 1 + probes]: the home code, then the likeliest others."""
        n = len(vectors)
        x = np.zeros((n, self.width), np.float32)
        x[:, : self.dim] = vectors
        near, out = 3, np.empty((n, self.tables, 1 + self.probes), np.int64)
        for t in range(self.tables):
            code, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1), np.float32)
            for k in range(self.hashes):
                r = self._rotated(x, self.signs[t, k])
                size = np.abs(r)
                top = np.argpartition(-size, near, axis=1)[:, :near]
                order = np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable")
                top = np.take_along_axis(top, order, 1)
                value = np.take_along_axis(r, top, 1)
                loss = (np.abs(value[:, :1]) - np.abs(value)) ** 2
                axis = top * 2 + (value < 0)
                code = (code[:, :, None] * (2 * self.width) + axis[:, None, :]).reshape(n, -1)
                cost = (cost[:, :, None] + loss[:, None, :]).reshape(n, -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, : 1 + self.probes]
            out[:, t] = np.take_along_axis(code, best, 1)
        return out


def first_meeting(a: np.ndarray, b: np.ndarray, table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether pairs with codes a, b (each [pairs, tables, 1 + probes]) meet in their ``bucket`` of ``table`` and in none before it.

    A pair meets where one is at home and the other at home or probing; buckets are ordered by table, then code."""
    at_b = (b[:, :, :1] == a).any(2)  # in a table, they meet at b's home
    at_a = (a[:, :, :1] == b).any(2)
    pair = np.arange(len(a))
    fresh = (at_a | at_b).argmax(1) == table
    home_a, home_b = a[pair, table, 0], b[pair, table, 0]
    in_a, in_b = at_a[pair, table], at_b[pair, table]
    first = np.where(in_a & in_b, np.minimum(home_a, home_b), np.where(in_a, home_a, home_b))
    return fresh & (in_a | in_b) & (first == bucket)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of the component of each of n nodes under the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _hashers(settings: dict):
    """Hasher by length of vector; ``settings`` maps a length to its further arguments."""
    return lru_cache(16)(lambda dim: Hasher(dim, **settings[dim]))


def _filed(settings: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = _hashers(settings)
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                same = batch.take(pa.array(np.flatnonzero(dims == dim)))
                for at in range(0, same.num_rows, 4096):
                    rows = same.slice(at, 4096)
                    vectors = rows.column(1).flatten().to_numpy().reshape(rows.num_rows, dim)
                    codes = hashers(dim).codes(unit(vectors))
                    n, tables, wide = codes.shape
                    yield pa.record_batch(
                        [
                            pa.array(np.repeat(rows.column(0).to_numpy(), tables * wide)),
                            pa.array(np.repeat(rows.column(2).to_numpy(), tables * wide)),
                            pa.array(np.full(n * tables * wide, dim, np.int32)),
                            pa.array(np.tile(np.repeat(np.arange(tables), wide), n), pa.int32()),
                            pa.array(codes.ravel()),
                            pa.array(np.tile(np.arange(wide) == 0, n * tables)),
                        ],
                        names=["node", "label", "dim", "tab", "code", "home"],
                    )

    return run


def _compare(settings: dict, least: float):
    """Rows (tab, code, label, i, j, salt, node, copies, vector, dim) sorted by dim, bucket and sub-block -> (node, links, root)."""
    at_once = PAIRS // 64  # pairs whose codes are laid side by side

    def resolved(hasher, c, v, p, q):
        """Links and spanning roots of the rows, from all close pairs p-q of some blocks."""
        used = np.unique(np.concatenate([p, q]))
        codes = np.concatenate([hasher.codes(v[used[a : a + 4096]]) for a in range(0, len(used), 4096)])
        of_p, of_q = np.searchsorted(used, p), np.searchsorted(used, q)
        ok = np.concatenate([first_meeting(codes[of_p[a : a + at_once]], codes[of_q[a : a + at_once]], c[0][p[a : a + at_once]], c[1][p[a : a + at_once]]) for a in range(0, len(p), at_once)])
        p, q, n, node, copies = p[ok], q[ok], len(v), c[6], c[7]
        links = np.bincount(p, copies[q], n).astype(np.int64) + np.bincount(q, copies[p], n).astype(np.int64)
        some = np.flatnonzero(links)
        root = spanning(n, p, q)
        return pa.record_batch([pa.array(node[some]), pa.array(links[some]), pa.array(node[root[some]])], names=["node", "links", "root"])

    def close_pairs(c, v, a, b):
        i, j, salt = c[3][a], c[4][a], c[5][a:b]
        left, right = a + np.flatnonzero(salt == i), a + np.flatnonzero(salt == j)
        if not len(left) or not len(right):
            return
        step = max(1, PAIRS // len(right))
        for k in range(0, len(left), step):
            x, y = np.nonzero(v[left[k : k + step]] @ v[right].T >= least)
            x, y = left[k + x], right[y]
            if i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, held, of = _hashers(settings), None, None

        def blocks(c, bounds):
            v, found, n = unit(c[8]), [], 0
            for a, b in bounds:
                for x, y in close_pairs(c, v, a, b):
                    found.append((x, y))
                    n += len(x)
                if n > PAIRS:
                    yield resolved(hashers(of), c, v, *map(np.concatenate, zip(*found, strict=True)))
                    found, n = [], 0
            if n:
                yield resolved(hashers(of), c, v, *map(np.concatenate, zip(*found, strict=True)))

        for batch in batches:
            dims = batch.column(9).to_numpy()
            cuts = [0, *(np.flatnonzero(dims[1:] != dims[:-1]) + 1).tolist(), len(dims)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held is not None and of != dims[a]:  # the last block of a length
                    yield from blocks(held, [(0, len(held[0]))])
                    held = None
                of, rows = int(dims[a]), batch.slice(a, b - a)
                c = [rows.column(k).to_numpy() for k in range(8)] + [rows.column(8).flatten().to_numpy().reshape(-1, of)]
                if held is not None:
                    c = [np.concatenate(x) for x in zip(held, c, strict=True)]
                new = np.ones(len(c[0]), bool)
                new[1:] = np.any([c[k][1:] != c[k][:-1] for k in range(5)], axis=0)
                starts = np.flatnonzero(new)
                if len(starts) > 1:
                    yield from blocks([x[: starts[-1]] for x in c], list(zip(starts[:-1], starts[1:], strict=True)))
                held = [x[starts[-1] :] for x in c]
        if held is not None:
            yield from blocks(held, [(0, len(held[0]))])

    return run


def hashes_for(dim: int, count: int) -> int:
    """One more axis per bucket for every factor of twice the dimension, two at least."""
    width = 2 << max(2, (dim - 1).bit_length())
    return max(2, min(5, int(np.ceil(np.log(max(2, count)) / np.log(width)))))


def tables_for(hashes: int) -> int:
    return TABLES[max(2, min(5, hashes))]


def link(
    vectors: DataFrame, least: float = 0.93, tables: int | None = None, hashes: int | None = None, probes: int = 8, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.  ``hashes`` is chosen by the number of vectors of a length unless given (``hashes_for``), ``tables`` by the hashes.  The result reads a written table."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).cast("string").alias("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)
    fine &= F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("vector", F.when(F.coalesce(fine, F.lit(False)), F.col("vector")))
    counts = {r["n"]: r["c"] for r in rows.where("vector is not null").groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    chosen = {dim: hashes or hashes_for(dim, count) for dim, count in counts.items()}
    settings = {dim: {"tables": tables or tables_for(k), "hashes": k, "probes": probes} for dim, k in chosen.items()}
    with common.Scratch(spark, "vectors") as scratch:
        named = common.written(_named(rows, settings, least, scratch), "vector-groups")
    out = rows.withColumns(_names(F.col("vector").isNotNull())).join(named, ["name", "other_name"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _names(there: Column) -> dict[str, Column]:
    """128 bits that name a vector of a label, so that no two of them share a row."""
    return {"name": F.when(there, F.xxhash64("label", "vector")), "other_name": F.when(there, F.xxhash64(F.lit("other"), "vector", "label"))}


def _named(rows: DataFrame, settings: dict, least: float, scratch: common.Scratch) -> DataFrame:
    """(name, other_name, component_id, n_links) of every distinct vector of a label."""
    nodes = rows.where("vector is not null").groupBy("label", "vector").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # the number is fixed by the write
    nodes = scratch.keep(nodes.withColumns(_names(F.lit(True))).withColumn("node", F.monotonically_increasing_id()), "nodes")
    filed = common.in_arrow(nodes.select("node", "vector", F.xxhash64("label").alias("label"), F.size("vector").alias("dim")), _filed(settings), "node long, label long, dim int, tab int, code long, home boolean")
    filed = scratch.keep(filed, "buckets")
    bucket = ["dim", "tab", "code", "label"]
    sizes = filed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home")).where("home and n > 1").select(*bucket, F.ceil(F.col("n") / CELL).cast("int").alias("cells"))
    cut = filed.join(sizes, bucket).withColumn("salt", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cut = cut.select(*bucket, F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "node")
    block = [*bucket, "i", "j"]  # dim is the first to sort by, and the last column
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = cut.join(nodes.select("node", "copies", "vector"), "node").select(*block[1:], "salt", "node", "copies", "vector", "dim").repartition(parts, *block).sortWithinPartitions(*block, "node")
    found = scratch.keep(common.in_arrow(met, _compare(settings, least), "node long, links long, root long"), "links")
    scratch.drop(filed)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    named = nodes.select("node", "name", "other_name", "first_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return named.join(least_id, "root").join(links, "node", "left").select("name", "other_name", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
