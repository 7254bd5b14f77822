"""N-gram Jaccard join by count vectors.

Each text is the set of its distinct word shingles.  Shingle hashes fall into groups; the numbers of
shingles per group are the text's count vector.  Two sets can share no more shingles than the sum of the
coordinate minima of their vectors, so an R-tree over the vectors, asked with that bound, gives few
candidates, and each candidate is verified on the sets themselves.

A tree over all texts would have to visit most of its leaves for every query, so the join is first routed,
exactly, by the groups' contents.  Texts are put into size classes (a pair belongs to the class of its
larger text, and a text also joins every class above where a partner may lie).  A linked pair of class c
differs in at most d_c shingles; with K_c > d_c groups, K_c - d_c of them are equal, and equal groups have
equal keys.  Groups of at most one shingle are frequent among unrelated texts, so a text that has fewer
than K_c - d_c of them leaves their keys out: an equal group of two or more must then exist.

Steps, none of which gathers a group or builds all pairs of one:

1. texts with equal sets are one node; a task files a node's keys once, so thousands of copies are a few rows;
2. nodes that share a key meet in one sorted run, and each is put into the cell of its run's first node.  A key that a
   sample of the texts shows to be frequent is dealt out over SALTS runs, whose first nodes meet in a second, small merge;
3. in each cell an R-tree over the members' coarse count vectors answers for the first node; the pairs it leaves are
   verified, again cell by cell (the first node's set travels once a cell), and joined to components;
4. runs that still hold nodes of different components are searched for all their pairs by R-trees (once for
   runs of the same nodes), large runs as pairs of bounded sub-blocks.  A search of coarse vectors leaves the nodes
   that may have a partner in their run at all; one of fine vectors gives the candidates that would join a block's
   components, best bounds first; and a last one, after these are verified, all candidates that are left between
   different components.

So every linked pair of different sets was a candidate of an R-tree before it was verified.

Step 4 leaves out pairs in long runs (HOT_RUN nodes or more, such as those of a passage that many texts hold) where it
can: a node whose keys in long runs, with its groups that have no key, are fewer than K_c - d_c has an equal group in
a shorter run with every partner of which the same holds, so two such nodes need not be compared there.

A pair that shares no key differs in more than d_c shingles, so no link is lost.  Shingles and sets are known by 64-bit
hashes: among n distinct sets, about n^2 / 2^65 pairs of different ones are expected to be taken for equal (one in
three thousand million for ten thousand sets, 0.03 for a thousand million).

All tables between the steps are deleted as soon as their last reader is written.

Defined results: null and empty texts, and texts without words, have size 0 and are their own component; a
text of fewer words than a shingle is one shingle; rows are the nodes, so repeated identifiers and rows are
allowed, and a component is named by the least identifier in it; a null identifier links nothing and has no
component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

#: A class spans sizes up to this many times its least.
CLASS_RATIO = 1.5
#: Groups beyond those that a linked pair can spoil, as a share of these.
SPARE = 0.3
#: Least coordinates of a count vector; larger texts have more, so that the bound still tells them apart.
COORDINATES = 64
#: Nodes in one side of a sub-block of a large run.
CELL = 2048
#: Nodes of a run that make it a long one.
HOT_RUN = 64
#: The low bits of a key are its size class.
CLASSES = 128
#: Rows up to which a list of needed documents is broadcast (three longs each, so 6 MB of values).
BROADCAST_ROWS = 250_000
LEAF = 16
#: Texts in one of which a key is looked for ahead (by a hash of the text), and keys found there that make a frequent one.
AHEAD, FREQUENT = 64, 32
#: Runs over which a frequent key is dealt out.
SALTS = 64


class Classes:
    """Size classes for a threshold of ``percent``: first and last size, spoilable groups d and groups K of each."""

    def __init__(self, percent: int, largest: int = 1 << 40):
        self.percent = percent
        low, lows, highs = 1, [], []
        while low <= largest:
            high = max(low, int(low * CLASS_RATIO) - 1)
            lows.append(low)
            highs.append(high)
            low = high + 1
        self.low, self.high = np.array(lows, np.int64), np.array(highs, np.int64)
        self.spoiled = 2 * self.high * (100 - percent) // (100 + percent)
        self.groups = np.where(self.spoiled > 0, self.spoiled + 1 + np.ceil(self.spoiled * SPARE).astype(np.int64), 0)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, sizes, side="right") - 1


def group_keys(hashes: np.ndarray, first: np.ndarray, classes: Classes) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of all rows and per row the index of its first key; ``hashes`` are sorted and distinct within each row.

    Then (row, class, spare): a row may leave out fewer than ``spare`` more keys of the class."""
    sizes = np.diff(first)
    own = classes.of(np.maximum(sizes, 1))
    jobs = []
    step, reach = 0, sizes > 0
    while not step or reach.any():  # the own class, and every one above where a partner may lie
        c = np.minimum(own + step, len(classes.low) - 1)
        rows = np.flatnonzero(reach & (classes.groups[c] > 0))
        jobs.append((rows, c[rows]))
        step += 1
        c = np.minimum(own + step, len(classes.low) - 1)
        reach = (sizes > 0) & (own + step < len(classes.low)) & (sizes * 100 >= classes.percent * classes.low[c])
    rows = np.concatenate([j[0] for j in jobs])
    cls = np.concatenate([j[1] for j in jobs])
    order = np.argsort(rows, kind="stable")
    rows, cls = rows[order], cls[order]
    if not len(rows):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64), (none, none, none)
    n = sizes[rows]
    base = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(base[-1]) + np.repeat(first[rows] - base[:-1], n)
    item = hashes[at]
    k = np.repeat(classes.groups[cls].astype(np.uint64), n)
    group = ((item >> np.uint64(32)) * k) >> np.uint64(32)  # rises with the hash, so groups are contiguous
    job = np.repeat(np.arange(len(rows)), n)
    new = np.ones(len(item), bool)
    new[1:] = (job[1:] != job[:-1]) | (group[1:] != group[:-1])
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(common.mix(item), starts)
    counts = np.diff(np.append(starts, len(item)))
    of_job = job[starts]
    keys = common.mix(sums ^ (cls[of_job].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    total, spoiled = classes.groups[cls], classes.spoiled[cls]
    filled = np.bincount(of_job, minlength=len(rows))
    heavy = np.bincount(of_job, counts > 1, minlength=len(rows)).astype(np.int64)
    all_needed = total - heavy >= total - spoiled  # too few groups of two or more to rely on them
    keep = (counts > 1) | all_needed[of_job]
    keys, of_job = keys[keep], of_job[keep]
    bare = np.flatnonzero(all_needed & (filled < total))  # an empty group may be all that two such texts share
    keys = np.concatenate([keys, common.mix(cls[bare].astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB))])
    row_of = np.concatenate([rows[of_job], rows[bare]])
    of_class = np.concatenate([cls[of_job], cls[bare]]).astype(np.uint64)
    keys = keys & ~np.uint64(CLASSES - 1) | of_class
    # all empty groups share one key
    spare = np.where(all_needed, total - spoiled - np.maximum(0, total - filled - 1), heavy - spoiled)
    order = np.argsort(row_of, kind="stable")
    return keys[order], np.searchsorted(row_of[order], np.arange(len(sizes) + 1)), (rows, cls, spare)


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes row by row, and per row the index of its first (+ total)."""
    data = common.lowered(data)
    starts, ends, word_at = common.word_spans(data, offsets, "nonspace")
    found, first = common.shingle_hashes(common.span_hashes(data, starts, ends), word_at, width)
    for a, b in zip(first[:-1], first[1:], strict=True):
        found[a:b].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[first[:-1][first[:-1] < len(found)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return found[new], kept[first]


def set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(hashes ^ np.uint64(0x8EBC6AF09C88C6E3)), dtype=np.uint64)])
    return common.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), _signed(values))


def _sized(width: int, classes: Classes):
    """Rows -> sizes and nodes; spares are packed as spare * CLASSES + class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.pieces(batches):
            found, first = distinct_shingles(data, offsets, width)
            of_row, cls, spare = group_keys(found, first, classes)[2]
            spares = pa.ListArray.from_arrays(pa.array(np.searchsorted(of_row, np.arange(rows.num_rows + 1)), pa.int32()), pa.array(np.maximum(spare, 0) * CLASSES + cls))
            yield pa.record_batch([rows.column(0), pa.array(np.diff(first)), _signed(set_ids(found, first)), rows.column(2), spares], names=["doc_id", "n_shingles", "node", "text_hash", "spares"])

    return run


def salted(keys: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A key of the same class for each frequent key and salt."""
    return common.mix(keys ^ common.mix(salts + np.uint64(1))) & ~np.uint64(CLASSES - 1) | keys & np.uint64(CLASSES - 1)


def _keyed(width: int, classes: Classes, shared=None):
    """Rows (text) -> (key, node); keys in the sorted array ``shared`` holds are salted by the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared.value if shared is not None else np.zeros(0, np.uint64)
        filed: set[int] = set()  # nodes of this task, which are as many as its texts at most
        for _, data, offsets in common.pieces(batches, 0):
            found, first = distinct_shingles(data, offsets, width)
            ids = set_ids(found, first).view(np.int64)
            fresh = np.zeros(len(ids), bool)
            for r, node in enumerate(ids.tolist()):
                if node not in filed:
                    filed.add(node)
                    fresh[r] = True
            # the sets of the fresh rows alone
            sizes = np.where(fresh, np.diff(first), 0)
            found = found[np.repeat(fresh, np.diff(first))]
            keys, at, _ = group_keys(found, np.concatenate([[0], np.cumsum(sizes)]), classes)
            nodes = np.repeat(ids, np.diff(at))
            if len(frequent):
                hot = frequent[np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)] == keys
                keys[hot] = salted(keys[hot], common.mix(nodes[hot].view(np.uint64)) % np.uint64(SALTS))
            yield pa.record_batch([_signed(keys), pa.array(nodes)], names=["key", "node"])

    return run


def frequent_keys(rows: DataFrame, width: int, classes: Classes) -> np.ndarray:
    """Keys that FREQUENT or more of one in AHEAD texts have: what is dealt out, which changes no result.  There are at
    most (keys of those texts) / FREQUENT of them."""
    some = rows.where(F.pmod(F.xxhash64(F.lit("ahead"), F.col("text")), F.lit(AHEAD)) == 0)
    found = common.in_arrow(some.select("text"), _keyed(width, classes), "key long, node long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT)
    with common.shuffles_dropped(rows.sparkSession):
        return np.sort(found.select("key").toArrow()["key"].to_numpy().view(np.uint64))


def _runs(shared=None):
    """Rows (key, node) sorted by both -> (leader, node, key) for every node of a run but its first; key is null in runs
    of two.  Of a frequent key's runs, ``shared`` holds the sorted salted keys and the key of each: their rows have that
    key, and the first node is a row without a leader.

    A node that several tasks filed stands in a run more than once; it is taken once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, whole = shared.value if shared is not None else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        open_key = open_leader = None  # a run of three or more that goes on
        held_k, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)  # a run of one or two that may go on
        last = None

        def out(leader, node, key, small, lone=None):
            if len(cut):
                at = np.minimum(np.searchsorted(cut, key), len(cut) - 1)
                hot = cut[at] == key
                key, small = np.where(hot, whole[at], key), small & ~hot
            return pa.record_batch([pa.array(leader, mask=lone), pa.array(node), pa.array(key, mask=small)], names=["leader", "node", "key"])

        def heads(key, node):
            """The first nodes of runs, where their key is a salted one."""
            if not len(cut):
                return
            hot = cut[np.minimum(np.searchsorted(cut, key), len(cut) - 1)] == key
            if hot.any():
                key, node = key[hot], node[hot]
                yield out(node, node, key, np.zeros(len(key), bool), np.ones(len(key), bool))

        def closed(k, n, final):
            """Runs of k but the last (all if ``final``)."""
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            starts = np.flatnonzero(new)
            size = np.diff(np.append(starts, len(k)))
            of = np.cumsum(new) - 1
            done = final | (of < len(starts) - 1)
            yield from heads(k[new & done], n[new & done])
            take = ~new & done
            if take.any():
                yield out(n[starts][of[take]], n[take], k[take], size[of[take]] < 3)

        for batch in batches:
            k, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            again = np.zeros(len(k), bool)
            again[1:] = (k[1:] == k[:-1]) & (n[1:] == n[:-1])
            if len(k) and last == (k[0], n[0]):
                again[0] = True
            if len(k):
                last = (k[-1], n[-1])
            k, n = k[~again], n[~again]
            if open_key is not None:
                more = int(np.searchsorted(k != open_key, True)) if len(k) else 0
                if more:
                    yield out(np.full(more, open_leader), n[:more], k[:more], np.zeros(more, bool))
                k, n = k[more:], n[more:]
                if not len(k):
                    continue
                open_key = None
            k, n = np.concatenate([held_k, k]), np.concatenate([held_n, n])
            if not len(k):
                continue
            yield from closed(k, n, False)
            at = int(np.searchsorted(k, k[-1]))
            held_k, held_n = k[at:], n[at:]
            if len(held_k) > 2:
                open_key, open_leader = held_k[0], held_n[0]
                yield from heads(held_k[:1], held_n[:1])
                yield out(np.full(len(held_k) - 1, open_leader), held_n[1:], held_k[1:], np.zeros(len(held_k) - 1, bool))
                held_k, held_n = held_k[:0], held_n[:0]
        if len(held_k):
            yield from closed(held_k, held_n, True)

    return run


def runs_of(rows: DataFrame, width: int, classes: Classes, scratch: common.Scratch) -> DataFrame:
    """(leader, node, key) of all runs, those of frequent keys merged."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frequent = frequent_keys(rows, width, classes)
    keys = cuts = None
    if len(frequent):
        every = salted(np.repeat(frequent, SALTS), np.tile(np.arange(SALTS, dtype=np.uint64), len(frequent))).view(np.int64)
        order = np.argsort(every)
        keys, cuts = spark.sparkContext.broadcast(frequent), spark.sparkContext.broadcast((every[order], np.repeat(frequent, SALTS).view(np.int64)[order]))
    met = common.in_arrow(rows.select("text"), _keyed(width, classes, keys), "key long, node long").repartition(parts, "key").sortWithinPartitions("key", "node")
    runs = scratch.keep(common.in_arrow(met, _runs(cuts), "leader long, node long, key long"), "runs")
    if keys is None:
        return runs
    keys.unpersist()
    cuts.unpersist()
    heads = runs.where("leader is null")
    first = heads.groupBy("key").agg(F.min("node").alias("leader"))
    merged = heads.drop("leader").join(first, "key").where("node <> leader").select("leader", "node", "key")
    return runs.where("leader is not null").unionByName(scratch.keep(merged, "heads"))


# ------------------------------------------------------------------ verification


#: Set members per coordinate, at most, of the vectors that screen pairs and of those in the R-tree.  Shingles that
#: differ seldom fall together in the latter, so the bound tells apart texts that are only nearly similar enough.
COARSE, FINE = 6, 2


def coordinates_for(size: int, members: int) -> int:
    """Coordinates of the vector of a set of this size: a power of two."""
    return max(COORDINATES, 1 << max(0, -(-size // members) - 1).bit_length())


def count_vector(hashes: np.ndarray, members: int) -> np.ndarray:
    n = coordinates_for(len(hashes), members)
    return np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (n - 1), minlength=n)


def _sets(width: int, members: int):
    """Rows (identifier, text, wanted node) -> the node's set, sorted, or (``members`` > 0) its count vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in common.pieces(batches):
            found, first = distinct_shingles(data, offsets, width)
            if members:
                each = [count_vector(found[a:b], members) for a, b in zip(first[:-1], first[1:], strict=True)]
                values = pa.array(np.concatenate(each).astype(np.int16))
                column = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in each])]), pa.int32()), values)
            else:
                column = _lists(found, first)
            nodes = set_ids(found, first).view(np.int64)
            yield pa.record_batch([pa.array(nodes), column], names=["node", "found"]).filter(pa.array(nodes == rows.column(2).to_numpy()))

    return run


def _list_rows(column: pa.Array) -> list[np.ndarray]:
    at, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def _found(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int, members: int, scratch: common.Scratch) -> DataFrame:
    """(node, found): sets (or count vectors, with ``members``) of the nodes in ``wanted``, each from one of its texts.

    The list of those texts is broadcast while it is at most BROADCAST_ROWS rows; beyond that it is an ordinary join."""
    ids = scratch.keep(wanted.select("node").distinct().join(nodes, "node"), "wanted")
    n = ids.count()
    met = docs.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, ["doc_id", "text_hash"]).select("doc_id", "text", "node")
    out = scratch.keep(common.in_arrow(met, _sets(width, members), f"node long, found array<{'short' if members else 'long'}>"), "found")
    scratch.drop(ids)
    if out.count() > n:  # repeated rows
        once = scratch.keep(out.dropDuplicates(["node"]), "found")
        scratch.drop(out)
        return once
    return out


def _cells(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) as cells (a, salt) of at most some CELL members: first a's own row, then those of its partners."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    lead = cells.select("a", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("salt"), F.lit(0).alias("place"), F.col("a").alias("node"))
    rest = pairs.join(cells, "a").select("a", F.pmod(F.xxhash64("b"), F.col("cells")).cast("int").alias("salt"), F.lit(1).alias("place"), F.col("b").alias("node"))
    rows = lead.unionByName(rest).join(found, "node").select("a", "salt", "place", "node", "found")
    return rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "place")


def _of_leaders(percent: int, exact: bool):
    """Rows of ``_cells`` -> the pairs (a, b) that an R-tree over a cell's count vectors leaves, or (``exact``) whose sets are similar enough."""

    def within_sets(lead: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        lead = lead.view(np.uint64)
        ok = np.zeros(len(others), bool)
        for k, other in enumerate(others):
            at = np.searchsorted(lead, other.view(np.uint64))
            both = int((lead[np.minimum(at, len(lead) - 1)] == other.view(np.uint64)).sum())
            ok[k] = (100 + percent) * both >= percent * (len(lead) + len(other))
        return ok

    def within_vectors(lead: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        ok, length = np.zeros(len(others), bool), np.minimum([len(v) for v in others], len(lead))
        for n in np.unique(length).tolist():  # vectors of one length at a time, folded to that of the shorter side
            mine = np.flatnonzero(length == n)
            tree = CountTree(np.stack([others[k].reshape(-1, n).sum(0, dtype=np.int32) for k in mine]))
            ok[mine[tree.query(lead.reshape(-1, n).sum(0, dtype=np.int32), percent)]] = True
        return ok

    within = within_sets if exact else within_vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = lead = None
        for batch in batches:
            a, salt, place, node = (batch.column(c).to_numpy() for c in range(4))
            found = _list_rows(batch.column(4))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])
            starts = np.flatnonzero(new)
            left, right = [], []
            for x, y in zip(starts, np.append(starts[1:], len(a)), strict=True):
                if (a[x], salt[x]) != cell:
                    cell, lead, x = (a[x], salt[x]), found[x].copy(), x + 1
                if x < y:
                    ok = np.flatnonzero(within(lead, found[x:y])) + x
                    left.append(a[ok])
                    right.append(node[ok])
            if left:
                yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def screened(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """The pairs that the R-trees of their cells leave, by coarse vectors."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    vectors = _found(docs, nodes, both, width, COARSE, scratch)
    out = scratch.keep(common.in_arrow(_cells(pairs, vectors), _of_leaders(percent, False), "a long, b long"), "screened")
    scratch.drop(vectors)
    return out


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """The (a, b) of ``pairs`` (distinct) whose sets are similar enough."""
    both = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    sets = _found(docs, nodes, both, width, 0, scratch)
    out = scratch.keep(common.in_arrow(_cells(pairs, sets), _of_leaders(percent, True), "a long, b long"), "links")
    scratch.drop(sets)
    return out


# ------------------------------------------------------------------ the R-tree


class CountTree:
    """R-tree over count vectors, bulk-loaded in order of size: a node keeps the coordinate maxima and the least size below it."""

    def __init__(self, vectors: np.ndarray):
        sizes = vectors.sum(1, dtype=np.int64)
        self.order = np.lexsort((vectors[:, 0], sizes))
        level, least = vectors[self.order], sizes[self.order]
        self.levels = [(level, least)]
        while len(level) > LEAF:
            cuts = np.arange(0, len(level), LEAF)
            level, least = np.maximum.reduceat(level, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((level, least))

    def query(self, vector: np.ndarray, percent: int) -> np.ndarray:
        """Indices of the points whose summed minima with ``vector`` allow the threshold."""
        size = int(vector.sum(dtype=np.int64))
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            level, least = self.levels[depth]
            bound = np.minimum(level[at], vector).sum(1, dtype=np.int64)
            at = at[(100 + percent) * bound >= percent * (size + least[at])]
            if depth:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def forest(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs x-y, taken in their order, join components that were apart (given by ``root``) until then."""
    _, start = np.unique(root, return_inverse=True)
    parent = list(range(start.max() + 1))
    left, kept = len(parent) - 1, []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (a, b) in enumerate(zip(start[x].tolist(), start[y].tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            parent[a] = b
            kept.append(k)
            left -= 1
            if not left:
                break
    return np.array(kept, np.int64)


def _search(percent: int, what: str):
    """Sorted rows (key, i, j, salt, node, root, skip, counts) -> candidate pairs (a, b) of different roots, not both of which
    skip, within each (key, i, j): ``all`` of them, or only those that ``join`` the block's components; or (key, node) of the nodes that are ``near`` any."""

    def folded(counts: list[np.ndarray]) -> np.ndarray:
        """Vectors of one block with the coordinates of the shortest: the counts of coordinates that fall together add up."""
        n = min(len(c) for c in counts)
        return np.stack([c.reshape(-1, n).sum(0, dtype=np.int16) for c in counts])

    def pairs_of(key, i, j, salt, node, root, skip, counts):
        if root.min() == root.max() or skip.all():
            return None
        vectors = folded(counts)
        sizes = vectors.sum(1, dtype=np.int64)
        a, b, slack = [], [], []

        def between(left, right):
            """Candidates of each of ``left`` among ``right``."""
            if not len(left) or not len(right):
                return
            tree = CountTree(vectors[right])
            for x in left:
                y = right[tree.query(vectors[x], percent)]
                y = y[root[y] != root[x]]
                if i == j:  # a pair of two that do not skip is found from both sides
                    y = y[skip[y] | (node[y] > node[x])]
                if len(y):
                    a.append(np.full(len(y), x))
                    b.append(y)
                    if what == "join":
                        slack.append(np.minimum(vectors[y], vectors[x]).sum(1, dtype=np.int64) / (sizes[y] + sizes[x]))

        if i == j:
            between(np.flatnonzero(~skip), np.arange(len(node)))
        else:
            left, right = np.flatnonzero(salt == i), np.flatnonzero(salt == j)
            between(left[~skip[left]], right)
            between(left[skip[left]], right[~skip[right]])
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        if what == "join":
            order = np.argsort(-np.concatenate(slack), kind="stable")
            order = order[forest(root, a[order], b[order])]
            a, b = a[order], b[order]
        if what == "near":
            found = np.unique(np.concatenate([node[a], node[b]]))
            return np.full(len(found), key), found
        return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        out_a, out_b, waiting = [], [], 0

        def emit(group):
            nonlocal waiting
            got = pairs_of(group[0][0], group[1][0], group[2][0], *group[3:])
            if got is not None and len(got[0]):
                out_a.append(got[0])
                out_b.append(got[1])
                waiting += len(got[0])

        def flush():
            nonlocal waiting
            ab = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], 1), axis=0)
            out_a.clear()
            out_b.clear()
            waiting = 0
            return pa.record_batch([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)]
            counts = np.empty(batch.num_rows, object)
            counts[:] = _list_rows(batch.column(7))
            columns.append(counts)
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            k, i, j = columns[:3]
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            starts = np.flatnonzero(new)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                emit([c[a:b] for c in columns])
                if waiting > 200_000:
                    yield flush()
            held = [c[starts[-1] :] for c in columns] if len(starts) else held
        if held is not None and len(held[0]):
            emit(held)
        if waiting:
            yield flush()

    return run


# ------------------------------------------------------------------ the join


def link(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id; then text_hash (xxhash64 of the text) and group (a key of the
    component: null where n_shingles is 0 or the identifier is null).  The result is a written table."""
    with common.Scratch(docs.sparkSession, "jaccard") as scratch:
        return common.written(_linked(docs, width, percent, id_col, text_col, scratch), "jaccard-groups")


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, scratch: common.Scratch) -> DataFrame:
    classes = Classes(percent)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sized = scratch.keep(common.in_arrow(rows, _sized(width, classes), "doc_id long, n_shingles long, node long, text_hash long, spares array<long>"), "sizes")
    # 1. equal sets are one node
    nodes = sized.where("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    nodes = scratch.keep(nodes.select("node", "least.doc_id", "least.text_hash"), "nodes")
    # 2. runs of nodes that share a key; each node in the cell of the first of its run
    runs = runs_of(rows.where("doc_id is not null"), width, classes, scratch)
    # 3. verified pairs with the first nodes, and their components
    pairs = scratch.keep(runs.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "stars")
    left = screened(rows, nodes, pairs, width, percent, scratch)
    scratch.drop(pairs)
    stars = verified(rows, nodes, left, width, percent, scratch)
    scratch.drop(left)
    # 4. what is left between components of one run
    roots = _rest(rows, sized, nodes, runs, stars, width, percent, scratch)
    # components are named by the least identifier of their nodes
    named = nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = named.select("node", "root").join(least, "root").select("node", "component_id", F.col("root").alias("group"))
    linkable = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    linked = sized.where(linkable).join(of_node, "node").select("doc_id", "n_shingles", "component_id", "text_hash", "group")
    alone = sized.where(~linkable).select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id"), "text_hash", F.lit(None).cast("long").alias("group"))
    return linked.unionByName(alone)


def _match(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_anti") -> DataFrame:
    """Semi or anti join whose key side is broadcast while it is at most BROADCAST_ROWS rows."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one stays of each component: that with the least identifier (of
    repeated ones, any).  Rows without words or without an identifier stay."""
    linked = link(docs, width, percent, id_col, text_col)
    inner = linked.where("group is not null")
    mark, own = "_text_hash_of_keep_one", "_identifier_of_keep_one"
    marked = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string"))).withColumn(own, F.col(id_col).cast("long"))
    key = lambda df: df.select(F.col("doc_id").alias(own), F.col("text_hash").alias(mark))
    out = _match(marked, key(inner.where("doc_id <> component_id")).distinct(), [own, mark])
    first = inner.where("doc_id = component_id")
    repeated = common.written(first.join(first.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "group", "left_semi"), "jaccard-repeated")
    if not repeated.isEmpty():
        again = repeated.select(F.col("doc_id").alias(own), F.col("text_hash").alias(mark), F.col("group").alias("_group_of_keep_one")).distinct()
        once = out.join(again, [own, mark]).dropDuplicates(["_group_of_keep_one"]).drop("_group_of_keep_one")
        out = _match(out, key(repeated).distinct(), [own, mark]).unionByName(once)
    return out.drop(mark, own)


def _rest(rows: DataFrame, sized: DataFrame, nodes: DataFrame, runs: DataFrame, links: DataFrame, width: int, percent: int, scratch: common.Scratch) -> DataFrame:
    """Components of ``links`` and of the links between different components inside runs of three or more nodes."""
    roots = components(links, scratch)
    large = runs.where("key is not null")
    rooted = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lead = roots.select(F.col("node").alias("leader"), F.col("root").alias("lead_root"))
    mixed = rooted.join(lead, "leader", "left").where(F.col("root") != F.coalesce("lead_root", "leader")).select("key").distinct()
    mixed = scratch.keep(mixed, "mixed")
    if mixed.isEmpty():
        return roots
    members = large.join(mixed, "key", "left_semi")
    members = scratch.keep(members.select("key", "node").unionByName(members.select("key", F.col("leader").alias("node"))).distinct(), "members")
    # nodes that may leave out long runs
    hot = large.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT_RUN - 1).select("key", F.lit(True).alias("hot"))
    hot = scratch.keep(hot, "long")
    in_hot = large.join(hot, "key")
    in_hot = in_hot.select("key", "node").unionByName(in_hot.select("key", F.col("leader").alias("node"))).distinct()
    of_class = F.pmod(F.col("key"), F.lit(CLASSES)).alias("cls")
    held = in_hot.groupBy("node", of_class).agg(F.count(F.lit(1)).alias("held"))
    spares = sized.where("n_shingles > 0").select("node", F.explode("spares").alias("s")).distinct().select("node", F.pmod(F.col("s"), F.lit(CLASSES)).alias("cls"), F.floor(F.col("s") / CLASSES).alias("spare"))
    skips = held.join(spares, ["node", "cls"]).where("held < spare").select("node", "cls", F.lit(True).alias("may"))
    flagged = members.join(hot, "key", "left").withColumn("cls", of_class).join(skips, ["node", "cls"], "left")
    flagged = scratch.keep(flagged.select("key", "node", F.coalesce(F.col("hot") & F.col("may"), F.lit(False)).alias("skip")), "flagged")
    scratch.drop(members, mixed)
    # runs of the same nodes would give the same pairs: one of them is searched
    same = flagged.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node", "skip").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", "skip", F.lit(1))).alias("x"))
    apart = scratch.keep(flagged.join(same.groupBy("n", "s", "x").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"), "runs-apart")
    scratch.drop(flagged)
    near = _searched(rows, nodes, apart, roots, width, percent, "near", scratch)
    members = scratch.keep(apart.join(near.select(F.col("a").alias("key"), F.col("b").alias("node")), ["key", "node"]), "near")
    scratch.drop(apart, near)
    for what in ("join", "all"):
        found = _searched(rows, nodes, members, roots, width, percent, what, scratch)
        if not found.isEmpty():
            links = links.unionByName(verified(rows, nodes, found, width, percent, scratch))
            roots = components(links, scratch)
        scratch.drop(found)
    return roots


def _searched(rows: DataFrame, nodes: DataFrame, members: DataFrame, roots: DataFrame, width: int, percent: int, what: str, scratch: common.Scratch) -> DataFrame:
    """The search (distinct a, b) of the runs in ``members`` (key, node, skip) that hold more than one root."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    now = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), "skip")
    cells = now.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"), F.min("root").alias("least"), F.max("root").alias("most"), F.min("skip").alias("all_skip")).where("least < most and not all_skip")
    live = scratch.keep(now.join(cells.select("key", "cells"), "key"), "blocks")
    vectors = _found(rows, nodes, live, width, COARSE if what == "near" else FINE, scratch).withColumnRenamed("found", "counts")
    cut = live.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    cut = cut.select("key", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"), "salt", "node", "root", "skip").join(vectors, "node")
    ordered = cut.select("key", "i", "j", "salt", "node", "root", "skip", "counts").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = scratch.keep(common.in_arrow(ordered, _search(percent, what), "a long, b long").distinct(), what)
    scratch.drop(live)
    return found
