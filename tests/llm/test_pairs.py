"""Joins and components against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import common, jaccard, neighbours
from shardloom.llm.components import components

from .test_text import ODD, frame, words_of
from .test_text import NONSPACE as WORDS


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none", "loops"])
def test_components(spark, shape):
    rng = random.Random(7)
    links = {
        "chain": [(i, i + 1) for i in range(120)],
        "star": [(500, i) for i in range(200)],
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)],
        "none": [],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
    }[shape]
    with common.Scratch(spark, "components") as scratch:
        got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3), (5, None)], "a long, b long"), scratch).collect()}
    want = roots({x for e in links for x in e}, links)
    assert got == {n: r for n, r in want.items() if n != r}


def test_components_never_gives_unfinished_ones(spark):
    with common.Scratch(spark, "components") as scratch, pytest.raises(RuntimeError, match="not finished"):
        components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"), scratch, max_rounds=2)


# ------------------------------------------------------------------ n-gram Jaccard


def shingles(text, width):
    w = words_of(text, WORDS)
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_force(texts, width, percent):
    sets = [shingles(t, width) for t in texts]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j]:
                both = len(a & sets[j])
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    links.append((j, i))
    return sets, roots(range(len(texts)), links), links


def family(rng, words, copies, edits):
    """A text and copies of it with a few words changed, dropped or added."""
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randrange(edits + 1)):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(2)] = [rng.choice("uvwxyz")] * rng.randrange(3)
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "in"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}"
    text = lambda n: [word() for _ in range(n)]
    passage = text(60)
    out = [" ".join(text(rng.randrange(1, 200))) for _ in range(40)]
    out += [" ".join(text(rng.randrange(5, 60)) + passage + text(rng.randrange(5, 60))) for _ in range(40)]
    for _ in range(6):
        out += family(rng, text(rng.choice([8, 20, 60, 150, 400])), rng.randrange(2, 12), 4)
    out += family(rng, text(120), 60, 6)  # a large family whose members often do not link directly
    out += [" ".join(text(50))] * 25
    # a chain: each text links the next only
    base = text(200)
    for k in range(0, 60, 4):
        out.append(" ".join(base[:k] + [f"z{i}" for i in range(k, k + 4)] + base[k + 4 :]))
    out += ["A b C d", "a B c D", "a  b\tc\nd", "one", "One", "", None, "two words"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 4, 85), (2, 5, 80)])
def test_jaccard_join(spark, seed, width, percent):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets, want, links = brute_force(texts, width, percent)
    assert len(links) > 200
    got = {r.doc_id: r for r in jaccard.link(docs, width, percent).collect()}
    assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == {i: (len(s), want[i]) for i, s in enumerate(sets)}
    kept = sorted(r.doc_id for r in jaccard.keep_one(docs, width, percent).collect())
    assert kept == sorted(i for i in range(len(texts)) if want[i] == i)


def test_jaccard_small_cells(spark, monkeypatch):
    """Large runs as pairs of sub-blocks."""
    monkeypatch.setattr(jaccard, "CELL", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)  # no broadcast at all
    monkeypatch.setattr(jaccard, "HOT_RUN", 4)  # and most runs are long ones
    texts = corpus(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_force(texts, 4, 85)[1]
    assert {r.doc_id: r.component_id for r in jaccard.link(docs, 4, 85).collect()} == want


def test_jaccard_frequent_keys_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "AHEAD", 2)
    monkeypatch.setattr(jaccard, "FREQUENT", 2)  # many keys are frequent ones
    monkeypatch.setattr(jaccard, "SALTS", 3)
    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = docs.where("doc_id is not null")
    assert len(jaccard.frequent_keys(rows, 4, jaccard.Classes(85))) > 50
    want = brute_force(texts, 4, 85)[1]
    assert {r.doc_id: r.component_id for r in jaccard.link(docs, 4, 85).collect()} == want


def test_jaccard_leaves_no_tables_but_its_result(spark):
    import glob

    at = common.work_dir(spark).removeprefix("file://") + "/llm/jaccard*"
    before = set(glob.glob(at))
    assert jaccard.link(spark.createDataFrame(list(enumerate(corpus(6))), "doc_id long, text string"), 4, 85).count()
    (left,) = set(glob.glob(at)) - before
    assert "jaccard-groups" in left


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    classes = jaccard.Classes(percent)
    for _ in range(200):
        n = int(rng.choice([3, 10, 30, 100, 400, 3000]))
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        a = np.sort(pool[:n])
        spoil = int(rng.integers(0, 2 * n * (100 - percent) // (100 + percent) + 1))
        out = int(rng.integers(0, spoil + 1))
        b = np.sort(np.concatenate([rng.permutation(a)[out:], pool[n : n + spoil - out]]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        keys, at, _ = jaccard.group_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), classes)
        assert set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


def test_bare_groups_are_keys_when_needed():
    """Sets small enough to leave most groups empty still meet."""
    classes = jaccard.Classes(50)
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(2, 12))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.append(a[:-1], rng.integers(0, 2**63, 1, dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 50 * (len(a) + len(b) - both):
            keys, at, _ = jaccard.group_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), classes)
            assert set(keys[: at[1]].tolist()) & set(keys[at[1] :].tolist())


def test_runs_over_batch_borders():
    rng = np.random.default_rng(9)
    for size in (1, 2, 3, 7, 1000):
        key = np.sort(rng.integers(0, 25, 120)).astype(np.int64)
        node = rng.integers(0, 30, 120).astype(np.int64)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        batches = [pa.record_batch([pa.array(key[i : i + size]), pa.array(node[i : i + size])], names=["key", "node"]) for i in range(0, 120, size)]
        got = [t for b in jaccard._runs()(iter(batches)) for t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
        want = []
        for k in np.unique(key):
            run = sorted(set(node[key == k].tolist()))
            want += [(run[0], n, int(k) if len(run) > 2 else None) for n in run[1:]]
        show = lambda rows: sorted(map(str, rows))
        assert show(got) == show(want)


def test_count_tree_finds_all_within_the_bound():
    rng = np.random.default_rng(10)
    points = rng.poisson(rng.integers(1, 6, (300, 1)), (300, 64))
    tree = jaccard.CountTree(points)
    for q in points[::17]:
        both = np.minimum(points, q).sum(1)
        want = np.flatnonzero(180 * both >= 80 * (points.sum(1) + q.sum()))
        assert sorted(tree.query(q, 80).tolist()) == want.tolist()
    assert jaccard.CountTree(points[:1]).query(points[0], 80).tolist() == [0]


def test_jaccard_odd_rows(spark):
    docs = frame(spark, [*ODD, *ODD, "same text of five words", "Same text OF five words"])
    got = jaccard.link(docs, 5, 80).collect()
    assert len(got) == docs.count()
    assert all(r.component_id == r.doc_id for r in got if r.n_shingles == 0)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(r.doc_id for r in rows if r.doc_id is None)[None] == docs.where("doc_id is null").count()
    seen = Counter(" ".join(words_of(r.text, WORDS)) for r in rows if r.doc_id is not None and words_of(r.text, WORDS))
    assert max(seen.values()) == 1
    assert jaccard.link(docs.limit(0)).collect() == [] == jaccard.keep_one(docs.limit(0)).collect()


def test_repeated_identifiers(spark):
    texts = ["the same old text here", "the same old text here", "something else all together now", "The Same old text here"]
    docs = spark.createDataFrame([(5, texts[0]), (5, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[0])], "doc_id long, text string")
    rows = jaccard.keep_one(docs, 2, 80).collect()
    assert sorted(r.text.lower() for r in rows) == sorted({t.lower() for t in texts}) and {r.doc_id for r in rows} == {5}


def test_partners_two_size_classes_away_are_linked(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words[:7]), " ".join(words[:13]), " ".join(words[20:40]), " ".join(words[20:58])]
    got = {r.doc_id: r for r in jaccard.link(frame(spark, texts), width=1, percent=50).collect()}
    assert [got[i].component_id for i in sorted(got)] == [min(got), min(got), sorted(got)[2], sorted(got)[2]]


# ------------------------------------------------------------------ embeddings


def cosines(vectors, labels):
    links = []
    for i in range(len(vectors)):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if a is None or b is None or labels[i] is None or labels[i] != labels[j] or len(a) != len(b):
                continue
            a, b = np.array(a, float), np.array(b, float)
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any() and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                links.append((j, i))
    return links


@pytest.mark.parametrize("cell", [4, 1024])
def test_embeddings_recall_and_precision(spark, monkeypatch, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(60, 64))
    vectors = [v for v in base]
    for v in base[:30]:  # partners near the threshold
        for cos in (0.9, 0.935, 0.95, 0.99):
            u = v / np.linalg.norm(v)
            w = rng.normal(size=64)
            w -= (w @ u) * u
            vectors.append(cos * u + np.sqrt(1 - cos**2) * w / np.linalg.norm(w))
    vectors += [base[0]] * 12 + [base[0] * 2] * 3
    labels = [int(i % 2) if i < 60 else int(rng.integers(0, 2)) for i in range(len(vectors))]
    labels[60:180] = [int((k // 4) % 2) for k in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v], y) for i, (v, y) in enumerate(zip(vectors, labels, strict=True))]
    got = {r.vec_id: r for r in neighbours.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()}
    links = cosines([r[1] for r in rows], labels)
    degree = Counter(x for e in links for x in e)
    found = sum(got[i].n_links for i in got)
    assert found <= 2 * len(links) and found >= 0.97 * 2 * len(links)
    assert all(got[i].n_links <= degree[i] for i in got)
    want = roots(got, links)
    assert sum(got[i].component_id == want[i] for i in got) / len(got) > 0.97
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 2.0, 3.0]
    rows = [(0, one, 1), (1, one, 1), (2, [2.0, 4.0, 6.0], 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, nan, 1.0], 1), (9, [1.0, inf, 1.0], 1), (10, [1.0, None, 3.0], 1), (None, one, 1), (11, [1.0, 2.0], 1), (12, [-1.0, -2.0, -3.0], 1), (13, [1e30, 2e30, 3e30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neighbours.link(df).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 13):
        assert got[i] == (3, 0, i == 0)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, True)
    assert neighbours.link(df.limit(0)).collect() == []
    assert {r.n_links for r in neighbours.link(df.where("vec_id > 4 and vec_id < 11")).collect()} == {0}
    twice = neighbours.link(df.where("vec_id < 2").union(df.where("vec_id < 2"))).collect()
    assert len(twice) == 4 and {r.n_links for r in twice} == {3}


def test_embeddings_of_every_length_link(spark):
    rng = np.random.default_rng(13)
    rows, near = [], 0.05
    for dim, n in ((64, 40), (48, 20), (2, 6), (1, 3)):
        base = rng.normal(size=(n, dim))
        for v in [*base, base[0], base[1] + near * rng.normal(size=dim) * np.linalg.norm(base[1]) / np.sqrt(dim)]:
            rows.append((len(rows), [float(np.float32(x)) for x in v], 0))
    found = [e for d in {len(r[1]) for r in rows} for e in ((a[0], b[0]) for a in rows for b in rows if len(a[1]) == len(b[1]) == d and a[0] < b[0]) if _cosine(rows, *e) >= 0.93]
    degree = Counter(x for e in found for x in e)
    assert all(any(len(rows[a][1]) == d for a, _ in found) for d in (64, 48, 2, 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r for r in neighbours.link(df).collect()}
    assert {i: got[i].n_links for i in got} == {i: degree[i] for i in got}
    assert {i: got[i].component_id for i in got} == roots(got, found)


@pytest.mark.parametrize("dim", [64, 128])
@pytest.mark.parametrize("hashes", [2, 3, 4, 5])
def test_recall_at_the_threshold_stays_level(hashes, dim):
    rng = np.random.default_rng(14)
    a, w = rng.normal(size=(2, 2000, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    w -= (w * a).sum(1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    h = neighbours.Hasher(dim, neighbours.tables_for(hashes), hashes, 8)
    x, y = h.codes(a), h.codes(b)
    met = ((y[:, :, :1] == x).any(2) | (x[:, :, :1] == y).any(2)).any(1)
    assert met.mean() > 0.99
    print("recall", dim, hashes, h.tables, met.mean())


def _cosine(rows, a, b):
    a, b = np.array(rows[a][1]), np.array(rows[b][1])
    return a @ b / np.linalg.norm(a) / np.linalg.norm(b)


def test_rotations_keep_lengths_and_codes_repeat():
    h = neighbours.Hasher(50, 3, 2, 4)
    v = np.random.default_rng(12).normal(size=(20, 50))
    x = np.zeros((20, 64), np.float32)
    x[:, :50] = v
    assert np.linalg.norm(h._rotated(x, h.signs[0, 0]), axis=1) == pytest.approx(np.linalg.norm(v, axis=1), rel=1e-4)
    codes = h.codes(v)
    assert (codes == neighbours.Hasher(50, 3, 2, 4).codes(v)).all()
    assert all(len(set(c)) == 5 for row in codes for c in row)


def test_work_dir_is_the_configured_one(spark):
    assert common.work_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
