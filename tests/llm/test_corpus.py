"""Token shards, mixing, URL filters, the registered queries with SQL, and the pipeline."""

import math
import random
import warnings
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shardloom.llm import common, decontaminate, jaccard, mixing, tokens, urls
from shardloom.llm import entry as queries

from ..test_queries import TABLES
from .test_models import plain_bits, plain_counts
from .test_pairs import brute_force, corpus
from .test_text import ODD, frame, leaks

VOCABULARY = queries.vocabulary_path()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(13)
    alphabet = [" ", "  ", "\n", "\n\n", "\t", ".", ",", "!", "a", "the", "é", " ", " ", "　", "—", "22", "½", "'s", "日本", "😀", "\x85", "_", "\0", "<|endoftext|>", "́", "\r\n", ".."]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(14))) for _ in range(4000)]
    encoder = tokens.Encoder(VOCABULARY)
    for at in range(0, len(texts), 500):
        for t, got in zip(texts[at : at + 500], encoder.batch(texts[at : at + 500], 2), strict=True):
            assert np.frombuffer(got, encoder.kind).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_encoder_forgets(monkeypatch, tokenizer):
    monkeypatch.setattr(tokens, "MOST_PIECES", 50)
    monkeypatch.setattr(tokens, "MOST_NEW", 8)
    encoder, most = tokens.Encoder(VOCABULARY), 0
    for k in [0, 1, 1, 2, 0, 3, 4]:
        text = " ".join(f"w{k}{i}" for i in range(20))
        assert np.frombuffer(encoder.batch([text], 2)[0], encoder.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        most = max(most, len(encoder.pieces))
    assert most <= 50 + 20 and len(encoder.pieces.main[0])


def test_pieces_that_share_a_hash_are_no_error(monkeypatch, tokenizer):
    real = tokens.Encoder._hashes
    monkeypatch.setattr(tokens.Encoder, "_hashes", lambda self, *a: (real(self, *a)[0] % np.uint64(7), real(self, *a)[1]))
    encoder = tokens.Encoder(VOCABULARY)
    for text in ("one", "some words of a text that clash", "one two"):
        assert np.frombuffer(encoder.batch([text], 2)[0], encoder.kind).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_vocabularies_that_rewrite_texts_take_them_whole(tmp_path):
    import json

    import public_tokenizers

    assert tokens.can_cut(VOCABULARY)
    other = public_tokenizers.path("word_bpe_49k.json")
    assert not tokens.can_cut(other)
    library, encoder = Tokenizer.from_file(other), tokens.Encoder(other)
    for text in ("Some  TEXT, with\nlines. And é", "", "a . b"):
        assert np.frombuffer(encoder.batch([text], 2)[0], encoder.kind).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    made = json.load(open(VOCABULARY))
    for content in ("a b", " a", "x.\ny", "end.", ""):
        changed = {**made, "added_tokens": [{"id": 1, "content": content, "lstrip": False, "rstrip": False, "single_word": False}]}
        (tmp_path / "v.json").write_text(json.dumps(changed))
        assert not tokens.can_cut(str(tmp_path / "v.json")), content


def test_number_of_shards():
    mb, gb = 1 << 20, 1 << 30
    assert [tokens.shard_count(n, 6) for n in (0, mb, 5 * mb, 500 * mb, 100 * gb)] == [1, 1, 3, 6, 400]


@pytest.mark.parametrize("least", [300, 16 << 20])
def test_shards_round_trip(spark, monkeypatch, tokenizer, least):
    monkeypatch.setattr(tokens, "SHARD_BYTES", least)
    monkeypatch.setattr(tokens, "LEAST_SHARD", least)
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 200)
    monkeypatch.setattr(tokens, "BAND", 3)
    rng = random.Random(14)
    ids = rng.sample(range(-(10**12), 10**12), 60) + [0, -1, 2**63 - 1, -(2**63), 7, 7]
    texts = [" ".join(rng.choice(["one", "two", "the", "\n", "é"]) for _ in range(rng.randrange(40))) for _ in ids]
    texts[:3] = [None, "", " "]
    rows = [*zip(ids, texts, strict=True), (None, "no name")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).repartition(3)
    manifest = tokens.write_shards(docs, VOCABULARY, 2).collect()
    assert (len(manifest) > 5) == (least == 300)
    got = sorted(tokens.read_shards(spark.createDataFrame(manifest, tokens.MANIFEST + ", start long")).collect(), key=lambda r: r["at"])
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    show = lambda rows: sorted(map(str, rows))
    assert show((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == show((i, len(encode(t)), crc(encode(t))) for i, t in rows)
    assert [r["at"] for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert sum(m.n_tokens for m in manifest) == sum(r.n_tokens for r in got)
    # look-ups
    shards = [tokens.Shard(m.path) for m in sorted(manifest, key=lambda m: m.shard)]
    find = lambda i: [x.tolist() for s in shards for x in s.get(i)]
    for i, t in rows:
        assert encode(t) in find(i)
    assert len(find(7)) == 2 and find(12345678901234567) == []
    assert [k for s in shards for k, _ in s] == sorted(tokens.key_of(i) for i, _ in rows)
    assert sum(s.may_hold(10**15 + k) for s in shards for k in range(300)) < 0.1 * 300 * len(shards)


def test_shards_of_nothing_and_damage(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.read_shards(tokens.write_shards(empty, VOCABULARY, 2)).collect() == []
    (m,) = tokens.write_shards(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), VOCABULARY, 2, folder=f"file://{tmp_path}/s").collect()
    path = m.path.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[3] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError, match="checksum"):
        list(tokens.Shard(m.path))
    open(path, "wb").write(raw[:-1] + b"?")
    with pytest.raises(ValueError, match="no token shard"):
        tokens.Shard(m.path)


# ------------------------------------------------------------------ mixing


def rake(cells, goals, rounds):
    total = sum(cells.values())
    w = {k: v / total for k, v in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            share = defaultdict(float)
            for k, v in w.items():
                share[k[d]] += v
            w = {k: v * goals[d][k[d]] / share[k[d]] for k, v in w.items()}
    total = sum(w.values())
    return {k: v / total for k, v in w.items()}


def test_raking_and_calibration(spark):
    rng = random.Random(15)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): rng.randrange(1, 5000) for a in range(5) for b in range(3) for c in range(2)}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    goals = [{f"s{a}": 0.2 for a in range(5)}, {"l0": 0.5, "l1": 0.3, "l2": 0.2}, {"t0": 0.9, "t1": 0.1}]
    raked = mixing.rake(df, dict(zip(mixing.DIMENSIONS, goals, strict=True)), 12)
    got = {(r.source, r.lang, r.topic): r for r in mixing.calibrate(raked, 0.4).collect()}
    want = rake(cells, goals, 12)
    for k, v in want.items():
        assert got[k].weight == pytest.approx(v, rel=1e-9)
    for d in range(3):
        for name, goal in goals[d].items():
            assert sum(r.weight for k, r in got.items() if k[d] == name) == pytest.approx(goal, abs=2e-3)
    assert sum(cells[k] * r.probability for k, r in got.items()) == pytest.approx(0.4 * sum(cells.values()), rel=1e-9)
    scale = {round(r.probability * cells[k] / r.weight, 3) for k, r in got.items() if r.probability < 1}
    assert len(scale) == 1  # below one, in proportion to weight over tokens
    assert [r.probability for r in mixing.calibrate(raked, 1.0).collect()] == pytest.approx([1.0] * len(cells))


def test_mixing_odd_rows(spark):
    docs = frame(spark, [*ODD, *ODD])
    got = mixing.mix(docs, carry=tuple(docs.columns)).collect()
    assert len(got) == docs.count()
    assert all(not r.kept and r.probability == 0 for r in got if not r.carried.text)
    assert {r.source for r in got} == {"", "s"} and all(0 <= r.probability <= 1 for r in got)
    fate = defaultdict(set)
    for r in got:
        fate[r.doc_id, r.carried.text, r.source, r.lang].add(r.kept)
    assert all(len(f) == 1 for f in fate.values())
    assert mixing.mix(docs.limit(0)).collect() == []
    pooled = mixing.mix(docs, max_sources=1, keep_share=1.0).collect()
    assert all(r.kept for r in pooled if r.n_tokens)


def test_mixing_samples_what_it_promises(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.when(F.col("id") % 10 == 0, "de").otherwise("en").alias("lang"))
    got = mixing.mix(docs, targets={"source": 1.0, "lang": {"en": 0.5, "de": 0.5}}, keep_share=0.15).collect()
    kept = [r for r in got if r.kept]
    assert len(kept) / 6000 == pytest.approx(0.15, abs=0.015)
    assert sum(r.lang == "de" for r in kept) / len(kept) == pytest.approx(0.5, abs=0.06)


@pytest.mark.parametrize("here", [0, 200_000])
def test_mixing_rakes_every_source_by_its_name(spark, monkeypatch, here):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", here)
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.format_string("s%04d", "id").alias("source"), F.lit("en").alias("lang"))
    got = mixing.mix(docs, keep_share=0.6, rounds=2).collect()
    assert {r.source for r in got} == {f"s{k:04d}" for k in range(1500)}
    assert [r.probability for r in got] == pytest.approx([0.6] * 1500)  # equal sources have equal chances
    named = mixing.mix(docs, targets={"source": {"s1400": 0.5, "s0001": 0.5}}, keep_share=0.001, rounds=2).collect()
    assert {r.source: r.probability for r in named if r.probability > 0} == pytest.approx({"s0001": 0.75, "s1400": 0.75})


def sparse_cells(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"s{a}", f"l{b}", f"t{c}", 1 + int(1e6 / (a + 1) * x * y)) for a in range(20) for b, x in enumerate(rng.dirichlet([0.1] * 4)) for c, y in enumerate(rng.dirichlet([0.1] * 5))]
    return spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


def worst_error(rows, power):
    total, worst = sum(r.tokens for r in rows), 0.0
    for d in mixing.DIMENSIONS:
        natural, share = defaultdict(float), defaultdict(float)
        for r in rows:
            natural[r[d]] += r.tokens / total
            share[r[d]] += r.weight
        norm = sum(v**power for v in natural.values())
        worst = max(worst, *(abs(share[k] / (v**power / norm) - 1) for k, v in natural.items()))
    return worst


def test_raking_goes_on_until_the_targets_hold(spark):
    cells = sparse_cells(spark, 17)
    with warnings.catch_warnings():
        warnings.simplefilter("error", RuntimeWarning)
        raked = mixing.rake(cells, {d: 0.7 for d in mixing.DIMENSIONS}, 8)
    assert worst_error(raked.collect(), 0.7) < 2e-6


@pytest.mark.parametrize("here", [0, 200_000])
def test_raking_tells_targets_that_cannot_be_met(spark, monkeypatch, here):
    monkeypatch.setattr(mixing, "DRIVER_CELLS", here)
    # two sources in one language: their goals do not add up to its goal
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "x", "t", 20), ("c", "y", "t", 30)], "source string, lang string, topic string, tokens long")
    with pytest.warns(RuntimeWarning, match="off its target") as told:
        raked = mixing.rake(cells, {d: 0.0 for d in mixing.DIMENSIONS}, 1)
    assert {r.source: r.weight for r in raked.collect()} == pytest.approx({"a": 0.25, "b": 0.25, "c": 0.5})
    [message] = [str(w.message) for w in told if w.category is RuntimeWarning]
    margins = spark.read.parquet(message.rsplit(" ", 1)[1])
    assert {(r.category, round(r.goal, 6), round(r.share, 6)) for r in margins.where("dimension = 'source'").collect()} == {("a", 0.333333, 0.25), ("b", 0.333333, 0.25), ("c", 0.333333, 0.5)}


def test_raking_is_the_same_in_both_ways(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", "t", 90), ("a", "y", "t", 10), ("b", "x", "t", 20), ("b", "y", "u", 70), ("c", "y", "t", 30), ("c", "x", "u", 5)], "source string, lang string, topic string, tokens long")
    targets = {"source": 0.5, "lang": {"x": 0.5, "y": 0.5}}
    here = {(r.source, r.lang): r.weight for r in mixing.rake(cells, targets, 2).collect()}
    monkeypatch.setattr(mixing, "DRIVER_CELLS", 0)
    assert {(r.source, r.lang): r.weight for r in mixing.rake(cells, targets, 2).collect()} == pytest.approx(here, rel=1e-9)


# ------------------------------------------------------------------ URL filters


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_url_filter_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "BROADCAST_INTERVALS", broadcast)
    rng = random.Random(16)
    domains = ["a.com", "b.a.com", "c.b.a.com", "x.org", "y.x.org"]
    entries = [(rng.choice(domains + ["A.com", None]), rng.choice(["spam", "ads", None]), rng.choice(["add", "remove", "odd"]), rng.choice([None, *range(0, 50, 5)])) for _ in range(60)]
    captures = [(i, rng.choice([f"http://{rng.choice(domains)}/p?q=1", f"HTTPS://user@{rng.choice(domains).upper()}:80#f", "no url", None, "http:///"]), rng.choice([None, *range(60)])) for i in range(300)]
    time = lambda df, c: df.withColumn(c, F.timestamp_seconds(F.col(c)))
    got = urls.judge(time(spark.createDataFrame(captures, "page_id long, url string, fetched long"), "fetched").withColumn("open", F.lit(1)), time(spark.createDataFrame(entries, "pattern string, category string, action string, at long"), "at"))
    rows = {r.page_id: r for r in got.collect()}
    assert len(rows) == 300
    history = defaultdict(dict)
    for pattern, category, action, at in entries:
        if pattern and category and at is not None and action != "odd":
            old = history[pattern.lower(), category].get(at)
            history[pattern.lower(), category][at] = "remove" if "remove" in (old, action) else "add"
    for i, url, fetched in captures:
        host = rows[i].host
        assert (host is None) == (url in (None, "no url", "http:///"))
        active = []
        for (pattern, category), h in history.items():
            if host and fetched is not None and (host == pattern or host.endswith("." + pattern)):
                past = [t for t in h if t <= fetched]
                if past and h[max(past)] == "add":
                    active.append((len(pattern), pattern, category))
        assert rows[i].categories == sorted({c for *_, c in active}) and rows[i].blocked == bool(active)
        assert rows[i].pattern == (max(active)[1] if active else None)


def test_url_filter_of_nothing(spark):
    none = spark.createDataFrame([], "pattern string, category string, action string, at timestamp")
    some = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string").withColumn("fetched", F.current_timestamp())
    assert [r.blocked for r in urls.judge(some, none).collect()] == [False]
    assert urls.judge(some.limit(0), none).collect() == []


# ------------------------------------------------------------------ registered queries and pipeline


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, data, con, name):
    df = queries.QUERIES[name](spark, data)
    names = sorted(df.columns)
    found = con.execute(queries.ORACLE_SQL[name])
    order = [[d[0] for d in found.description].index(c) for c in names]
    assert sorted(repr(tuple(r[c] for c in names)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in found.fetchall())


def test_every_operator_has_its_query():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages_against_brute_force(spark, data, tokenizer):
    bench = [tuple(r) for r in common.table(spark, data, "benchmark").select("item_id", "text").collect()]
    texts = [*corpus(17), *ODD, "leak: " + bench[0][1], "12345 67", "!!"]
    docs = frame(spark, texts).withColumn("doc_id", F.monotonically_increasing_id())
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    before = [r.asDict() for r in docs.collect()]
    # language: what has no letter goes; what stays is coded better than by chance
    known = stages["language"](spark, docs, data)
    assert known.columns == docs.columns
    kept = {r.doc_id for r in known.collect()}
    assert not any(r["doc_id"] in kept for r in before if not any(c.isalpha() for c in r["text"] or ""))
    # (code lengths straight from the definition, for the shorter texts)
    trees = [plain_counts([r["text"] for r in before if r["lang"] == lang and r["text"] is not None]) for lang in sorted({r["lang"] for r in before} - {None})]
    for r in before:
        text = r["text"] or ""
        if any(c.isalpha() for c in text) and len(text) < 300:
            least = min(plain_bits(None, text, counts) for counts in trees) / len(text.encode())
            assert abs(least - corpus_pipeline.MOST_BITS) < 1e-9 or (r["doc_id"] in kept) == (least <= corpus_pipeline.MOST_BITS)
    # near duplicates: the least identifier of each component
    rows = sorted(known.collect(), key=lambda r: r.doc_id)
    want = brute_force([r.text for r in rows], 5, 80)[1]
    once = stages["near_duplicates"](spark, known, data)
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == [r.doc_id for k, r in enumerate(rows) if want[k] == k]
    # leaks
    rows = once.collect()
    clean = stages["decontamination"](spark, once, data)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r, leak in zip(rows, leaks([r.text for r in rows], bench), strict=True) if not leak[-1]}
    # mixing: cells raked and calibrated by plain loops, documents picked by a hash of their identifier
    rows = clean.collect()
    mixed = stages["mixing"](spark, clean, data)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == plain_mix([(r.doc_id, r.text, r.source, r.lang) for r in rows])
    # tokens
    rows = sorted(mixed.collect(), key=lambda r: r.doc_id)
    out = sorted(stages["tokens"](spark, mixed, data).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in out] == [r.doc_id for r in rows]
    assert [r.start for r in out] == [sum(x.n_tokens for x in out[:k]) for k in range(len(out))]
    ids = [[*e.ids, queries.END_ID] for e in tokenizer.encode_batch([r.text for r in rows], add_special_tokens=False)]
    assert [(r.n_tokens, r.ids_crc32) for r in out] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]


def plain_mix(rows, share=0.7, power=0.7):
    """Identifiers kept of (id, text, source, lang)."""
    import hashlib

    def topic(t):
        return "table" if " | " in t else "legal" if "license" in t.lower() else "loud" if "!!" in t else "note" if len(t.encode()) < 600 else "prose"

    cells, of = defaultdict(int), {}
    for i, t, source, lang in rows:
        of[i] = cell = (source or "", lang or "", topic(t))
        cells[cell] += math.ceil(len(t.encode()) / 4)
    total = sum(cells.values())
    goals = []
    for d in range(3):
        natural = defaultdict(float)
        for k, v in cells.items():
            natural[k[d]] += v / total
        norm = sum(v**power for v in natural.values())
        goals.append({k: v**power / norm for k, v in natural.items()})
    weight = rake(cells, goals, 3000)
    low, high = 0.0, 1e12
    for _ in range(200):  # the scale at which the expected tokens are the share asked for
        scale = (low + high) / 2
        got = sum(cells[k] * min(1.0, scale * w / cells[k]) for k, w in weight.items())
        low, high = (scale, high) if got < share * total else (low, scale)
    chance = {k: min(1.0, high * w / cells[k]) for k, w in weight.items()}
    draw = lambda i: int(hashlib.md5(f"{i}/mix".encode()).hexdigest()[:8], 16) / 2**32
    return {i for i, cell in of.items() if draw(i) < chance[cell]}


def test_pipeline_runs_and_takes_empty_tables(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert 0 < out.count() < common.table(spark, data, "documents").count()
    empty = common.table(spark, data, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, data)
        assert got.collect() == [], name
    assert math.isfinite(corpus_pipeline.MOST_BITS) and decontaminate.BLOCK_WORDS > 0 and jaccard.LEAF > 1
