"""Learned operators: held-out accuracy on the small tables, and their parts against plain Python."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import common, language, toxicity
from shardloom.llm import entry as queries

from .test_text import ODD, frame

SF = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in common.table(spark, SF, "documents").select("doc_id", "lang").collect()}
    got = queries.op6_language(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) > 0.98


def model_of(texts):
    grams = {}
    for lang, ts in texts.items():
        g, n = np.unique(language.grams_of(*common.text_bytes(pa.array(ts))), return_counts=True)
        grams[lang] = g, n
    return language.Model(grams)


def lower_bytes(text):
    return [b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()]


def plain_counts(texts):
    counts = {}
    for t in texts:
        s = [32] * 3 + lower_bytes(t)
        for i in range(3, len(s)):
            for k in range(4):
                c = counts.setdefault(tuple(s[i - k : i]), {})
                c[s[i]] = c.get(s[i], 0) + 1
    return counts


def plain_bits(texts, text, counts=None):
    """Escape code lengths with exclusion, straight from the definition."""
    counts = plain_counts(texts) if counts is None else counts

    def p(context, x):
        below = (lambda y: p(context[1:], y)) if context else (lambda y: 1 / 256)
        c = counts.get(context)
        if c is None:
            return below(x)
        n, d = sum(c.values()), len(c)
        if d == 256:
            return c[x] / n
        if x in c:
            return c[x] / (n + d)
        return d / (n + d) * below(x) / (1 - sum(below(y) for y in c))

    s = [32] * 3 + lower_bytes(text)
    return -sum(np.log2(p(tuple(s[i - 3 : i]), s[i])) for i in range(3, len(s)))


def test_language_code_lengths_are_exact():
    texts = {"a": ["the cat and the hat", "that then"], "b": ["el gato y la casa", "él"], "c": ["Кошка и дом", "猫と犬"]}
    model = model_of(texts)
    asked = ["the hat", "la casa él", "zzz", "", "x", "дом КОШКА", "犬"]
    bits = language.code_lengths(model, *common.text_bytes(pa.array(asked)))
    for k, lang in enumerate(model.languages):
        for r, t in enumerate(asked):
            assert bits[r, k] == pytest.approx(plain_bits(texts[lang], t), rel=1e-9, abs=1e-9)
    every = np.arange(256, dtype=np.uint32)
    for tree in model.trees():  # every context is a proper distribution
        for context in (b"the", b"zz ", "ка".encode()[1:4], b"\xff\xff\xff"):
            whole = np.uint32(int.from_bytes(context, "big") << 8) | every
            assert np.exp2(-tree.bits(whole)).sum() == pytest.approx(1, rel=1e-9)


def test_language_with_every_byte_seen():
    full = "".join(chr(i) for i in range(128)) * 2
    data = np.arange(256, dtype=np.uint8)
    g, n = np.unique(language.grams_of(data, np.array([0, 256])), return_counts=True)
    tree = language.Tree(g, n)
    assert np.exp2(-tree.bits(np.arange(256, dtype=np.uint32))).sum() == pytest.approx(1, rel=1e-9)
    assert plain_bits([full], "ab") > 0


def test_language_training_equals_plain_counts(spark):
    texts = ["The cat", "el gato", "Кот", None, "the CAT sat", "日本語", ""]
    langs = ["en", "es", "ru", "ru", "en", None, "en"]
    rows = spark.createDataFrame(list(enumerate(zip(texts, langs))), "doc_id long, x struct<text:string,lang:string>").select("doc_id", "x.*").repartition(3)
    model = language.fit(rows)
    assert model.languages == ["en", "es", "ru"]
    bits = language.code_lengths(model, *common.text_bytes(pa.array(["the cat", "gato кот"])))
    for k, lang in enumerate(model.languages):
        mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
        assert bits[:, k] == pytest.approx([plain_bits(mine, "the cat"), plain_bits(mine, "gato кот")], rel=1e-9)


SCRIPTS = {
    "ru": ("кошка дом река ночь утро книга слово человек время дорога город вода", "{} и {} на {} был {} что {} не {}"),
    "uk": ("кішка дім річка ніч ранок книга слово людина час дорога місто вода", "{} і {} на {} був {} що {} не {}"),
    "ja": ("猫 家 川 夜 朝 本 言葉 人 時間 道 町 水", "{}は{}の{}です。{}を{}に{}ます。"),
    "zh": ("猫 房子 河 夜晚 早晨 书 话 人 时间 路 城市 水", "{}的{}是{}，{}在{}和{}了。"),
    "el": ("γάτα σπίτι ποτάμι νύχτα πρωί βιβλίο λέξη άνθρωπος χρόνος δρόμος πόλη νερό", "{} και {} στο {} ήταν {} που {} δεν {}"),
}


def test_language_tells_scripts_and_their_languages_apart(spark):
    import random

    rng = random.Random(19)
    rows = [(f"plain english words number {i} and some more of the same {rng.random()}", "en") for i in range(200)]
    for lang, (words, frame_) in SCRIPTS.items():
        rows += [(" ".join(frame_.format(*rng.choices(words.split(), k=6)) for _ in range(4)), lang) for _ in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(docs.where("doc_id % 2 = 0"))
    got = language.predict(docs, model).collect()
    wrong = [r for r in got if r.lang_pred != rows[r.doc_id][1]]
    assert len([r for r in got if r.doc_id % 2]) == 200 and wrong == []


def test_language_learns_every_language(spark):
    """No cap on languages: 300 of them, each with words of its own."""
    docs = spark.range(900).selectExpr("id as doc_id", "concat('l', id % 300) as lang", "concat(repeat(concat('w', conv(id % 300, 10, 36), 'q '), 6), id) as text")
    model = language.fit(docs)
    assert len(model.languages) == 300
    assert all(r.lang_pred == f"l{r.doc_id % 300}" for r in language.predict(docs, model).where("doc_id < 60").collect())


def test_language_odd_texts(spark):
    model = model_of({"a": ["the cat and the hat"], "b": ["el gato y la casa"]})
    docs = frame(spark, ODD + ["12345 !!", "½ ²"])
    got = {r.carried.text: r for r in language.predict(docs, model, carry=tuple(docs.columns)).collect()}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) for t, r in got.items())
    assert all(r.score == 0 for r in got.values() if r.lang_pred == "und")
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).collect() == []
    assert language.fit(docs.limit(0)) is None
    assert language.fit(docs.where("lang is null")) is None
    assert language.fit(docs) is not None  # null texts and languages are no examples


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in common.table(spark, "/root/testdata/sf0.1", "labels").collect()}
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 10_000 and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    y, p = np.array([truth[r.doc_id] for r in out]), np.array([r.predicted for r in out])
    assert (p & y).sum() / y.sum() > 0.8 and (p & y).sum() / p.sum() > 0.9


def test_toxicity_distinct_buckets():
    distinct, rng = toxicity.Distinct(), np.random.default_rng(5)
    for _ in range(20):
        x = rng.integers(0, 50, 200).astype(np.uint32)
        assert sorted(distinct(x)) == sorted(set(x.tolist()))
    for text in ("", "a", "abcdefghijkl", "Злой ИДИОТ", "大馬鹿者め😀"):
        x = toxicity.characters(text.encode())
        assert x.tolist() == [ord(c) for c in f" {text.lower()} "]
        assert len(toxicity.buckets(x)) == sum(max(0, len(x) - n + 1) for n in toxicity.GRAMS)


def plain_presence(texts):
    return [set(toxicity.buckets(toxicity.characters((t or "").encode())).tolist()) for t in texts]


def test_toxicity_scores_and_ratios_agree_with_plain_counts(spark):
    texts = ["you moron idiot " * 3, "a fine day", "idiot again", "what a fine thing", None, "", "Ты ИДИОТ", "хороший день"] * 10
    labels = [1, 0, 1, 0, 0, 0, 1, 0] * 10
    rows = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, toxic int").repartition(3)
    sets = plain_presence(texts)
    # counts over all labelled rows
    counted = {r.bucket: (r.clean, r.toxic) for r in rows.select(F.col("toxic").alias("label"), "text").mapInArrow(toxicity._presence, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).collect()}
    every = set().union(*sets)
    count = {x: tuple(sum(x in s for s, y in zip(sets, labels, strict=True) if y == label) for label in (0, 1)) for x in every}
    assert counted == {**count, -1: (50, 30)}
    # the ratios scale the weights: the model's weight of a bucket has the sign of its ratio where it is not zero
    model = toxicity.fit(rows)
    ratio = {x: np.log((t + 1) / 32) - np.log((c + 1) / 52) for x, (c, t) in count.items()}
    assert set(np.flatnonzero(model.weights).tolist()) <= every
    assert all(model.weights[x] * ratio[x] >= 0 for x in every if abs(ratio[x]) > 1)
    # and the weights are those of a logistic regression on the scaled presence of the buckets of the largest ratios
    best = sorted(every, key=lambda x: (-abs(ratio[x]) / np.sqrt(1 / (count[x][1] + 1) + 1 / (count[x][0] + 1)), x))[:3000]
    place = {x: i for i, x in enumerate(best)}
    w, b = toxicity.logistic([np.array(sorted(place[x] for x in s if x in place), int) for s in sets], np.array(labels, float), np.array([ratio[x] for x in best]), 3e-4)
    got = {r.doc_id: r.score for r in toxicity.score(rows.drop("toxic"), model).collect()}
    for i, s in enumerate(sets):
        z = b + sum(w[place[x]] * ratio[x] for x in s if x in place)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=2e-2, abs=2e-3) and (got[i] > 0.5) == (labels[i] == 1)


def test_toxicity_odd_cases(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0), (2, 7), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    assert len(toxicity.score(docs, model).collect()) == len(ODD)
    nothing = toxicity.fit(toxicity.training_rows(docs.limit(0), labels))
    assert {round(r.score, 6) for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).collect() == []
    one = toxicity.fit(toxicity.training_rows(docs, labels.where("toxic = 1")))
    assert {round(r.score, 6) for r in toxicity.score(docs, one).collect()} == {1.0}


def test_logistic_finds_the_minimum():
    rng = np.random.default_rng(6)
    found = [np.flatnonzero(rng.random(12) < 0.3) for _ in range(300)]
    ratio = rng.normal(size=12)
    y = np.array([float((f < 4).sum() > (f >= 8).sum()) for f in found])
    w, b = toxicity.logistic(found, y, ratio, 1e-3)
    z = np.array([(ratio[f] * w[f]).sum() + b for f in found])
    e = 1 / (1 + np.exp(-z)) - y
    grad = np.array([sum(e[i] * ratio[j] for i, f in enumerate(found) if j in f) for j in range(12)]) / 300 + 1e-3 * w
    assert np.abs(grad).max() < 2e-3 and abs(e.mean()) < 2e-3
