import operator
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shardloom import TypeCheckError, cogroup, count, plans, sources, total, union
from shardloom.testing import assert_rows_equal, by_shard, rows


@pytest.mark.parametrize("shards", [1, 4])
@pytest.mark.parametrize("add", ["sum", operator.add, lambda a, b: a + b])
def test_reduce_sum(spark, shards, add):
    ds = sources.const(spark, shards, [f"{x % 3}x" for x in range(100)], list(range(100)))
    assert_rows_equal(ds.reduce(add), [("0x", 1683), ("1x", 1617), ("2x", 1650)])


def test_reduce_by_two_columns(spark):
    ds = sources.const(spark, 2, ["x"] * 100, [x % 3 for x in range(100)], list(range(100))).prefixed(2)
    assert_rows_equal(ds.reduce("sum"), [("x", 0, 1683), ("x", 1, 1617), ("x", 2, 1650)])


def test_reduce_max_has_no_identity(spark):
    ds = sources.const(spark, 2, [0, 0, 0, 1, 1, 2], [-6, -5, -4, -3, -2, -1])
    want = [(0, -4), (1, -2), (2, -1)]
    for got in (ds.reduce(max), ds.reduce_expr(lambda a, b: F.greatest(a, b)), ds.reduce(lambda a, b: a if a > b else b)):
        assert_rows_equal(got, want)


def test_reduce_counts_letters(spark):
    ds = sources.const(spark, 2, list("cabccbaaaac"), [1] * 11)
    assert_rows_equal(ds.reduce("sum"), [("a", 5), ("b", 2), ("c", 4)])
    assert_rows_equal(count(ds), [("a", 5), ("b", 2), ("c", 4)])


def test_reduce_plan_sums_before_the_shuffle(spark):
    ds = sources.const(spark, 2, ["a"], [1]).reduce("sum")
    assert plans.count(ds.df, "HashAggregate") == 2 and plans.exchanges(ds.df) == 1


WORDS = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod".split()


def test_fold_three_ways(spark):
    ds = sources.const(spark, 2, list("cabccbaaaac"), list(range(1, 12)), WORDS)
    groups = defaultdict(list)
    for k, i, w in zip("cabccbaaaac", range(1, 12), WORDS, strict=True):
        groups[k].append((i, w))
    want = [(k, sum(i for i, _ in g), max(len(w) for _, w in g)) for k, g in groups.items()]
    assert_rows_equal(ds.fold(total=F.sum("c1"), longest=F.max(F.length("c2").cast("long"))), want)
    assert_rows_equal(ds.fold(lambda acc, i, w: (acc[0] + i, max(acc[1], len(w))), zero=(0, 0), schema="total long, longest long"), want)
    zero = F.struct(F.lit(0).cast("long").alias("t"), F.lit(0).cast("long").alias("n"))
    expr = ds.fold_expr(zero, lambda a, x: F.struct((a["t"] + x["c1"]).alias("t"), F.greatest(a["n"], F.length(x["c2"]).cast("long")).alias("n")))
    assert_rows_equal(expr.map("c0", "acc.t", "acc.n"), want)


def test_fold_by_more_columns_must_be_asked_for(spark):
    ds = sources.const(spark, 2, ["a", "a"], [1, 2], [3, 4]).prefixed(2)
    with pytest.raises(TypeCheckError, match="keys=2"):
        ds.fold(n=F.count(F.lit(1)))
    assert_rows_equal(ds.fold(keys=2, n=F.count(F.lit(1))), [("a", 1, 1), ("a", 2, 1)])


def test_total_of_nothing_has_no_row(spark):
    ds = sources.const(spark, 2, [], schema="a long")
    assert rows(total(ds, n=F.count(F.lit(1)))) == []
    assert rows(total(sources.const(spark, 2, [1, 2]), n=F.sum("c0"))) == [(3,)]


LEFT, RIGHT = [("z", 1), ("b", 2), ("d", 3), ("d", 4)], [("x", "one"), ("y", "two"), ("z", "three"), ("d", "four")]


def two(spark, l_shards, r_shards):
    return (sources.const(spark, n, *zip(*r, strict=True), schema=s) for n, r, s in ((l_shards, LEFT, "k string, v long"), (r_shards, RIGHT, "k string, w string")))


@pytest.mark.parametrize("shards", [(1, 1), (2, 1), (4, 4)])
def test_cogroup_of_two(spark, shards):
    a, b = two(spark, *shards)
    got = a.cogroup(b)
    assert_rows_equal(got, [("b", [2], []), ("d", [3, 4], ["four"]), ("x", [], ["one"]), ("y", [], ["two"]), ("z", [1], ["three"])])
    assert got.num_shards == max(shards) and plans.exchanges(got.df) == 1
    assert_rows_equal(b.cogroup(a), [("b", [], [2]), ("d", ["four"], [3, 4]), ("x", ["one"], []), ("y", ["two"], []), ("z", ["three"], [1])])


def test_cogroup_of_one_and_three(spark):
    a, b = two(spark, 2, 2)
    assert_rows_equal(a.cogroup(), [("b", [2]), ("d", [3, 4]), ("z", [1])])
    three = cogroup(a, b, a)
    assert plans.exchanges(three.df) == 1
    assert ("d", (3, 4), ("four",), (3, 4)) in rows(three)


def test_cogroup_by_two_columns(spark):
    a = sources.const(spark, 2, list("zaabd"), [0, 0, 0, 2, 3], ["foo", "bar", "baz", "qux", "quux"]).prefixed(2)
    b = sources.const(spark, 2, list("daabcdb"), [3, 0, 1, 1, 2, 3, 1], [0, 1, 2, 3, 4, 5, 6]).prefixed(2)
    want = [("a", 0, ["bar", "baz"], [1]), ("a", 1, [], [2]), ("b", 1, [], [3, 6]), ("b", 2, ["qux"], []), ("c", 2, [], [4]), ("d", 3, ["quux"], [0, 5]), ("z", 0, ["foo"], [])]
    assert_rows_equal(a.cogroup(b), want)


def test_cogroup_null_keys_and_values(spark):
    a = sources.const(spark, 1, [None, "k", "k"], [1, None, 2], schema="k string, v long")
    got = {r[0]: r[1] for r in a.cogroup(a).df.collect()}
    assert got[None] == [1] and sorted(got["k"], key=str) == [2, None]


def test_cogroup_checks_keys(spark):
    with pytest.raises(TypeCheckError):
        sources.const(spark, 1, ["a"], [1]).cogroup(sources.const(spark, 1, [1], [1]))


@pytest.mark.parametrize(("how", "want"), [("inner", 3), ("left", 4), ("right", 5), ("full", 6), ("left_semi", 3), ("left_anti", 1)])
def test_joins(spark, how, want):
    a, b = two(spark, 2, 3)
    assert len(rows(a.join(b, how))) == want


def test_join_keeps_clashing_names_apart(spark):
    a = sources.const(spark, 1, ["k"], [1])
    assert a.join(a).df.columns == ["c0", "c1", "c1_right"]


def test_union_and_distinct(spark):
    a = sources.const(spark, 2, [1, 1, 2])
    assert_rows_equal(union(a, a).distinct(), [(1,), (2,)])


# ------------------------------------------------------------------ shards


@pytest.mark.parametrize(("source", "target"), [(1, 1), (1, 5), (10, 2), (5, 100)])
def test_reshard_keeps_rows(spark, source, target):
    ds = sources.const(spark, source, [str(i) for i in range(200)])
    got = ds.reshard(target)
    assert (got is ds) == (source == target)
    assert_rows_equal(got, [(str(i),) for i in range(200)])
    assert got.df.rdd.getNumPartitions() == target


@pytest.mark.parametrize("shards", [1, 4, 9])
def test_reshuffle_puts_a_key_in_one_shard(spark, shards):
    ds = sources.const(spark, shards, ["a" * (i % 7) for i in range(100)], list(range(100))).reshuffle()
    parts = by_shard(ds)
    assert len(parts) == shards and sum(map(len, parts)) == 100
    homes = defaultdict(set)
    for k, part in enumerate(parts):
        for key, _ in part:
            homes[key].add(k)
    assert all(len(h) == 1 for h in homes.values())


def test_repartition_both_ways(spark):
    ds = sources.const(spark, 2, [1, 2, 3, 4, 5, 6])
    assert [len(p) for p in by_shard(ds)] == [3, 3]
    for zero in (F.lit(0), lambda n, i: 0):
        assert [len(p) for p in by_shard(ds.repartition(zero))] == [6, 0]
    words = sources.const(spark, 3, ["a", "bb", "ccc", "dddd"])
    assert [sorted(p) for p in by_shard(words.repartition(lambda n, w: len(w) % n))] == [[("ccc",)], [("a",), ("dddd",)], [("bb",)]]


def test_repartition_out_of_range_fails(spark):
    ds = sources.const(spark, 2, [1, 2, 3])
    with pytest.raises(Exception, match="shard out of"):
        ds.repartition(F.lit(2)).df.collect()


def test_shards_survive_adaptive_coalescing(spark):
    ds = sources.const(spark, 5, ["a", "b"], [1, 2]).reduce("sum")
    assert len(by_shard(ds)) == 5


# ------------------------------------------------------------------ reduce in every way


@pytest.mark.parametrize("bits", [1, 13])
def test_reduce_products_are_exact(spark, monkeypatch, bits):
    monkeypatch.setattr("shardloom.operators.aggregate.CHUNK_BITS", bits)
    a, b = 3037000493, 3037000499
    ds = sources.const(spark, 2, ["x", "x", "y", "z"], [a, b, -7, None], schema="k string, v long")
    want = [("x", a * b), ("y", -7), ("z", None)]
    for way in (ds.reduce(operator.mul), ds.reduce("product"), ds.reduce(lambda p, q: p * q), ds.reduce_expr(lambda p, q: p * q)):
        assert_rows_equal(way, want)
    floats = sources.const(spark, 1, ["x", "x"], [0.5, 4.0])
    assert_rows_equal(floats.reduce("product"), [("x", 2.0)])
    with pytest.raises(Exception, match="(?i)overflow|too large|convert"):
        sources.const(spark, 2, ["x"] * 3, [1 << 40] * 3).reduce(operator.mul).df.collect()


@pytest.mark.parametrize("way", ["sum", lambda a, b: a + b, None])
def test_reduce_leaves_nulls_out(spark, way):
    ds = sources.const(spark, 3, ["a", "a", "a", "b", "c", None], [1, None, 2, None, 5, 7], schema="k string, v long")
    got = ds.reduce_expr(lambda a, b: a + b) if way is None else ds.reduce(way)
    assert_rows_equal(got, [("a", 3), ("b", None), ("c", 5), (None, 7)])


def test_reduce_expr_merges_level_by_level(spark, monkeypatch):
    monkeypatch.setattr("shardloom.operators.aggregate.CHUNK_BITS", 3)
    ds = sources.const(spark, 6, [i % 2 for i in range(1000)], list(range(1000)))
    assert_rows_equal(ds.reduce_expr(lambda a, b: a + b), [(0, 249500), (1, 250000)])
    zero = F.struct(F.lit(0).cast("long").alias("n"))
    counted = ds.fold_expr(zero, lambda a, x: F.struct((a["n"] + 1).alias("n")), finish=lambda a: a["n"], combine=lambda a, b: F.struct((a["n"] + b["n"]).alias("n")))
    assert_rows_equal(counted, [(0, 500), (1, 500)])


def test_sort_and_top(spark):
    ds = sources.const(spark, 3, [3, 1, 2, 1], list("abcd"))
    assert [r[0] for r in ds.sort().df.collect()] == [1, 1, 2, 3]
    assert [tuple(r) for r in ds.top(2, F.desc("c1")).df.collect()] == [(1, "d"), (2, "c")]
    assert plans.exchanges(ds.top(2).df) == 0  # each task keeps its own first rows
    assert rows(ds.top(3).reduce("min"))[0] == (1, "b")


def test_cogroup_and_join_compose_hints(spark):
    from shardloom import EXCLUSIVE, procs

    a = sources.const(spark, 2, ["k"], [1]).map("c0", "c1", pragma=procs(3))
    b = sources.const(spark, 2, ["k"], [2]).map("c0", "c1", pragma=EXCLUSIVE)
    for got in (a.cogroup(b), a.join(b)):
        assert got.pragma.procs == 3 and got.pragma.exclusive
