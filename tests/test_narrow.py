import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom import TypeCheckError, sources
from shardloom.sources.generated import split_evenly
from shardloom.testing import assert_rows_equal, by_shard, rows

ROWS = [(0, "zero"), (1, "one"), (2, "two"), (3, "three")]


def const(spark, rows, schema, shards=2):
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema.split(",")]
    return sources.const(spark, shards, *columns, schema=schema)


@given(st.integers(0, 60), st.integers(1, 19))
def test_const_split_is_even_and_in_order(n, shards):
    ranges = split_evenly(n, shards)
    sizes = [len(r) for r in ranges]
    assert [i for r in ranges for i in r] == list(range(n))
    assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_const_keeps_rows_and_shards(spark, shards):
    ds = const(spark, [(i, str(i)) for i in range(20)], "c0 long, c1 string", shards)
    assert_rows_equal(ds, [(i, str(i)) for i in range(20)])
    assert [len(p) for p in by_shard(ds)] == [len(r) for r in split_evenly(20, shards)]


def test_map_both_ways(spark):
    ds = const(spark, ROWS, "c0 long, c1 string")
    want = [(k, s, k * k, s + ".squared") for k, s in ROWS]
    assert_rows_equal(ds.map("c0", "c1", (F.col("c0") * F.col("c0")).alias("q"), F.concat("c1", F.lit(".squared")).alias("t")), want)
    assert_rows_equal(ds.map(lambda k, s: (k, s, k * k, s + ".squared"), schema="a long, b string, c long, d string"), want)


def test_map_keeps_order_within_a_shard(spark):
    ds = sources.const(spark, 1, list(range(20_000))).map(lambda i: str(i), schema="s string")
    assert [r[0] for r in by_shard(ds)[0]] == [str(i) for i in range(20_000)]


def test_map_schema_from_annotation(spark):
    def f(k: int, s: str) -> tuple[str, list[int]]:
        return s, [k]

    assert_rows_equal(const(spark, ROWS, "c0 long, c1 string").map(f), [(s, [k]) for k, s in ROWS])


@pytest.mark.parametrize("keep", [lambda i: i % 2 == 0, lambda i: False, lambda i: i in (250, 500, 750)])
def test_filter_both_ways(spark, keep):
    ds = sources.const(spark, 3, list(range(1000)))
    want = [(i,) for i in range(1000) if keep(i)]
    assert_rows_equal(ds.filter(keep), want)
    assert_rows_equal(ds.filter(F.col("c0").isin([i for i, in want])), want)


def test_flatmap_both_ways(spark):
    ds = sources.const(spark, 2, ["x,x", "y,y,y", "z", "", "x"])
    want = [("x", 1)] * 3 + [("y", 1)] * 3 + [("z", 1)]
    words = F.filter(F.split("c0", ","), lambda w: w != "")
    assert_rows_equal(ds.flatmap(words.alias("w"), F.transform(words, lambda w: F.length(w).cast("long")).alias("n")), want)

    def split(s: str) -> tuple[list[str], list[int]]:
        found = [w for w in s.split(",") if w]
        return found, [len(w) for w in found]

    assert_rows_equal(ds.flatmap(split), want)


def test_flatmap_widths(spark):
    ds = sources.const(spark, 2, [1, 1025])
    assert len(rows(ds.flatmap(lambda n: list(range(n)), schema="i long"))) == 1026
    assert rows(ds.flatmap(lambda n: [], schema="i long")) == []


def test_flatmap_unequal_vectors_fail(spark):
    ds = const(spark, ROWS, "c0 long, c1 string")
    with pytest.raises(Exception, match="unequal length"):
        ds.flatmap(F.array("c0", "c0").alias("a"), F.array("c1").alias("b")).df.collect()
    with pytest.raises(Exception, match="unequal length"):
        ds.flatmap(lambda k, s: ([k], [s, s]), schema="a long, b string").df.collect()


def test_head_is_per_shard(spark):
    ds = sources.const(spark, 2, [1, 2, 3, 4, 5, 6, 7, 8, 9, 0])
    assert_rows_equal(ds.head(2), [(1,), (2,), (6,), (7,)])
    assert_rows_equal(sources.const(spark, 1, [5, 4, 3, 2]).head(3), [(5,), (4,), (3,)])
    assert rows(ds.head(0)) == []


def test_prefix_and_repr(spark):
    ds = const(spark, ROWS, "c0 long, c1 string").prefixed(2)
    assert ds.keys == ["c0", "c1"] and ds.unwrap().keys == ["c0"]
    assert "bigint, string" in repr(ds)
    with pytest.raises(TypeCheckError):
        ds.prefixed(3)


def test_type_errors_name_the_operator_and_this_file(spark):
    ds = const(spark, ROWS, "c0 long, c1 string")
    for bad, word in [
        (lambda: ds.map(lambda a: a, schema="x long"), "map"),
        (lambda: ds.map(3), "map"),
        (lambda: ds.map(lambda a, b: a), "map"),
        (lambda: ds.filter("c0 + 1"), "filter"),
        (lambda: ds.filter(lambda a: True), "filter"),
        (lambda: ds.flatmap(F.col("c0")), "flatmap"),
        (lambda: ds.repartition(F.col("c1")), "repartition"),
        (lambda: ds.repartition(lambda n: 0), "repartition"),
        (lambda: ds.writer_func(lambda shard: None), "writer_func"),
        (lambda: ds.map("c0").fold(lambda a, b: a, zero=0, schema="a long"), "fold"),
        (lambda: ds.map(F.col("c0").cast("float").alias("k"), "c1").fold(lambda a, b: a, zero=0, schema="a long", strict=True), "fold"),
        (lambda: sources.const(spark, 2, [1], [1, 2]), "const"),
        (lambda: ds.reduce(lambda a: a), "reduce"),
        (lambda: ds.prefixed(2).reduce("sum"), "reduce"),
    ]:
        with pytest.raises(TypeCheckError) as e:
            bad()
        assert e.value.operator == word and __file__ in str(e.value)


def test_a_predicate_must_be_boolean(spark):
    with pytest.raises(Exception, match="bool"):
        const(spark, ROWS, "c0 long, c1 string").filter(lambda a, b: 1).df.collect()


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(max_size=5), st.integers(-(2**40), 2**40)), max_size=30))
def test_const_round_trip(spark, pairs):
    assert_rows_equal(const(spark, pairs, "a string, b long", 3), pairs)
