import io
import os
import shutil
import tarfile

import pytest
from pyspark.sql import functions as F

from shardloom import EOF, Session, drain, func, read_cache, sources, streaming
from shardloom.metrics import Counter, Scope
from shardloom.operators.sinks import Store, write_tsv
from shardloom.session import Func
from shardloom.testing import assert_rows_equal, by_shard, rows, show
from shardloom.types import TypeCheckError


def test_lines_two_ways(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("".join(f"{i}\n" for i in range(1000)))
    assert sum(int(r[0]) for r in rows(sources.scan_lines(spark, str(path)))) == 499_500
    for shards in (2, 13):
        got = sources.scan_reader(spark, shards, lambda: open(path, "rb"))
        assert len(rows(got)) == 1000  # no line too many
        assert by_shard(got)[1][0] == ("1",)


def test_lines_of_nothing(spark, tmp_path):
    path = tmp_path / "empty.txt"
    path.write_text("")
    assert rows(sources.scan_reader(spark, 3, lambda: open(path))) == []


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "a.tar"
    with tarfile.open(path, "w") as t:
        for i in range(60):
            info = tarfile.TarInfo(f"{i:03d}")
            info.size = i
            t.addfile(info, io.BytesIO(bytes([i]) * i))
    return str(path)


def test_tar_by_path_and_by_opener(spark, archive):
    for ds in (sources.tar_reader(spark, archive), sources.tar_reader(spark, lambda: open(archive, "rb"), 5)):
        got = {r.header.name: bytes(r.body) for r in ds.df.collect()}
        assert got == {f"{i:03d}": bytes([i]) * i for i in range(60)}


def test_reader_func_generator_and_state(spark):
    def letters(shard: int):
        yield from ((i, chr(96 + i)) for i in range(1, 27) if i % 6 == shard)

    assert_rows_equal(sources.reader_func(spark, 6, letters, "i long, s string"), [(i, chr(96 + i)) for i in range(1, 27)])

    def batches(shard: int, state: dict):
        state["n"] = state.get("n", 0) + 1
        return None if state["n"] > 12 else [] if state["n"] < 11 else [shard * 10 + state["n"] % 10]

    assert_rows_equal(sources.reader_func(spark, 2, batches, "i long"), [(1,), (2,), (11,), (12,)])


def test_reader_func_error_fails(spark):
    def bad(shard: int):
        yield (1,)
        raise ValueError("broken source")

    with pytest.raises(Exception, match="broken source"):
        sources.reader_func(spark, 2, bad, "i long").df.collect()


def test_keyed_generator(spark):
    got = sources.keyed_generator(spark, 3, 50)
    assert sorted(r[0] for r in got.df.collect()) == sorted(list(range(50)) * 3)


def test_tsv(spark, tmp_path):
    write_tsv(sources.const(spark, 2, ["a", "b"], [1, 2]), str(tmp_path / "t"))
    assert_rows_equal(sources.read_tsv(spark, str(tmp_path / "t"), "a string, b long"), [("a", 1), ("b", 2)])


def test_writer_sees_every_row_and_the_end(spark, tmp_path):
    folder = str(tmp_path)

    def write(shard, state, err, s, x):
        state["lines"] = state.get("lines", []) + [f"{a}{b}" for a, b in zip(s, x, strict=True)]
        if err is not None:
            with open(f"{folder}/attempt-{shard}", "w") as f:
                f.write(" ".join(state["lines"]))
            os.rename(f"{folder}/attempt-{shard}", f"{folder}/{shard}")

    ds = sources.const(spark, 2, list("abcabc"), [3, 3, 2, 2, 1, 1])
    assert_rows_equal(ds.writer_func(write), list(zip("abcabc", [3, 3, 2, 2, 1, 1], strict=True)))
    assert [open(f"{folder}/{k}").read() for k in (0, 1)] == ["a3 b3 c2", "a2 b1 c1"]
    assert isinstance(EOF, EOFError)


def test_writer_error_fails(spark):
    def bad(shard, state, err, x):
        raise OSError("disk full")

    with pytest.raises(Exception, match="disk full"):
        sources.const(spark, 2, [1, 2]).writer_func(bad).df.collect()


def test_scan_visits_every_row_and_shard(spark):
    seen, shards = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def visit(shard, found):
        seen.add(sum(1 for _ in found))
        shards.add(1)

    ds = sources.const(spark, 10, list(range(1000))).scan(visit)
    assert ds.df.columns == []
    drain(ds)
    assert (seen.value, shards.value) == (1000, 10)


@pytest.fixture
def counted(spark):
    calls = spark.sparkContext.accumulator(0)

    def double(i: int) -> int:
        calls.add(1)
        return i * 2

    return calls, lambda: sources.const(spark, 10, list(range(1000))).map(double)


WANT = [(i * 2,) for i in range(1000)]


def test_cache_runs_once(spark, counted, tmp_path):
    calls, make = counted
    path = str(tmp_path / "c")
    assert_rows_equal(make().cache(path), WANT)
    assert len([d for d in os.listdir(path) if d.startswith("shard=")]) == 10
    assert_rows_equal(make().cache(path), WANT)
    assert calls.value == 1000
    for k in range(5):
        shutil.rmtree(f"{path}/shard={k:04d}-of-0010")
    assert_rows_equal(make().cache(path), WANT)
    assert calls.value == 2000  # all or nothing


def test_cache_partial_computes_what_is_missing(spark, counted, tmp_path):
    calls, make = counted
    path = str(tmp_path / "c")
    assert_rows_equal(make().cache_partial(path), WANT)
    for k in range(5):
        shutil.rmtree(f"{path}/shard={k:04d}-of-0010")
    assert_rows_equal(make().cache_partial(path), WANT)
    assert calls.value == 1500


def test_read_cache_and_missing_shards(spark, counted, tmp_path):
    path = str(tmp_path / "c")
    counted[1]().cache(path)
    got = read_cache(spark, "c0 long", 10, path)
    assert_rows_equal(got, WANT)
    assert by_shard(got)[0] == [(i * 2,) for i in range(100)]
    shutil.rmtree(f"{path}/shard=0003-of-0010")
    with pytest.raises(FileNotFoundError, match="3"):
        read_cache(spark, "c0 long", 10, path)
    with pytest.raises(TypeCheckError):
        Store(spark, "", 10, "cache")


def test_cache_of_a_failing_source_stores_nothing(spark, tmp_path):
    path = str(tmp_path / "c")

    def bad(shard: int):
        yield (1,)
        raise ValueError("broken")

    with pytest.raises(Exception, match="broken"):
        sources.reader_func(spark, 2, bad, "i long").cache(path)
    assert Store(spark, path, 2, "cache").missing() == [0, 1]


def test_cache_of_empty_shards(spark, tmp_path):
    ds = sources.const(spark, 4, [1])
    assert_rows_equal(ds.cache(str(tmp_path / "e")), [(1,)])
    assert_rows_equal(ds.cache(str(tmp_path / "e")), [(1,)])
    none = sources.const(spark, 2, [], schema="a long")
    assert rows(none.cache(str(tmp_path / "n"))) == [] == rows(none.cache(str(tmp_path / "n")))


# ------------------------------------------------------------------ sessions


@func
def numbers(spark, n: int):
    return sources.const(spark, 5, list(range(n)))


@func
def add(spark, ds, k: int):
    return ds.map((F.col("c0") + k).alias("c0"))


def test_results_are_reused(spark):
    session = Session(spark)
    result = session.run(numbers, 1000)
    for k in range(5):
        result = session.run(add, result, k)
    assert sorted(r[0] for r in result.scanner()) == list(range(10, 1010))
    result.discard()
    assert len(result.collect()) == 1000  # recomputed


def test_a_kept_result_is_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def once(i):
        calls.add(1)
        return i

    session = Session(spark)
    result = session.run(lambda s: sources.const(s, 4, list(range(500))).map(once, schema="i long"))
    session.run(lambda s, ds: ds.map((F.col("i") / 2).cast("long").alias("k"), "i").reduce("sum"), result)
    session.run(lambda s, ds: ds.map((F.col("i") * 2).alias("i")), result)
    assert calls.value == 500


def test_function_arguments_are_checked(spark):
    session = Session(spark)
    for bad in (("x",), (1, 2), (None,), (True,)):
        with pytest.raises(TypeCheckError):
            session.run(numbers, *bad)

    def optional(spark, a: int | None, b: list[str], c: dict[int, int]):
        return sources.const(spark, 1, [a or 0])

    f = Func(optional, "here")
    f.check((None, ["x"], {1: 2}))
    with pytest.raises(TypeCheckError):
        f.check((1, None, {}))
    with pytest.raises(SystemExit):
        session.must(numbers, "x")


def test_counters(spark):
    ones = Counter("total")
    drain(ones.over(sources.const(spark, 2, [1, 2, 3]), F.col("c0")))
    assert ones.value == 6
    scope, other = Scope(spark), Scope(spark)
    dropped = scope.counter("dropped")

    def odd(i):
        if i % 2 == 0:
            dropped.add(1)
        return i % 2 == 1

    drain(sources.const(spark, 2, [1, 2, 3, 4, 5, 6]).filter(odd))
    assert scope.value("dropped") == 3
    other.merge(scope)
    assert other.value("dropped") == 3
    scope.reset()
    assert scope.value("dropped") == 0


def test_show_and_config(spark, tmp_path):
    assert show(sources.const(spark, 2, [2, 1], ["b", "a"])) == "1 a\n2 b"
    assert Session.from_config(str(tmp_path / "none")).spark is spark


def test_streams(spark, tmp_path):
    sources.const(spark, 2, ["a", "b", "a"], [1, 2, 3], schema="k string, v long").df.write.parquet(str(tmp_path / "in"))
    stream = streaming.read_stream(spark, str(tmp_path / "in"), "k string, v long")
    assert sorted(map(tuple, streaming.drain(streaming.reduce_stream(stream, ["k"], "v", "sum"), "sums").collect())) == [("a", 4), ("b", 2)]


# ------------------------------------------------------------------ splits, hints, scanners, sessions


def test_shards_of_a_file_source_are_its_splits(spark, tmp_path):
    from shardloom import plans

    path = str(tmp_path / "t")
    spark.range(0, 100, 1, 5).selectExpr("id", "id % 3 k").write.parquet(path)
    ds = sources.read_table(spark, path)
    splits = by_shard(ds)
    assert len(splits) == ds.by_shard().num_shards > 1 and sum(map(len, splits)) == 100
    head = ds.head(2)
    assert plans.exchanges(head.df) == 0 and [tuple(r) for r in head.df.collect()] == [r for part in splits for r in part[:2]]
    seen = spark.sparkContext.accumulator(0)

    def visit(shard, found):
        seen.add(sum(1 for _ in found))

    scanned = ds.scan(visit)
    assert plans.exchanges(scanned.df) == 0
    drain(scanned)
    assert seen.value == 100
    written = ds.writer_func(lambda shard, state, err, *columns: None)
    assert plans.exchanges(written.df) == 0
    calls = spark.sparkContext.accumulator(0)

    def once(i: int, k: int) -> int:
        calls.add(1)
        return i

    cache = str(tmp_path / "c")
    assert_rows_equal(ds.map(once).cache_partial(cache), [(i,) for i in range(100)])
    n = len(splits)
    shutil.rmtree(f"{cache}/shard=0000-of-{n:04d}")
    assert_rows_equal(ds.map(once).cache_partial(cache), [(i,) for i in range(100)])
    assert calls.value == 100 + len(splits[0])


def test_materialize_keeps_rows_for_every_reader(spark):
    from shardloom import MATERIALIZE

    calls = spark.sparkContext.accumulator(0)

    def count_call(i):
        calls.add(1)
        return i

    kept = sources.const(spark, 3, list(range(30))).map(count_call, schema="i long", pragma=MATERIALIZE)
    assert len(rows(kept.map(F.col("i") + 1))) == len(rows(kept.filter("i >= 0"))) == 30
    assert calls.value == 30
    kept.df.unpersist()


def test_large_archives_are_streamed(spark, archive, monkeypatch):
    from shardloom.sources import files

    monkeypatch.setattr(files, "WHOLE_BYTES", 1)
    assert len(sources.tar_reader(spark, archive).df.collect()) == 60


def test_scanner(spark):
    from shardloom import Scanner

    ds = sources.const(spark, 3, [1, 2, 3], ["a", "b", "c"])
    with Scanner(ds, int, str) as scanner:
        assert tuple(scanner.scan()) == (1, "a") and len(scanner.scanv(5)) == 2 and scanner.scan() is None and scanner.err is None
    for bad in ((int,), (int, int), (str, str), (int, str, str)):
        with pytest.raises(TypeCheckError):
            Scanner(ds, *bad)
    closed = Scanner(ds, "bigint", "string")
    closed.close()
    assert list(closed) == []

    def broken(i):
        raise ValueError("broken row")

    failing = Scanner(sources.const(spark, 1, [1]).map(broken, schema="i long"))
    assert failing.scan() is None and "broken row" in str(failing.err) and failing.scan() is None


def test_invocations_scopes_and_events(spark):
    from shardloom.metrics import Scope as Counters

    told = []
    session = Session(spark, eventer=lambda name, **fields: told.append((name, fields["func"], fields.get("state"))))
    call = numbers.invocation(7)
    assert numbers.num_in == 1 and call.args == (7,) and len(rows(call.invoke(spark))) == 7 == len(rows(numbers.apply(spark, 7)))
    with pytest.raises(TypeCheckError):
        numbers.invocation("x")

    @func(exclusive=True)
    def counting(spark, n: int):
        odd = Counters.current().counter("odd")

        def one(i):
            odd.add(i % 2)
            return i

        return sources.const(spark, 2, list(range(n))).map(one, schema="i long")

    result = session.run(counting, 10)
    assert result.scope.value("odd") == 5 and session.run(numbers, 3).scope.counters == {}
    assert told == [("run:start", "counting", None), ("run:end", "counting", "ok"), ("run:start", "numbers", None), ("run:end", "numbers", "ok")]
    with pytest.raises(LookupError):
        Counters.current()
    pages: dict = {}
    session.handle_debug(pages)
    assert "max_load 0.95" in pages["/debug/session"]() and pages["/debug/stages"]() == ""
    assert session.status()["running_programs"] == 0


def test_exclusive_programs_run_alone(spark):
    import threading

    session, order = Session(spark), []
    session._enter(False)
    other = threading.Thread(target=lambda: (session._enter(True), order.append("alone"), session._leave(True)))
    other.start()
    other.join(0.2)
    order.append("first done")
    session._leave(False)
    other.join(5)
    assert order == ["first done", "alone"]


def test_config_files(spark, tmp_path, monkeypatch):
    given = {}
    monkeypatch.setattr(Session, "start", classmethod(lambda cls, **kw: given.update(kw)))
    (tmp_path / "c").write_text("[shardloom]\nlocal = true\nparallelism = 7\nmax-load = 0.5\nmachine-combiners = yes\nother = 1\n")
    Session.from_config(str(tmp_path / "c"))
    assert given == {"local": os.cpu_count(), "parallelism": 7, "max_load": 0.5, "machine_combiners": True}
    given.clear()
    (tmp_path / "c").write_text("[shardloom]\nlocal = 3\n")
    Session.from_config(str(tmp_path / "c"), ["-parallelism", "9"])
    assert given == {"local": 3, "parallelism": 9}


def test_keyed_generator_beyond_32_bits(spark):
    got = sources.keyed_generator(spark, 2, 1 << 33)
    few = got.df.limit(3).collect()
    assert all(0 <= r.key < 1 << 33 for r in few)
