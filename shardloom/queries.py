"""One registered query per operator or idiom, over the whole test tables, with the same result as DuckDB SQL."""

from __future__ import annotations

import io
import operator
import tarfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import functions as fn
from . import sources
from .dataset import Dataset
from .metrics import Counter
from .operators import aggregate, cogroup, sinks
from .session import Session

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns) -> Dataset:
    ds = sources.read_table(spark, f"{sf_dir}/{name}.parquet")
    return ds.map(*columns) if columns else ds


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder, or beside the warehouse where none is set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ reduce and fold


@query("select w, count(*) n from (select unnest(regexp_split_to_array(text, '[ \\n\\t\\r]+')) w from documents) where w <> '' group by 1")
def wordcount(spark, sf_dir):
    words = table(spark, sf_dir, "documents", "text").flatmap(fn.fields(F.col("text")).alias("w"))
    return aggregate.count(words).df


@query("select l_returnflag, cast(sum(cast(l_quantity as bigint)) as bigint) q from lineitem group by 1")
def reduce_sum_by_key(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", F.col("l_quantity").cast("long").alias("q")).reduce(operator.add).df


@query("select l_returnflag, l_linestatus, count(*) n from lineitem group by 1, 2")
def reduce_prefix2_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", F.lit(1).cast("long").alias("n")).prefixed(2).reduce("sum").df


@query("select o_custkey, max(o_totalprice) p from orders group by 1")
def reduce_max(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_custkey", F.col("o_totalprice").alias("p")).reduce(max).df


@query("select event_type, max(user_id) user_id from events group by 1")
def reduce_lambda_max(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type", "user_id").reduce_expr(lambda a, b: F.greatest(a, b)).df


@query("select l_returnflag, cast(sum(cast(l_quantity as bigint)) as bigint) q from lineitem group by 1")
def reduce_python_two_phase(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", F.col("l_quantity").cast("long").alias("q")).reduce(lambda a, b: a + b).df


@query("select l_returnflag, l_linestatus, cast(product(cast(u as double)) as bigint) u from (select distinct l_returnflag, l_linestatus, l_linenumber * 10 + 1 u from lineitem) group by 1, 2")
def reduce_product(spark, sf_dir):
    """Integers multiply exactly (here below 2^53, so that SQL's doubles do too)."""
    units = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", (F.col("l_linenumber") * 10 + 1).cast("long").alias("u")).prefixed(2)
    return units.distinct().reduce(operator.mul).df


_NULLS = "select o_orderpriority, cast(sum({0}) as bigint) q from (select o_orderpriority, case when o_orderkey % 3 = 0 and o_orderpriority not like '1%' then cast(o_orderkey as bigint) end v from orders) group by 1"


@query("select 'built in' way, * from ({0}) union all select 'expr', * from ({0}) union all select 'python', * from ({0})".format(_NULLS.format("v")))
def reduce_nulls(spark, sf_dir):
    """Nulls are left out in every way of reduce; a key of nulls alone has null."""
    value = F.when((F.col("o_orderkey") % 3 == 0) & ~F.col("o_orderpriority").startswith("1"), F.col("o_orderkey").cast("long")).alias("q")
    ds = table(spark, sf_dir, "orders", "o_orderpriority", value)
    ways = {"built in": ds.reduce(operator.add), "expr": ds.reduce_expr(lambda a, b: a + b), "python": ds.reduce(lambda a, b: a + b)}
    return cogroup.union(*[out.map(F.lit(way).alias("way"), "o_orderpriority", "q") for way, out in ways.items()]).df


@query("select count(*) n from lineitem")
def reduce_global_unit_key(spark, sf_dir):
    return aggregate.total(table(spark, sf_dir, "lineitem", "l_orderkey"), n=F.count(F.lit(1))).df


@query("select o_custkey, count(*) n, max(o_orderkey) last, round(sum(o_totalprice), 2) spent from orders group by 1")
def fold_multi_acc(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return ds.fold(n=F.count(F.lit(1)), last=F.max("o_orderkey"), spent=F.round(F.sum("o_totalprice"), 2)).df


@query("select o_custkey, cast(sum(o_orderkey) as bigint) total, max(o_orderkey) largest from orders group by 1")
def fold_hof_struct(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).cast("long").alias("largest"))
    step = lambda a, total, largest: F.struct((a["total"] + total).alias("total"), F.greatest(a["largest"], largest).alias("largest"))
    out = ds.fold_expr(zero, lambda a, x: step(a, x["o_orderkey"], x["o_orderkey"]), combine=lambda a, b: step(a, b["total"], b["largest"]))
    return out.df.select("o_custkey", "acc.total", "acc.largest")


@query("select o_custkey, cast(sum(o_orderkey) as bigint) total, count(*) n from orders group by 1")
def fold_python(spark, sf_dir):
    ds = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    return ds.fold(lambda acc, k: (acc[0] + k, acc[1] + 1), zero=(0, 0), schema="total long, n long").df


@query("select distinct l_returnflag, l_linestatus from lineitem")
def distinct_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus").distinct().df


# ------------------------------------------------------------------ cogroup and joins


@query(
    """select coalesce(a.k, b.k) k, coalesce(orders, '') orders, coalesce(names, '') names
    from (select o_custkey k, string_agg(cast(o_orderkey as varchar), ',' order by cast(o_orderkey as varchar)) orders from orders group by 1) a
    full join (select c_custkey k, string_agg(c_name, ',' order by c_name) names from customer group by 1) b on a.k = b.k"""
)
def cogroup_two(spark, sf_dir):
    a = table(spark, sf_dir, "orders", F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("string").alias("orders"))
    b = table(spark, sf_dir, "customer", F.col("c_custkey").alias("k"), F.col("c_name").alias("names"))
    out = a.cogroup(b)
    return out.map("k", fn.joined(F.col("orders")).alias("orders"), fn.joined(F.col("names")).alias("names")).df


@query(
    """select k, coalesce(string_agg(s, ',' order by s) filter (where t = 0), '') suppliers, coalesce(string_agg(s, ',' order by s) filter (where t = 1), '') nations,
      cast(count(*) filter (where t = 2) as bigint) customers
    from (select s_nationkey k, s_name s, 0 t from supplier union all select n_nationkey, n_name, 1 from nation union all select c_nationkey, c_name, 2 from customer) group by 1"""
)
def cogroup_three(spark, sf_dir):
    a = table(spark, sf_dir, "supplier", F.col("s_nationkey").alias("k"), F.col("s_name").alias("suppliers"))
    b = table(spark, sf_dir, "nation", F.col("n_nationkey").alias("k"), F.col("n_name").alias("nations"))
    c = table(spark, sf_dir, "customer", F.col("c_nationkey").alias("k"), F.col("c_name").alias("customers"))
    out = cogroup.cogroup(a, b, c)
    return out.map("k", fn.joined(F.col("suppliers")).alias("suppliers"), fn.joined(F.col("nations")).alias("nations"), F.size("customers").cast("long").alias("customers")).df


@query(
    """select k1, k2, cast(count(*) filter (where t = 0) as bigint) lines, cast(count(*) filter (where t = 1) as bigint) big
    from (select l_partkey k1, l_suppkey k2, 0 t from lineitem union all select l_partkey, l_suppkey, 1 from lineitem where l_quantity >= 45) group by 1, 2"""
)
def cogroup_prefix2(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", F.col("l_partkey").alias("k1"), F.col("l_suppkey").alias("k2"), "l_quantity").prefixed(2)
    big = lines.filter("l_quantity >= 45").with_df(lines.df.where("l_quantity >= 45").withColumnRenamed("l_quantity", "big"))
    return lines.cogroup(big).map("k1", "k2", F.size("l_quantity").cast("long").alias("lines"), F.size("big").cast("long").alias("big")).df


@query("select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by cast(o_orderkey as varchar)) orders from orders group by 1")
def cogroup_one(spark, sf_dir):
    out = table(spark, sf_dir, "orders", "o_custkey", F.col("o_orderkey").cast("string").alias("orders")).cogroup()
    return out.map("o_custkey", fn.joined(F.col("orders")).alias("orders")).df


def _customers(spark, sf_dir) -> Dataset:
    return table(spark, sf_dir, "customer", F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))


@query("select c_mktsegment segment, count(*) n from orders join customer on o_custkey = c_custkey group by 1")
def join_inner(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", F.col("o_custkey").alias("k"), "o_orderkey")
    return aggregate.count(orders.join(_customers(spark, sf_dir)).map("segment")).df


@query("select n_name, s_name from nation left join supplier on n_nationkey = s_nationkey")
def join_left(spark, sf_dir):
    n = table(spark, sf_dir, "nation", F.col("n_nationkey").alias("k"), "n_name")
    s = table(spark, sf_dir, "supplier", F.col("s_nationkey").alias("k"), "s_name")
    return n.join(s, "left").map("n_name", "s_name").df


@query("select n_name, s_name from supplier right join nation on n_nationkey = s_nationkey")
def join_right(spark, sf_dir):
    n = table(spark, sf_dir, "nation", F.col("n_nationkey").alias("k"), "n_name")
    s = table(spark, sf_dir, "supplier", F.col("s_nationkey").alias("k"), "s_name")
    return s.join(n, "right").map("n_name", "s_name").df


@query(
    """select coalesce(c.nation, s.nation) nation, coalesce(c.band, s.band) band, customers, suppliers
    from (select c_nationkey nation, cast(floor(c_acctbal / 50) as bigint) band, count(*) customers from customer group by 1, 2) c
    full join (select s_nationkey nation, cast(floor(s_acctbal / 50) as bigint) band, count(*) suppliers from supplier group by 1, 2) s
    on c.nation = s.nation and c.band = s.band"""
)
def join_full(spark, sf_dir):
    """Bands of balances in a nation; some hold customers only, some suppliers only."""

    def bands(name: str, prefix: str, n: str) -> Dataset:
        band = F.floor(F.col(f"{prefix}_acctbal") / 50).cast("long").alias("band")
        return table(spark, sf_dir, name, F.col(f"{prefix}_nationkey").alias("nation"), band, F.lit(1).cast("long").alias(n)).prefixed(2).reduce("sum")

    return bands("customer", "c", "customers").join(bands("supplier", "s", "suppliers"), "full").map("nation", "band", "customers", "suppliers").df


@query("select p_partkey k, p_name from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50 and l_discount >= 0.1)")
def join_semi(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1").map(F.col("l_partkey").alias("k"))
    return table(spark, sf_dir, "part", F.col("p_partkey").alias("k"), "p_name").join(hit, "left_semi").df


@query("select p_partkey k, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity >= 50 and l_discount >= 0.1)")
def join_anti(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.1").map(F.col("l_partkey").alias("k"))
    return table(spark, sf_dir, "part", F.col("p_partkey").alias("k"), "p_name").join(hit, "left_anti").df


# ------------------------------------------------------------------ narrow


@query("select o_orderkey, o_custkey * 2 twice, upper(o_orderpriority) priority from orders")
def map_project(spark, sf_dir):
    return table(spark, sf_dir, "orders").map("o_orderkey", (F.col("o_custkey") * 2).alias("twice"), F.upper("o_orderpriority").alias("priority")).df


def _squared(k: int, s: str) -> tuple[int, str]:
    return k * k, s + ".squared"


@query("select n_nationkey * n_nationkey c0, n_name || '.squared' c1 from nation")
def map_python(spark, sf_dir):
    return table(spark, sf_dir, "nation", F.col("n_nationkey").cast("long"), "n_name").map(_squared).df.select("c0", "c1")


@query("select l_orderkey, l_linenumber from lineitem where l_discount >= 0.05 and l_quantity < 24")
def filter_pred(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_discount >= 0.05 and l_quantity < 24").map("l_orderkey", "l_linenumber").df


@query("select event_id, event_type from events where event_id % 2 = 0")
def filter_python(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "event_type").filter(lambda i, kind: i % 2 == 0).df


@query("select w, cast(length(w) as bigint) n from (select unnest(string_split(p_name, ' ')) w from part)")
def flatmap_pair(spark, sf_dir):
    words = F.split("p_name", " ")
    return table(spark, sf_dir, "part").flatmap(words.alias("w"), F.transform(words, lambda w: F.length(w).cast("long")).alias("n")).df


@query("select w, cast(length(w) as bigint) n from (select unnest(string_split(p_name, ' ')) w from part)")
def flatmap_python(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_name").flatmap(lambda s: (s.split(" "), [len(w) for w in s.split(" ")]), schema="w string, n long").df


@query("select event_id from events qualify row_number() over (partition by event_id % 4 order by event_id) <= 3")
def head_per_shard(spark, sf_dir):
    ds = table(spark, sf_dir, "events", "event_id")
    placed = Dataset(ds.df, 1, 4).repartition((F.col("event_id") % 4).cast("int"))
    return placed.narrow(lambda df: df.sortWithinPartitions("event_id"), "sorted").head(3).df


@query("select cast(count(*) > 0 as integer) any_row, cast(1 as integer) as_many from part")
def head_of_splits(spark, sf_dir):
    """Shards of a file source are its splits: the first rows of each, without a shuffle."""
    ds = table(spark, sf_dir, "part", "p_partkey")
    sizes = lambda df, n: df.groupBy(F.spark_partition_id().alias("shard")).agg(F.count(F.lit(1)).alias(n))
    both = sizes(ds.df, "all").join(sizes(ds.head(7).df, "got"), "shard", "left")
    return both.agg((F.sum("got") > 0).cast("int").alias("any_row"), F.min((F.coalesce("got", F.lit(0)) == F.least("all", F.lit(7))).cast("int")).alias("as_many"))


@query("select n_nationkey, n_name from nation order by n_name desc limit 6")
def head_single_shard(spark, sf_dir):
    one = Dataset(table(spark, sf_dir, "nation", "n_nationkey", "n_name").df, 1, 1).repartition(F.lit(0))
    return one.narrow(lambda df: df.sortWithinPartitions(F.desc("n_name")), "sorted").head(6).df


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def top_k(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").top(10, F.desc("o_totalprice"), "o_orderkey").df


@query("select s_suppkey, cast(row_number() over (order by s_acctbal, s_suppkey) as bigint) place from supplier")
def sort_rows(spark, sf_dir):
    ds = table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal").sort("s_acctbal", "s_suppkey")
    placed = ds.df.select("s_suppkey", F.monotonically_increasing_id().alias("at"))  # rises with the order of partitions and rows
    return placed.select("s_suppkey", F.row_number().over(Window.orderBy("at")).cast("long").alias("place"))


@query("select * from (values (0, 'zero'), (1, 'one'), (2, 'two'), (3, 'three')) t(c0, c1)")
def const_rows(spark, sf_dir):
    return sources.const(spark, 2, [0, 1, 2, 3], ["zero", "one", "two", "three"], schema="c0 int, c1 string").df


# ------------------------------------------------------------------ shuffles


@query("select cast(l_orderkey % 4 as integer) shard, count(*) n from lineitem group by 1")
def repartition_by_id(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "lineitem", "l_orderkey").df, 1, 4).repartition((F.col("l_orderkey") % 4).cast("int"))
    return ds.df.select(F.spark_partition_id().alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(length(event_type) % 3 as integer) shard, count(*) n from events group by 1")
def repartition_python(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "events", "event_type").df, 1, 3).repartition(lambda n, kind: len(kind) % n)
    return ds.df.select(F.spark_partition_id().alias("shard")).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query("select count(distinct o_custkey) n_keys, cast(0 as bigint) spread from orders")
def reshuffle_colocated(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").df, 1, 7).reshuffle()
    per_key = ds.df.select("o_custkey", F.spark_partition_id().alias("shard")).distinct().groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.count(F.lit(1)).alias("n_keys"), F.sum((F.col("n") > 1).cast("long")).alias("spread"))


@query("select count(*) n, count(distinct o_custkey) n_keys, cast(5 as bigint) shards, cast(0 as bigint) spread from orders")
def reshard_multiset(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").df, 1, 3).reshard(5)
    placed = ds.df.select("o_custkey", F.spark_partition_id().alias("shard"))
    per_key = placed.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("shard").alias("a"), F.max("shard").alias("b"))
    shards = F.lit(ds.df.rdd.getNumPartitions()).cast("long")
    return per_key.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_keys"), shards.alias("shards"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("spread"))


# ------------------------------------------------------------------ sources


@query("select cast(i % 6 as integer) shard, count(*) n, cast(sum(i) as bigint) total from range(1, 27) t(i) group by 1")
def reader_func_range(spark, sf_dir):
    def letters(shard: int):
        yield from ((i,) for i in range(1, 27) if i % 6 == shard)

    ds = sources.reader_func(spark, 6, letters, "i long")
    return ds.df.groupBy(F.spark_partition_id().alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("total"))


@query("select unnest(string_split(text, chr(10))) line from documents")
def scan_reader_lines(spark, sf_dir):
    path = scratch(spark, "lines")
    table(spark, sf_dir, "documents", "text").df.write.text(path)
    return sources.scan_lines(spark, path).df.select(F.col("c0").alias("line"))


@query("select n_name line, cast((row_number() over (order by n_nationkey) - 1) % 3 as integer) shard from nation")
def scan_reader_striped(spark, sf_dir):
    """One input that cannot be read in splits, its lines dealt out in turn."""
    rows = table(spark, sf_dir, "nation", "n_nationkey", "n_name").df.orderBy("n_nationkey").collect()
    data = "".join(f"{r.n_name}\n" for r in rows).encode()
    ds = sources.scan_reader(spark, 3, lambda: io.BytesIO(data))
    return ds.df.select(F.col("c0").alias("line"), F.spark_partition_id().alias("shard"))


@query("select 'entry-' || n_nationkey name, cast(length(n_name) as bigint) size, n_name body from nation")
def tar_entries(spark, sf_dir):
    rows = table(spark, sf_dir, "nation", "n_nationkey", "n_name").df.collect()
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w") as archive:
        for r in rows:
            info = tarfile.TarInfo(f"entry-{r.n_nationkey}")
            info.size = len(r.n_name)
            archive.addfile(info, io.BytesIO(r.n_name.encode()))
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark, "tar") + "/nations.tar")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    return sources.tar_reader(spark, path.toString()).df.select("header.name", "header.size", F.col("body").cast("string").alias("body"))


@query("select n_name, n_regionkey from nation")
def tsv_roundtrip(spark, sf_dir):
    path = scratch(spark, "tsv")
    sinks.write_tsv(table(spark, sf_dir, "nation", "n_name", "n_regionkey"), path)
    return sources.read_tsv(spark, path, "n_name string, n_regionkey int").df


@query("select coalesce(nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), ''), '<unknown>') host, count(*) n from pages group by 1")
def urls_domain_count(spark, sf_dir):
    return aggregate.count(table(spark, sf_dir, "pages").map(fn.url_host(F.col("url")).alias("host"))).df


@query("select key, cast(4 as bigint) n from range(1000) t(key)")
def keyed_generator_counts(spark, sf_dir):
    return aggregate.count(sources.keyed_generator(spark, 4, 1000)).df


# ------------------------------------------------------------------ side effects, caches, sessions


def _doubled(spark, ds: Dataset):
    """The dataset with its last column doubled by a Python function, and a counter of the function's calls."""
    calls = spark.sparkContext.accumulator(0)

    def double(k: int, v: int) -> tuple[int, int]:
        calls.add(1)
        return k, v * 2

    return ds.by_shard().map(double), calls


@query("select c0, c1, cast(1 as bigint) computed from (select cast(p_partkey as bigint) c0, cast(p_size as bigint) * 2 c1 from part)")
def cache_roundtrip(spark, sf_dir):
    """``computed``: how often each row was computed, for three uses of the cache."""
    ds, calls = _doubled(spark, Dataset(table(spark, sf_dir, "part", F.col("p_partkey").cast("long"), F.col("p_size").cast("long")).df, 1, 6))
    path = scratch(spark, "cache")
    out = [ds.cache(path) for _ in range(3)][-1].df
    return out.withColumn("computed", F.lit(calls.value / out.count()).cast("long"))


@query("select c0, c1, cast(1 as bigint) computed from (select cast(o_orderkey as bigint) c0, cast(o_custkey as bigint) * 2 c1 from orders)")
def cache_partial(spark, sf_dir):
    """As cache_roundtrip, three of six shards being there before."""
    ds, calls = _doubled(spark, Dataset(table(spark, sf_dir, "orders", F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")).df, 1, 6))
    path = scratch(spark, "partial")
    sinks.Store(spark, path, 6, "cache_partial").write(ds, [0, 2, 4])
    out = ds.cache_partial(path).df
    return out.withColumn("computed", F.lit(calls.value / out.count()).cast("long"))


@query("select s_suppkey, s_name from supplier")
def read_cache(spark, sf_dir):
    ds = Dataset(table(spark, sf_dir, "supplier", "s_suppkey", "s_name").df, 1, 3)
    path = scratch(spark, "read")
    ds.cache(path)
    return sinks.read_cache(spark, "s_suppkey long, s_name string", 3, path).df


@query("select event_id, cast(event_id % 4 as integer) shard, n seen, cast(4 as bigint) ends from (select event_id, count(*) over () n from events)")
def writer_func_passthrough(spark, sf_dir):
    """The rows with their shard, the rows that the writers saw, and the ends that they were told."""
    seen, ends = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def write(shard, state, err, ids):
        state["rows"] = state.get("rows", 0) + len(ids)
        if err is not None:
            seen.add(state["rows"])
            ends.add(1)

    placed = Dataset(table(spark, sf_dir, "events", "event_id").df, 1, 4).repartition((F.col("event_id") % 4).cast("int"))
    out = placed.writer_func(write)
    sinks.drain(out)
    return out.df.select("event_id", F.spark_partition_id().alias("shard"), F.lit(seen.value).cast("long").alias("seen"), F.lit(ends.value).cast("long").alias("ends"))


@query("select count(*) n, count(distinct shard) shards from (select event_id % 5 shard from events)")
def scan_side_effect(spark, sf_dir):
    seen, shards = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def visit(shard, rows):
        n = sum(1 for _ in rows)
        seen.add(n)
        shards.add(1 if n else 0)

    ds = Dataset(table(spark, sf_dir, "events", "event_id").df, 1, 5).repartition((F.col("event_id") % 5).cast("int"))
    sinks.drain(ds.scan(visit))
    return spark.createDataFrame([(seen.value, shards.value)], "n long, shards long")


@query("select count(*) filter (where event_type = 'error') n from events")
def metrics_filtered(spark, sf_dir):
    counter = Counter("errors")
    ds = counter.over(table(spark, sf_dir, "events", "event_type").filter("event_type = 'error'"))
    sinks.drain(ds)
    return spark.createDataFrame([(counter.value,)], "n long")


@query("select o_orderkey + 10 x from orders")
def iterate_add(spark, sf_dir):
    session = Session(spark)
    result = session.run(lambda s: table(s, sf_dir, "orders", F.col("o_orderkey").alias("x")))
    for i in range(5):
        result = session.run(lambda s, ds, i=i: ds.map((F.col("x") + i).alias("x")), result)
    return result.dataset.df


@query("select n_name name, n_regionkey region from nation union all select r_name, r_regionkey from region")
def union_rows(spark, sf_dir):
    a = table(spark, sf_dir, "nation", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return cogroup.union(a, table(spark, sf_dir, "region", F.col("r_name").alias("name"), F.col("r_regionkey").alias("region"))).df


@query("select o_custkey % 10 k, cast(sum(o_orderkey) as bigint) total from orders group by 1")
def result_reduced(spark, sf_dir):
    """A kept result as the input of a shuffle."""
    session = Session(spark)
    kept = session.run(lambda s: table(s, sf_dir, "orders", (F.col("o_custkey") % 10).alias("k"), F.col("o_orderkey").cast("long").alias("total")))
    return session.run(lambda s, ds: ds.reduce("sum"), kept).dataset.df


@query("select r_regionkey, r_name from region")
def result_scanner(spark, sf_dir):
    result = Session(spark).run(lambda s: table(s, sf_dir, "region", F.col("r_regionkey").cast("long"), "r_name"))
    with result.scanner(int, str) as rows:
        return spark.createDataFrame([tuple(r) for r in rows], "r_regionkey long, r_name string")
