"""A dataset: a lazy DataFrame, the width of its key, and how it is cut into shards."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import types
from .pragma import Pragma

#: Given shard numbers, a DataFrame whose partition k holds shard k and where other shards are empty; None: all shards.
ShardsOf = Callable[[Iterable[int] | None], DataFrame]


class Dataset:
    """Immutable.  The first ``prefix`` columns are the key.

    ``num_shards`` is what the program asked for; a partition is a shard only where a shard-observing operator needs
    it (``by_shard``), so ordinary plans keep Spark's own partitioning and adaptive coalescing.  ``shards_of``, where
    known, computes chosen shards alone; narrow operators keep it, so that a partly filled cache recomputes only what
    is missing."""

    def __init__(self, df: DataFrame, prefix: int = 1, num_shards: int | None = None, pragma: Pragma | None = None, name: str = "dataset", shards_of: ShardsOf | None = None):
        self.df, self.prefix, self.num_shards, self.pragma, self.name, self.shards_of = df, prefix, num_shards, pragma or Pragma(), name, shards_of
        if not 0 <= prefix <= max(1, len(df.columns)):
            raise types.TypeCheckError(name, f"prefix {prefix} of {len(df.columns)} columns")

    # -------------------------------------------------------------- shape

    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def schema(self) -> StructType:
        return self.df.schema

    @property
    def keys(self) -> list[str]:
        return self.df.columns[: self.prefix]

    @property
    def values(self) -> list[str]:
        return self.df.columns[self.prefix :]

    @property
    def shards(self) -> int:
        """Asked for, or else Spark's number of shuffle partitions."""
        return self.num_shards or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def __repr__(self) -> str:
        return f"{self.name} {types.describe(self.schema, self.prefix)}"

    def with_df(self, df: DataFrame, **changes) -> Dataset:
        return Dataset(df, **({"prefix": self.prefix, "num_shards": self.num_shards, "pragma": self.pragma, "name": self.name} | changes))

    def narrow(self, step: Callable[[DataFrame], DataFrame], name: str, prefix: int | None = None, pragma: Pragma | None = None) -> Dataset:
        """Apply a step that works shard by shard.  With the materialize hint its rows are kept, once computed, for every reader."""
        shards_of = self.shards_of
        df = step(self.df)
        if pragma is not None and pragma.materialize:
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
        return Dataset(
            df,
            self.prefix if prefix is None else prefix,
            self.num_shards,
            self.pragma | pragma if pragma else self.pragma,
            name,
            None if shards_of is None else lambda shards: step(shards_of(shards)),
        )

    def prefixed(self, n: int) -> Dataset:
        """Take the first n columns as the key (no plan node)."""
        if not 1 <= n <= len(self.df.columns):
            raise types.TypeCheckError("prefixed", f"prefix {n} of {len(self.df.columns)} columns")
        return Dataset(self.df, n, self.num_shards, self.pragma, self.name, self.shards_of)

    def unwrap(self) -> Dataset:
        return self.prefixed(1)

    def shard_expr(self) -> Column:
        """The shard of a row by its key: the placement of Spark's hash partitioning."""
        return F.pmod(F.hash(*[self.df[k] for k in self.keys]), F.lit(self.shards))

    def by_shard(self) -> Dataset:
        """The same rows with one partition per shard: as they are where shards are known, else hashed by key."""
        if self.shards_of is not None:
            rows = self.shards_of(None)
            n = self.num_shards or max(1, rows._jdf.queryExecution().toRdd().getNumPartitions())  # splits of a source
            return Dataset(rows, self.prefix, n, self.pragma, self.name, self.shards_of)
        from .operators.shuffle import placed

        return placed(self, self.shard_expr(), self.shards, self.name)

    # -------------------------------------------------------------- operators (see shardloom.operators)

    def map(self, *exprs, schema=None, pragma: Pragma | None = None) -> Dataset:
        from .operators import narrow

        return narrow.map(self, *exprs, schema=schema, pragma=pragma)

    def filter(self, predicate, pragma: Pragma | None = None) -> Dataset:
        from .operators import narrow

        return narrow.filter(self, predicate, pragma=pragma)

    def flatmap(self, *exprs, schema=None, pragma: Pragma | None = None) -> Dataset:
        from .operators import narrow

        return narrow.flatmap(self, *exprs, schema=schema, pragma=pragma)

    def head(self, n: int) -> Dataset:
        from .operators import narrow

        return narrow.head(self, n)

    def reduce(self, fn) -> Dataset:
        from .operators import aggregate

        return aggregate.reduce(self, fn)

    def reduce_expr(self, merge) -> Dataset:
        from .operators import aggregate

        return aggregate.reduce_expr(self, merge)

    def fold(self, *args, **kwargs) -> Dataset:
        from .operators import aggregate

        return aggregate.fold(self, *args, **kwargs)

    def fold_expr(self, zero, merge, finish=None, name: str = "acc", combine=None) -> Dataset:
        from .operators import aggregate

        return aggregate.fold_expr(self, zero, merge, finish, name, combine)

    def distinct(self) -> Dataset:
        from .operators import aggregate

        return aggregate.distinct(self)

    def cogroup(self, *others: Dataset) -> Dataset:
        from .operators import cogroup

        return cogroup.cogroup(self, *others)

    def join(self, other: Dataset, how: str = "inner") -> Dataset:
        from .operators import cogroup

        return cogroup.join(self, other, how)

    def reshuffle(self) -> Dataset:
        from .operators import shuffle

        return shuffle.reshuffle(self)

    def reshard(self, n: int) -> Dataset:
        from .operators import shuffle

        return shuffle.reshard(self, n)

    def repartition(self, fn) -> Dataset:
        from .operators import shuffle

        return shuffle.repartition(self, fn)

    def top(self, n: int, *order) -> Dataset:
        from .operators import shuffle

        return shuffle.top(self, n, *order)

    def sort(self, *order) -> Dataset:
        from .operators import shuffle

        return shuffle.sort(self, *order)

    def writer_func(self, fn) -> Dataset:
        from .operators import sinks

        return sinks.writer_func(self, fn)

    def scan(self, fn) -> Dataset:
        from .operators import sinks

        return sinks.scan(self, fn)

    def cache(self, prefix: str) -> Dataset:
        from .operators import sinks

        return sinks.cache(self, prefix)

    def cache_partial(self, prefix: str) -> Dataset:
        from .operators import sinks

        return sinks.cache_partial(self, prefix)
