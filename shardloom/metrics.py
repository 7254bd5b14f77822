"""Counters.

In Column programs a counter is an observed aggregate: exact, because it is taken from the rows that a successful run
produced.  In Python functions it is an accumulator, which a retried task may count twice."""

from __future__ import annotations

from pyspark.sql import Column, Observation
from pyspark.sql import functions as F

from .dataset import Dataset


class Counter:
    """``value`` is known once the dataset returned by ``over`` has been run."""

    def __init__(self, name: str):
        self.name, self.observation = name, Observation(name)

    def over(self, ds: Dataset, amount: Column | None = None) -> Dataset:
        """Count the rows of ``ds``, or add up ``amount``, while they pass."""
        counted = F.count(F.lit(1)) if amount is None else F.coalesce(F.sum(amount), F.lit(0))
        return ds.with_df(ds.df.observe(self.observation, counted.alias("value")))

    @property
    def value(self) -> int:
        return self.observation.get["value"]


class Scope:
    """Named accumulators for Python functions; scopes can be merged and reset.

    A session's run opens one (``current``), which its Result keeps."""

    _open: list[Scope] = []

    def __init__(self, spark):
        self.spark, self.counters = spark, {}

    @classmethod
    def current(cls) -> Scope:
        """The scope of the run that is being made."""
        if not cls._open:
            raise LookupError("no run is being made")
        return cls._open[-1]

    def __enter__(self) -> Scope:
        self._open.append(self)
        return self

    def __exit__(self, *error) -> None:
        self._open.remove(self)

    def counter(self, name: str):
        if name not in self.counters:
            self.counters[name] = self.spark.sparkContext.accumulator(0)
        return self.counters[name]

    def value(self, name: str) -> int:
        return self.counters[name].value if name in self.counters else 0

    def merge(self, other: Scope) -> None:
        for name, c in other.counters.items():
            self.counter(name).add(c.value)

    def reset(self) -> None:
        for name in list(self.counters):
            self.counters[name] = self.spark.sparkContext.accumulator(0)
