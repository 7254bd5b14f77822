"""Hints for the runtime; they never change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Pragma:
    """procs: task slots one task should take; exclusive: a whole executor; materialize: keep the result for reuse.

    Composed over a pipeline by the largest procs and by or."""

    procs: int = 1
    exclusive: bool = False
    materialize: bool = False

    def __or__(self, other: Pragma) -> Pragma:
        return Pragma(max(self.procs, other.procs), self.exclusive or other.exclusive, self.materialize or other.materialize)


def procs(n: int) -> Pragma:
    return Pragma(procs=n)


EXCLUSIVE = Pragma(exclusive=True)
MATERIALIZE = Pragma(materialize=True)


def profile(pragma: Pragma, spark):
    """A resource profile for mapInArrow, or None where the cluster manager cannot give one (local mode)."""
    if pragma.procs <= 1 and not pragma.exclusive or spark.sparkContext.master.startswith("local"):
        return None
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    cores = int(spark.sparkContext.getConf().get("spark.executor.cores", "1"))
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores if pragma.exclusive else min(cores, pragma.procs))).build
