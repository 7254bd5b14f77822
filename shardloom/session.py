"""Sessions, registered functions and their results."""

from __future__ import annotations

import configparser
import inspect
import os
import threading
import typing
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Row, SparkSession

from . import types
from .dataset import Dataset
from .metrics import Scope

_REGISTRY: list[Func] = []


@dataclass
class Func:
    """A registered program: a function of a SparkSession and arguments that gives a dataset."""

    fn: Callable[..., Dataset]
    location: str
    exclusive: bool = False
    index: int = -1

    def __call__(self, *args, **kwargs):
        return self.fn(*args, **kwargs)

    @property
    def arguments(self) -> list[inspect.Parameter]:
        return list(inspect.signature(self.fn).parameters.values())[1:]

    @property
    def num_in(self) -> int:
        return len(self.arguments)

    def invocation(self, *args) -> Invocation:
        """This program bound to arguments, checked now, to be run later or more than once."""
        self.check(args)
        return Invocation(self, args, types.call_site())

    def apply(self, spark: SparkSession, *args) -> Dataset:
        """The dataset of the program, checked and not run."""
        return self.invocation(*args).invoke(spark)

    def check(self, args: tuple) -> None:
        """Arguments must fit in number, and in type where annotated; None only where the annotation allows it."""
        types.check_arity(self.fn, 1 + len(args), self.fn.__name__)
        hints = typing.get_type_hints(self.fn)
        for p, a in zip(self.arguments, args, strict=False):
            hint = hints.get(p.name)
            if isinstance(a, Result) or hint is None or hint is typing.Any:
                continue
            allowed = typing.get_args(hint) if type(hint).__name__ in ("UnionType", "_UnionGenericAlias", "Union") else (hint,)
            kinds = tuple(typing.get_origin(h) or h for h in allowed)
            if not isinstance(a, kinds) or isinstance(a, bool) and bool not in kinds:
                raise types.TypeCheckError(self.fn.__name__, f"argument {p.name}: expected {hint}, got {type(a).__name__}")


def func(fn: Callable[..., Dataset] | None = None, *, exclusive: bool = False):
    """Register a program."""

    def register(f):
        made = Func(f, types.call_site(), exclusive, len(_REGISTRY))
        _REGISTRY.append(made)
        return made

    return register(fn) if fn is not None else register


def func_by_index(i: int) -> Func:
    return _REGISTRY[i]


def func_locations() -> list[str]:
    return [f.location for f in _REGISTRY]


@dataclass(frozen=True)
class Invocation:
    """A program and its arguments; ``location`` is the caller's line."""

    func: Func
    args: tuple
    location: str

    def invoke(self, spark: SparkSession) -> Dataset:
        """Results among the arguments are passed as their datasets."""
        ds = self.func.fn(spark, *[a.dataset if isinstance(a, Result) else a for a in self.args])
        if not isinstance(ds, Dataset):
            raise types.TypeCheckError(self.func.fn.__name__, f"a program must return a dataset, got {type(ds).__name__}")
        return ds


class Scanner:
    """Rows of a result on the driver, one partition at a time; an iterator and a context manager.

    ``scan`` gives the next row, or None at the end or after an error, which ``err`` then holds; as an iterator it raises
    instead.  After ``close`` there are no more rows."""

    def __init__(self, dataset: Dataset, *expected):
        """``expected``: types of the columns, where they are to be checked (annotations, Spark types or type names)."""
        if expected:
            want = [types.as_schema(e).fields[0].dataType if isinstance(e, str) else types.spark_type(e) for e in expected]
            have = types.columns(dataset.schema)
            if len(want) != len(have):
                raise types.TypeCheckError("scanner", f"{len(want)} columns expected, there are {len(have)}")
            for f, w in zip(dataset.schema.fields, want, strict=True):
                if f.dataType != w:
                    raise types.TypeCheckError("scanner", f"column {f.name} is {f.dataType.simpleString()}, not {w.simpleString()}")
        self._rows = dataset.df.toLocalIterator()
        self.err: Exception | None = None
        self.closed = False

    def __iter__(self) -> Scanner:
        return self

    def __next__(self) -> Row:
        if self.closed:
            raise StopIteration
        return next(self._rows)

    def scan(self) -> Row | None:
        if self.err is not None:
            return None
        try:
            return next(self, None)
        except Exception as e:
            self.err = e
            return None

    def scanv(self, n: int) -> list[Row]:
        """The next n rows, fewer at the end."""
        found = []
        while len(found) < n and (row := self.scan()) is not None:
            found.append(row)
        return found

    def close(self) -> None:
        self.closed, self._rows = True, iter(())

    def __enter__(self) -> Scanner:
        return self

    def __exit__(self, *error) -> None:
        self.close()


@dataclass
class Result:
    """A run dataset, kept for reuse: pass it to a later run, or read it.  ``scope`` holds the counters of its run."""

    dataset: Dataset
    rows: int
    _parents: list[Result] = field(default_factory=list)
    scope: Scope | None = None

    def scanner(self, *expected) -> Scanner:
        return Scanner(self.dataset, *expected)

    def collect(self) -> list[Row]:
        return self.dataset.df.collect()

    def discard(self) -> None:
        """Drop the stored rows of this result and of the results it was made from; recomputed if needed again."""
        self.dataset.df.unpersist()
        for parent in self._parents:
            parent.discard()


def _threads(value: str) -> int | None:
    """A number of threads, or yes (all cores) or no."""
    if value.isdigit():
        return int(value)
    if value.lower() in ("true", "yes", "on"):
        return os.cpu_count() or 1
    if value.lower() in ("false", "no", "off"):
        return None
    raise ValueError(f"neither a number nor true or false: {value!r}")


class Session:
    """Runs registered programs on one SparkSession.

    A program registered as exclusive runs alone: it waits for the session's other runs, and they for it."""

    def __init__(self, spark: SparkSession, max_load: float = 0.95, machine_combiners: bool = False, eventer: Callable[..., None] | None = None):
        """max_load and machine_combiners are kept and shown by ``debug``: the cluster manager decides how many cores a
        job gets, and Spark always combines map-side, per task, before a shuffle; a combiner shared by the tasks of a
        machine has no counterpart, and no result depends on it.  eventer(name, **fields) is told when a run starts and ends."""
        self.spark, self.max_load, self.machine_combiners, self.eventer = spark, max_load, machine_combiners, eventer
        self._turn, self._running, self._alone = threading.Condition(), 0, False

    @classmethod
    def start(cls, local: int | None = None, parallelism: int | None = None, max_load: float = 0.95, event_log: str | None = None, conf: dict[str, str] | None = None, **options) -> Session:
        """local: run in this process on so many threads.  parallelism: default shuffle partitions.  event_log: folder for
        Spark's event log.  max_load and other options: as for a Session."""
        b = SparkSession.builder
        if local:
            b = b.master(f"local[{local}]")
        if parallelism:
            b = b.config("spark.sql.shuffle.partitions", str(parallelism)).config("spark.default.parallelism", str(parallelism))
        if event_log:
            b = b.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log)
        for k, v in (conf or {}).items():
            b = b.config(k, v)
        return cls(b.getOrCreate(), max_load, **options)

    @classmethod
    def from_config(cls, path: str | None = None, argv: list[str] | None = None) -> Session:
        """Settings from an ini file (section [shardloom]; ``~/.shardloom`` by default), then from ``-local``, ``-parallelism N``."""
        settings: dict = {}
        ini = configparser.ConfigParser()
        if ini.read(path or os.path.expanduser("~/.shardloom")) and ini.has_section("shardloom"):
            settings.update(ini.items("shardloom"))
        rest = list(argv or [])
        if "-local" in rest:
            settings["local"] = os.cpu_count() or 1
        if "-parallelism" in rest:
            settings["parallelism"] = rest[rest.index("-parallelism") + 1]
        known = {"local": _threads, "parallelism": int, "max-load": float, "event-log": str, "machine-combiners": lambda v: _threads(v) is not None}
        return cls.start(**{name.replace("-", "_"): known[name](str(v)) for name, v in settings.items() if name in known and v})

    def run(self, fn: Func | Callable[..., Dataset], *args) -> Result:
        """Run a program; results among the arguments are passed as their datasets."""
        f = fn if isinstance(fn, Func) else Func(fn, types.call_site())
        call, scope = f.invocation(*args), Scope(self.spark)
        self._enter(f.exclusive)
        self._tell("run:start", func=f.fn.__name__, location=f.location)
        self.spark.sparkContext.setJobDescription(f"{f.fn.__name__} at {f.location}")
        ended = "error"
        try:
            with scope:
                ds = call.invoke(self.spark)
                if ds.df.columns:
                    kept = ds.df.persist(StorageLevel.MEMORY_AND_DISK)
                    n = kept.count()
                else:  # a scan: run for its effects
                    kept, n = ds.df, 0
                    ds.df.write.format("noop").mode("overwrite").save()
            ended = "ok"
        finally:
            self.spark.sparkContext.setJobDescription(None)
            self._leave(f.exclusive)
            self._tell("run:end", func=f.fn.__name__, location=f.location, state=ended)
        # a kept result's partitions are what was asked for; readers of shards place rows anew where they must
        return Result(Dataset(kept, ds.prefix, ds.num_shards, ds.pragma, ds.name), n, [a for a in args if isinstance(a, Result)], scope)

    def _enter(self, alone: bool) -> None:
        with self._turn:
            self._turn.wait_for(lambda: not self._alone and (not alone or not self._running))
            self._running, self._alone = self._running + 1, alone

    def _leave(self, alone: bool) -> None:
        with self._turn:
            self._running, self._alone = self._running - 1, False if alone else self._alone
            self._turn.notify_all()

    def _tell(self, name: str, **fields) -> None:
        if self.eventer is not None:
            self.eventer(name, **fields)

    def must(self, fn, *args) -> Result:
        """As run; an error ends the program."""
        try:
            return self.run(fn, *args)
        except Exception as e:
            raise SystemExit(f"{getattr(fn, '__name__', fn)}: {e}") from e

    def discard(self, result: Result) -> None:
        result.discard()

    def status(self) -> dict[str, int]:
        tracker = self.spark.sparkContext.statusTracker()
        return {"active_jobs": len(tracker.getActiveJobsIds()), "active_stages": len(tracker.getActiveStageIds()), "running_programs": self._running}

    def stages(self) -> list[dict]:
        """The stages that run now: name, and how many of their tasks are done, running and failed."""
        tracker = self.spark.sparkContext.statusTracker()
        found = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
        return [{"stage": x.stageId, "name": x.name, "tasks": x.numTasks, "done": x.numCompletedTasks, "running": x.numActiveTasks, "failed": x.numFailedTasks} for x in found if x is not None]

    def debug(self) -> str:
        """A page of text: options, status, running stages, kept results and registered programs."""
        kept = [f"{info.name()} {info.numCachedPartitions()} of {info.numPartitions()} partitions, {info.memSize()} bytes in memory, {info.diskSize()} on disk" for info in self.spark.sparkContext._jsc.sc().getRDDStorageInfo()]
        lines = [f"application {self.spark.sparkContext.applicationId} on {self.spark.sparkContext.master}", f"max_load {self.max_load}, machine_combiners {self.machine_combiners}"]
        lines += [f"{k} {v}" for k, v in self.status().items()] + [str(x) for x in self.stages()] + kept + [f"program {i} at {at}" for i, at in enumerate(func_locations())]
        return "\n".join(lines)

    def handle_debug(self, handlers: dict[str, Callable[[], str]], prefix: str = "/debug") -> None:
        """Put this session's pages into a server's table of handlers, by path."""
        handlers[f"{prefix}/session"] = self.debug
        handlers[f"{prefix}/stages"] = lambda: "\n".join(map(str, self.stages()))

    def shutdown(self) -> None:
        self.spark.stop()
