"""Typed, sharded, higher-order dataflow on Spark DataFrames, and training-data operators."""

from . import sources
from .dataset import Dataset
from .operators.aggregate import count, total
from .operators.cogroup import cogroup, join, union
from .operators.sinks import EOF, drain, read_cache, write_tsv
from .pragma import EXCLUSIVE, MATERIALIZE, Pragma, procs
from .session import Invocation, Result, Scanner, Session, func
from .types import TypeCheckError

__all__ = ["EOF", "EXCLUSIVE", "MATERIALIZE", "Dataset", "Invocation", "Pragma", "Result", "Scanner", "Session", "TypeCheckError", "cogroup", "count", "drain", "func", "join", "procs", "read_cache", "sources", "total", "union", "write_tsv"]
