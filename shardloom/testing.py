"""Helpers for tests of programs."""

from __future__ import annotations

from .dataset import Dataset


def _plain(x):
    if isinstance(x, list):
        return tuple(sorted((_plain(v) for v in x), key=_order))
    if hasattr(x, "asDict"):
        return tuple(_plain(v) for v in x)
    return bytes(x) if isinstance(x, bytearray) else x


def _order(x):
    if isinstance(x, tuple):
        return (2, tuple(_order(v) for v in x))
    return (0, "", "") if x is None else (1, type(x).__name__, x)


def rows(ds: Dataset) -> list[tuple]:
    """All rows, arrays and rows sorted: groups and shards have no fixed order."""
    return sorted((tuple(_plain(v) for v in r) for r in ds.df.collect()), key=_order)


def by_shard(ds: Dataset) -> list[list[tuple]]:
    """The rows of each shard in their order."""
    return [[tuple(r) for r in part] for part in ds.by_shard().df.rdd.glom().collect()]


def assert_rows_equal(ds: Dataset, expected: list[tuple]) -> None:
    got, want = rows(ds), sorted((tuple(_plain(v) for v in r) for r in expected), key=_order)
    assert got == want, f"got {got[:10]}..., want {want[:10]}..."


def show(ds: Dataset) -> str:
    """Sorted rows, one a line."""
    return "\n".join(" ".join(map(str, r)) for r in rows(ds))
