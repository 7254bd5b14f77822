"""Looking at physical plans: what a program's shuffles and scans come to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    """The physical plan before adaptive execution changes it; of a plan that has run, the part that says so."""
    shown = df._jdf.queryExecution().executedPlan().toString()
    return shown.rsplit("== Initial Plan ==", 1)[-1]


def count(df: DataFrame, node: str) -> int:
    """How many nodes of a kind the plan has, for example ``Exchange`` (shuffles only) or ``HashAggregate``."""
    return len(re.findall(rf"(?m)^[^\w\n]*(?:\*\(\d+\) )?{re.escape(node)}\b", text(df)))


def exchanges(df: DataFrame) -> int:
    return count(df, "Exchange")


def scanned_columns(df: DataFrame) -> list[list[str]]:
    """Per file scan, the columns that it reads."""
    return [re.findall(r"(\w+):", m) for m in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", text(df))]


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*?)(?:\]|\.\.\.)", text(df))
