"""Small Column functions that the programs of this library share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(text: Column) -> Column:
    """The words of a text: what stands between runs of blanks, tabs and line ends."""
    return F.filter(F.split(text, "[ \n\t\r]+"), lambda w: w != "")


def url_host(url: Column, unknown: str = "<unknown>") -> Column:
    """The host of a URL, or ``unknown``."""
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(unknown))


def joined(values: Column, separator: str = ",") -> Column:
    """An array as one string, sorted: a value that can be compared whatever the order of a group was."""
    return F.array_join(F.array_sort(values), separator)
