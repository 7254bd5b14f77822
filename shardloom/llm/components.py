"""Connected components of links, as DataFrame steps that never gather the links anywhere.

Alternating large-star and small-star rounds: each node's neighbours are hooked to the smallest node in
reach, until every node points straight at the smallest node of its component.  Each round is partial
aggregations and equi-joins (a node with very many links is split by the skewed-join rule), and ends in a
written table in the shared folder; the one before it is deleted then.

Defined results: a link with a null end, and a loop, links nothing; repeated links count once; no links give no
rows.  The rounds grow with the logarithm of the number of nodes; should ``max_rounds`` not be enough, an error
is raised, and no unfinished result is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; any order, repeats and loops allowed) but the roots
    themselves: root is the smallest node of the component.  The result is a table of ``scratch``."""
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _digest(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        # large star: every larger neighbour of u is hooked to the least node around u
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours are hooked to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, edges = edges, scratch.keep(hooked.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        scratch.drop(old)
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components: not finished after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
