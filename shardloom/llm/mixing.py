"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall into cells (source, language, topic).  The token weight of each cell is raked in turn to the
target marginal of each dimension until all three hold: in ``rounds`` passes at least, and until no category is off
its target by more than TOLERANCE of it.  Targets that cannot be met together (a source in one language only, say)
never get there: raking then ends when the weights have settled, or after ``most`` passes, with a warning that tells the
largest error, and all goals and shares are kept in the shared folder as ``mix-margins``.  A document of a cell is kept
with probability min(1, scale * weight / tokens), the scale chosen so that the expected kept tokens are
``keep_share`` of all.  Which documents are kept depends on a hash of the identifier alone.

DataFrame functions only on documents; they are aggregated once to cells (partial sums before the shuffle, so a
hot source is a few rows); raking and calibration run on the cells.  Every source is raked by its own name, however
many there are: up to DRIVER_CELLS cells in arrays on the driver, beyond that by groupBy and join on written tables.
(Only a caller that gives ``max_sources`` has the smaller sources pooled into one.)  Cells come back to the documents
by a broadcast while they are at most BROADCAST_CELLS rows, else by an ordinary join.

Defined results: null source or language is a category of its own (''); null and empty texts weigh nothing and
are never kept; a null identifier hashes like ''; repeated rows share one fate; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, new_path, written

#: Topic rules in order: the first condition that holds names the topic of a text.
TOPICS = (("table", "text like '% | %'"), ("legal", "lower(text) like '%license%'"), ("loud", "text like '%!!%'"), ("note", "octet_length(text) < 600"))
REST = "prose"
POOLED = "(pooled)"
#: Tokens of a text: a quarter of its bytes, rounded up.
TOKENS = "cast(ceil(octet_length(text) / 4.0) as bigint)"
BROADCAST_CELLS = 200_000
DRIVER_CELLS = 200_000
#: Raking ends when no category's share is off its goal by more than this part of it,
TOLERANCE = 1e-6
#: or a pass moves no more than this part of the whole weight, which is where targets that cannot be met end,
SETTLED = 1e-9
#: or after so many passes.
MOST_PASSES = 10_000
DIMENSIONS = ("source", "lang", "topic")


def topic_of(rules=TOPICS) -> Column:
    sql = " ".join(f"when {condition} then '{name}'" for name, condition in rules)
    return F.expr(f"case {sql} else '{REST}' end")


def uniform(id_col: str, seed: str) -> Column:
    """A number in [0, 1) from a hash of the identifier."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"/{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def cells_of(rows: DataFrame, max_sources: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Token sums by (source, lang, topic).  Only if ``max_sources`` is given: smaller sources pooled, and the sources that keep their name."""
    fine = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    if max_sources is None:
        return fine, None
    named = fine.groupBy("source").agg(F.sum("tokens").alias("t")).orderBy(F.desc("t"), "source").limit(max_sources).select(F.col("source"), F.col("source").alias("named"))
    pooled = fine.join(named, "source", "left").withColumn("source", F.coalesce("named", F.lit(POOLED)))
    return pooled.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), named


def _rake_here(spark: SparkSession, cells: pa.Table, targets: dict[str, dict[str, float] | float], rounds: int, most: int = MOST_PASSES) -> DataFrame:
    """``rake`` of a table of few cells."""
    tokens = cells["tokens"].to_numpy()
    weight = tokens / tokens.sum()
    codes, goals = [], []
    for d in DIMENSIONS:
        column = cells[d].combine_chunks().dictionary_encode()
        code, names = column.indices.to_numpy(), column.dictionary.to_pylist()
        target = targets.get(d, 1.0)
        goal = np.array([float(target.get(n, 0.0)) for n in names]) if isinstance(target, dict) else np.bincount(code, weight) ** float(target)
        codes.append(code)
        goals.append(goal / goal.sum() if goal.sum() > 0 else goal)
    passes, moved, error = 0, math.inf, math.inf
    while passes < rounds or (error > TOLERANCE and moved > SETTLED and passes < most):
        before = weight
        for code, goal in zip(codes, goals, strict=True):
            share = np.bincount(code, weight, len(goal))
            weight = weight * np.divide(goal, share, out=np.zeros(len(goal)), where=share > 0)[code]
        passes, moved = passes + 1, np.abs(weight - before).sum()
        total = weight.sum() or 1.0
        error = max(_off(np.bincount(code, weight, len(goal)) / total, goal) for code, goal in zip(codes, goals, strict=True))
    weight = weight / weight.sum() if weight.sum() > 0 else weight
    out = written(spark.createDataFrame(cells.append_column("weight", pa.array(weight))), "mix-weights")
    if error > TOLERANCE:
        names = [cells[d].combine_chunks().dictionary_encode().dictionary.to_pylist() for d in DIMENSIONS]
        rows = [(d, n, float(g)) for d, of_d, goal in zip(DIMENSIONS, names, goals, strict=True) for n, g in zip(of_d, goal, strict=True)]
        _missed(out, spark.createDataFrame(rows, "dimension string, category string, goal double"), passes, error)
    return out


def _off(share: np.ndarray, goal: np.ndarray) -> float:
    """The largest error of a share, as a part of its goal (which is 0 only where nothing can be off)."""
    some = goal > 0
    return float(np.max(np.abs(share[some] / goal[some] - 1), initial=0.0))


def _missed(raked: DataFrame, goals: DataFrame, passes: int, error: float) -> None:
    """Warn that targets are not met, and keep the goal and the share of every category."""
    shares = [raked.groupBy(F.lit(d).alias("dimension"), F.col(d).alias("category")).agg(F.sum("weight").alias("share")) for d in DIMENSIONS]
    path = new_path(raked.sparkSession, "mix-margins")
    _stored(goals.join(shares[0].union(shares[1]).union(shares[2]), ["dimension", "category"]), path)
    warnings.warn(f"raking: after {passes} passes a share is still off its target by {error:.3g} of it; all are in {path}", RuntimeWarning, stacklevel=4)


def _sum(rows: DataFrame, column: str) -> float:
    return rows.agg(F.sum(column)).first()[0] or 0.0


def _goals(cells: DataFrame, d: str, target: dict[str, float] | float) -> DataFrame:
    """(category, goal) of a dimension, as shares."""
    shares = cells.groupBy(d).agg(F.sum("weight").alias("share"))
    if isinstance(target, dict):
        listed = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], f"{d} string, goal double")
        goals = shares.join(listed, d, "left").select(d, F.coalesce("goal", F.lit(0.0)).alias("goal"))
    else:
        goals = shares.select(d, F.pow("share", F.lit(float(target))).alias("goal"))
    goals = written(goals, "mix-goals")
    return goals.withColumn("goal", F.col("goal") / F.lit(_sum(goals, "goal") or 1.0))


def _rake_spread(cells: DataFrame, targets: dict[str, dict[str, float] | float], rounds: int, most: int = MOST_PASSES) -> DataFrame:
    """``rake`` by groupBy and join on written tables; only sums come to the driver."""
    spark, out = cells.sparkSession, cells.withColumn("weight", F.col("tokens") / F.lit(float(_sum(cells, "tokens"))))
    goals, held = {d: _goals(out, d, targets.get(d, 1.0)) for d in DIMENSIONS}, None
    passes, change, error = 0, math.inf, math.inf
    while passes < rounds or (error > TOLERANCE and change > SETTLED and passes < most):
        path, factors = new_path(spark, "mix-weights"), []
        moved = out.withColumn("before", F.col("weight"))
        for d in DIMENSIONS:
            share = moved.groupBy(d).agg(F.sum("weight").alias("share"))
            factor = F.when(F.col("share") > 0, F.col("goal") / F.col("share")).otherwise(0.0)
            factors.append(_stored(share.join(goals[d], d).select(d, factor.alias("factor")), f"{path}-{d}"))
            moved = moved.join(factors[-1], d).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        out = _stored(moved, path)
        for old in [held, *(f"{path}-{d}" for d in DIMENSIONS)]:
            _forget(spark, old)
        passes, held = passes + 1, path
        total, change = out.agg(F.sum("weight"), F.sum(F.abs(F.col("weight") - F.col("before")))).first()
        off = F.max(F.abs(F.col("share") / F.lit(total or 1.0) / F.col("goal") - 1))
        error = max(out.groupBy(d).agg(F.sum("weight").alias("share")).join(goals[d], d).where("goal > 0").agg(off).first()[0] or 0.0 for d in DIMENSIONS)
    out = out.withColumn("weight", F.col("weight") / F.lit(_sum(out, "weight") or 1.0)).select(*DIMENSIONS, "tokens", "weight")
    if error > TOLERANCE:
        named = [goals[d].select(F.lit(d).alias("dimension"), F.col(d).alias("category"), "goal") for d in DIMENSIONS]
        _missed(out, named[0].union(named[1]).union(named[2]), passes, error)
    return out


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str | None) -> None:
    """Delete a table that this module wrote and no plan reads any more: raking would leave one a pass."""
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def rake(cells: DataFrame, targets: dict[str, dict[str, float] | float], rounds: int, most: int = MOST_PASSES) -> DataFrame:
    """Add ``weight``: the share of the mix that each cell gets.

    A target is a mapping category -> share (categories it does not list get nothing), or an exponent that
    tempers the natural shares (1 keeps them, 0 makes all categories equal).  ``rounds`` passes are done at least, and
    more, up to ``most``, until the targets hold or the weights have settled (see TOLERANCE).  Up to DRIVER_CELLS cells are raked
    in one place, more of them by groupBy and join."""
    cells = written(cells.select(*DIMENSIONS, F.col("tokens").cast("long").alias("tokens")), "mix-cells")
    n = cells.count()
    if not n:
        return cells.withColumn("weight", F.lit(0.0))
    if n <= DRIVER_CELLS:
        return _rake_here(cells.sparkSession, cells.toArrow(), targets, rounds, most)
    return _rake_spread(cells, targets, rounds, most)


def calibrate(raked: DataFrame, keep_share: float) -> DataFrame:
    """Add ``probability``: min(1, scale * weight / tokens), the expected kept tokens being keep_share of all.

    The scale grows from the one that needs no cap, each time by what the cells above the cap leave over, until no
    further cell passes the cap (Newton steps on a concave function of straight pieces, so it ends).  Cells without
    weight are never kept; where the others hold fewer tokens than asked for, they are kept whole."""
    rated = raked.withColumn("rate", F.col("weight") / F.col("tokens"))
    budget = keep_share * float(_sum(raked, "tokens"))
    scale, capped = 0.0, -1
    while True:
        over = F.lit(scale) * F.col("rate") > 1
        row = rated.where("weight > 0").agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("tokens"))).alias("t"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if row.n == capped:
            break
        capped = row.n
        if not row.w:  # every cell is kept whole
            scale = float("inf")
            break
        scale = max(scale, (budget - (row.t or 0)) / row.w)
    chance = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.lit(scale) * F.col("rate"))).otherwise(0.0)
    return rated.withColumn("probability", chance).select(*DIMENSIONS, "tokens", "weight", "probability")


def mix(
    docs: DataFrame,
    targets: dict[str, dict[str, float] | float] | None = None,
    keep_share: float = 0.7,
    rounds: int = 8,
    most: int = MOST_PASSES,
    max_sources: int | None = None,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per document row: doc_id, source, lang, topic, n_tokens, probability, kept; then the ``carry`` columns as a struct ``carried``."""
    targets = {d: 0.7 for d in DIMENSIONS} if targets is None else targets
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *carried(docs, carry),
    )
    rows = rows.withColumn("topic", topic_of()).withColumn("n_tokens", F.expr(TOKENS)).drop("text")
    cells, named = cells_of(rows.select("source", "lang", "topic", "n_tokens"), max_sources)
    chances = calibrate(rake(cells, targets, rounds, most), keep_share)
    chances = written(chances.select(*DIMENSIONS, "probability"), "mix-chances")
    if chances.count() <= BROADCAST_CELLS:
        chances = F.broadcast(chances)
    if named is None:
        out = rows.withColumn("cell_source", F.col("source"))
    else:
        named = written(named, "mix-sources")
        out = rows.join(F.broadcast(named), "source", "left").withColumn("cell_source", F.coalesce("named", F.lit(POOLED))).drop("named")
    chances = chances.withColumnRenamed("source", "cell_source")
    out = out.join(chances, ["cell_source", "lang", "topic"], "left").withColumn("probability", F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0))
    kept = uniform("doc_id", seed) < F.col("probability")
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", kept.alias("kept"), *(["carried"] if carry else []))
