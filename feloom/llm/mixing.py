"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target size; the expected copies of its documents are target
over size. The documents of a source are ranked by size (then by block and
``doc_id``), expected copies are summed along the ranks from one offset, and a
document is emitted once for each whole number that the sum crosses at it. Since
neighbours have nearly equal sizes, the size taken comes near the target.

Ranks are found on two levels: counts per source, size and block give each block
its first rank; only within a block rows are numbered, and a block is at most
1/BLOCKS of the rows of one source and size.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, drop

#: Weights of the sources in code point order, repeating (fixed values).
WEIGHTS = (5, 2, 1)
#: A target is at most this many times the source's size.
MOST = 3
BLOCKS = 256
#: 2**32 over the golden ratio (fixed value).
FACTOR = 2654435769
SEED = 20240229


def words_of(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset_of(seed: int) -> float:
    """The one random offset in [0, 1), a multiple of 2**-20 so that SQL can repeat it exactly."""
    return random.Random(seed).randrange(1 << 20) / (1 << 20)


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    The targets share the sum of all sizes by weight; what a target exceeds
    ``most`` times its source's size is shared again among the others. That is
    ``least(level * weight, most * size)`` for the level that uses up the sum: the
    sources are capped in the order of cap over weight. The table has one row per
    source, and its windows order sources only.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (place % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.select(
        "*",
        F.sum("source_size").over(whole).cast("double").alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("used"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    level = (F.col("total") - F.col("used")) / F.col("open")
    fits = F.when(level <= F.col("cap") / F.col("weight"), level)
    best = levels.select("*", F.max(fits).over(whole).alias("level"))
    return best.select("source", "source_size", F.least(F.coalesce("level", F.lit(float("inf"))) * F.col("weight"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` (``doc_id``, ``text``, ``source``) with ``size, source_size, target, copies``.

    A null text has size 0, a null source is a source of its own that comes last,
    a null ``doc_id`` ranks after the others. Rows alike in all three may trade
    places, which changes no result. An empty table gives no rows; other columns
    pass through, those named like a new column or starting with ``_fl_`` are replaced.
    """
    made = ["size", "source_size", "target", "copies"]
    own = [c for c in docs.columns if c.startswith("_fl_")]
    rows = docs.drop(*made, *own).withColumns({"size": words_of("text"), "_fl_block": block_of("doc_id"), "_fl_none": F.col("source").isNull(), "_fl_source": F.coalesce("source", F.lit(""))})
    # a null source is told by the flag, so that joins and windows have plain keys and share one exchange
    of = ["_fl_none", "_fl_source"]
    counts = cut(rows.groupBy(*of, "size", "_fl_block").agg(F.count("*").alias("n")), "counts")
    sums = counts.groupBy(*of).agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    named = sums.withColumn("source", F.when(~F.col("_fl_none"), F.col("_fl_source")))
    rates = targets(named.select("source", "source_size"), weights, most).withColumns({"_fl_none": F.col("source").isNull(), "_fl_source": F.coalesce("source", F.lit(""))}).drop("source")
    by_size = counts.groupBy(*of, "size").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*of).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select(*of, "size", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("first"))
    inner = Window.partitionBy(*of, "size").orderBy("_fl_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.select(*of, "size", "_fl_block", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inside"))
    firsts = blocks.join(by_size, [*of, "size"]).join(rates, of).withColumn("_fl_first", F.col("first") + F.col("inside")).drop("first", "inside")
    placed = rows.join(cut(firsts, "first-ranks"), [*of, "size", "_fl_block"])
    drop(counts)
    within = Window.partitionBy(*of, "size", "_fl_block").orderBy(F.col("doc_id").asc_nulls_last())
    ranked = placed.withColumn("_fl_rank", F.col("_fl_first") + F.row_number().over(within) - 1)
    mixed = ranked.withColumn("copies", copies("_fl_rank", "target", "source_size", seed))
    return mixed.select(*rows.drop("size", "_fl_block", *of).columns, *made)


def block_of(doc_id: str):
    """A block of 0 to BLOCKS - 1 by multiplicative hashing, in arithmetic that SQL has too; BLOCKS for a null."""
    mixed = F.pmod(F.col(doc_id).cast("long"), F.lit(1 << 31)) * F.lit(FACTOR)
    return F.coalesce(F.shiftright(mixed, 24) % BLOCKS, F.lit(BLOCKS)).cast("int")


def copies(rank: str, target: str, size: str, seed: int):
    """Whole numbers that the sum of expected copies crosses at this rank (from 0)."""
    rate = F.coalesce(F.try_divide(F.col(target), F.col(size).cast("double")), F.lit(0.0))
    start = F.lit(offset_of(seed))
    return (F.floor(rate * (F.col(rank) + 1) + start) - F.floor(rate * F.col(rank) + start)).cast("long")


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of :func:`mix` as often as its copies say."""
    return mixed.where("copies > 0").withColumn("_fl_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_fl_copy", "size", "source_size", "target", "copies")


def oracle_sql(weights=WEIGHTS, most: int = MOST, seed: int = SEED) -> str:
    """DuckDB SQL for ``doc_id, size, source_size, target, taken`` over ``documents``."""
    case = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(weights))
    u = repr(offset_of(seed))
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         coalesce(((((doc_id % 2147483648) + 2147483648) % 2147483648 * {FACTOR}) // 16777216) % {BLOCKS}, {BLOCKS}) AS block
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {case} END)::DOUBLE AS weight,
         (source_size * {most})::DOUBLE AS cap
  FROM s),
l AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM w),
b AS (SELECT *, max(CASE WHEN (total - used) / open <= cap / weight THEN (total - used) / open END) OVER () AS level FROM l),
t AS (SELECT source, source_size, least(coalesce(level, 'inf'::DOUBLE) * weight, cap) AS target FROM b),
r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size::DOUBLE END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY size, block, doc_id NULLS LAST) - 1 AS rank
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate * (rank + 1) + {u}) - floor(rate * rank + {u}))::BIGINT * size)::BIGINT AS taken
FROM r"""
