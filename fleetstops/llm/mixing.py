"""Mixing sources to target weights (DataFrame operations only).

Sizes are summed per source; targets share the budget by weight, none above ``most`` times its source's size, the
excess shared again by weight (water filling, solved in closed form over the sources sorted by size per weight).
A source's rate is target / size. Each document is emitted floor(rate) times, plus once more if a hash of seed and
doc_id, read as a fraction, is below the rate's fraction: the same rows on every run.

One row per source reaches the window that solves the targets; documents meet their source's row by an equality
join whose small side Spark broadcasts when its measured size allows, else splits a hot source's partitions.

Cases: null text has size 0; null is a source of its own, last in order; documents of size 0 count but take
nothing; repeated rows with one doc_id share one draw; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialize, q, table

#: Production parameters: weights by the sources' order (repeating), budget in percent of all sizes, the cap of a
#: target in times of its source's size, and the seed of the draws.
WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST = 2
SEED = 42


def word_count(text: Column) -> Column:
    """Number of words: runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (turn % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    # In the order of most / weight, those that reach their cap come first. "level" is the share of a unit of weight
    # if all before this source are at their caps and it and all after it are not.
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone) * F.lit(budget_percent) / 100.0
    spent, gone = (F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("most", "weight"))
    per = per.withColumn("level", (total - spent) / (F.sum("weight").over(everyone) - gone))
    # The true level is the first one that stays below its source's cap; none: all are capped.
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "source_size", "level"))).over(everyone)["level"]
    target = F.when(level.isNull(), F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), level * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def copies(doc_id: Column, rate: Column, seed: int = SEED) -> Column:
    """floor(rate) plus a draw of probability rate - floor(rate), fixed by seed and doc_id."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def _rates(sizes: DataFrame, **how) -> DataFrame:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return source_targets(sizes, **how).select(F.col("source").alias("_of"), "source_size", "target", rate.alias("rate"))


def plan_mix(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, copies, taken (size times copies)."""
    sizes = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    sizes = materialize(sizes, "sizes")  # the texts are read once; what follows reads three narrow columns
    plan = sizes.join(_rates(sizes, **how), F.col("source").eqNullSafe(F.col("_of")))
    plan = plan.withColumn("copies", copies(F.col("doc_id"), F.col("rate"), seed))
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The mix itself: every document as often as planned, with its own columns."""
    sizes = docs.select("source", word_count(F.col("text")).alias("size"))
    rates = _rates(sizes, **how).select(F.col("_of").alias(of := fresh(docs, "of")), F.col("rate").alias(rate := fresh(docs, "rate")))
    joined = docs.join(rates, q("source").eqNullSafe(q(of)))
    times = copies(q("doc_id"), q(rate), seed).cast("int")
    return joined.withColumn(copy := fresh(joined, "copy"), F.explode(F.array_repeat(F.lit(0), times))).drop(of, rate, copy)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents by the production parameters."""
    plan = plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH n AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM n GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS most FROM p),
l AS (SELECT *, ((SELECT sum(source_size) FROM w) * 150 / 100.0 - coalesce(sum(most) OVER b, 0)) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(CAST(most AS DOUBLE), (SELECT level FROM l WHERE level * weight <= most ORDER BY most / weight, source_size LIMIT 1) * weight), most) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN CAST('0x' || md5('42:' || doc_id)[1:13] AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM n JOIN r ON n.source IS NOT DISTINCT FROM r.source
"""
