"""Filter interaction audit: what each of five filters removes in every order, and its exact Shapley value.

A document's outcome is the set of filters that it fails. Documents are counted by (part, set), at most 32 sets a
part; that table gives the removals v(S) of all 32 coalitions S of filters, and every step of every order is a
difference of them: a filter f after the filters S removes v(S + f) - v(S). Shapley values come from the least-squares
form: minimise the sum over coalitions S (neither empty nor full) of k(S) (v(S) - sum of f's value over S)^2 with the
Shapley kernel k, under the constraint that all values add up to v(all). Its normal equations are solved in rationals,
so the result is exact; times 120 it is the sum of removals over all orders, a whole number.

The counts are DataFrame operations. Texts meet by digest only (filter E): rows are summed by (digest, part, outcome,
labels) before they meet, so a text held by a third of all rows is a few rows a task, and no row is joined with its
copies. One row of at most 32 counts a part reaches the solver.

Cases: null text is empty; null lang is the part ''; a row without doc_id is never smaller than another nor compared
with one, so it neither fails E nor makes others fail; rows that share doc_id and text don't make each other fail;
several label rows of one doc_id count as one that has what any of them has; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, map_rows, materialize, table

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def own_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails by itself."""
    # The names below live for one row: words are cut once, lambdas keep them from being cut again for each use.
    words = F.array(F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != ""))

    def bits(w):
        few = F.when(F.size(w) < 200, 1).otherwise(0)
        repeats = F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)
        return few + repeats

    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    loud = F.when(100 * capitals.cast("long") > 3 * F.length(text).cast("long"), 4).otherwise(0)
    signs = F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)
    return F.transform(words, bits)[0] + loud + signs


def outcomes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, docs, good, toxic): documents of a part by the set of filters they fail, E included."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        own_failures(text).alias("own"),
    )
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    # Written, so that the join below deals both sides itself and can split a doc_id that very many rows share.
    rows = rows.join(materialize(marks, "marks"), "doc_id", "left").na.fill(False, ["good", "toxic"])
    same = ["digest", "part", "own", "good", "toxic"]
    rows = rows.groupBy(*same, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy(*same).agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("with_id"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    stays = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    groups = groups.withColumn("late", F.col("with_id") - stays)
    both = F.explode(F.array(F.struct(F.col("own").alias("fails"), (F.col("n") - F.col("late")).alias("k")), F.struct((F.col("own") + 16).alias("fails"), F.col("late").alias("k"))))
    cells = groups.select("part", "good", "toxic", both.alias("cell"))
    count = lambda c: F.sum(F.when(c, F.col("cell.k")).otherwise(0)).alias
    return cells.groupBy("part", F.col("cell.fails").alias("fails")).agg(count(F.lit(True))("docs"), count(F.col("good"))("good"), count(F.col("toxic"))("toxic"))


def coalition_removals(counts: dict[int, int]) -> list[int]:
    """v(S) for each of the 32 coalitions S: documents that fail any filter of S."""
    return [sum(n for fails, n in counts.items() if fails & s) for s in range(FULL + 1)]


def solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system of linear equations, in rationals."""
    rows = [[*left, right] for left, right in zip(a, b, strict=True)]
    for k in range(len(rows)):
        pivot = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i, row in enumerate(rows):
            if i != k and row[k]:
                rows[i] = [x - row[k] * y for x, y in zip(row, rows[k], strict=True)]
    return [row[-1] for row in rows]


def shapley_values(removals: list[int]) -> list[Fraction]:
    """Values of the players by kernel-weighted least squares under the efficiency constraint (see the module)."""
    n = len(removals).bit_length() - 1
    a = [[Fraction(0)] * (n + 1) for _ in range(n + 1)]
    b = [Fraction(0)] * n + [Fraction(removals[-1])]
    for s in range(1, len(removals) - 1):
        size = s.bit_count()
        kernel = Fraction(n - 1, comb(n, size) * size * (n - size))
        members = [i for i in range(n) if s >> i & 1]
        for i in members:
            b[i] += kernel * removals[s]
            for j in members:
                a[i][j] += kernel
    for i in range(n):  # the multiplier of the constraint, and the constraint
        a[i][n] = a[n][i] = Fraction(1)
    return solve(a, b)[:n]


def audit_part(cells: list[dict]) -> list[tuple]:
    """(filter_order, step, *COUNTS) for every order and step, from a part's counts by set of failures."""
    docs, good, toxic = (coalition_removals({c["fails"]: c[k] for c in cells}) for k in ("docs", "good", "toxic"))
    total = sum(c["docs"] for c in cells)
    shares = [int(120 * x) for x in shapley_values(docs)]
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = docs[after] - docs[before]
            only = docs[FULL] - docs[FULL & ~(1 << f)]
            out.append((name, step, total - docs[after], removed, docs[1 << f] - removed, only, good[after] - good[before], toxic[after] - toxic[before], shares[f]))
            before = after
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows part, filter_order, step and the counts of COUNTS: 600 for each part."""
    parts = outcomes(docs, labels).groupBy("part").agg(F.collect_list(F.struct("fails", "docs", "good", "toxic")).alias("cells"))

    def run(batch):
        rows = [(part, *row) for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True) for row in audit_part(cells)]
        names = ["part", "filter_order", "step", *COUNTS]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return {n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)}

    return map_rows(parts, run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
least AS (SELECT text, min(doc_id) AS first_id FROM t GROUP BY text),
fails AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
           + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS fails
    FROM t JOIN least USING (text) LEFT JOIN marks USING (doc_id)
),
cells AS (SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, fails),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)),
orders AS (
    SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM f a JOIN f b ON b.bit <> a.bit JOIN f c ON c.bit NOT IN (a.bit, b.bit) JOIN f d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN f e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)
),
steps AS (
    SELECT filter_order, s.step, bits[s.step] AS bit, CAST(list_sum(bits[1:s.step]) AS INTEGER) AS upto FROM orders, (SELECT unnest(range(1, 6)) AS step) s
),
counted AS (
    SELECT part, filter_order, step, bit,
           sum(CASE WHEN fails & upto = 0 THEN docs ELSE 0 END) AS kept,
           sum(CASE WHEN fails & bit <> 0 AND fails & (upto - bit) = 0 THEN docs ELSE 0 END) AS removed,
           sum(CASE WHEN fails & bit <> 0 AND fails & (upto - bit) <> 0 THEN docs ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = bit THEN docs ELSE 0 END) AS unique_fails,
           sum(CASE WHEN fails & bit <> 0 AND fails & (upto - bit) = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN fails & bit <> 0 AND fails & (upto - bit) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
