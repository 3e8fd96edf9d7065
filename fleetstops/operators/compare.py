"""Dataset comparison at any size: schema, count, exact content, approximate content.

Unlike a collect-and-compare helper, every check here is a Spark job: the
content checks return the differing rows as a DataFrame, so two tables of any
size can be compared without moving either to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def default_sort(df: DataFrame) -> DataFrame:
    """Sort by all columns in name order."""
    return df.sort(*sorted(df.columns))


def schema_diff(a: DataFrame, b: DataFrame, ignore_nullable: bool = False, ignore_names: bool = False) -> DataFrame:
    """One row per field position with both sides' name, type and nullability.

    ``equal`` is true when the field matches under the chosen options; a schema
    matches when every row is equal (fields missing on one side are never equal).
    """
    fa, fb = a.schema.fields, b.schema.fields
    rows = []
    for i in range(max(len(fa), len(fb))):
        x = fa[i] if i < len(fa) else None
        y = fb[i] if i < len(fb) else None
        same_name = x is not None and y is not None and x.name == y.name
        same_type = x is not None and y is not None and x.dataType == y.dataType
        same_null = x is not None and y is not None and x.nullable == y.nullable
        equal = same_type and (same_name or ignore_names) and (same_null or ignore_nullable)
        rows.append(
            (
                i + 1,
                x.name if x else None,
                x.dataType.simpleString() if x else None,
                x.nullable if x else None,
                y.name if y else None,
                y.dataType.simpleString() if y else None,
                y.nullable if y else None,
                same_name,
                same_type,
                equal,
            )
        )
    schema = (
        "position int, name_a string, type_a string, nullable_a boolean, name_b string, type_b string, "
        "nullable_b boolean, same_name boolean, same_type boolean, equal boolean"
    )
    return a.sparkSession.createDataFrame(rows, schema)


def schemas_equal(a: DataFrame, b: DataFrame, ignore_nullable: bool = False, ignore_names: bool = False) -> bool:
    """C1 as a yes/no answer (metadata only, no job)."""
    fa, fb = a.schema.fields, b.schema.fields
    if len(fa) != len(fb):
        return False
    return all(
        x.dataType == y.dataType and (ignore_names or x.name == y.name) and (ignore_nullable or x.nullable == y.nullable)
        for x, y in zip(fa, fb)
    )


def count_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both row counts and whether they agree, from one union and one aggregate."""
    both = a.select(F.lit(1).alias("_fs_a")).unionByName(b.select(F.lit(0).alias("_fs_a")))
    return both.agg(
        F.count_if(F.col("_fs_a") == 1).alias("count_a"), F.count_if(F.col("_fs_a") == 0).alias("count_b")
    ).withColumn("equal", F.col("count_a") == F.col("count_b"))


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Dense 0-based row index in the DataFrame's current order (partition order, then row order).

    The DataFrame is checkpointed to the shared checkpoint folder first, so both
    passes (per-partition counts, then numbering) see the very same rows even if
    the plan above it is not deterministic. The per-partition counts are one row
    per partition; their running sum gives each partition's offset.
    """
    ensure_checkpoint_dir(df.sparkSession)
    fixed = df.checkpoint(eager=True)
    tagged = fixed.select("*", F.spark_partition_id().alias("_fs_pid"), F.monotonically_increasing_id().alias("_fs_mid"))
    counts = tagged.groupBy("_fs_pid").agg(F.count(F.lit(1)).alias("_fs_n"), F.min("_fs_mid").alias("_fs_first"))
    w = Window.orderBy("_fs_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_fs_pid", "_fs_first", F.coalesce(F.sum("_fs_n").over(w), F.lit(0)).alias("_fs_offset")
    )
    # Size bound: one row per partition of ``df``.
    out = tagged.join(F.broadcast(offsets), "_fs_pid")
    return out.select(
        (F.col("_fs_offset") + F.col("_fs_mid") - F.col("_fs_first")).alias(name), *[F.col(c) for c in df.columns]
    )


def content_diff(a: DataFrame, b: DataFrame, ordered: bool = False) -> DataFrame:
    """C4: the rows that differ, with a ``side`` column ('a' or 'b').

    Unordered: multiset difference both ways in one pass — rows of both sides are
    counted per distinct row (+1 for a, -1 for b, map-side combined) and each row
    whose counts differ is emitted as often as it is in surplus. NULLs compare
    equal to NULLs, NaN to NaN.

    Ordered: rows are numbered in their current order and compared position by
    position (``row_index`` is added to the output).
    """
    require_same_schema(a, b)
    cols = a.columns
    if not ordered:
        both = a.select(*cols, F.lit(1).alias("_fs_d")).unionByName(b.select(*cols, F.lit(-1).alias("_fs_d")))
        net = both.groupBy(*cols).agg(F.sum("_fs_d").alias("_fs_net")).filter(F.col("_fs_net") != 0)
        side = F.when(F.col("_fs_net") > 0, F.lit("a")).otherwise(F.lit("b")).alias("side")
        return _repeat(net.select(*cols, side, F.abs("_fs_net").alias("_fs_times")), "_fs_times")
    ia = with_row_index(a, "row_index")
    ib = with_row_index(b, "row_index")
    sa = ia.select("row_index", F.struct(*cols).alias("_fs_a"))
    sb = ib.select("row_index", F.struct(*cols).alias("_fs_b"))
    j = sa.join(sb, "row_index", "full_outer").filter(~F.col("_fs_a").eqNullSafe(F.col("_fs_b")))
    sides = [F.struct(F.lit(k).alias("side"), F.col(f"_fs_{k}").alias("row")) for k in ("a", "b")]
    both = j.select("row_index", F.explode(F.array(*sides)).alias("_fs_s")).filter(F.col("_fs_s.row").isNotNull())
    return both.select("row_index", *[F.col(f"_fs_s.row.`{c}`").alias(c) for c in cols], F.col("_fs_s.side").alias("side"))


def content_diff_by_digest(a: DataFrame, b: DataFrame, buckets: int = 4096, levels: int = 2) -> DataFrame:
    """C4 (unordered) for tables that are nearly equal: as :func:`content_diff`, but only rows of buckets that differ move.

    Each level deals the rows by a hash of its own into ``buckets`` and sums up, for each bucket, the rows and 128 bits
    of hash of each, those of ``b`` counted negative; the sums don't depend on the order of rows and are combined
    map-side, so a task sends one row a bucket. Where all sums are zero the bucket holds the same rows on both sides, and
    they go. With d differing rows about ``(d / buckets) ** levels`` of the others stay. Each side is read ``levels`` + 1
    times. Two buckets that differ pass for equal with a chance of 2^-128.
    """
    require_same_schema(a, b)
    if buckets < 1 or levels < 1:
        raise ValueError("buckets and levels must be positive")
    for level in range(levels):
        node = F.pmod(_row_hash(a, 3 * level), F.lit(buckets))
        pieces = [p for k in (1, 2) for p in _pieces(_row_hash(a, 3 * level + k))]
        sums = [*pieces, F.lit(1).cast("long")]
        names = [f"_fs_{i}" for i in range(len(sums))]
        both = a.select(node.alias("_fs_node"), *[s.alias(n) for s, n in zip(sums, names)]).unionByName(
            b.select(node.alias("_fs_node"), *[(-s).alias(n) for s, n in zip(sums, names)])
        )
        net = both.groupBy("_fs_node").agg(*[F.sum(n).alias(n) for n in names])
        differ = net.filter(" OR ".join(f"{n} <> 0" for n in names)).select("_fs_node")
        # Size bound: at most ``buckets`` numbers.
        a, b = (x.join(F.broadcast(differ), node == F.col("_fs_node"), "left_semi") for x in (a, b))
    return content_diff(a, b)


def _row_hash(df: DataFrame, seed: int) -> Column:
    """64 bits of hash of a whole row. Hashes pass over NULLs, so which columns are NULL is part of it, and nested
    columns, whose NULLs nothing else shows, go in as JSON."""
    nulls = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in df.columns])
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType))}
    values = [F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if c in nested else F.col(c) for c in df.columns]
    return F.xxhash64(F.lit(seed), nulls, *values)


def _pieces(h: Column) -> list[Column]:
    """A long in three pieces of at most 22 bits, whose sums over 2^41 rows fit a long."""
    return [h.bitwiseAND(F.lit((1 << 21) - 1)), F.shiftright(h, 21).bitwiseAND(F.lit((1 << 21) - 1)), F.shiftrightunsigned(h, 42)]


# Most copies one array of positions stands for.
_BLOCK = 1 << 16


def _repeat(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its (long) column ``times`` says, which goes; by blocks of blocks of blocks of copies, so
    that no array is longer than a block, up to 2^48 copies."""
    cols = [c for c in df.columns if c != times]
    for unit in (_BLOCK * _BLOCK, _BLOCK, 1):
        here = F.ceil(F.col(times) / F.lit(unit)).cast("long") if unit > 1 else F.col(times)
        part = F.explode(F.sequence(F.lit(0).cast("long"), here - 1)).alias("_fs_k")
        df = df.select(*cols, times, part).select(*cols, F.least(F.lit(unit).cast("long"), F.col(times) - F.col("_fs_k") * F.lit(unit)).alias(times))
    return df.drop(times)


def require_same_schema(a: DataFrame, b: DataFrame) -> None:
    """Content is compared only under equal names and types, as schemas are compared first; else ValueError."""
    if not schemas_equal(a, b, ignore_nullable=True):
        raise ValueError(f"schemas differ: {a.schema.simpleString()} and {b.schema.simpleString()}")


def _require_unique_key(a: DataFrame, b: DataFrame, key: list[str]) -> None:
    """Keyed comparison pairs rows 1:1; a repeated key would pair every copy with every copy.

    One small job: both sides' keys are counted together (map-side combined) and
    the first repeated key, if any, stops the comparison.
    """
    both = a.select(*key, F.lit(1).alias("_fs_a"), F.lit(0).alias("_fs_b")).unionByName(
        b.select(*key, F.lit(0).alias("_fs_a"), F.lit(1).alias("_fs_b"))
    )
    dup = both.groupBy(*key).agg(F.sum("_fs_a").alias("na"), F.sum("_fs_b").alias("nb")).filter(
        (F.col("na") > 1) | (F.col("nb") > 1)
    )
    if dup.limit(1).count():
        raise ValueError(f"key {key} is not unique; compare by position (key=None) or by a unique key")


def _close(x: Column, y: Column, dtype: T.DataType, tol: float) -> Column:
    """Row-comparer rule for one field: NULL only equals NULL; floats within ``tol``,
    NaN equals NaN; timestamps within ``tol`` milliseconds; decimals, bytes and all else exact."""
    both_null = x.isNull() & y.isNull()
    one_null = x.isNull() != y.isNull()
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        nan_x, nan_y = F.isnan(x), F.isnan(y)
        # Equal values first: two infinities of one sign have no finite difference.
        same = (x == y) | (nan_x & nan_y) | (~nan_x & ~nan_y & (F.abs(x - y) <= F.lit(tol)))
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        ms = lambda c: F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))
        same = F.abs(ms(x) - ms(y)) <= F.lit(tol)
    else:
        same = x == y
    return both_null | (~one_null & F.coalesce(same, F.lit(False)))


def approx_diff(a: DataFrame, b: DataFrame, tol: float, key: list[str] | None = None) -> DataFrame:
    """Rows that differ beyond ``tol``, matched by ``key`` (or by position when no key).

    Output: the key, ``side`` ('both' when the key is on both sides but values
    differ, else 'a' or 'b'), and ``columns`` = the differing column names joined by ','.
    """
    require_same_schema(a, b)
    if key is None:
        a, b, key = with_row_index(a), with_row_index(b), ["row_index"]
    else:
        _require_unique_key(a, b, list(key))
    key = list(key)
    vals = [c for c in a.columns if c not in key]
    types = {f.name: f.dataType for f in a.schema.fields}
    sa = a.select(*key, F.struct(*vals).alias("_fs_a"), F.lit(True).alias("_fs_ina"))
    sb = b.select(*key, F.struct(*vals).alias("_fs_b"), F.lit(True).alias("_fs_inb"))
    j = sa.join(sb, key, "full_outer")
    mism = F.concat_ws(
        ",",
        *[F.when(~_close(F.col(f"_fs_a.{c}"), F.col(f"_fs_b.{c}"), types[c], tol), F.lit(c)) for c in vals],
    )
    side = (
        F.when(F.col("_fs_ina").isNull(), F.lit("b")).when(F.col("_fs_inb").isNull(), F.lit("a")).otherwise(F.lit("both"))
    )
    out = j.select(*key, side.alias("side"), F.when(side == "both", mism).otherwise(F.lit("")).alias("columns"))
    return out.filter((F.col("side") != "both") | (F.col("columns") != ""))


def diff_with(a: DataFrame, b: DataFrame, equals, key: list[str] | None = None) -> DataFrame:
    """U4: rows for which a user predicate says "not equal".

    ``equals(x, y)`` receives the two sides' rows as struct Columns (fields by
    column name) and returns a boolean Column, so the rule runs inside Spark's
    generated code rather than per row in Python. Rows are matched by ``key``,
    or by position when no key is given. Output: the key, ``side`` ('both', 'a'
    or 'b').
    """
    if key is None:
        a, b, key = with_row_index(a), with_row_index(b), ["row_index"]
    else:
        _require_unique_key(a, b, list(key))
    key = list(key)
    vals = [c for c in a.columns if c not in key]
    sa = a.select(*key, F.struct(*vals).alias("_fs_a"), F.lit(True).alias("_fs_ina"))
    sb = b.select(*key, F.struct(*vals).alias("_fs_b"), F.lit(True).alias("_fs_inb"))
    j = sa.join(sb, key, "full_outer")
    side = (
        F.when(F.col("_fs_ina").isNull(), F.lit("b")).when(F.col("_fs_inb").isNull(), F.lit("a")).otherwise(F.lit("both"))
    )
    same = F.coalesce(equals(F.col("_fs_a"), F.col("_fs_b")), F.lit(False))
    return j.select(*key, side.alias("side"), same.alias("_fs_same")).filter(
        (F.col("side") != "both") | ~F.col("_fs_same")
    ).drop("_fs_same")
