"""Approximate nearest neighbours by cross-polytope hashing.

A hash turns a unit vector by a fast pseudo-rotation (three rounds of fixed random signs and a Hadamard transform) and
takes the nearest signed axis; a table joins FUNCTIONS of them. Each vector stands in one bucket of each of TABLES
tables. A query looks into its own bucket and the next best ones (PROBES a table, by the sum of its coordinates along
the axes), and what stands there is ranked by exact Euclidean distance in double precision on the original vectors.

Equal vectors are one point with its smallest ids (one more than neighbours asked for: no larger id can be among the
nearest), found by a ranked window that keeps so many rows a task before it shuffles; so any number of copies is one
point. Points have numbers of their own, as different vectors may share their least id. A bucket with many points or queries is split into blocks that meet each other, block by block, and only a
query's best points of each block leave it. A query that its buckets leave short of neighbours looks into all buckets
of one table, which is an exact scan.

Cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, as points or as
queries; vectors of different lengths never meet; rows that share vec_id are rows of their own, except that one row of
a query's id is left out as its own; a null vec_id comes last among ties; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_rows, materialize, ship, table

#: Production parameters: neighbours, tables, hash functions a table, buckets a query looks into per table, seed.
#: More points want more functions (128 buckets each at 64 dimensions) and then more tables and probes.
NEAREST, TABLES, FUNCTIONS, PROBES, SEED = 10, 12, 1, 9, 42
#: Points and queries of a block.
BLOCK_POINTS, BLOCK_QUERIES = 16384, 2048
#: Queries are the vectors whose id this divides.
EVERY = 100


@functools.lru_cache(8)
def _signs(width: int, tables: int, functions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, functions, 3, width))


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Each row times the normalised Hadamard matrix, by butterflies."""
    rows, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(vectors: np.ndarray, tables: int, functions: int, seed: int) -> np.ndarray:
    """(table, function, row, coordinate): unit vectors, padded to a power of two, after each pseudo-rotation."""
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    width = max(2, 1 << (unit.shape[1] - 1).bit_length())
    unit = np.pad(unit, ((0, 0), (0, width - unit.shape[1])))
    signs = _signs(width, tables, functions, seed)
    out = np.empty((tables, functions, *unit.shape))
    for t, f in itertools.product(range(tables), range(functions)):
        x = unit
        for sign in signs[t, f]:
            x = _hadamard(x * sign)
        out[t, f] = x
    return out


def own_buckets(turned: np.ndarray) -> np.ndarray:
    """(row, table): the bucket of each vector, one axis number (sign in the last bit) after another."""
    axis = np.abs(turned).argmax(axis=3)
    negative = np.take_along_axis(turned, axis[..., None], 3)[..., 0] < 0
    code = 2 * axis + negative
    bucket = np.zeros(code.shape[::2], dtype=np.int64)
    for f in range(turned.shape[1]):
        bucket = bucket * (2 * turned.shape[3]) + code[:, f]
    return bucket.T


def best_buckets(turned: np.ndarray, probes: int) -> np.ndarray:
    """(row, table, probe): the buckets of the largest sums of coordinates along their axes."""
    tables, functions, rows, width = turned.shape
    score = np.stack([turned, -turned], axis=4).reshape(tables, functions, rows, 2 * width)
    few = min(probes, 2 * width)
    total = code = None
    for f in range(functions):
        best = np.argsort(-score[:, f], axis=2, kind="stable")[:, :, :few]
        value = np.take_along_axis(score[:, f], best, 2)
        if total is None:
            total, code = value, best
            continue
        total = (total[..., :, None] + value[..., None, :]).reshape(tables, rows, -1)
        code = (code[..., :, None] * (2 * width) + best[..., None, :]).reshape(tables, rows, -1)
        keep = np.argsort(-total, axis=2, kind="stable")[:, :, :probes]
        total, code = np.take_along_axis(total, keep, 2), np.take_along_axis(code, keep, 2)
    return code.transpose(1, 0, 2)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~wrong & F.exists(vector, lambda x: x != 0), F.lit(False))


def points(vectors: DataFrame, nearest: int = NEAREST) -> DataFrame:
    """(rep, vector, ids): each different vector with its smallest ids, nearest + 1 of them, and the least as rep."""
    rank = F.row_number().over(Window.partitionBy("vector").orderBy(F.col("vec_id").asc_nulls_last()))
    few = vectors.withColumn("rank", rank).filter(F.col("rank") <= nearest + 1)
    pairs = few.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))).alias("ids"))
    return pairs.select(F.col("ids")[0]["vec_id"].alias("rep"), "vector", F.transform("ids", lambda x: x["vec_id"]).alias("ids"))


def _matrix(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix in double precision), for each length of vectors in the batch."""
    lists = batch.column("vector")
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = []
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        out.append((rows, flat[starts[rows][:, None] + np.arange(n)]))
    return out


def _placed(rows: DataFrame, how: tuple, all_of_one: bool | None) -> DataFrame:
    """Rows (with a column vector) with their cells: own buckets (None), best buckets (False), all of table 0 (True)."""
    tables, functions, probes, seed = how
    names = rows.columns

    def run(batch):
        took, cells = [], []
        for own, matrix in _matrix(batch):
            turned = rotated(matrix, tables, functions, seed)
            if all_of_one:
                bucket = np.broadcast_to(np.arange((2 * turned.shape[3]) ** functions), (len(own), 1, (2 * turned.shape[3]) ** functions))
            else:
                bucket = own_buckets(turned)[:, :, None] if all_of_one is None else best_buckets(turned, probes)
            # The cell's number: length of the vectors, table, bucket.
            cell = (matrix.shape[1] << 48) + (np.arange(bucket.shape[1])[None, :, None] << 40) + bucket
            took.append(np.repeat(own, cell[0].size))
            cells.append(cell.reshape(-1))
        took, cells = np.concatenate(took), np.concatenate(cells)
        out = {c: batch.column(c).take(pa.array(took)) for c in names}
        return out | {"cell": pa.array(cells)}

    schema = StructType.fromJson(rows.schema.jsonValue()).add("cell", "long")
    return map_rows(rows, run, schema, rows=1024)


def _nearest_in(queries: np.ndarray, base: np.ndarray, reps: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places in base, exact distances) of each query's ``most`` nearest, ties to the smaller rep."""
    squares = (base**2).sum(axis=1)
    rough = (queries**2).sum(axis=1)[:, None] + squares[None, :] - 2 * queries @ base.T
    out = []
    for q, near in zip(queries, rough, strict=True):
        if len(base) > most:
            # What the rounding of the quick form could have put behind is kept, then ranked by the exact form.
            limit = np.partition(near, most - 1)[most - 1] + 1e-9 * (squares.max() + (q**2).sum())
            at = np.flatnonzero(near <= limit)
        else:
            at = np.arange(len(base))
        exact = np.sqrt(((base[at] - q) ** 2).sum(axis=1))
        order = np.lexsort((reps[at], exact))[:most]
        out.append((at[order], exact[order]))
    return out


_NO_ID = np.iinfo(np.int64).max


def _search(base: DataFrame, asked: DataFrame, how: tuple, nearest: int, scan: bool) -> DataFrame:
    """(query, point, rep, ids, score): for each asked vector (column query its number) the best points of each block."""
    own = materialize(_placed(base, how, None), "buckets")
    if scan:
        own = own.filter(F.col("cell").bitwiseAND((1 << 48) - 1) < (1 << 40))
    look = materialize(_placed(asked, how, scan), "probes")
    sizes = look.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(own.groupBy("cell").agg(F.count(F.lit(1)).alias("p")), "cell")
    blocks = sizes.select("cell", F.ceil(F.col("p") / F.lit(BLOCK_POINTS)).cast("int").alias("ps"), F.ceil(F.col("q") / F.lit(BLOCK_QUERIES)).cast("int").alias("qs"))
    blocks = materialize(blocks, "blocks")
    mine = {"p": F.pmod(F.xxhash64("point"), F.col("ps")).cast("int"), "q": F.pmod(F.xxhash64("query"), F.col("qs")).cast("int")}
    each = {k: F.explode(F.sequence(F.lit(0), F.col(f"{k}s") - 1)) for k in "pq"}
    a = own.join(blocks, "cell").withColumn("pb", mine["p"]).withColumn("qb", each["q"])
    b = look.join(blocks, "cell").withColumn("qb", mine["q"]).withColumn("pb", each["p"])
    a = a.select("cell", "pb", "qb", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query"), "point", "rep", "vector", "ids")
    b = b.select("cell", "pb", "qb", F.lit(0).alias("kind"), "query", *(F.lit(None).cast("long").alias(c) for c in ("point", "rep")), "vector", F.lit(None).cast("array<bigint>").alias("ids"))
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = a.unionByName(b).repartition(tasks, "cell", "pb", "qb").sortWithinPartitions("cell", "pb", "qb", "kind")
    ship(base.sparkSession)
    schema = "query long, point long, rep long, ids array<bigint>, score double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        key, queries, numbers = None, None, None

        def meet(part):
            reps = part.column("rep").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            took, at, scores = [], [], []
            base = _matrix(part)[0][1]
            for number, (places, exact) in zip(numbers, _nearest_in(queries, base, reps, nearest + 1), strict=True):
                took.append(np.full(len(places), number))
                at.append(places)
                scores.append(exact)
            at = pa.array(np.concatenate(at))
            own = [part.column(c).take(at) for c in ("point", "rep", "ids")]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(took)), *own, pa.array(np.concatenate(scores))], schema=arrow)

        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "pb", "qb", "kind")])
            cuts = (np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist()
            for start, end in itertools.pairwise([0, *cuts, batch.num_rows]):
                if start == end:
                    continue
                part, now = batch.slice(start, end - start), tuple(marks[:3, start])
                if marks[3, start] == 0:
                    # A block's queries come first; they may go on from the batch before.
                    matrix, ids = _matrix(part)[0][1], part.column("query").to_numpy(zero_copy_only=False)
                    go_on = now == key
                    queries = np.concatenate([queries, matrix]) if go_on else matrix
                    numbers = np.concatenate([numbers, ids]) if go_on else ids
                    key = now
                elif now == key:
                    for at in range(0, part.num_rows, 4096):
                        yield meet(part.slice(at, 4096))

    return met.mapInArrow(run, schema)


def _best(found: DataFrame, nearest: int) -> DataFrame:
    """(query, score, vec_id, place): each query's nearest + 1 rows, ties to the smaller id."""
    rows = found.groupBy("query", "point").agg(F.min(F.struct("score", "rep", "ids")).alias("r")).select("query", "r.*")
    nearer = Window.partitionBy("query").orderBy("score", F.col("rep").asc_nulls_last())
    rows = rows.withColumn("n", F.row_number().over(nearer)).filter(F.col("n") <= nearest + 1)
    rows = rows.select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last())
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= nearest + 1)


def search(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """The nearest rows of ``vectors`` (vec_id, vector) to each row of ``queries`` (vec_id, vector), its own left out.

    Columns: query_id, rank (from 1), vec_id, score (Euclidean distance).
    """
    how = (tables, functions, probes, seed)
    base = points(vectors.filter(usable(F.col("vector"))), nearest)
    base = materialize(base.withColumn("point", F.monotonically_increasing_id()), "points")
    rows = materialize(queries.filter(usable(F.col("vector"))).withColumn("row", F.monotonically_increasing_id()), "queries")
    # Equal query vectors are asked once, under the number of one of their rows.
    asked = rows.groupBy("vector").agg(F.min("row").alias("query"))
    asked = materialize(asked, "asked")
    best = materialize(_best(_search(base, asked, how, nearest, False), nearest), "best")
    short = best.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > nearest).select("query")
    missing = materialize(asked.join(short, "query", "left_anti"), "short")
    if not missing.isEmpty():
        rest = materialize(_best(_search(base, missing, how, nearest, True), nearest), "rest")
        best = best.join(missing.select("query"), "query", "left_anti").unionByName(rest)
    out = rows.withColumnRenamed("vec_id", "query_id").join(asked, "vector").select("query_id", "row", "query").join(best, "query")
    # One row with the query's own id and distance zero is the query itself; it is the only one left out.
    twin = F.coalesce((F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0), F.lit(False))
    self_first = Window.partitionBy("row").orderBy(F.when(twin, 0).otherwise(1), "place")
    out = out.withColumn("first", F.row_number().over(self_first)).filter(~(twin & (F.col("first") == 1)))
    order = Window.partitionBy("row").orderBy("place")
    out = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return out.select("query_id", "rank", "vec_id", "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches embeddings for the nearest of every vector whose id EVERY divides."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
