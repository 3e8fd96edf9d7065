"""Exact answers for the stop ends the id-bounded window form cannot decide.

Question per open stop end s: the latest moving reading m of the same
vehicle with ``m.time < s.time`` and ``m.id >= L`` where ``L = s.id - gap + 1``.

Of the scan's pieces (vehicle, chunk) at most two can hold the answer:

* the piece of s itself;
* outside it every moving reading of an earlier piece is earlier in time, so only ids count: the latest earlier piece
  whose largest moving id reaches L holds an answer, and no older piece a later one. With a limit ``max_s`` on the
  stop's length it is the piece ``max_s`` seconds before, or none.

So each open stop end asks for one or two pieces, and meets their readings in an equality join on (vehicle, chunk)
with the scan's own shuffle. The largest ids come from one summary row a piece, over the same shuffle. Where ids
follow time nothing is open, which Spark finds at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tuning import CHUNK_SECONDS
from .scan import PART, chunk_of


def _asked(undecided: DataFrame, gap: int, *, key: str, time: str, rid: str, chunk_seconds: int) -> DataFrame:
    return undecided.select(
        F.col(key).alias("_g_v"),
        F.col(time).alias("_g_end"),
        (F.col(rid) - F.lit(int(gap))).alias("_g_below"),  # ids above this one count
        chunk_of(F.col(time), chunk_seconds).alias("_g_c"),
    )


def _latest_in(asked: DataFrame, dealt: DataFrame, near: Column, counts: Column, *, key: str, time: str, rid: str) -> DataFrame:
    """(key, time, found): the latest moving reading of the asked pieces that passes the id bound and ``near``.

    ``counts`` is asked of joined pairs only: pushed down, it would make another shuffle of what the scan has dealt.
    """
    passes = (F.col(time) < F.col("_g_end")) & (F.col(rid) > F.col("_g_below")) & near
    met = asked.join(dealt, PART).filter(F.when(passes, counts))
    return met.groupBy(F.col(f"{PART}.k").alias(key), F.col("_g_end").alias(time)).agg(F.max(F.col(time)).alias("found"))


def _part(chunk: Column) -> Column:
    return F.struct(F.col("_g_v").alias("k"), chunk.alias("c")).alias(PART)


def resolve_in_chunks(
    undecided: DataFrame, dealt: DataFrame, gap: int, max_s: int, *, counts: Column, key: str, time: str, rid: str, chunk_seconds: int
) -> DataFrame:
    """(key, time, found) for each open stop end with an answer younger than ``max_s`` seconds.

    ``dealt``: readings as :func:`fleetstops.operators.scan.deal` gives them; ``counts`` says which are moving.
    """
    asked = _asked(undecided, gap, key=key, time=time, rid=rid, chunk_seconds=chunk_seconds)
    ago = lambda s: F.col("_g_end") - F.make_dt_interval(secs=F.lit(s).cast("decimal(18,6)"))
    pieces = F.explode(F.sequence(chunk_of(ago(max_s), chunk_seconds), F.col("_g_c")))
    asked = asked.withColumn("_g_p", pieces).select(_part(F.col("_g_p")), "_g_end", "_g_below")
    return _latest_in(asked, dealt, F.col(time) > ago(max_s + 1), counts, key=key, time=time, rid=rid)


def resolve_undecided(
    undecided: DataFrame,
    dealt: DataFrame,
    gap: int,
    *,
    counts: Column,
    key: str = "vehicle_tag",
    time: str = "report_time",
    rid: str = "reading_id",
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """(key, time, found) for each open stop end that has an answer; ``dealt`` and ``counts`` as above."""
    asked = _asked(undecided, gap, key=key, time=time, rid=rid, chunk_seconds=chunk_seconds)
    # One row a piece. It looks at all columns (the hash), as the join below does, so that Spark makes the shuffle once.
    rest = [F.col(c) for c in dealt.columns if c not in (PART, rid)]
    tops = dealt.groupBy(PART).agg(F.max(F.when(counts, F.col(rid))).alias("_g_top"), F.max(F.hash(*rest)).alias("_g_same"))
    tops = tops.filter(F.col("_g_same").isNotNull()).select(F.col(f"{PART}.k").alias("_g_k"), F.col(f"{PART}.c").alias("_g_t"), "_g_top")
    reaches = (F.col("_g_t") < F.col("_g_c")) & (F.col("_g_top") > F.col("_g_below"))
    earlier = asked.join(tops, (F.col("_g_v") == F.col("_g_k")) & (F.col("_g_t") <= F.col("_g_c")) & (reaches | (F.col("_g_t") == F.col("_g_c"))))
    # The own piece is always among them, so that no open stop end is lost.
    places = earlier.groupBy("_g_v", "_g_end", "_g_below", "_g_c").agg(F.max(F.when(reaches, F.col("_g_t"))).alias("_g_e"))
    asked = places.withColumn("_g_p", F.explode(F.array_compact(F.array("_g_c", "_g_e")))).select(_part(F.col("_g_p")), "_g_end", "_g_below")
    return _latest_in(asked, dealt, F.lit(True), counts, key=key, time=time, rid=rid)
