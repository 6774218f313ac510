"""Continuous periods and gaps of overlapping intervals, merged in two levels.

Level one works per (entity, time shard): intervals are clipped at the end of the shard they start in.
What reaches past it isn't copied into every later shard (an extreme duration would make millions of
pieces); of the overhang only the latest end per shard is kept, and a running maximum over an entity's
shards carries it forward. Each shard then knows the coverage that touches its lower boundary and finds
its own breaks. Level two stitches: it sees one row per shard, and joins the period that is open at the
end of a shard with the first break of a later one.

An entity holding a third of all rows is spread over its shards. Before anything is shuffled, of the intervals
of one start that a task reads together only the longest is kept, so however many intervals start at one time, few of
them reach the group of their shard, which is sorted, streamed and spilled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.session import ship


def _longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a batch that differ in nothing but their end, the one with the latest."""
    for b in batches:
        names = b.schema.names
        keys = [n for n in names if n != "_tl_e"]
        t = pa.Table.from_batches([b]).group_by(keys, use_threads=False).aggregate([("_tl_e", "max")])
        yield from t.select([*(n if n != "_tl_e" else "_tl_e_max" for n in names)]).rename_columns(names).combine_chunks().to_batches()


def periods_and_gaps(
    intervals: DataFrame,
    entity: Sequence[str],
    start: str = "time_start",
    end: str = "time_end",
    max_pause: int = 1000,
    shard_us: int = 10_000_000,
) -> DataFrame:
    """`entity` columns, kind (`period` or `gap`), from_time, to_time.

    Intervals of an entity belong to one period if they overlap, touch, or the pause since the latest end
    so far is at most `max_pause`. Rows with a NULL bound or an end before the start are left out; NULL
    entity values are an entity like any other; repeated rows change nothing. An empty input gives an
    empty result. Further columns of `intervals` are ignored.
    """
    ent = [f"_tl_k{i}" for i in range(len(entity))]
    s, e = F.col("_tl_s"), F.col("_tl_e")
    iv = (
        intervals.select(*[F.col(c).alias(k) for c, k in zip(entity, ent)], F.col(start).cast("long").alias("_tl_s"), F.col(end).cast("long").alias("_tl_e"))
        .filter(s.isNotNull() & (e >= s))
        .withColumn("_tl_shard", F.expr(f"_tl_s div {int(shard_us)}L"))
    )
    ship(iv.sparkSession)
    iv = iv.mapInArrow(_longest, iv.schema)
    over_shards = Window.partitionBy(*ent).orderBy("_tl_shard")
    carried = (
        iv.groupBy(*ent, "_tl_shard")
        .agg(F.max("_tl_e").alias("_tl_m"))
        .select(
            *ent,
            "_tl_shard",
            F.lit(None).cast("long").alias("_tl_s"),
            F.max("_tl_m").over(over_shards.rowsBetween(Window.unboundedPreceding, -1)).alias("_tl_e"),
            F.max("_tl_m").over(over_shards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_tl_last"),
        )
    )
    rows = iv.select(*ent, "_tl_shard", "_tl_s", "_tl_e", F.lit(None).cast("long").alias("_tl_last")).unionByName(carried)

    in_shard = Window.partitionBy(*ent, "_tl_shard").orderBy(F.col("_tl_s").asc_nulls_first())
    breaks = (
        rows.select(
            *ent,
            "_tl_shard",
            "_tl_s",
            F.max("_tl_e").over(in_shard.rowsBetween(Window.unboundedPreceding, -1)).alias("_tl_prev"),
            F.max("_tl_last").over(in_shard.rowsBetween(Window.unboundedPreceding, 0)).alias("_tl_last"),
        )
        .filter(s.isNotNull() & (F.col("_tl_prev").isNull() | (s > F.try_add(F.col("_tl_prev"), F.lit(int(max_pause))))))
    )
    piece = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), F.col(a).alias("from_time"), F.col(b).alias("to_time"))
    # _tl_last is known in every row; reading it here too lets both parts below share one shuffle of the intervals
    inner = (
        breaks.withColumn("_tl_next", F.when(F.col("_tl_last").isNotNull(), F.lead("_tl_prev").over(in_shard)))
        .select(*ent, F.explode(F.array(piece("gap", "_tl_prev", "_tl_s"), piece("period", "_tl_s", "_tl_next"))).alias("_tl_p"))
        .filter("_tl_p.from_time is not null and _tl_p.to_time is not null")
        .select(*ent, "_tl_p.*")
    )
    stitched = (
        breaks.groupBy(*ent, "_tl_shard")
        .agg(F.min_by("_tl_prev", "_tl_s").alias("_tl_first"), F.max("_tl_s").alias("_tl_open"), F.max("_tl_last").alias("_tl_last"))
        .select(
            *ent,
            F.lit("period").alias("kind"),
            F.col("_tl_open").alias("from_time"),
            F.coalesce(F.lead("_tl_first").over(over_shards), F.col("_tl_last")).alias("to_time"),
        )
    )
    out = inner.unionByName(stitched)
    return out.select(*[F.col(k).alias(c) for c, k in zip(entity, ent)], "kind", "from_time", "to_time")
