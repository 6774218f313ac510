"""Range-sorted chunks: ordered work over groups of any size, without one task per group.

`range_chunks` cuts a frame by its whole sort key into even partitions, so a group with a third of all rows
spans many of them. A chunk operator then streams each partition in order and leaves what it can't know
alone, the state it would need from earlier chunks, to a merge over one summary per chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.session import cut, ship, shuffle_partitions

CHUNK_BYTES, MAX_CHUNKS = 128 << 20, 100_000


def range_chunks(df: DataFrame, keys: Sequence[str | Column], n: int | None = None) -> DataFrame:
    """`df` range-partitioned and sorted by `keys`; equal keys share a chunk. Chunks are Spark's partitions in order.

    The number is given, so adaptive execution neither joins nor splits chunks: partition ids are chunk numbers. It
    follows from the input's size as the optimizer estimates it (CHUNK_BYTES a chunk), and is at least the session's
    number of shuffle partitions.
    """
    ship(df.sparkSession)
    return df.repartitionByRange(n or chunks_for(df), *keys).sortWithinPartitions(*keys)


def chunks_for(df: DataFrame) -> int:
    """A chunk for each CHUNK_BYTES of the input, where the optimizer can tell its size: not after a checkpoint or a join."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(plan.stats().sizeInBytes())
    known = 0 if size >= 1 << 60 or "Join" in plan.toString() else size
    return min(MAX_CHUNKS, max(shuffle_partitions(df.sparkSession), -(-known // CHUNK_BYTES)))


def running(df: DataFrame, group: Sequence[str], order: Sequence[str], values: Mapping[str, tuple[str, str]]) -> DataFrame:
    """`df` with a running value per group in `order`, up to and with each row: new column -> (column, `sum` or `last`).

    The columns are whole numbers. `sum` counts NULL as 0, `last` is the last value that isn't NULL (NULL before any).
    NULL group values are a group like any other. Rows equal in group and order come in no particular order among
    themselves. The same as a window per group, but a group of any size is shared by several tasks.
    """
    names = list(values)
    how = [values[n][1] for n in names]
    if not names or set(how) - {"sum", "last"}:
        raise ValueError(f"sum or last, not {how}")
    v = [f"_tl_v{i}" for i in range(len(names))]
    rows = df.select(*[F.col(f"`{c}`") for c in df.columns], F.xxhash64(*group).alias("_tl_g"), *[F.col(values[n][0]).cast("long").alias(x) for n, x in zip(names, v)])
    chunks = range_chunks(rows, [*group, *order])
    schema = T.StructType([*chunks.schema.fields, T.StructField("_tl_chunk", T.IntegerType()), T.StructField("_tl_n", T.LongType())])
    local = cut(chunks.mapInArrow(lambda it: _running(it, how), schema))

    # One row per chunk, so no more rows than the shuffle has partitions.
    ends = local.groupBy("_tl_chunk").agg(F.min_by("_tl_g", "_tl_n").alias("g0"), F.max_by("_tl_g", "_tl_n").alias("g1"), *[F.max_by(x, "_tl_n").alias(x) for x in v])
    by_chunk = Window.orderBy("_tl_chunk")
    linked = F.coalesce(F.lag("g1").over(by_chunk) == F.col("g0"), F.lit(False))
    ends = ends.withColumn("linked", linked).withColumn("seg", F.sum(((F.col("g0") != F.col("g1")) | ~F.col("linked")).cast("int")).over(by_chunk))
    upto = Window.partitionBy("seg").orderBy("_tl_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumns({x: F.sum(x).over(upto) if h == "sum" else F.last(x, ignorenulls=True).over(upto) for x, h in zip(v, how)})
    entry = ends.select("_tl_chunk", F.col("g0").alias("_tl_g0"), *[F.when(F.col("linked"), F.lag(x).over(by_chunk)).alias(f"{x}_0") for x in v])

    joined = local.join(F.broadcast(entry), "_tl_chunk")
    carried = lambda x: F.when(F.col("_tl_g") == F.col("_tl_g0"), F.col(f"{x}_0"))
    whole = {n: F.col(x) + F.coalesce(carried(x), F.lit(0)) if h == "sum" else F.coalesce(F.col(x), carried(x)) for n, x, h in zip(names, v, how)}
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in whole], *[c.alias(n) for n, c in whole.items()])


def _running(batches: Iterator[pa.RecordBatch], how: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Running values within each group of one chunk, as if nothing came before it."""
    chunk = TaskContext.get().partitionId()
    group: int | None = None
    state: list[int | None] = [0 if h == "sum" else None for h in how]
    seen = 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        names = b.schema.names
        g = b.column(names.index("_tl_g")).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = g[1:] != g[:-1]
        new[0] = group is None or g[0] != group
        starts = np.flatnonzero(new)
        owner = np.cumsum(new)  # 0: goes on with the group before
        cols = list(b.columns)
        for i, h in enumerate(how):
            at = names.index(f"_tl_v{i}")
            null = cols[at].is_null().to_numpy(zero_copy_only=False)
            x = cols[at].fill_null(0).to_numpy(zero_copy_only=False)
            if h == "sum":
                run = np.cumsum(x)
                out = run - np.concatenate([[-(state[i] or 0)], run[starts] - x[starts]])[owner]
                cols[at], state[i] = pa.array(out), int(out[-1])
            else:
                last = np.maximum.accumulate(np.where(null, -1, np.arange(n)))
                own = last >= np.concatenate([[0], starts])[owner]
                out, none = x[np.maximum(last, 0)], ~own
                if state[i] is not None:
                    before = none & (owner == 0)
                    out = np.where(before, state[i], out)
                    none &= ~before
                cols[at], state[i] = pa.array(out, mask=none), None if none[-1] else int(out[-1])
        group = int(g[-1])
        yield pa.record_batch([*cols, pa.array(np.full(n, chunk), pa.int32()), pa.array(np.arange(seen, seen + n))], names=[*names, "_tl_chunk", "_tl_n"])
        seen += n
