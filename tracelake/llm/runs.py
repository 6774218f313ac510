"""Runs of consecutive equal events, collapsed by associative run summaries.

Events are range-sorted by (pid, tid, time_start, event_id) into even chunks, so a thread with a third of
all events spans many of them. Each chunk encodes its runs in one streaming pass; only its first and last
run can go on in a neighbour. Those edge runs are joined by a tree of merges: blocks of chunks at a time,
each block leaving its own first and last run, so no task sees more than a block's edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.chunked import range_chunks
from tracelake.operators.events import function_key, valid_events
from tracelake.session import cut, shuffle_partitions

_NONE = -(2**63)
_SCHEMA = "chunk int, edge int, pid long, tid long, function_key string, first_event_id long, last_event_id long, n_events long, from_time long, to_time long"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5]
_FIRST, _LAST = 1, 2


def collapse_runs(trace: DataFrame, min_events: int = 1, fan_in: int = 64) -> DataFrame:
    """pid, tid, function_key, first_event_id, last_event_id, n_events, from_time, to_time, duration of each run of at least `min_events`.

    A run is a longest stretch of events of one function in a thread's order (time_start, then event_id; NULLs
    first). Names that differ in decoration or letter case only are one function; a NULL or blank name is of no
    known function, ends the run before it and stands alone. NULL pid or tid are a thread like any other. to_time
    is the latest known end not before its start, or else the latest start; duration is to_time - from_time, NULL
    without times. Deliveries of one event (same id, thread and start) count once; rows without an id all count.
    """
    n = shuffle_partitions(trace.sparkSession)
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(_NONE)).alias(c)
    rows = valid_events(trace).select(whole("pid"), whole("tid"), whole("time_start"), F.col("event_id").cast("long").alias("event_id"), F.col("time_end").cast("long").alias("time_end"), "func_name")
    chunks = range_chunks(rows, ["pid", "tid", "time_start", "event_id"], n).withColumn("func_name", function_key(F.col("func_name")))
    runs = cut(chunks.mapInArrow(lambda it: _encode(it, min_events), _SCHEMA))

    done = [runs.filter("edge = 0")]
    edges = runs.filter("edge > 0")
    for _ in range(max(1, math.ceil(math.log(max(n, 2), fan_in)))):
        merged = cut(edges.withColumn("block", F.expr(f"chunk div {fan_in}")).groupBy("block").applyInPandas(_join_edges, _SCHEMA))
        done.append(merged.filter(f"edge = 0 and n_events >= {int(min_events)}"))
        edges = merged.filter("edge > 0")
    done.append(edges.filter(f"n_events >= {int(min_events)}"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    known = lambda c: F.nullif(F.col(c), F.lit(_NONE)).alias(c)
    return out.select(
        known("pid"), known("tid"), "function_key", "first_event_id", "last_event_id", "n_events", known("from_time"), known("to_time"),
        F.when((F.col("from_time") != _NONE) & (F.col("to_time") != _NONE), F.col("to_time") - F.col("from_time")).alias("duration"),
    )


def _encode(batches: Iterator[pa.RecordBatch], min_events: int) -> Iterator[pa.RecordBatch]:
    """The runs of one chunk; the first and the last are flagged and come out whatever their length."""
    chunk = TaskContext.get().partitionId()
    last: tuple | None = None  # thread, start and id of the row before
    open_: list | None = None  # the run that may go on: pid, tid, key, first id, last id, count, from, to
    first = True
    for b in batches:
        if not b.num_rows:
            continue
        pid, tid, start = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ids, null = b.column(3).fill_null(0).to_numpy(zero_copy_only=False), b.column(3).is_null().to_numpy(zero_copy_only=False)
        same = np.zeros(len(pid), bool)
        same[1:] = (pid[1:] == pid[:-1]) & (tid[1:] == tid[:-1]) & (start[1:] == start[:-1]) & (ids[1:] == ids[:-1]) & ~null[1:] & ~null[:-1]
        same[0] = last is not None and not null[0] and last == (pid[0], tid[0], start[0], ids[0])
        last = (pid[-1], tid[-1], start[-1], ids[-1]) if not null[-1] else None
        keep = np.flatnonzero(~same)
        if not len(keep):
            continue
        pid, tid, start = pid[keep], tid[keep], start[keep]
        take = pa.array(keep)
        raw, key = b.column(3).take(take), b.column(5).take(take)
        end = b.column(4).fill_null(_NONE).to_numpy(zero_copy_only=False)[keep]
        end = np.where(end >= start, end, start)
        new = np.ones(len(pid), bool)
        alike = pc.fill_null(pc.equal(key.slice(1), key.slice(0, len(key) - 1)), False).to_numpy(zero_copy_only=False)
        new[1:] = ~((pid[1:] == pid[:-1]) & (tid[1:] == tid[:-1]) & alike)
        at = np.flatnonzero(new)
        stop = np.append(at[1:], len(pid)) - 1
        cols = [pid[at], tid[at], key.take(pa.array(at)), raw.take(pa.array(at)), raw.take(pa.array(stop)), stop - at + 1, start[at], np.maximum.reduceat(end, at)]
        head = [int(pid[0]), int(tid[0]), key[0].as_py(), raw[0].as_py(), cols[4][0].as_py(), int(cols[5][0]), int(start[0]), int(cols[7][0])]
        if open_ is not None and head[2] is not None and open_[:3] == head[:3]:
            head[3], head[5], head[6], head[7] = open_[3], open_[5] + head[5], open_[6], max(open_[7], head[7])
        elif open_ is not None:
            if first or open_[5] >= min_events:
                yield _one(chunk, _FIRST if first else 0, open_)
            first = False
        if len(at) == 1:
            open_ = head
            continue
        if first or head[5] >= min_events:
            yield _one(chunk, _FIRST if first else 0, head)
        first = False
        inner = np.arange(1, len(at) - 1)
        inner = inner[cols[5][inner] >= min_events]
        if len(inner):
            ix = pa.array(inner)
            n = len(inner)
            yield pa.record_batch([pa.array(np.full(n, chunk), pa.int32()), pa.array(np.zeros(n), pa.int32()), *[(c if isinstance(c, pa.Array) else pa.array(c)).take(ix).cast(t) for c, t in zip(cols, _TYPES[2:])]], names=_NAMES)
        open_ = [int(pid[-1]), int(tid[-1]), cols[2][-1].as_py(), cols[3][-1].as_py(), cols[4][-1].as_py(), int(cols[5][-1]), int(cols[6][-1]), int(cols[7][-1])]
    if open_ is not None:
        yield _one(chunk, _LAST | (_FIRST if first else 0), open_)


def _one(chunk: int, edge: int, run: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], t) for v, t in zip([chunk, edge, *run], _TYPES)], names=_NAMES)


def _join_edges(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Join the edge runs of a block of chunks; the block's own first and last run stay edges, of chunk `block`."""
    rows = sorted(pdf[_NAMES].astype(object).itertuples(index=False, name=None), key=lambda r: (r[0], r[1] & _LAST, ~r[1] & _FIRST))
    out: list[list] = []
    for r in rows:
        r = [None if v is None or v is pd.NA or v != v else v for v in r]
        p = out[-1] if out else None
        if p and p[1] & _LAST and r[1] & _FIRST and r[4] is not None and p[2:5] == r[2:5]:
            p[1] = (p[1] & _FIRST) | (r[1] & _LAST)
            p[6], p[7], p[9] = r[6], p[7] + r[7], max(p[9], r[9])
        else:
            out.append(r)
    for i, r in enumerate(out):
        r[0], r[1] = key[0], (_FIRST if i == 0 else 0) | (_LAST if i == len(out) - 1 else 0)
    frame = pd.DataFrame(out, columns=_NAMES)
    return frame.astype({c: "Int64" for c in _NAMES if c != "function_key"})
