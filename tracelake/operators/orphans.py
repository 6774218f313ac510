"""References to records that are missing, deleted or not yet registered.

References and parent records are put in one order by (table, hash, time) and cut into even chunks, so
both sides of a hash lie together and a hash with a third of all references spans several chunks. Each
chunk merges the two streams in one pass, keeping the number of records in force. A chunk that starts in
the middle of a hash doesn't know the records before it; its leading references carry their state
relative to the chunk's start, and a running sum over one summary row per chunk completes them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.chunked import range_chunks
from tracelake.operators.events import day_of, valid_events
from tracelake.session import cut

_FIRST = -(2**63)
_SCHEMA = "role int, chunk int, tab int, h long, event_id long, time_start long, recs long, started long, in_force long, tab0 int, h0 long, fresh boolean"
_ORPHAN, _OPEN, _SUMMARY = 0, 1, 2


def hash_number(text: Column) -> Column:
    """The number a hash spells (as a signed 64-bit value); NULL where it isn't a hexadecimal number of up to 16 digits."""
    digits = F.regexp_extract(F.lower(text), r"^[\s\p{Z}\p{C}]*(?:0x)?0*([0-9a-f]{1,16})[\s\p{Z}\p{C}]*$", 1)
    return F.conv(F.nullif(digits, F.lit("")), 16, -10).try_cast("long")


def orphan_references(
    events: DataFrame,
    parents: Mapping[str, tuple[DataFrame, str]],
    references: Mapping[str, str],
    event_id: str = "event_id",
    time: str = "time_start",
    registered: str = "registered_at",
    deleted: str = "deleted_at",
) -> DataFrame:
    """ref_table, event_id, time_start, reason of each reference without a record in force at its time.

    `references`: table name -> column of `events` holding the hash; `parents`: table name -> (records, hash column).
    A record is in force from `registered` to before `deleted` (NULL: for good); one without `registered`, or
    deleted no later than registered, never is. NULL and blank hashes are no references. reason: `missing`
    (no record of the hash), else `deleted` (some record registered by then), else `late`. A hash that isn't
    a number has no record. A reference without a time comes before every record. Several deliveries of one
    event give one row; events without an id stand alone.
    """
    names = sorted(references)
    n = len(names)
    pairs = ", ".join(f"{i}, cast(`{references[t]}` as string)" for i, t in enumerate(names))
    refs = (
        valid_events(events)
        .select(F.col(event_id).cast("long").alias("event_id"), F.coalesce(F.col(time).cast("long"), F.lit(_FIRST)).alias("t"), F.expr(f"stack({n}, {pairs}) as (tab, txt)"))
        .filter("trim(txt) <> ''")
        .withColumn("h", hash_number(F.col("txt")))
        # what isn't a number is set beside the tables, where no record lies
        .select(F.when(F.col("h").isNull(), F.col("tab") + n).otherwise(F.col("tab")).alias("tab"), F.coalesce("h", F.xxhash64("txt")).alias("h"), "t", F.lit(2).alias("kind"), "event_id")
    )
    both = refs
    for i, t in enumerate(names):
        records, column = parents[t]
        rec = (
            records.select(hash_number(F.col(column).cast("string")).alias("h"), F.col(registered).cast("long").alias("a"), F.col(deleted).cast("long").alias("z"))
            .filter("h is not null")
            .distinct()
            .withColumn("ok", F.coalesce(F.col("z") > F.col("a"), F.lit(True)).cast("long"))
        )
        # kind 0: the hash has a record; 1: one is registered (event_id: whether it comes into force); -1: one is deleted
        steps = (
            F.array(
                F.struct(F.lit(_FIRST).alias("t"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("event_id")),
                F.when(F.col("a").isNotNull(), F.struct(F.col("a").alias("t"), F.lit(1).alias("kind"), F.col("ok").alias("event_id"))),
                F.when(F.col("a").isNotNull() & F.col("z").isNotNull() & (F.col("ok") == 1), F.struct(F.col("z").alias("t"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("event_id"))),
            )
        )
        both = both.unionByName(rec.select(F.lit(i).alias("tab"), "h", F.explode(steps).alias("s")).filter("s is not null").select("tab", "h", "s.*"))

    merged = cut(range_chunks(both, ["tab", "h", "t", "kind", "event_id"]).mapInArrow(_merge, _SCHEMA))

    # One row per chunk, so no more rows than the shuffle has partitions.
    order = Window.orderBy("chunk")
    before = lambda c: F.lag(c).over(order)
    run = Window.partitionBy("seg").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    linked = F.coalesce((before("tab") == F.col("tab0")) & (before("h") == F.col("h0")), F.lit(False))
    entry = (
        merged.filter(F.col("role") == _SUMMARY)
        .withColumn("linked", linked)
        .withColumn("seg", F.sum((F.col("fresh") | ~F.col("linked")).cast("int")).over(order))
        .select("chunk", "linked", *[F.sum(c).over(run).alias(c) for c in ("recs", "started", "in_force")])
        .select("chunk", *[F.when(F.col("linked"), before(c)).otherwise(0).alias(f"{c}_0") for c in ("recs", "started", "in_force")])
    )
    done = merged.filter(F.col("role") == _ORPHAN)
    left = merged.filter(F.col("role") == _OPEN).join(F.broadcast(entry), "chunk")
    for c in ("recs", "started", "in_force"):
        left = left.withColumn(c, F.col(c) + F.col(f"{c}_0"))
    out = done.unionByName(left.filter("in_force <= 0").select(done.columns))
    name = F.element_at(F.array(*[F.lit(t) for t in names]), F.col("tab") % n + 1)
    reason = F.when(F.col("recs") <= 0, "missing").when(F.col("started") > 0, "deleted").otherwise("late")
    return out.select(name.alias("ref_table"), "event_id", F.nullif(F.col("time_start"), F.lit(_FIRST)).alias("time_start"), reason.alias("reason"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, day of the reference's time (NULL: unknown) and reason."""
    return orphans.groupBy("ref_table", day_of(F.col("time_start")).alias("day"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Linear merge of one chunk; see `orphan_references` for the rows' kinds."""
    chunk = TaskContext.get().partitionId()
    first = None  # the chunk's first (table, hash): its state is relative until another hash begins
    key, sums, last = None, np.zeros(3, np.int64), None
    left_first = False
    for b in batches:
        if not b.num_rows:
            continue
        tab, h, t, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        eid = b.column(4)
        null = eid.is_null().to_numpy(zero_copy_only=False)
        ids = eid.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.empty(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (tab[1:] != tab[:-1])
        new[0] = key is None or (tab[0], h[0]) != key
        if first is None:
            first = (int(tab[0]), int(h[0]))
        ref = kind == 2
        step = np.stack([kind == 0, kind == 1, np.where(kind == 1, ids, np.where(kind == -1, -1, 0))]).astype(np.int64)
        run = step.cumsum(axis=1)
        starts = np.flatnonzero(new)
        base = np.zeros((3, len(starts) + 1), np.int64)
        base[:, 0] = -sums  # rows before the first new hash go on with the state so far
        base[:, 1:] = run[:, starts] - step[:, starts]
        state = run - base[:, np.cumsum(new)]
        same = np.zeros(len(h), bool)
        same[1:] = ref[1:] & ref[:-1] & ~new[1:] & ~null[1:] & ~null[:-1] & (t[1:] == t[:-1]) & (ids[1:] == ids[:-1])
        if last is not None and ref[0] and not null[0]:
            same[0] = last == (int(tab[0]), int(h[0]), int(t[0]), int(ids[0]))
        # whether the hash's beginning is known: it begins after the chunk's first row
        known = np.ones(len(h), bool)
        if not left_first:
            changed = np.flatnonzero((h != first[1]) | (tab != first[0]))
            known[: changed[0] if len(changed) else len(h)] = False
            left_first = bool(len(changed))
        out = np.flatnonzero(ref & ~same & (~known | (state[2] <= 0)))
        if len(out):
            yield _batch(np.where(known[out], _ORPHAN, _OPEN), chunk, tab[out], h[out], eid.take(pa.array(out)), t[out], state[:, out])
        key, sums = (int(tab[-1]), int(h[-1])), state[:, -1].copy()
        last = (*key, int(t[-1]), int(ids[-1])) if ref[-1] and not null[-1] else None
    if first is not None:
        z = np.zeros(1, np.int64)
        yield _batch(z + _SUMMARY, chunk, z + key[0], z + key[1], pa.nulls(1, pa.int64()), z, sums[:, None], first, left_first)


def _batch(role, chunk, tab, h, ids, t, state, first=None, fresh=None) -> pa.RecordBatch:
    n = len(role)
    return pa.record_batch(
        [
            pa.array(role, pa.int32()), pa.array(np.full(n, chunk), pa.int32()), pa.array(tab, pa.int32()), pa.array(h, pa.int64()), ids, pa.array(t, pa.int64()),
            *[pa.array(s, pa.int64()) for s in state],
            pa.array([first[0] if first else None] * n, pa.int32()), pa.array([first[1] if first else None] * n, pa.int64()), pa.array([fresh] * n, pa.bool_()),
        ],
        names=[c.split()[0] for c in _SCHEMA.split(", ")],
    )
