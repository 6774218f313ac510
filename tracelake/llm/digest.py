"""Percentiles of large numeric columns by merging centroid digests, with certified rank errors.

A digest is a list of centroids (mean, weight). Sorted values are clustered under the size function
k(q) = delta / (2 pi) * asin(2q - 1): a cluster covers about one unit of k, so clusters are fine in the
tails and hold about pi/delta of all values in the middle. Digests merge by clustering their centroids
again. Tasks cluster their own rows before anything is shuffled; daily digests merge into digests of all
days. A second pass over the values counts how many lie below each estimate, which gives its true rank.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.grouping import grouped_stream
from tracelake.operators.events import DAY_US, distinct_events, function_key, plain_category, plain_spellings, repeated_ids, valid_events
from tracelake.session import cut, ship, shuffle_partitions

DELTA = 1000.0
PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.99)
METRICS = ("duration", "size")
NO_DAY, ALL_DAYS = -(2**31), 2**31 - 1
#: Clustering happens up to this often: in a task, per group, per block of tasks, over days.
_LEVELS = 4
_KEYS = ["func", "category", "day", "metric"]
_DIGEST = "func string, category string, day int, metric string, part int, n long, lo double, hi double, means array<double>, weights array<double>"
_DIGEST_NAMES = [c.split()[0] for c in _DIGEST.split(", ")]


def groups(ranked: DataFrame) -> DataFrame:
    """func_name, plain_name, category, day, metric, n, within_bound: of each group of `percentiles`, whether all its estimates keep to the bound."""
    return ranked.groupBy("func_name", "plain_name", "category", "day", "metric", "n").agg(F.bool_and("within_bound").alias("within_bound"))


def rank_bound(q: float, n: float, delta: float = DELTA) -> float:
    """The stated bound on |rank error| / n: one unit of k around q for each level of clustering, and one value."""
    return _LEVELS * 2 * np.pi * np.sqrt(q * (1 - q)) / delta + 1 / max(n, 1)


def cluster(codes: np.ndarray, values: np.ndarray, weights: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster weighted values within each code: codes, means and weights of the centroids, in order."""
    order = np.lexsort((values, codes))
    c, v, w = codes[order], values[order], weights[order]
    if not len(c):
        return c, v, w
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(c)))
    upto = np.cumsum(w)
    total = np.add.reduceat(w, at)
    before = np.repeat(upto[at] - w[at], size)
    q = (upto - before - w / 2) / np.repeat(total, size)
    k = np.floor(delta / (2 * np.pi) * (np.arcsin(np.clip(2 * q - 1, -1, 1)) + np.pi / 2)).astype(np.int64)
    new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    weight = np.add.reduceat(w, at)
    # means relative to a cluster's first value, so that equal values keep their mean and large ones their digits
    base = v[at]
    shift = np.add.reduceat((v - np.repeat(base, np.diff(np.append(at, len(v))))) * w, at) / weight
    return c[at], base + shift, weight


def quantiles(means: np.ndarray, weights: np.ndarray, lo: float, hi: float, at: Sequence[float]) -> list[float]:
    """Values at the given quantiles, linear between the centroids' middles, lo and hi at the ends."""
    n = weights.sum()
    mid = np.cumsum(weights) - weights / 2
    if weights[0] > 1:
        mid, means = np.append(0.5, mid), np.append(lo, means)
    if weights[-1] > 1:
        mid, means = np.append(mid, n - 0.5), np.append(means, hi)
    return [float(np.interp(p * n, mid, means)) for p in at]


def event_values(trace: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """func, category, day, duration, size of distinct events; unknown values are NULL, unknown names '' and an unknown day NO_DAY."""
    e = distinct_events(trace, ["func_name", "cat", "time_start", "duration", "size"], repeated=repeated)
    day = F.floor(F.col("time_start") / F.lit(float(DAY_US)))
    return e.select(
        F.coalesce(function_key(F.col("func_name")), F.lit("")).alias("func"),
        F.coalesce(plain_category(F.col("cat")), F.lit("")).alias("category"),
        F.coalesce(day.try_cast("int"), F.lit(NO_DAY)).alias("day"),
        F.when(~F.isnan("duration") & (F.abs("duration") < float("inf")), F.col("duration").cast("double")).alias("duration"),
        F.when(F.col("size") >= 0, F.col("size").cast("double")).alias("size"),
    )


def daily_digests(values: DataFrame, delta: float = DELTA, flush_rows: int = 1 << 20, block: int = 64) -> DataFrame:
    """One digest per func, category, day and metric, from `event_values`."""
    ship(values.sparkSession)
    partial = values.mapInArrow(lambda it: _build(it, delta, flush_rows), _DIGEST)
    if shuffle_partitions(values.sparkSession) > block:  # a hot group has a digest per task: merge blocks of tasks first
        partial = merge_digests(partial.withColumn("part", F.expr(f"part div {int(block)}")), [*_KEYS, "part"], delta)
    return merge_digests(partial, _KEYS, delta)


def merge_digests(digests: DataFrame, keys: Sequence[str], delta: float = DELTA) -> DataFrame:
    """One digest per group of `keys` (further key columns keep any value of the group's)."""
    ship(digests.sparkSession)
    placed = digests.repartition(*keys).sortWithinPartitions(*keys)
    return placed.mapInArrow(lambda it: _merge(it, list(keys), delta), _DIGEST)


def percentiles(trace: DataFrame, at: Sequence[float] = PERCENTILES, delta: float = DELTA, broadcast_rows: int = 200_000) -> DataFrame:
    """func_name, plain_name, category, day, metric, n, percentile, estimate, rank_low, rank_high, rank_error, bound, within_bound.

    func_name is a function's key, plain_name its most frequent spelling, category in lower case without blanks around it.
    day is a date, or `all` for the days combined; rows whose day, function or category is unknown have NULL
    there. Unknown values (NULL, NaN, infinite, sizes below 0) are left out, and a group without any known value
    has no row. rank_low and rank_high are the exact shares of values below and up to the estimate, counted in a
    second pass; rank_error is the distance of the percentile from that interval, `bound` what is stated for it.

    The estimates are broadcast to the counting pass up to `broadcast_rows` groups; beyond, they are joined by
    key with the events salted, so a group with a third of all events is shared by many tasks.
    """
    spark = trace.sparkSession
    # Both passes read the trace itself; what they share is which ids come more than once.
    values = event_values(trace, cut(repeated_ids(trace)))
    daily = cut(daily_digests(values, delta))
    whole = merge_digests(daily.withColumn("day", F.lit(ALL_DAYS)), _KEYS, delta)
    at = [float(p) for p in at]
    est = cut(daily.unionByName(whole).mapInArrow(lambda it: _estimate(it, at), "func string, category string, day int, metric string, n long, est array<double>"))

    group = ["func", "category", "day"]
    one = lambda d, p: d.groupBy(*group).agg(*[F.max(F.when(F.col("metric") == m, F.col("est"))).alias(f"{p}_{m}") for m in METRICS])
    per_day = one(est.filter(F.col("day") != ALL_DAYS), "d")
    overall = one(est.filter(F.col("day") == ALL_DAYS), "a").drop("day")
    limits = cut(per_day.join(overall, ["func", "category"]))
    if limits.count() <= broadcast_rows:
        joined = values.join(F.broadcast(limits), group)
    else:
        salts = min(64, shuffle_partitions(spark))
        salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = values.withColumn("salt", F.pmod(F.xxhash64("duration", "size", F.monotonically_increasing_id()), F.lit(salts)).cast("int")).join(salted, [*group, "salt"])
    counts = []
    for p in ("d", "a"):
        for m in METRICS:
            for i in range(len(at)):
                limit = F.element_at(F.col(f"{p}_{m}"), i + 1)
                counts += [F.count_if(F.col(m) < limit).alias(f"{p}_{m}_lt{i}"), F.count_if(F.col(m) <= limit).alias(f"{p}_{m}_le{i}")]
    counted = joined.groupBy(*group).agg(*counts)
    pick = lambda p: F.array(
        *[F.struct(F.lit(m).alias("metric"), F.lit(i).alias("i"), F.col(f"{p}_{m}_lt{i}").alias("lt"), F.col(f"{p}_{m}_le{i}").alias("le")) for m in METRICS for i in range(len(at))]
    )
    rows = counted.select("func", "category", F.explode(F.array(F.struct(F.col("day"), pick("d").alias("c")), F.struct(F.lit(ALL_DAYS).alias("day"), pick("a").alias("c")))).alias("x"))
    rows = rows.select("func", "category", "x.day", F.explode("x.c").alias("c")).select("func", "category", "day", "c.*")
    ranks = rows.groupBy(*_KEYS, "i").agg(F.sum("lt").alias("lt"), F.sum("le").alias("le"))
    out = est.select(*_KEYS, "n", F.posexplode("est").alias("i", "estimate")).join(ranks, [*_KEYS, "i"])
    p = F.element_at(F.array(*[F.lit(x) for x in at]), F.col("i") + 1)
    low, high = F.col("lt") / F.col("n"), F.col("le") / F.col("n")
    error = F.greatest(low - p, p - high, F.lit(0.0))
    bound = F.lit(_LEVELS * 2 * np.pi / delta) * F.sqrt(p * (1 - p)) + 1 / F.col("n")
    day = F.when(F.col("day") == ALL_DAYS, "all").when(F.col("day") != NO_DAY, F.date_from_unix_date("day").cast("string"))
    names = plain_spellings(valid_events(trace)).select(F.col("function_key").alias("func"), "plain_name")
    return out.join(names, "func", "left").select(
        F.nullif("func", F.lit("")).alias("func_name"), "plain_name", F.nullif("category", F.lit("")).alias("category"), day.alias("day"), "metric", "n", p.alias("percentile"), "estimate",
        low.alias("rank_low"), high.alias("rank_high"), error.alias("rank_error"), bound.alias("bound"), (error <= bound).alias("within_bound"),
    )


def _rows(keys: list[tuple], metric: Sequence[str], part: int, codes: np.ndarray, means: np.ndarray, weights: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """A digest for each code present; lo and hi are indexed by code."""
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    offsets = pa.array(np.append(at, len(codes)), pa.int32())
    own = codes[at]
    func, category, day = zip(*[keys[c] for c in own])
    n = np.add.reduceat(weights, at)
    return pa.record_batch(
        [
            pa.array(func, pa.string()), pa.array(category, pa.string()), pa.array(day, pa.int32()), pa.array(metric if len(metric) == len(own) else [metric[0]] * len(own), pa.string()), pa.array([part] * len(own), pa.int32()),
            pa.array(np.rint(n).astype(np.int64)), pa.array(lo[own]), pa.array(hi[own]), pa.ListArray.from_arrays(offsets, pa.array(means)), pa.ListArray.from_arrays(offsets, pa.array(weights)),
        ],
        names=_DIGEST_NAMES,
    )


def _extremes(codes: np.ndarray, lows: np.ndarray, highs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = np.full(n, np.inf), np.full(n, -np.inf)
    np.minimum.at(lo, codes, lows)
    np.maximum.at(hi, codes, highs)
    return lo, hi


def _build(batches: Iterator[pa.RecordBatch], delta: float, flush_rows: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    code: dict[tuple, int] = {}
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(code)
        codes = np.concatenate([k[0] for k in kept])
        for j, m in enumerate(METRICS):
            v = np.concatenate([k[1 + j] for k in kept])
            known = ~np.isnan(v)
            if known.any():
                c, v = codes[known], v[known]
                yield _rows(keys, [m], part, *cluster(c, v, np.ones(len(v)), delta), *_extremes(c, v, v, len(keys)))
        code.clear()
        kept.clear()

    for b in batches:
        if not b.num_rows:
            continue
        f, c = b.column(0).dictionary_encode(), b.column(1).dictionary_encode()
        day = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
        joint = (f.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)) << 32 | (day + 2**31)
        seen, inverse = np.unique(joint, return_inverse=True)
        funcs, cats = f.dictionary.to_pylist(), c.dictionary.to_pylist()
        own = np.empty(len(seen), np.int64)
        for i, s in enumerate(seen.tolist()):
            a, z = divmod(s >> 32, len(cats))
            own[i] = code.setdefault((funcs[a], cats[z], (s & 0xFFFFFFFF) - 2**31), len(code))
        kept.append((own[inverse], *[b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (3, 4)]))
        held += b.num_rows
        if held >= flush_rows:
            yield from flush()
            held = 0
    if kept:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch], keys: list[str], delta: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by `keys`; whole groups are merged, many at a time."""
    for t in grouped_stream(batches, keys, weight="means", enough=1 << 19):
        cols = {n: t.column(n) for n in _DIGEST_NAMES}
        names = [cols[k].to_pylist() for k in _KEYS]
        part = cols["part"].to_pylist()
        code: dict[tuple, int] = {}
        slots = [names[_KEYS.index(k)] if k in _KEYS else part for k in keys]
        own = np.array([code.setdefault(x, len(code)) for x in zip(*slots)])
        first = {c: i for i, c in reversed(list(enumerate(own.tolist())))}
        size = np.diff(cols["means"].offsets.to_numpy())
        codes = np.repeat(own, size)
        lo, hi = _extremes(own, cols["lo"].to_numpy(), cols["hi"].to_numpy(), len(code))
        out = cluster(codes, cols["means"].flatten().to_numpy(), cols["weights"].flatten().to_numpy(), delta)
        heads = [first[c] for c in range(len(code))]
        labels = [(names[0][i], names[1][i], names[2][i]) for i in heads]
        batch = _rows(labels, [names[3][i] for i in heads], 0, *out, lo, hi)
        if "part" in keys:
            batch = batch.set_column(4, "part", pa.array([part[i] for i in heads], pa.int32()))
        yield batch


def _estimate(batches: Iterator[pa.RecordBatch], at: Sequence[float]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        est = []
        means, weights, lo, hi = (b.column(_DIGEST_NAMES.index(n)) for n in ("means", "weights", "lo", "hi"))
        for i in range(b.num_rows):
            est.append(quantiles(np.array(means[i].as_py()), np.array(weights[i].as_py()), lo[i].as_py(), hi[i].as_py(), at))
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), b.column(5), pa.array(est, pa.list_(pa.float64()))], names=["func", "category", "day", "metric", "n", "est"])
