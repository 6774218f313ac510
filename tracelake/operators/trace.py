"""From trace lines to typed events, and from events to high-level metrics.

Every stage is a function from DataFrame to DataFrame. A whole analysis parses the lines once into typed events; over
those it is one small aggregate for the time base, a join per hash dictionary, and one shuffle for the metrics.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.functions import vocab as V
from tracelake.functions.lines import is_event_line, json_value
from tracelake.operators.chunked import running
from tracelake.session import cut, is_small, ship, stored

PARSED = {"type", "func_name", "cat", "ph", "pid", "tid", "hhash", "fhash", "time_start", "time_end", "duration", "count", "ret", "offset", "image_id", "epoch", "io_cat", "size", "acc_pat", *V.BIN_COLUMNS}
#: Rows up to which a hash dictionary is broadcast, if it is also small enough in bytes (`is_small`); larger ones are joined by key.
BROADCAST_ROWS = 500_000
#: Members up to which a group's set is given as an array.
MAX_SET = 10_000


def parse_trace(lines: DataFrame, value: str = "value", mode: str = "analyze") -> DataFrame:
    """`lines` with a text column -> typed events; lines that aren't events or aren't JSON are left out.

    mode `analyze`: categories in lower case, sizes from what reads and writes returned, all metadata types.
    mode `replay`: categories as written, args.size and args.offset as they are, file and host hashes only.
    Numbers may be given as text; what can't be read is NULL (epoch, pid, tid, start: 0), and so is an end whose
    duration isn't a number that fits. Other columns of `lines` stay, but those named like parsed ones.
    """
    if mode not in ("analyze", "replay"):
        raise ValueError(f"no such mode: {mode}")
    keep = [F.col(f"`{c}`") for c in lines.columns if c != value and c not in PARSED]
    doc = json_value(F.col(value))
    rows = lines.filter(is_event_line(F.col(value))).select(*keep, doc.alias("_tl_j")).filter("_tl_j is not null")
    get = lambda path, kind: F.try_variant_get("_tl_j", f"$.{path}", kind)
    meta = get("ph", "string") == "M"
    name = F.coalesce(get("name", "string"), F.lit(""))
    kind = F.when(~F.coalesce(meta, F.lit(False)), V.REGULAR)
    for k, code in V.TYPE_CODES.items():
        if mode == "analyze" or k in ("FH", "HH"):
            kind = kind.when(name == k, code)
    kind = kind.otherwise(V.OTHER_METADATA)
    cat = F.coalesce(get("cat", "string"), F.lit(""))
    cat = F.lower(cat) if mode == "analyze" else cat
    dur = F.coalesce(get("dur", "double"), F.lit(0.0))
    start = F.coalesce(get("ts", "long"), F.lit(0))
    value_ = F.coalesce(get("args.value", "string"), F.lit(""))
    base = rows.select(
        *keep,
        kind.alias("type"),
        F.when((kind != V.REGULAR), F.coalesce(get("args.name", "string"), F.lit(""))).otherwise(name).alias("func_name"),
        cat.alias("cat"),
        get("ph", "string").alias("ph"),
        F.coalesce(get("pid", "long"), F.lit(0)).alias("pid"),
        F.coalesce(get("tid", "long"), F.lit(0)).alias("tid"),
        F.when(kind == 2, value_).otherwise(F.coalesce(get("args.hhash", "string"), F.lit(""))).alias("hhash"),
        F.when((kind != V.REGULAR) & (kind != 2), value_).otherwise(F.coalesce(get("args.fhash", "string"), F.lit(""))).alias("fhash"),
        start.alias("time_start"),
        F.try_add(start, dur.try_cast("long")).alias("time_end"),
        dur.alias("duration"),
        F.lit(1).cast("long").alias("count"),
        get("args.ret", "long").alias("ret"),
        get("args.size", "long").alias("_tl_size"),
        get("args.offset", "long").alias("offset"),
        get("args.image_idx", "long").alias("image_id"),
        F.coalesce(get("args.epoch", "long"), F.lit(0)).alias("epoch"),
    )
    if mode == "replay":
        return base.withColumn("size", F.col("_tl_size")).drop("ret", "_tl_size", "image_id", "epoch", "count")
    return classify(base.drop("_tl_size"))


def classify(events: DataFrame) -> DataFrame:
    """io_cat, size, offset, image_id, acc_pat and the size bins, from cat, func_name, ret, offset and image_id."""
    io = F.col("cat").isin("posix", "stdio")
    size = S.known_size(F.col("cat"), F.col("func_name"), F.col("ret"))
    out = events.withColumns(
        {
            "io_cat": F.when(io, S.io_category_label(F.col("func_name"))).otherwise("other"),
            "size": size,
            "offset": F.when(io, F.col("offset")),
            "image_id": F.when(~io, F.col("image_id")),
            "acc_pat": F.lit(str(V.ACCESS_PATTERNS["SEQUENTIAL"])),
        }
    ).drop("ret")
    return out.withColumns(S.size_bins(F.col("size")))


def kept_events(events: DataFrame) -> DataFrame:
    """Without records that have no name or category, and without ignored functions."""
    return events.filter((F.col("func_name") != "") & (F.col("cat") != "") & ~S.ignored_function(F.col("func_name")))


def regular_events(events: DataFrame) -> DataFrame:
    return events.filter(F.col("type") == V.REGULAR)


def hash_dictionary(records: DataFrame, hash_column: str, name_column: str) -> DataFrame:
    """hash, name: one row per hash; of several names the largest, so the choice is the same in every run."""
    rows = records.filter(F.col(hash_column).isNotNull() & (F.col(hash_column) != ""))
    return rows.groupBy(F.col(hash_column).alias("hash")).agg(F.max(name_column).alias("name"))


def dictionaries_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The file and the host dictionary that a trace's own metadata rows give: one pass over them, materialised."""
    hash_ = F.when(F.col("type") == 1, F.col("fhash")).otherwise(F.col("hhash"))
    rows = events.filter("type in (1, 2)").select("type", hash_.alias("hash"), "func_name").filter("hash <> ''")
    both = cut(rows.groupBy("type", "hash").agg(F.max("func_name").alias("name")))
    return both.filter("type = 1").drop("type"), both.filter("type = 2").drop("type")


def resolve_hashes(events: DataFrame, files: DataFrame, hosts: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """file_name and host_name by dictionaries (hash, name); NULL where a hash isn't known.

    A dictionary is broadcast if it is sure to have at most `broadcast_rows` rows; a larger one is joined by
    key, where adaptive execution splits hot keys.
    """
    out = events.drop("file_name", "host_name")
    for dictionary, key, name in ((files, "fhash", "file_name"), (hosts, "hhash", "host_name")):
        d = dictionary.select(F.col("hash").alias(key), F.col("name").alias(name))
        out = out.join(F.broadcast(d) if is_small(d, broadcast_rows) else d, key, "left")
    return out


def name_processes(events: DataFrame) -> DataFrame:
    """proc_name, and the category by its file's place; events on ignored files are left out."""
    out = events.withColumn("proc_name", S.process_name(F.col("host_name"), F.col("pid"), F.col("tid")))
    return out.filter(~S.ignored_path(F.col("file_name"))).withColumn("cat", S.enriched_category(F.col("cat"), F.col("file_name")))


def normalize_time(events: DataFrame, granularity: float = 1e6, resolution: float = 1e6) -> DataFrame:
    """Times relative to the earliest start; duration in units of `resolution`; time_range buckets of `granularity`.

    The earliest start is a scalar subquery, run with the query that reads the result: an aggregate over the same
    source, of the columns that decide which events there are and of the start.
    """
    first = events.agg(F.min("time_start").cast("long").alias("_tl_first")).scalar()
    start = F.col("time_start") - first
    return events.withColumn("time_start", start).withColumns(
        {
            "time_end": F.try_add(F.col("time_start"), F.col("duration").try_cast("long")),
            "duration": F.col("duration") / F.lit(float(resolution)),
            "time_range": S.time_range(F.col("time_start"), granularity),
        }
    )


def epoch_spans(events: DataFrame, granularity: float = 1e6) -> DataFrame:
    """epoch, span_start, span_end, span_duration (in time ranges): the longest epoch event of each epoch.

    Of equally long ones the earliest. Epoch 0 stands for none and has no span.
    """
    marks = events.filter(S.is_epoch_event(F.col("cat"), F.col("func_name")) & (F.col("epoch") > 0) & F.col("time_end").isNotNull())
    end = S.time_range(F.col("time_end"), granularity)
    marks = marks.select("epoch", F.col("time_range").alias("s"), end.alias("e"))
    best = F.max_by(F.struct("s", "e"), F.struct((F.col("e") - F.col("s")).alias("d"), (-F.col("s")).alias("b")))
    return marks.groupBy("epoch").agg(best.alias("b")).select("epoch", F.col("b.s").alias("span_start"), F.col("b.e").alias("span_end"), (F.col("b.e") - F.col("b.s")).alias("span_duration"))


def assign_epochs(events: DataFrame, spans: DataFrame, chain: int = 500) -> DataFrame:
    """epoch of the lowest-numbered span that holds the event's time_range; events outside all spans are left out.

    Up to `chain` spans become one conditional expression, with no join. More are made into stretches that don't
    overlap; the different time ranges there are find their stretch in one order, and the events join them by range.
    """
    rows = spans.select("epoch", "span_start", "span_end").orderBy("epoch").limit(chain + 1).collect()
    if len(rows) <= chain:
        pick: Column | None = None
        for e, a, z in rows:
            inside = F.col("time_range").between(a, z)
            pick = F.when(inside, F.lit(e)) if pick is None else pick.when(inside, F.lit(e))
        pick = F.lit(None).cast("long") if pick is None else pick.cast("long")
        return events.withColumn("epoch", pick).filter("epoch is not null")
    none = F.lit(None).cast("long")
    starts = stretches(spans).select(F.col("a").alias("time_range"), F.lit(0).alias("kind"), F.col("epoch").alias("of"), F.col("z").alias("until"))
    ranges = events.select(F.col("time_range").cast("long").alias("time_range")).filter("time_range is not null").distinct().select("time_range", F.lit(1).alias("kind"), none.alias("of"), none.alias("until"))
    seen = running(starts.unionByName(ranges).withColumn("all", F.lit(0)), ["all"], ["time_range", "kind"], {"of": ("of", "last"), "until": ("until", "last")})
    found = seen.filter("kind = 1 and until >= time_range").select("time_range", F.col("of").alias("epoch"))
    return events.drop("epoch").join(found, "time_range")


def stretches(spans: DataFrame) -> DataFrame:
    """a, z, epoch: stretches that don't overlap, each with the lowest epoch of the spans (epoch, span_start, span_end) that hold it.

    A sweep over the starts with a heap of open spans, in one task: there is a row per epoch. A span that ends before
    it starts holds nothing.
    """
    ship(spans.sparkSession)
    rows = spans.select(*[F.col(c).cast("long").alias(c) for c in ("span_start", "span_end", "epoch")]).filter("span_end >= span_start")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple[int, int]] = []
        at = 0
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for a, z, epoch in zip(*(c.to_pylist() for c in b.columns)):
                at = _advance(open_, at, a, out) if open_ else a
                heapq.heappush(open_, (epoch, z))
            yield _stretch_batch(out)
        out = []
        _advance(open_, at, None, out)
        yield _stretch_batch(out)

    return rows.repartition(1).sortWithinPartitions("span_start", "epoch").mapInArrow(sweep, "a long, z long, epoch long")


def _advance(open_: list[tuple[int, int]], at: int, to: int | None, out: list[tuple[int, int, int]]) -> int:
    """Give out what the open spans hold from `at` to before `to` (None: to their end)."""
    while open_ and (to is None or at < to):
        epoch, end = open_[0]
        if end < at:
            heapq.heappop(open_)
            continue
        last = end if to is None else min(end, to - 1)
        out.append((at, last, epoch))
        at = last + 1
    return at if to is None else max(at, to)


def _stretch_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["a", "z", "epoch"])


def views_of(views: str | Sequence[str]) -> list[str]:
    """View types as given (text is split at commas, empty ones dropped), with proc_name, sorted."""
    given = views.split(",") if isinstance(views, str) else list(views)
    return sorted({v.strip() for v in given if v.strip()} | {"proc_name"})


def high_level_metrics(events: DataFrame, views: str | Sequence[str] = ("proc_name", "file_name"), sets: bool = True) -> DataFrame:
    """time, count, size and size bins per views, cat, io_cat (as code), acc_pat and func_name.

    Unknown sizes are left out; a group without any has NULL. With `sets`, the views that aren't keys come as
    sorted arrays of their different values, or as NULL where there are more than MAX_SET: `unique_members` has
    those, a row each. Durations are added exactly, to a billionth; NaN and what is too large for that is left out.
    """
    keys = list(dict.fromkeys([*views_of(views), *V.EXTRA_KEYS]))
    rows = events.withColumn("io_cat", S.io_category_code(F.col("func_name")).cast("string"))
    aggs = [F.sum(F.col("duration").try_cast("decimal(28,9)")).cast("double").alias("time"), F.sum("count").alias("count"), F.sum("size").alias("size")]
    aggs += [F.sum(b).alias(b) for b in V.BIN_COLUMNS if b in events.columns]
    out = rows.groupBy(*keys).agg(*aggs)
    if sets:
        for v in ("file_name", "proc_name"):
            if v not in keys and v in events.columns:
                out = _with_set(out, unique_members(events, v, views), keys, v)
    return out


def unique_members(events: DataFrame, member: str, views: str | Sequence[str] = ("proc_name", "file_name")) -> DataFrame:
    """Every different value of `member` in each group of `high_level_metrics`, a row each; NULL is none."""
    keys = list(dict.fromkeys([*views_of(views), *V.EXTRA_KEYS]))
    rows = events.withColumn("io_cat", S.io_category_code(F.col("func_name")).cast("string"))
    return rows.filter(F.col(member).isNotNull()).select(*keys, member).distinct()


def _with_set(metrics: DataFrame, members: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """`metrics` with the members of each group that has at most MAX_SET as an array; larger groups, usually none, are found by count first, so none is ever gathered."""
    named = [F.col(k).alias(f"_tl_{k}") for k in keys]
    same = lambda df: [df[k].eqNullSafe(F.col(f"_tl_{k}")) for k in keys]
    large = members.groupBy(*named).agg(F.count(F.lit(1)).alias("_tl_n")).filter(F.col("_tl_n") > MAX_SET)
    few = members.join(large, same(members), "left_anti")
    sets = few.groupBy(*named).agg(F.sort_array(F.collect_list(member)).alias(f"{member}_set"))
    out = metrics.join(sets, same(metrics), "left").drop(*[f"_tl_{k}" for k in keys]).join(large, same(metrics), "left")
    none = F.array().cast("array<string>")
    return out.withColumn(f"{member}_set", F.when(F.col("_tl_n").isNull(), F.coalesce(f"{member}_set", none))).drop("_tl_n", *[f"_tl_{k}" for k in keys])


def metric_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.sum("count").alias("total_count"), F.sum(F.col("time").try_cast("decimal(28,9)")).cast("double").alias("total_time"), F.sum("size").alias("total_size"), F.count(F.lit(1)).alias("n_groups"))


def humanized(df: DataFrame) -> DataFrame:
    """Columns under their readers' names."""
    return df.select(*[F.col(f"`{c}`").alias(V.COLUMN_LABELS.get(c, c)) for c in df.columns])


def analyze(events: DataFrame, views: str | Sequence[str] = ("proc_name", "file_name"), granularity: float = 1e6, resolution: float = 1e6) -> DataFrame:
    """Parsed events (all types) -> high-level metrics, by way of every stage above.

    Lines are parsed once: the typed events are stored, and dictionaries, time base, epochs and metrics read the
    columns they need from there.
    """
    events = stored(kept_events(events))
    named = name_processes(resolve_hashes(regular_events(events), *dictionaries_of(events)))
    timed = normalize_time(named, granularity, resolution)
    if "epoch" in views_of(views):
        timed = assign_epochs(timed, epoch_spans(timed, granularity))
    return high_level_metrics(timed, views)
