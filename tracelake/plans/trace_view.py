"""The trace that the queries analyse: typed events from the driver's `trace` table, each once, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import vocab as V
from tracelake.operators import trace as T
from tracelake.operators.events import EDGE, distinct_events, plain_category
from tracelake.session import stored, table

_HASH = rf"^{EDGE[:-1]}*(?:0x)?0*([0-9a-f]{{1,16}}){EDGE[:-1]}*$"


def plain_hash(text: Column) -> Column:
    """The 16 digits of the hexadecimal number that a hash spells; '' for NULL, and what isn't a number as it is."""
    digits = F.regexp_extract(F.lower(text), _HASH, 1)
    return F.when(text.rlike("^[0-9a-f]{16}$"), text).when(digits != "", F.lpad(digits, 16, "0")).otherwise(F.coalesce(text, F.lit("")))


def raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as a parser would give them, before classification; those without a name or a category, and those of ignored functions, are left out."""
    columns = ["func_name", "cat", "pid", "tid", "hhash", "fhash", "time_start", "time_end", "duration", "epoch", "size", "file_offset", "image_id"]
    e = distinct_events(table(spark, d, "trace"), columns)
    return T.kept_events(
        e.select(
            "event_id",
            F.coalesce("func_name", F.lit("")).alias("func_name"),
            plain_category(F.coalesce("cat", F.lit(""))).alias("cat"),
            F.lit(V.REGULAR).alias("type"),
            "pid",
            "tid",
            plain_hash(F.col("fhash")).alias("fhash"),
            plain_hash(F.col("hhash")).alias("hhash"),
            "time_start",
            "time_end",
            "duration",
            F.lit(1).cast("long").alias("count"),
            F.col("size").alias("ret"),
            F.col("file_offset").alias("offset"),
            "image_id",
            F.coalesce("epoch", F.lit(0).cast("long")).alias("epoch"),
        )
    )


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    return T.classify(raw_events(spark, d))


def _dictionary(spark: SparkSession, d: str, name: str, key: str, value: str) -> DataFrame:
    return T.hash_dictionary(table(spark, d, name).select(plain_hash(F.col(key)).alias(key), value), key, value)


def file_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _dictionary(spark, d, "file_hashes", "fhash", "file_name")


def host_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _dictionary(spark, d, "host_hashes", "hhash", "host_name")


def named_events(spark: SparkSession, d: str) -> DataFrame:
    return T.name_processes(T.resolve_hashes(trace_events(spark, d), file_dictionary(spark, d), host_dictionary(spark, d)))


def timed_events(spark: SparkSession, d: str, granularity: float = 3.6e9, store: bool = False) -> DataFrame:
    """`store`: for readers that go over the events more than once besides the time base."""
    named = named_events(spark, d)
    return T.normalize_time(stored(named) if store else named, granularity)


def names(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


def code_sql(f: str = "func_name") -> str:
    cases = " ".join(f"WHEN {f} IN ({names(getattr(V, k))}) THEN {V.IO_CODES[k]}" for k in ("METADATA", "READ", "WRITE", "SYNC", "PCTL", "IPC"))
    return f"CASE {cases} ELSE 6 END"


def label_sql(f: str = "func_name") -> str:
    cases = " ".join(f"WHEN {f} IN ({names(x)}) THEN '{k}'" for k, x in V.LABELS.items())
    return f"CASE WHEN {f} IN ({names(V.METADATA)}) THEN 'metadata' {cases} ELSE 'other' END"


def bins_sql(size: str = "size") -> str:
    ends = [*V.BIN_BOUNDS[1:], None]
    return ", ".join(f"CAST(CASE WHEN {size} >= {a}{f' AND {size} < {z}' if z else ''} THEN 1 END AS INTEGER) AS {c}" for c, a, z in zip(V.BIN_COLUMNS, V.BIN_BOUNDS, ends))


_PATHS = " OR ".join(f"contains(file_name, '{p}')" for p in V.IGNORED_PATHS)
_ENRICH = " ".join(f"WHEN contains(file_name, '{a}') THEN cat || '{b}'" for a, b in V.PATH_SUFFIXES)

_EDGES = lambda c: f"regexp_replace({c}, '^{EDGE}|{EDGE}$', '', 'g')"
_DIGITS = lambda c: f"regexp_extract(lower({c}), '{_HASH}', 1)"
_PLAIN = lambda c: f"CASE WHEN {_DIGITS(c)} <> '' THEN lpad({_DIGITS(c)}, 16, '0') ELSE coalesce({c}, '') END"
IGNORED_SQL = f"(func_name IN ({names(V.IGNORED_FUNCTIONS)}) OR " + " OR ".join(f"contains(func_name, '{p}')" for p in V.IGNORED_PARTS) + ")"

#: Common table expressions: ev (classified), named (resolved, enriched, filtered), timed (hourly buckets).
TRACE_SQL = f"""once AS (SELECT * FROM trace WHERE is_valid IS DISTINCT FROM false
  QUALIFY event_id IS NULL OR row_number() OVER (PARTITION BY event_id ORDER BY ingested_at NULLS FIRST) = 1),
r AS (SELECT event_id, coalesce(func_name, '') AS func_name, lower({_EDGES("coalesce(cat, '')")}) AS cat, 0 AS type, pid, tid, {_PLAIN("fhash")} AS fhash, {_PLAIN("hhash")} AS hhash,
  time_start, time_end, duration, 1 AS count, size AS ret, file_offset AS "offset", image_id, coalesce(epoch, 0) AS epoch FROM once),
k AS (SELECT * FROM r WHERE func_name <> '' AND cat <> '' AND NOT {IGNORED_SQL}),
c AS (SELECT * EXCLUDE (ret, "offset", image_id), CASE WHEN cat IN ('posix','stdio') THEN {label_sql()} ELSE 'other' END AS io_cat,
  CASE WHEN cat IN ('posix','stdio') AND {label_sql()} IN ('read','write') AND ret > 0 THEN ret END AS size,
  CASE WHEN cat IN ('posix','stdio') THEN "offset" END AS "offset", CASE WHEN cat NOT IN ('posix','stdio') THEN image_id END AS image_id, '0' AS acc_pat FROM k),
ev AS (SELECT *, {bins_sql()} FROM c),
fd AS (SELECT {_PLAIN("fhash")} AS fhash, max(file_name) AS file_name FROM file_hashes WHERE {_PLAIN("fhash")} <> '' GROUP BY 1),
hd AS (SELECT {_PLAIN("hhash")} AS hhash, max(host_name) AS host_name FROM host_hashes WHERE {_PLAIN("hhash")} <> '' GROUP BY 1),
resolved AS (SELECT ev.*, file_name, host_name FROM ev LEFT JOIN fd USING (fhash) LEFT JOIN hd USING (hhash)),
named AS (SELECT * REPLACE (CASE WHEN cat IN ('posix','stdio') THEN CASE {_ENRICH} ELSE cat END ELSE cat END AS cat),
  concat_ws('#', 'app', coalesce(nullif(host_name, ''), 'unknown'), pid, tid) AS proc_name FROM resolved WHERE NOT coalesce({_PATHS}, false)),
first AS (SELECT min(time_start) AS t0 FROM named),
timed AS (SELECT * REPLACE (time_start - t0 AS time_start, time_start - t0 + TRY_CAST(trunc(duration) AS BIGINT) AS time_end, duration / 1e6 AS duration),
  (time_start - t0) // 3600000000 AS time_range FROM named, first)"""
EPOCH_SQL = f"""{TRACE_SQL},
spans AS (SELECT epoch, time_range AS span_start, time_end // 3600000000 AS span_end, time_end // 3600000000 - time_range AS span_duration FROM timed
  WHERE cat = 'pipeline' AND func_name IN ({names(V.EPOCH_NAMES)}) AND epoch > 0 AND time_end IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY epoch ORDER BY time_end // 3600000000 - time_range DESC, time_range) = 1),
assigned AS (SELECT m.* REPLACE (s.epoch AS epoch) FROM (SELECT t.time_range, min(s.epoch) AS epoch FROM (SELECT DISTINCT time_range FROM timed) t JOIN spans s ON t.time_range BETWEEN s.span_start AND s.span_end GROUP BY 1) s
  JOIN timed m USING (time_range))"""
BIN_SUMS_SQL = ", ".join(f"CAST(sum({b}) AS BIGINT) AS {b}" for b in V.BIN_COLUMNS)


def hlm_sql(keys: list[str], sets: list[str] = (), source: str = "timed", pre: str = TRACE_SQL) -> str:
    """High-level metrics by `keys` (before the extra keys) in SQL."""
    extra = [k for k in V.EXTRA_KEYS if k not in keys]
    cols = ", ".join([*keys, *extra])
    sets_ = "".join(f", coalesce(array_to_string(list_sort(list(DISTINCT {s}) FILTER ({s} IS NOT NULL)), '|'), '') AS {s}_set" for s in sets)
    return f"""WITH {pre}, h AS (SELECT * REPLACE (CAST({code_sql()} AS VARCHAR) AS io_cat) FROM {source})
SELECT {cols}, CAST(sum(TRY_CAST(duration AS DECIMAL(28,9))) AS DOUBLE) AS time, CAST(sum(count) AS BIGINT) AS count, CAST(sum(size) AS BIGINT) AS size, {BIN_SUMS_SQL}{sets_} FROM h GROUP BY {cols}"""
