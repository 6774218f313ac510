"""One query per operator of trace analytics over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import lines as L
from tracelake.functions import scalar as S
from tracelake.functions import vocab as V
from tracelake.operators import chunking, index, replay
from tracelake.operators import trace as T
from tracelake.operators.chunked import running
from tracelake.plans import trace_view as W
from tracelake.session import table
from tracelake.sources import archive, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_T = W.TRACE_SQL


# Scalar functions
@query(f"WITH {_T} SELECT event_id, {W.code_sql()} AS io_code FROM ev")
def io_category_code(spark, d):
    return W.raw_events(spark, d).select("event_id", S.io_category_code(F.col("func_name")).alias("io_code"))


@query(f"WITH {_T} SELECT event_id, io_cat FROM ev")
def io_category_label(spark, d):
    return W.trace_events(spark, d).select("event_id", "io_cat")


@query(f"SELECT event_id, func_name, {W.code_sql()} AS io_code, {W.label_sql()} AS io_label FROM trace WHERE is_valid IS DISTINCT FROM false")
def io_categories_of_trace(spark, d):
    t = table(spark, d, "trace").filter("is_valid is distinct from false")
    return t.select("event_id", "func_name", S.io_category_code(F.col("func_name")).alias("io_code"), S.io_category_label(F.col("func_name")).alias("io_label"))


@query(f"WITH {_T} SELECT event_id, size, {', '.join(V.BIN_COLUMNS)} FROM ev")
def size_bins(spark, d):
    return W.trace_events(spark, d).select("event_id", "size", *V.BIN_COLUMNS)


_BIN_CASE = " ".join(f"WHEN size < {b} THEN '{x}'" for b, x in zip(V.BIN_BOUNDS[1:], V.BIN_LABELS))


@query(f"SELECT event_id, CASE WHEN size < 0 THEN NULL {_BIN_CASE} WHEN size IS NOT NULL THEN '{V.BIN_LABELS[-1]}' END AS size_label FROM trace")
def size_labels(spark, d):
    return table(spark, d, "trace").select("event_id", S.size_label(F.col("size")).alias("size_label"))


_NAME_CASE = " ".join(f"WHEN size < {b} THEN '{x}'" for b, x in zip(V.BIN_BOUNDS[1:], V.BIN_NAMES))


@query(f"SELECT event_id, CASE WHEN size < 0 THEN NULL {_NAME_CASE} WHEN size IS NOT NULL THEN '{V.BIN_NAMES[-1]}' END AS size_name FROM trace")
def size_names(spark, d):
    return table(spark, d, "trace").select("event_id", S.size_label(F.col("size"), V.BIN_NAMES).alias("size_name"))


_KIND = f"CASE {W.code_sql()} WHEN 1 THEN 'read' WHEN 2 THEN 'write' WHEN 3 THEN 'metadata' END"
_OPERATION = " ".join(f"WHEN contains(func_name, '{x}') THEN '{x}'" for x in V.DERIVED_METADATA_OPERATIONS)


@query(f"SELECT event_id, {_KIND} AS io_type, upper(left({_KIND}, 1)) AS io_letter, CASE WHEN func_name IN ({W.names(V.METADATA)}) THEN CASE {_OPERATION} END END AS operation FROM trace")
def io_types(spark, d):
    kind = S.io_type(F.col("func_name"))
    return table(spark, d, "trace").select("event_id", kind.alias("io_type"), S.compact_io_type(kind).alias("io_letter"), S.metadata_operation(F.col("func_name")).alias("operation"))


@query("SELECT event_id, lower(cat) AS cat FROM trace")
def lower_category(spark, d):
    return table(spark, d, "trace").select("event_id", F.lower("cat").alias("cat"))


@query("SELECT event_id, time_start // 1000000 AS bucket, CAST(0 AS BIGINT) AS no_bucket FROM trace")
def time_bucket(spark, d):
    return table(spark, d, "trace").select("event_id", S.time_range(F.col("time_start"), 1e6).alias("bucket"), S.time_range(F.col("time_start"), 0).alias("no_bucket"))


@query(f"WITH {_T} SELECT event_id, cat, file_name, proc_name FROM named")
def category_enrich(spark, d):
    return W.named_events(spark, d).select("event_id", "cat", "file_name", "proc_name")


@query(f"WITH {_T} SELECT event_id, proc_name FROM named")
def proc_name(spark, d):
    return W.named_events(spark, d).select("event_id", "proc_name")


_DIR = "CASE WHEN contains(file_name, '/') THEN regexp_replace(file_name, '/[^/]*$', '') ELSE '' END"


@query(
    f"""WITH {_T} SELECT event_id, {_DIR} AS file_dir, regexp_replace(file_name, '[0-9]+', '[0-9]', 'g') AS file_pattern, split_part(proc_name, '#', 1) AS app_name,
split_part(proc_name, '#', 2) AS host_name, split_part(split_part(proc_name, '#', 2), '.', 1) AS node_name, split_part(proc_name, '#', 3) AS proc_id, CAST(NULL AS VARCHAR) AS rank,
split_part(proc_name, '#', 4) AS thread_id FROM named"""
)
def derived_views(spark, d):
    v = S.logical_views(F.col("file_name"), F.col("proc_name"))
    return W.named_events(spark, d).select("event_id", *[c.alias(k) for k, c in v.items()])


_VIEWS = [*V.VIEWS, *(v for views in V.LOGICAL_VIEWS.values() for v in views)]


@query(
    f"""WITH {_T}, d AS (SELECT time_range, proc_name, file_name, {_DIR} AS file_dir, regexp_replace(file_name, '[0-9]+', '[0-9]', 'g') AS file_pattern, split_part(proc_name, '#', 1) AS app_name,
split_part(proc_name, '#', 2) AS host_name, split_part(split_part(proc_name, '#', 2), '.', 1) AS node_name, split_part(proc_name, '#', 3) AS proc_id, CAST(NULL AS VARCHAR) AS rank,
split_part(proc_name, '#', 4) AS thread_id FROM timed) """
    + " UNION ALL ".join(f"SELECT '{V.VIEW_LABELS.get(v, v)}' AS view, count(DISTINCT {v}) AS n_values, '{V.METRIC_LABELS['time']}' AS metric FROM d" for v in _VIEWS)
)
def view_labels(spark, d):
    """How many values each view has, under the names for readers."""
    t = W.timed_events(spark, d)
    made = t.select(*[c for c in V.VIEWS if c != "host_name"], *[c.alias(k) for k, c in S.logical_views(F.col("file_name"), F.col("proc_name")).items()])
    pairs = ", ".join(f"'{v}', cast(`{v}` as string)" for v in _VIEWS)
    rows = made.select(F.expr(f"stack({len(_VIEWS)}, {pairs}) as (view, value)")).distinct()
    return rows.groupBy("view").agg(F.count("value").alias("n_values")).select(S.view_label(F.col("view")).alias("view"), "n_values", S.metric_label(F.lit("time")).alias("metric"))


@query(
    f"""WITH {_T}, h AS (SELECT * REPLACE (CAST({W.code_sql()} AS VARCHAR) AS io_cat) FROM timed) SELECT DISTINCT proc_name, cat, io_cat, acc_pat, func_name, file_name FROM h WHERE file_name IS NOT NULL"""
)
def hlm_unique_members(spark, d):
    return T.unique_members(W.timed_events(spark, d), "file_name", "")


@query("SELECT record_id, regexp_extract(file_name, '[^/]*$') AS base_name FROM file_hashes")
def base_names(spark, d):
    return table(spark, d, "file_hashes").select("record_id", S.base_name(F.col("file_name")).alias("base_name"))


# Filters
_IGNORED = f"(coalesce(func_name IN ({W.names(V.IGNORED_FUNCTIONS)}), false) OR " + " OR ".join(f"coalesce(contains(func_name, '{p}'), false)" for p in V.IGNORED_PARTS) + ")"


@query(f"SELECT event_id, func_name FROM trace WHERE NOT {_IGNORED} AND func_name <> '' AND cat <> ''")
def event_filter_ignored(spark, d):
    return T.kept_events(table(spark, d, "trace")).select("event_id", "func_name")


@query(f"SELECT record_id, file_name, coalesce({' OR '.join(f'contains(file_name, {chr(39)}{p}{chr(39)})' for p in V.IGNORED_PATHS)}, false) AS ignored FROM file_hashes")
def ignored_paths(spark, d):
    return table(spark, d, "file_hashes").select("record_id", "file_name", S.ignored_path(F.col("file_name")).alias("ignored"))


_TRIM = "regexp_replace(line, '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')"
_JSON_LINE = f"{_TRIM} NOT IN ('', '[', ']', '{{', '}}', '][')"
_EVENT_LINE = f"({_JSON_LINE} AND strlen({_TRIM}) > 8)"


@query(f"SELECT line_id, coalesce({_JSON_LINE}, false) AS is_json, coalesce({_EVENT_LINE}, false) AS is_event FROM raw_lines")
def valid_line_filter(spark, d):
    c = F.col("line")
    return table(spark, d, "raw_lines").select("line_id", L.is_json_line(c).alias("is_json"), L.is_event_line(c).alias("is_event"))


# Parsing
_TEXT = lambda p: f"json_extract_string(b, '$.{p}')"
#: A whole number, or a text that spells one; of other numbers the whole part; true is 1.
_LONG = lambda p: f"""CASE json_type(b, '$.{p}') WHEN 'BOOLEAN' THEN CAST(json_extract(b, '$.{p}') AS BOOLEAN)::BIGINT
  WHEN 'VARCHAR' THEN CASE WHEN regexp_full_match({_TEXT(p)}, '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST({_TEXT(p)} AS BIGINT) END
  ELSE CASE WHEN regexp_full_match({_TEXT(p)}, '-?[0-9]+') THEN TRY_CAST({_TEXT(p)} AS BIGINT) WHEN abs(TRY_CAST({_TEXT(p)} AS DOUBLE)) < 9e18 THEN CAST(trunc(TRY_CAST({_TEXT(p)} AS DOUBLE)) AS BIGINT) END END"""  # noqa: E731
_KINDS = lambda names: " ".join(f"WHEN name = '{k}' THEN {V.TYPE_CODES[k]}" for k in names)
_PARSED = lambda names, cat: f"""b AS (SELECT line_id, regexp_replace({_TRIM}, ',$', '') AS b FROM raw_lines WHERE fmt = 'json' AND {_EVENT_LINE}),
d AS (SELECT line_id, b, coalesce({_TEXT('ph')} = 'M', false) AS meta, coalesce({_TEXT('name')}, '') AS name, coalesce({_TEXT('args.value')}, '') AS val FROM b WHERE json_valid(b)),
k AS (SELECT *, CASE WHEN NOT meta THEN {V.REGULAR} {_KINDS(names)} ELSE {V.OTHER_METADATA} END AS type FROM d),
p AS (SELECT line_id, type, CASE WHEN type <> 0 THEN coalesce({_TEXT('args.name')}, '') ELSE name END AS func_name, {cat.format(f"coalesce({_TEXT('cat')}, '')")} AS cat, {_TEXT('ph')} AS ph,
  coalesce({_LONG('pid')}, 0) AS pid, coalesce({_LONG('tid')}, 0) AS tid, CASE WHEN type = 2 THEN val ELSE coalesce({_TEXT('args.hhash')}, '') END AS hhash,
  CASE WHEN type NOT IN (0, 2) THEN val ELSE coalesce({_TEXT('args.fhash')}, '') END AS fhash, coalesce({_LONG('ts')}, 0) AS time_start, coalesce(TRY_CAST({_TEXT('dur')} AS DOUBLE), 0.0::DOUBLE) AS duration,
  CAST(1 AS BIGINT) AS count, {_LONG('args.ret')} AS ret, {_LONG('args.size')} AS size, {_LONG('args.offset')} AS "offset", {_LONG('args.image_idx')} AS image_id, coalesce({_LONG('args.epoch')}, 0) AS epoch FROM k),
e AS (SELECT *, TRY_CAST(time_start::HUGEINT + TRY_CAST(trunc(duration) AS BIGINT) AS BIGINT) AS time_end FROM p)"""  # noqa: E731
_IO = "cat IN ('posix','stdio')"


@query(
    f"""WITH {_PARSED(V.TYPE_CODES, "lower({})")}, c AS (SELECT * EXCLUDE (ret, size, "offset", image_id), CASE WHEN {_IO} THEN {W.label_sql()} ELSE 'other' END AS io_cat,
  CASE WHEN {_IO} AND {W.label_sql()} IN ('read','write') AND ret > 0 THEN ret END AS size, CASE WHEN {_IO} THEN "offset" END AS "offset", CASE WHEN NOT {_IO} THEN image_id END AS image_id, '0' AS acc_pat FROM e)
SELECT *, {W.bins_sql()} FROM c"""
)
def parse_lines(spark, d):
    return T.parse_trace(table(spark, d, "raw_lines").filter("fmt = 'json'").select("line_id", F.col("line").alias("value")))


@query(f"""WITH {_PARSED(("FH", "HH"), "{}")} SELECT * EXCLUDE (ret, image_id, epoch, count) FROM e""")
def parse_lines_replay(spark, d):
    return T.parse_trace(table(spark, d, "raw_lines").filter("fmt = 'json'").select("line_id", F.col("line").alias("value")), mode="replay")


@query(
    f"""WITH b AS (SELECT line_id, regexp_replace({_TRIM}, ',$', '') AS b FROM raw_lines WHERE fmt = 'json' AND {_JSON_LINE})
SELECT line_id, json_extract_string(b, '$.name') AS name, coalesce(TRY_CAST(json_extract_string(b, '$.args.epoch') AS BIGINT), 0) AS epoch, coalesce(json_exists(b, '$.args.ret'), false) AS has_ret,
CASE WHEN json_type(b) = 'OBJECT' THEN CAST(len(json_keys(b)) AS INTEGER) END AS n_keys FROM b WHERE json_valid(b)"""
)
def json_documents(spark, d):
    docs = text.json_documents(table(spark, d, "raw_lines").filter("fmt = 'json'").withColumnRenamed("line", "value"))
    return docs.select("line_id", text.json_get("name").alias("name"), text.json_get("args.epoch", "long", 0).alias("epoch"), text.json_has("args.ret").alias("has_ret"), F.size(text.json_keys()).alias("n_keys"))


# Dictionaries and time
@query(f"WITH {_T} SELECT event_id, fhash, file_name FROM resolved")
def hash_resolve_file(spark, d):
    return T.resolve_hashes(W.raw_events(spark, d), W.file_dictionary(spark, d), W.host_dictionary(spark, d)).select("event_id", "fhash", "file_name")


@query(f"WITH {_T} SELECT event_id, hhash, host_name FROM resolved")
def hash_resolve_host(spark, d):
    return T.resolve_hashes(W.raw_events(spark, d), W.file_dictionary(spark, d), W.host_dictionary(spark, d)).select("event_id", "hhash", "host_name")


@query(f"WITH {_T} SELECT CAST(min(time_start) AS BIGINT) AS first_start, count(*) AS n_events FROM named")
def global_min(spark, d):
    return W.named_events(spark, d).agg(F.min("time_start").alias("first_start"), F.count(F.lit(1)).alias("n_events"))


@query(f"WITH {_T} SELECT event_id, time_start, time_end, duration, time_range FROM timed")
def normalized_time(spark, d):
    return W.timed_events(spark, d).select("event_id", "time_start", "time_end", "duration", "time_range")


# High-level metrics
@query(
    f"""WITH {_T} SELECT cat, CAST({W.code_sql()} AS VARCHAR) AS io_cat, func_name, CAST(sum(TRY_CAST(duration AS DECIMAL(24,6))) AS DOUBLE) AS time, CAST(sum(count) AS BIGINT) AS count
FROM ev GROUP BY ALL"""
)
def hlm_basic(spark, d):
    e = W.raw_events(spark, d).withColumn("io_cat", S.io_category_code(F.col("func_name")).cast("string"))
    return e.groupBy("cat", "io_cat", "func_name").agg(F.sum(F.col("duration").try_cast("decimal(24,6)")).cast("double").alias("time"), F.sum("count").alias("count"))


def _hlm(name: str, views: str, keys: list[str]) -> None:
    def run(spark, d):
        return T.high_level_metrics(W.timed_events(spark, d), views, sets=False)

    run.__name__ = name
    query(W.hlm_sql(keys))(run)


_hlm("hlm_proc", "", ["proc_name"])
_hlm("hlm_file", "file_name", ["file_name", "proc_name"])
_hlm("hlm_time_range", "time_range", ["proc_name", "time_range"])
_hlm("hlm_all_views", "file_name, proc_name, time_range", ["file_name", "proc_name", "time_range"])


@query(W.hlm_sql(["proc_name"], ["file_name"]))
def hlm_unique_sets(spark, d):
    m = T.high_level_metrics(W.timed_events(spark, d, store=True), "")
    return m.withColumn("file_name_set", F.concat_ws("|", "file_name_set"))


@query(f"WITH {_T} SELECT {W.BIN_SUMS_SQL} FROM ev")
def hlm_size_bins(spark, d):
    return W.trace_events(spark, d).agg(*[F.sum(b).alias(b) for b in V.BIN_COLUMNS])


@query(
    f"""SELECT CAST(sum(count) AS BIGINT) AS total_count, CAST(sum(CAST(time AS DECIMAL(28,9))) AS DOUBLE) AS total_time, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS n_groups
FROM ({W.hlm_sql(["file_name", "proc_name"])})"""
)
def hlm_totals(spark, d):
    return T.metric_totals(T.high_level_metrics(W.timed_events(spark, d), "file_name", sets=False))


# Epochs
@query(f"WITH {W.EPOCH_SQL} SELECT epoch, span_start, span_end, span_duration FROM spans")
def epoch_spans(spark, d):
    return T.epoch_spans(W.timed_events(spark, d), 3.6e9)


@query(f"WITH {W.EPOCH_SQL} SELECT event_id, epoch FROM assigned")
def epoch_assign(spark, d):
    m = W.timed_events(spark, d, store=True)
    return T.assign_epochs(m, T.epoch_spans(m, 3.6e9)).select("event_id", "epoch")


@query(f"WITH {W.EPOCH_SQL} SELECT event_id, epoch FROM assigned")
def epoch_assign_by_bucket(spark, d):
    m = W.timed_events(spark, d, store=True)
    return T.assign_epochs(m, T.epoch_spans(m, 3.6e9), chain=0).select("event_id", "epoch")


@query(W.hlm_sql(["epoch", "proc_name"], source="assigned", pre=W.EPOCH_SQL))
def hlm_epoch(spark, d):
    m = W.timed_events(spark, d, store=True)
    return T.high_level_metrics(T.assign_epochs(m, T.epoch_spans(m, 3.6e9)), "epoch", sets=False)


# Lines, ranges, chunks. A file's lines come numbered in raw_lines; offsets follow from their bytes.
def _numbered(spark, d, texts=True):
    """Lines with their offsets; without `texts` only their sizes go through the ordered chunks."""
    rows = table(spark, d, "raw_lines").select(F.col("file_id").alias("file"), F.col("line_no").cast("long").alias("line_no"), *([F.col("line").alias("value")] if texts else []), (F.octet_length("line") + 1).alias("size"))
    ended = running(rows, ["file"], ["line_no"], {"end": ("size", "sum")})
    newline = F.col("end") - 1
    return ended.select("file", "line_no", *(["value"] if texts else []), (newline - F.col("size") + 1).alias("begin"), newline.alias("newline"))


def _lines(spark, d):
    return table(spark, d, "raw_lines").select(F.col("file_id").alias("file"), F.col("line_no").cast("long").alias("line_no"), F.col("line").alias("value"))


_NUMBERED = """n AS (SELECT file_id AS file, CAST(line_no AS BIGINT) AS line_no, line AS value,
  CAST(sum(strlen(line) + 1) OVER (PARTITION BY file_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS newline FROM raw_lines),
nb AS (SELECT *, newline - strlen(value) AS "begin" FROM n)"""
_META = f"""m AS (SELECT file_id AS file, CAST(coalesce(sum(CASE WHEN {_EVENT_LINE} THEN strlen(line) END), 0) AS BIGINT) AS bytes, CAST(1 AS BIGINT) AS start_line, count(*) AS end_line,
  count(*) FILTER ({_EVENT_LINE}) AS valid_events FROM raw_lines GROUP BY file_id)"""


@query(f"SELECT file_id AS file, count(*) FILTER ({_EVENT_LINE}) AS n_events FROM raw_lines GROUP BY file_id")
def event_count(spark, d):
    return text.count_events(table(spark, d, "raw_lines").select(F.col("file_id").alias("file"), F.col("line").alias("value")))


@query(f"WITH {_META} SELECT *, bytes / 1048576.0::DOUBLE AS size_mb, CASE WHEN valid_events > 0 THEN bytes / 1048576.0::DOUBLE / valid_events ELSE 0.0::DOUBLE END AS size_per_line FROM m")
def file_metadata(spark, d):
    return text.file_metadata(table(spark, d, "raw_lines").select(F.col("file_id").alias("file"), F.col("line").alias("value")))


@query(f"WITH {_NUMBERED} SELECT file, line_no, \"begin\", newline FROM nb WHERE line_no BETWEEN 11 AND 60")
def line_ranges(spark, d):
    return text.read_lines(_numbered(spark, d, texts=False), 11, 60).select("file", "line_no", "begin", "newline")


@query(f"WITH {_NUMBERED} SELECT file, line_no, newline // 4096 AS owner FROM nb")
def byte_range_owner(spark, d):
    return _numbered(spark, d, texts=False).select("file", "line_no", F.call_function("div", F.col("newline"), F.lit(4096).cast("long")).alias("owner"))


@query(f"WITH {_NUMBERED} SELECT file, line_no, value FROM nb WHERE newline >= 4096 AND newline < 8192")
def byte_range_lines(spark, d):
    return text.read_line_bytes(_numbered(spark, d), 4096, 8192).select("file", "line_no", "value")


@query(f"WITH {_META} SELECT file, CASE WHEN bytes > 0 THEN CAST(floor(4096 * (end_line / bytes) * 1.1::DOUBLE) AS BIGINT) ELSE 0 END AS estimate FROM m")
def estimate_lines(spark, d):
    m = file_metadata(spark, d)
    return m.select("file", S.estimated_lines(F.lit(4096), F.col("end_line"), F.col("bytes")).alias("estimate"))


@query()
def chunk_plan(spark, d):
    return chunking.plan_for(file_metadata(spark, d), 0.25)


@query()
def split_lines(spark, d):
    return chunking.tag_lines(_lines(spark, d), chunk_plan(spark, d))


@query(
    f"""WITH {_NUMBERED}, e AS (SELECT nb.* FROM nb WHERE {_EVENT_LINE.replace('line', 'value')})
SELECT file, line_no, regexp_replace({_TRIM.replace('line', 'value')}, ',$', '') AS value FROM e"""
)
def merged_events(spark, d):
    from tracelake.sources.sinks import event_lines

    return event_lines(_lines(spark, d))


# Index
def _checkpoints(spark, d):
    return index.index_checkpoints(_numbered(spark, d, texts=False), 8192)


_CP = f"""{_NUMBERED}, cp AS (SELECT file, "begin" // 8192 AS checkpoint_idx, min("begin") AS uc_offset, max(newline) + 1 - min("begin") AS uc_size, count(*) AS num_lines,
  min(line_no) AS first_line, max(line_no) AS last_line FROM nb GROUP BY 1, 2)"""


@query(f"WITH {_CP} SELECT * FROM cp")
def checkpoints(spark, d):
    return _checkpoints(spark, d)


@query(f"WITH {_NUMBERED} SELECT file, max(line_no) AS total_lines, max(newline) + 1 AS total_bytes FROM nb GROUP BY file")
def index_totals(spark, d):
    return index.index_files(_numbered(spark, d)).drop("fingerprint")


@query(f"WITH {_NUMBERED} SELECT file, true AS same, true AS differs FROM nb GROUP BY file")
def index_fingerprints(spark, d):
    """A file's fingerprint is the same from its lines in any order, and another once a line changes."""
    n = _numbered(spark, d).select("file", "line_no", "value", "newline")
    first = index.index_files(n).select("file", F.col("fingerprint").alias("a"))
    again = index.index_files(n.orderBy(F.desc("newline"))).select("file", F.col("fingerprint").alias("b"))
    other = index.index_files(n.withColumn("value", F.when(F.col("line_no") == 1, F.concat("value", F.lit("x"))).otherwise(F.col("value")))).select("file", F.col("fingerprint").alias("c"))
    return first.join(again, "file").join(other, "file").select("file", (F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("differs"))


_ASOF = f"""WITH {_CP} SELECT n.file, n.newline AS target, cp.checkpoint_idx, cp.uc_offset FROM nb n ASOF JOIN cp ON n.file = cp.file AND n.newline >= cp.uc_offset"""


@query(_ASOF)
def checkpoint_asof(spark, d):
    """The checkpoint of every line."""
    n = _numbered(spark, d, texts=False)
    return index.checkpoint_asof(index.index_checkpoints(n, 8192), n.select("file", F.col("newline").alias("target")))


@query(f"WITH {_CP} SELECT file, checkpoint_idx FROM cp WHERE first_line <= 90 AND last_line >= 40")
def checkpoint_overlap(spark, d):
    return index.checkpoints_overlapping(_checkpoints(spark, d), 40, 90).select("file", "checkpoint_idx")


@query(f"WITH {_CP} SELECT file, max(uc_offset + uc_size) AS max_bytes FROM cp GROUP BY file")
def max_bytes(spark, d):
    return index.max_bytes(_checkpoints(spark, d), index.index_files(_numbered(spark, d)))


def _stored(spark, d):
    """An older state of the files table: some rows missing, some of another time, size or hash."""
    f = table(spark, d, "files").filter("id % 11 <> 0")
    return f.select(
        F.col("id").alias("file"), (F.col("mtime_unix") - F.when(F.col("id") % 7 == 0, 60).otherwise(0)).alias("mtime"),
        (F.col("byte_size") + F.when(F.col("id") % 13 == 0, 1).otherwise(0)).alias("size"), F.nullif("hash", F.lit(0)).alias("fingerprint"),
    )


def _current(spark, d):
    return table(spark, d, "files").select(F.col("id").alias("file"), F.col("mtime_unix").alias("mtime"), F.col("byte_size").alias("size"), F.col("hash").alias("fingerprint"))


@query("SELECT id AS file FROM files WHERE id % 11 = 0 OR id % 7 = 0 AND mtime_unix IS NOT NULL OR id % 13 = 0 AND byte_size IS NOT NULL OR hash IS NULL OR hash = 0")
def stale_index_join(spark, d):
    return index.stale_files(_stored(spark, d), _current(spark, d))


@query("SELECT id AS file, mtime_unix AS mtime, byte_size AS size, hash AS fingerprint FROM files")
def index_upsert(spark, d):
    return index.upsert(_stored(spark, d), _current(spark, d))


@query("SELECT line_id, file_id AS file FROM raw_lines WHERE file_id NOT IN (SELECT id FROM files WHERE id % 5 = 0)")
def index_cascade_delete(spark, d):
    return index.without_files(table(spark, d, "raw_lines").select("line_id", F.col("file_id").alias("file")), table(spark, d, "files").filter("id % 5 = 0").select(F.col("id").alias("file")))


# Archives
@query(
    """SELECT id, archive_id, logical_end - coalesce(file_size, 0) AS logical_begin, logical_end FROM (SELECT *, CAST(sum(coalesce(file_size, 0)) OVER
(PARTITION BY archive_id ORDER BY uncompressed_offset, data_offset, file_name, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS logical_end FROM tar_files)"""
)
def tar_logical_offsets(spark, d):
    return archive.logical_offsets(table(spark, d, "tar_files"), "archive_id").select("id", "archive_id", "logical_begin", "logical_end")


@query(
    """SELECT a.id AS archive_id, a.file_id, archive_name, total_files, logical_name, byte_size, n_members, member_bytes FROM tar_archives a JOIN files f ON a.file_id = f.id
JOIN (SELECT archive_id, count(*) AS n_members, CAST(sum(file_size) AS BIGINT) AS member_bytes FROM tar_files GROUP BY 1) m ON m.archive_id = a.id"""
)
def archive_lookup(spark, d):
    return index.archive_lookup(table(spark, d, "tar_archives"), table(spark, d, "files"), table(spark, d, "tar_files"))


@query("SELECT id, file_name FROM tar_files WHERE uncompressed_offset >= 1000000 AND uncompressed_offset < 9000000")
def tar_member_range(spark, d):
    return archive.find_members(table(spark, d, "tar_files"), begin=1_000_000, end=9_000_000).select("id", "file_name")


@query("SELECT id, CASE WHEN regexp_matches(lower(logical_name), '\\.(tar\\.gz|tgz)$') THEN 'tar.gz' WHEN regexp_matches(lower(logical_name), '\\.(gz|gzip)$') THEN 'gzip' END AS format FROM files")
def format_by_name(spark, d):
    return table(spark, d, "files").select("id", archive.format_column(F.col("logical_name")).alias("format"))


# Replay
_FILTERS = {"without": ("lseek64", "close"), "categories": ("posix", "stdio")}


def _plan(spark, d):
    return replay.replay_plan(W.trace_events(spark, d), without=("open64",), categories=("posix", "stdio"))


_PLAN = f"""{_T}, p AS (SELECT *, CASE WHEN func_name = 'open64' OR cat NOT IN ('posix', 'stdio') THEN 'filtered' WHEN cat = 'posix' THEN 'executed' ELSE 'failed' END AS outcome FROM ev)"""
_COUNTS = "count(*) AS total, count(*) FILTER (outcome = 'executed') AS executed, count(*) FILTER (outcome = 'filtered') AS filtered, count(*) FILTER (outcome = 'failed') AS failed"


@query(f"WITH {_PLAN} SELECT event_id, outcome FROM p")
def replay_filter_chain(spark, d):
    return _plan(spark, d).select("event_id", "outcome")


@query(
    f"""WITH {_PLAN} SELECT 'function' AS dimension, func_name AS name, {_COUNTS} FROM p GROUP BY 2 UNION ALL SELECT 'category', cat, {_COUNTS} FROM p GROUP BY 2
UNION ALL SELECT 'all', '', {_COUNTS} FROM p"""
)
def replay_stats(spark, d):
    return replay.replay_statistics(_plan(spark, d))


@query(
    f"""WITH {_PLAN}, s AS (SELECT {_COUNTS} FROM p) SELECT *, CAST(CASE WHEN failed > 0 THEN 2 WHEN executed > 0 THEN 0 ELSE 1 END AS INTEGER) AS exit_code,
CASE WHEN executed + failed = 0 THEN 0.0::DOUBLE ELSE executed * 100.0::DOUBLE / (executed + failed) END AS success_rate FROM s"""
)
def replay_status(spark, d):
    return replay.replay_status(replay.replay_statistics(_plan(spark, d)))


@query(
    f"""WITH {_T}, f AS (SELECT fhash, arg_min(time_start, event_id) AS t0 FROM ev GROUP BY 1)
SELECT event_id, time_start - t0 AS elapsed_us, least(greatest(time_start - t0, 0), 10000000) AS longest_wait_us FROM ev JOIN f USING (fhash)"""
)
def replay_elapsed(spark, d):
    return replay.planned_elapsed(W.trace_events(spark, d), "fhash", "event_id").select("event_id", "elapsed_us", "longest_wait_us")


@query(f"WITH {_T} SELECT event_id, greatest(0, least(time_end - time_start, 1000)) AS planned_sleep_us FROM ev")
def replay_sleep(spark, d):
    return replay.replay_plan(W.trace_events(spark, d), sleep_mode=True).select("event_id", "planned_sleep_us")


# Summaries
@query(f"WITH {_META} SELECT count(*) AS n_files, CAST(sum(valid_events) AS BIGINT) AS n_events, CAST(sum(bytes) AS BIGINT) AS n_bytes, count(*) FILTER (valid_events > 0) * 100.0::DOUBLE / count(*) AS success_rate FROM m")
def io_ratio_summary(spark, d):
    m = file_metadata(spark, d)
    return m.agg(F.count(F.lit(1)).alias("n_files"), F.sum("valid_events").alias("n_events"), F.sum("bytes").alias("n_bytes"), S.percent(F.count_if(F.col("valid_events") > 0), F.count(F.lit(1))).alias("success_rate"))


_LABELLED = {c: V.COLUMN_LABELS.get(c, c) for c in ("cat", "io_cat", "func_name", "time", "count")}


@query("SELECT " + ", ".join(f'{k} AS "{v}"' for k, v in _LABELLED.items()) + f" FROM ({SQL['hlm_basic']})")
def humanized_labels(spark, d):
    return T.humanized(hlm_basic(spark, d))
