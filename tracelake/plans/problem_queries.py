"""The core's pN_ queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators import hotkeys, intervals, orphans, rawlines, smallfiles
from tracelake.operators.events import valid_events
from tracelake.session import scratch_folder, table


# 2: overlapping and gapped intervals
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    events = valid_events(table(spark, d, "trace")).filter("epoch >= 1")
    return intervals.periods_and_gaps(events, ["pid", "epoch"])


# 3: lines that can't be parsed
def _loaded(spark: SparkSession, d: str, values: bool = True) -> DataFrame:
    return rawlines.load_lines(table(spark, d, "raw_lines"), values=values)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return rawlines.rejected(_loaded(spark, d, values=False)).select("line_id", "reason")


def p3_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rawlines.accepted(_loaded(spark, d))


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rawlines.rejected(_loaded(spark, d, values=False)).groupBy("reason", "error_field").agg(F.count(F.lit(1)).alias("n_lines"))


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    """Lines per reason, and of the sound ones (NULL) too: with the framing lines they are all lines."""
    return _loaded(spark, d, values=False).groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"))


# 4: small files
def _contents(spark: SparkSession, d: str) -> DataFrame:
    return smallfiles.small_contents(table(spark, d, "files"), table(spark, d, "tar_files"))


def p4_plan(spark: SparkSession, d: str) -> DataFrame:
    return smallfiles.consolidation_plan(_contents(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_plan(spark, d).select("src_table", "id")


def p4_targets(spark: SparkSession, d: str) -> DataFrame:
    return smallfiles.plan_totals(p4_plan(spark, d))


def p4_copied(spark: SparkSession, d: str) -> DataFrame:
    """The tables of the contents themselves as small Parquet files, whose blocks are copied into few: the copy's own totals, and whether it reads as the table does."""
    parts = [smallfiles.copy_totals(table(spark, d, t), scratch_folder(spark)).withColumn("src_table", F.lit(t)) for t in ("files", "tar_archives", "tar_files")]
    return reduce(DataFrame.unionByName, parts).select("src_table", "n_rows", "n_copied", "same", "fewer")


# 6: a few keys holding most rows
def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_totals(table(spark, d, "trace"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(p6_totals(spark, d)).select("field", "hot_key")


# 7: orphan references
def _orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = {"file_hashes": (table(spark, d, "file_hashes"), "fhash"), "host_hashes": (table(spark, d, "host_hashes"), "hhash")}
    return orphans.orphan_references(table(spark, d, "trace"), parents, {"file_hashes": "fhash", "host_hashes": "hhash"})


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "event_id", "reason")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p3_loaded, p3_reasons, p3_totals, p4_found, p4_plan, p4_targets, p4_copied, p6_found, p6_totals, p7_found, p7_report)}

EVENTS_SQL = """ev AS (
  SELECT * FROM trace WHERE is_valid IS DISTINCT FROM false
  QUALIFY event_id IS NULL OR row_number() OVER (PARTITION BY event_id ORDER BY ingested_at NULLS FIRST) = 1)"""
_CONTENTS_SQL = """c AS (
  SELECT 'files' AS src_table, min(id) AS id, arg_min(logical_name, id) AS name, count(*) AS n_rows, any_value(byte_size) AS byte_size FROM files
  WHERE byte_size BETWEEN 1 AND 65535 AND id IS NOT NULL
  GROUP BY byte_size, hash, CASE WHEN hash IS NULL OR hash = 0 THEN id END
  UNION ALL
  SELECT 'tar_files', min(id), arg_min(file_name, id), count(*), arg_min(file_size, id) FROM tar_files
  WHERE file_size BETWEEN 1 AND 65535 AND id IS NOT NULL AND trim(coalesce(typeflag, '')) IN ('', '0')
  GROUP BY archive_id, data_offset, CASE WHEN archive_id IS NULL OR data_offset IS NULL THEN id END)"""
# The plan of up to a million contents, which are one lane.
_PLAN_SQL = f"""{_CONTENTS_SQL}, k AS (SELECT *, CASE WHEN regexp_matches(lower(name), '\\.(gz|gzip|tgz)$') THEN 'gzip' WHEN regexp_matches(lower(name), '\\.parquet$') THEN 'parquet'
  WHEN regexp_matches(lower(name), '\\.(pfw|jsonl|ndjson|json|csv|txt)$') THEN 'lines' ELSE 'other' END AS kind FROM c),
p AS (SELECT *, CAST(sum(byte_size) OVER (PARTITION BY kind ORDER BY name NULLS FIRST, src_table, id ROWS UNBOUNDED PRECEDING) AS BIGINT) - byte_size AS pos FROM k),
s AS (SELECT *, pos // 134217728 AS slot FROM p),
plan AS (SELECT *, printf('%s-%05d-%06d', kind, 0, slot) AS target_file, pos - min(pos) OVER (PARTITION BY kind, slot) AS target_offset,
  CAST(sum(byte_size) OVER (PARTITION BY kind, slot) AS BIGINT) AS target_bytes FROM s)"""
_TOTALS_SQL = f"""WITH {EVENTS_SQL}, kv AS (
  SELECT 'fhash' AS field, fhash AS hot_key, duration, size FROM ev UNION ALL SELECT 'func_name', func_name, duration, size FROM ev),
t AS (SELECT field, hot_key, count(*) AS n_events,
  CAST(sum(CASE WHEN NOT isnan(duration) AND NOT isinf(duration) THEN TRY_CAST(duration AS DECIMAL(28,2)) END) AS DOUBLE) AS total_duration,
  CAST(sum(CASE WHEN size >= 0 THEN size END) AS BIGINT) AS total_size FROM kv GROUP BY field, hot_key)"""
_KEY_SQL = "nullif(regexp_extract(lower({0}), '^\\s*(?:0x)?0*([0-9a-f]{{1,16}})\\s*$', 1), '')"
_ORPHANS_SQL = f"""WITH {EVENTS_SQL},
refs AS (SELECT 'file_hashes' AS ref_table, event_id, time_start, {_KEY_SQL.format("fhash")} AS h FROM ev WHERE trim(fhash) <> ''
  UNION ALL SELECT 'host_hashes', event_id, time_start, {_KEY_SQL.format("hhash")} FROM ev WHERE trim(hhash) <> ''),
recs AS (SELECT 'file_hashes' AS ref_table, {_KEY_SQL.format("fhash")} AS h, registered_at, deleted_at FROM file_hashes
  UNION ALL SELECT 'host_hashes', {_KEY_SQL.format("hhash")}, registered_at, deleted_at FROM host_hashes),
j AS (SELECT refs.ref_table, event_id, time_start, count(recs.ref_table) AS n,
  count(*) FILTER (registered_at <= time_start) AS started,
  count(*) FILTER (registered_at <= time_start AND (deleted_at IS NULL OR deleted_at > time_start)) AS alive
  FROM refs LEFT JOIN recs ON refs.ref_table = recs.ref_table AND refs.h = recs.h GROUP BY ALL),
o AS (SELECT ref_table, event_id, time_start, CASE WHEN n = 0 THEN 'missing' WHEN started > 0 THEN 'deleted' ELSE 'late' END AS reason FROM j WHERE alive = 0)"""

# A csv field, its value within, and the value's rules, in the order of the columns.
_FIELD = r'[ \t]*"(?:[^"]|"")*"[ \t]*|[^",]*'
_VALUE = lambda c: f"""trim(CASE WHEN trim(f.{c}, ' ' || chr(9)) LIKE '"%' THEN replace(trim(f.{c}, ' ' || chr(9))[2:-2], '""', '"') ELSE f.{c} END, ' ' || chr(9))"""
_CSV_TESTS = {c: f"regexp_full_match({_VALUE(c)}, '{rule.removeprefix('^').removesuffix('$') if '(?i)' not in rule else '(?i)(true|false)'}', 's')" for c, rule in ((c, r.replace("(?s)^", "^")) for c, r in rawlines.CSV_RULES.items())}
_CSV_OK = " AND ".join(_CSV_TESTS.values())
_FIRST = lambda tests: "CASE " + " ".join(f"WHEN NOT coalesce({test}, false) THEN '{c}'" for c, test in tests.items()) + " END"
_HAS = " AND ".join(f"json_exists(b, '$.{k}')" for k in rawlines.JSON_REQUIRED)
_WHOLE = lambda k: f"(json_type(b, '$.{k}') IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') AND NOT starts_with(json_extract_string(b, '$.{k}'), '-'))"
_NAMED = lambda k: f"(json_type(b, '$.{k}') = 'VARCHAR' AND NOT regexp_full_match(json_extract_string(b, '$.{k}'), '\\s*'))"
_JSON_TESTS = {
    "name": _NAMED("name"), "cat": _NAMED("cat"), "ph": "(json_type(b, '$.ph') = 'VARCHAR' AND json_extract_string(b, '$.ph') IN ('X', 'M'))", **{k: _WHOLE(k) for k in ("pid", "tid", "ts")},
    "dur": "(json_type(b, '$.dur') IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') AND TRY_CAST(json_extract_string(b, '$.dur') AS DOUBLE) >= 0)", "args": "coalesce(json_type(b, '$.args'), 'OBJECT') = 'OBJECT'",
}
_JSON_OK = " AND ".join(_JSON_TESTS.values())
_LINES = f"""t AS (SELECT line_id, file_id, line_no, fmt, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS x FROM raw_lines),
u AS (SELECT line_id, file_id, line_no, fmt, x, regexp_replace(x, ',$', '') AS b FROM t
  WHERE x NOT IN ('', '[', ']', '{{', '}}', '][') AND NOT (fmt = 'csv' AND x = '{",".join(rawlines.CSV_COLUMNS)}')),
csv AS (SELECT line_id, x, regexp_full_match(x, '(?:{_FIELD})(?:,(?:{_FIELD}))*', 's') AS sound, len(string_split(regexp_replace(x, '"(?:[^"]|"")*"', '', 'gs'), ',')) AS n FROM u WHERE fmt = 'csv'),
cut AS (SELECT line_id, regexp_extract(x, '^{",".join([f"({_FIELD})"] * 12)}$', [{", ".join(f"'{c}'" for c in rawlines.CSV_COLUMNS)}], 's') AS f FROM csv WHERE sound AND n = 12),
js AS (SELECT line_id, b, CASE WHEN NOT json_valid(b) THEN 'syntax' WHEN json_type(b) <> 'OBJECT' THEN 'syntax' WHEN NOT ({_HAS}) THEN 'columns' WHEN NOT ({_JSON_OK}) THEN 'value' END AS reason FROM u WHERE fmt = 'json')"""
_LINES_SQL = f"""WITH {_LINES}
SELECT line_id, CASE WHEN NOT sound THEN 'quoting' ELSE 'columns' END AS reason FROM csv WHERE NOT sound OR n <> 12
UNION ALL SELECT line_id, 'value' FROM cut WHERE NOT ({_CSV_OK})
UNION ALL SELECT line_id, reason FROM js WHERE reason IS NOT NULL"""

_NOTE = """CASE WHEN trim(f.note, ' ' || chr(9)) LIKE '"%' THEN replace(trim(f.note, ' ' || chr(9))[2:-2], '""', '"') ELSE trim(f.note, ' ' || chr(9)) END"""
_GIVEN = lambda k: f"CASE WHEN json_type(b, '$.args.{k}') = 'VARCHAR' THEN nullif(json_extract_string(b, '$.args.{k}'), '') END"
_SPELLED = lambda k: f"CASE WHEN json_type(b, '$.args.{k}') IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'VARCHAR') AND regexp_full_match(json_extract_string(b, '$.args.{k}'), '\\s*-?[0-9]{{1,29}}\\s*') THEN TRY_CAST(json_extract_string(b, '$.args.{k}') AS BIGINT) END"
_TRIMMED = lambda k: f"regexp_replace(json_extract_string(b, '$.{k}'), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_END_SQL = "time_start + CAST(floor(CASE WHEN duration < 4e18 THEN duration END) AS BIGINT) AS time_end"
# The rows of sound lines. Numbers are cast as they are spelled.
_LOADED_SQL = f"""WITH {_LINES},
c AS (SELECT line_id, {_VALUE("func_name")} AS func_name, {_VALUE("cat")} AS cat, CAST(NULL AS VARCHAR) AS ph, CAST({_VALUE("pid")} AS BIGINT) AS pid, CAST({_VALUE("tid")} AS BIGINT) AS tid,
  CAST({_VALUE("time_start")} AS BIGINT) AS time_start, CAST({_VALUE("duration")} AS DOUBLE) AS duration, nullif({_VALUE("hhash")}, '') AS hhash, nullif({_VALUE("fhash")}, '') AS fhash,
  CAST(nullif({_VALUE("size")}, '') AS BIGINT) AS size, CAST(nullif({_VALUE("epoch")}, '') AS BIGINT) AS epoch, {_NOTE} AS note FROM cut WHERE {_CSV_OK}),
j AS (SELECT line_id, {_TRIMMED("name")}, {_TRIMMED("cat")}, json_extract_string(b, '$.ph'), TRY_CAST(json_extract_string(b, '$.pid') AS BIGINT), TRY_CAST(json_extract_string(b, '$.tid') AS BIGINT),
  TRY_CAST(json_extract_string(b, '$.ts') AS BIGINT), CASE WHEN TRY_CAST(json_extract_string(b, '$.dur') AS DOUBLE) < 1e300 THEN CAST(json_extract_string(b, '$.dur') AS DOUBLE) END,
  {_GIVEN("hhash")}, {_GIVEN("fhash")}, CASE WHEN {_SPELLED("ret")} > 0 THEN {_SPELLED("ret")} END, {_SPELLED("epoch")}, {_GIVEN("note")} FROM js WHERE reason IS NULL),
v AS (SELECT * FROM c UNION ALL SELECT * FROM j)
SELECT line_id, file_id, line_no, v.* EXCLUDE (line_id), {_END_SQL}, true AS is_valid FROM v JOIN raw_lines USING (line_id)"""

SQL = {
    "p3_found": _LINES_SQL,
    "p3_loaded": _LOADED_SQL,
    "p3_reasons": f"""WITH {_LINES}, r AS (SELECT CASE WHEN NOT sound THEN 'quoting' ELSE 'columns' END AS reason, CAST(NULL AS VARCHAR) AS error_field FROM csv WHERE NOT sound OR n <> 12
  UNION ALL SELECT 'value', {_FIRST(_CSV_TESTS)} FROM cut WHERE NOT ({_CSV_OK})
  UNION ALL SELECT reason, CASE reason WHEN 'columns' THEN {_FIRST({k: f"json_exists(b, '$.{k}')" for k in rawlines.JSON_REQUIRED})} WHEN 'value' THEN {_FIRST(_JSON_TESTS)} END FROM js WHERE reason IS NOT NULL)
SELECT reason, error_field, count(*) AS n_lines FROM r GROUP BY ALL""",
    "p3_totals": f"""SELECT CAST(NULL AS VARCHAR) AS reason, (WITH {_LINES} SELECT count(*) FROM u) - (SELECT count(*) FROM ({_LINES_SQL})) AS n_lines UNION ALL SELECT reason, count(*) FROM ({_LINES_SQL}) GROUP BY 1""",
    "p2_found": """WITH iv AS (SELECT pid, epoch, time_start AS s, time_end AS e FROM trace
  WHERE is_valid IS DISTINCT FROM false AND epoch >= 1 AND time_end >= time_start),
m AS (SELECT *, max(e) OVER (PARTITION BY pid, epoch ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM iv),
n AS (SELECT *, sum(CASE WHEN prev IS NULL OR s > prev + 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY pid, epoch ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m),
p AS (SELECT pid, epoch, g, min(s) AS s, max(e) AS e FROM n GROUP BY pid, epoch, g)
SELECT pid, epoch, 'period' AS kind, s AS from_time, e AS to_time FROM p
UNION ALL SELECT pid, epoch, 'gap', e, nxt FROM (SELECT pid, epoch, e, lead(s) OVER (PARTITION BY pid, epoch ORDER BY g) AS nxt FROM p) WHERE nxt IS NOT NULL""",
    "p4_found": f"WITH {_CONTENTS_SQL} SELECT src_table, id FROM c",
    "p4_plan": f"WITH {_PLAN_SQL} SELECT src_table, id, name, byte_size, n_rows, target_file, target_offset, target_bytes FROM plan",
    "p4_targets": f"""WITH {_PLAN_SQL} SELECT target_file, count(*) AS n_contents, CAST(sum(n_rows) AS BIGINT) AS n_records, CAST(sum(byte_size) AS BIGINT) AS n_bytes,
  CAST(max(target_offset + byte_size) - sum(byte_size) AS BIGINT) AS holes FROM plan GROUP BY target_file""",
    "p4_copied": " UNION ALL ".join(f"SELECT '{t}' AS src_table, count(*) AS n_rows, count(*) AS n_copied, true AS same, true AS fewer FROM {t}" for t in ("files", "tar_archives", "tar_files")),
    "p6_totals": f"{_TOTALS_SQL} SELECT * FROM t",
    "p6_found": f"{_TOTALS_SQL} SELECT field, hot_key FROM t WHERE hot_key <> '' AND n_events * 50 >= (SELECT count(*) FROM ev)",
    "p7_found": f"{_ORPHANS_SQL} SELECT ref_table, event_id, reason FROM o",
    "p7_report": f"""{_ORPHANS_SQL} SELECT ref_table, CAST(CAST(make_timestamp(time_start) AS DATE) AS VARCHAR) AS day, reason, count(*) AS n_orphans FROM o GROUP BY ALL""",
}
