"""Rules every reader of the `trace` table shares: which rows count, and what one event is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.operators.bits import bit_table, with_bit

DAY_US = 86_400_000_000
#: Blanks, controls, invisible format characters and non-characters at either end of a name.
EDGE = r"[\s\p{Z}\p{C}]+"
_PLAIN = "^[A-Za-z0-9_.]+$"


def valid_events(trace: DataFrame) -> DataFrame:
    """Rows whose `is_valid` isn't false; NULL counts as valid."""
    return trace.filter(~F.col("is_valid").eqNullSafe(F.lit(False)))


def repeated_ids(trace: DataFrame) -> DataFrame:
    """A bit table of every `event_id` delivered more than once. Only ids are shuffled, and each task counts its own first."""
    ids = valid_events(trace).select("event_id").filter("event_id is not null")
    return bit_table(ids.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "event_id")


def distinct_events(trace: DataFrame, columns: Sequence[str], order: str = "ingested_at", repeated: DataFrame | None = None) -> DataFrame:
    """Valid events, each `event_id` once, with `columns`.

    Of several deliveries the earliest by `order` is kept (NULL first), ties by the smallest payload, so
    the result is the same at every run. Rows without an event_id are events of their own. Rows whose id comes
    once aren't shuffled: the ids are counted first (`repeated_ids`; a reader of several passes gives it), and
    only rows of an id whose bit is set go by id, combined before the shuffle.
    """
    payload = [c for c in dict.fromkeys(columns) if c != "event_id"]
    rows = valid_events(trace).select("event_id", F.col(order).alias("_tl_order"), *payload)
    rows = with_bit(rows, "event_id", repeated_ids(trace) if repeated is None else repeated, "_tl_again")
    first = rows.filter("_tl_again").groupBy("event_id").agg(F.min(F.struct("_tl_order", *payload)).alias("_tl_row"))
    return rows.filter("not _tl_again").select("event_id", *payload).unionByName(first.select("event_id", *[F.col(f"_tl_row.{c}").alias(c) for c in payload]))


def function_key(name: Column) -> Column:
    """The function a name stands for, whatever its spelling; NULL for NULL and blank names.

    Letter case, surrounding blanks and invisible characters, a call's `()`, a symbol version `@...`,
    an instance number `#n` and the separator `::` are decoration. Digits in the name itself are not:
    pread and pread64 stay two functions.
    """
    k = F.regexp_replace(name, f"^{EDGE}|{EDGE}$", "")
    k = F.regexp_replace(F.lower(k), r"(?:\(\)|@+[^@\s]*|#[0-9]+)+$", "")
    k = F.regexp_replace(F.replace(k, F.lit("::"), F.lit(".")), f"{EDGE}$", "")
    return F.when(name.rlike(_PLAIN), F.lower(name)).otherwise(F.nullif(k, F.lit("")))  # most names have nothing to be taken off


def plain_category(cat: Column) -> Column:
    """A category in lower case, without blanks and invisible characters around it."""
    return F.lower(F.when(cat.rlike(_PLAIN), cat).otherwise(F.regexp_replace(cat, f"^{EDGE}|{EDGE}$", "")))


def plain_spellings(events: DataFrame, name: str = "func_name") -> DataFrame:
    """function_key -> plain_name, its most frequent spelling (ties: the smallest). One row per function."""
    counted = events.groupBy(F.col(name).alias("_tl_name")).agg(F.count(F.lit(1)).alias("_tl_n"))
    keyed = counted.withColumn("function_key", function_key(F.col("_tl_name"))).filter("function_key is not null")
    best = F.min(F.struct((-F.col("_tl_n")).alias("n"), F.col("_tl_name").alias("name")))
    return keyed.groupBy("function_key").agg(best.alias("_tl_b")).select("function_key", F.col("_tl_b.name").alias("plain_name"))


def day_of(us: Column) -> Column:
    """Calendar day (UTC) of a time in microseconds, as text."""
    return F.date_from_unix_date(F.floor(us / F.lit(DAY_US).cast("double")).cast("int")).cast("string")
