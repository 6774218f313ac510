"""Totals per key where a few keys hold most rows.

Each task combines its rows into one state per key (count, sums) before anything is shuffled, so a key
with a third of all rows costs the reducer one row per map task. The states are native algebraic
aggregates: bounded hash tables that fall back to sorting and spilling, merged at any level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.events import distinct_events
from tracelake.session import cut


def key_totals(trace: DataFrame, fields: Sequence[str] = ("fhash", "func_name")) -> DataFrame:
    """field, hot_key, n_events, total_duration, total_size: one row per field and value, as stored.

    NULL and empty values are keys too, so each field's counts add up to all events. Unknown durations
    (NULL, NaN, infinite) and sizes (NULL, below 0) are left out of the sums, which are NULL if nothing is
    known. Each event counts once. Durations are summed exactly, to a hundredth of a microsecond; those of 1e26
    and more, which no decimal of that scale holds, are added as doubles.
    """
    events = distinct_events(trace, [*fields, "duration", "size"])
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    known = F.when(~F.isnan("duration") & (F.abs("duration") < float("inf")), F.col("duration"))
    exact = known.try_cast("decimal(28,2)")
    rows = events.select(F.expr(f"stack({len(fields)}, {pairs}) as (field, hot_key)"), exact.alias("_tl_d"), F.when(exact.isNull(), known).alias("_tl_h"), F.when(F.col("size") >= 0, F.col("size")).alias("_tl_z"))
    exact_sum, huge_sum = F.sum("_tl_d").cast("double"), F.sum("_tl_h")
    return rows.groupBy("field", "hot_key").agg(
        F.count(F.lit(1)).alias("n_events"), F.coalesce(exact_sum + huge_sum, exact_sum, huge_sum).alias("total_duration"), F.sum("_tl_z").alias("total_size")
    )


def heavy_keys(totals: DataFrame, share: tuple[int, int] = (1, 50)) -> DataFrame:
    """field, hot_key, n_events of the keys of `key_totals`, neither NULL nor empty, that at least `share` (a fraction) of all events hold.

    The counts per key are read twice, so they are materialised once.
    """
    num, den = share
    totals = cut(totals.select("field", "hot_key", "n_events"))
    whole = totals.groupBy("field").agg(F.sum("n_events").alias("_tl_all"))  # one row per field
    return (
        totals.filter("hot_key is not null and hot_key <> ''")
        .join(F.broadcast(whole), "field")
        .filter(F.col("n_events") * den >= F.col("_tl_all") * num)
        .drop("_tl_all")
    )
