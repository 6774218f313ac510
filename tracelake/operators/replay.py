"""What a replay of a trace would do: filters, counts, planned timing. Nothing is executed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.functions import vocab as V
from tracelake.operators.trace import BROADCAST_ROWS
from tracelake.session import cut, is_small

LONGEST_SLEEP_US, LONGEST_OPERATION_US = 10_000_000, 1_000


@dataclass(frozen=True)
class ReplayConfig:
    """What a replay is asked for. Nothing is executed here, so max_file_size and output_directory only say what an executor may write, and where."""

    maintain_timing: bool = True
    timing_scale: float = 1.0
    start_time_offset: int = 0
    dry_run: bool = False
    sleep_mode: bool = False
    functions: Sequence[str] = field(default_factory=tuple)
    without: Sequence[str] = field(default_factory=tuple)
    categories: Sequence[str] = field(default_factory=tuple)
    max_file_size: int = 100 << 20
    output_directory: str = ""

    def __post_init__(self) -> None:
        if self.timing_scale <= 0 or self.max_file_size < 0:
            raise ValueError("the timing scale must be above 0 and the largest file not below")


def configured_plan(events: DataFrame, config: ReplayConfig, file: str = "file", order: str = "time_start") -> DataFrame:
    """`replay_plan` by a config, with longest_wait_us: how long each event waits at most for its time since its file's first event; 0 without timing.

    start_time_offset (microseconds) is added to every start first; it moves a file as a whole, so it changes no wait.
    """
    moved = events.withColumn("time_start", F.col("time_start") + F.lit(int(config.start_time_offset)))
    plan = replay_plan(moved, config.sleep_mode, config.dry_run, functions=config.functions, without=config.without, categories=config.categories)
    if not config.maintain_timing:
        return plan.withColumn("longest_wait_us", F.lit(0).cast("long"))
    return planned_elapsed(plan, file, order, config.timing_scale).drop("elapsed_us")


def would_run(functions: Sequence[str] = (), without: Sequence[str] = (), categories: Sequence[str] = ()) -> Column:
    """Function whitelist, function blacklist, category whitelist, regular events; an empty list doesn't filter."""
    ok = F.col("type") == V.REGULAR
    if functions:
        ok &= F.col("func_name").isin(list(functions))
    if without:
        ok &= ~F.col("func_name").isin(list(without))
    if categories:
        ok &= F.col("cat").isin(list(categories))
    return F.coalesce(ok, F.lit(False))


def replay_plan(events: DataFrame, sleep_mode: bool = False, dry_run: bool = True, **filters: Sequence[str]) -> DataFrame:
    """`events` with outcome (executed, filtered, failed) and planned_sleep_us.

    Only posix events (in that letter case) can be executed, and outside a dry run only the functions of
    REPLAY_FUNCTIONS; in sleep mode all can, each sleeping its length, at most a millisecond.
    """
    able = F.lit(True) if sleep_mode else (F.col("cat") == "posix") & (F.lit(True) if dry_run else F.col("func_name").isin(V.REPLAY_FUNCTIONS))
    outcome = F.when(~would_run(**filters), "filtered").when(able, "executed").otherwise("failed")
    nap = F.greatest(F.lit(0).cast("long"), F.least(F.col("time_end") - F.col("time_start"), F.lit(LONGEST_OPERATION_US).cast("long")))
    return events.withColumn("outcome", outcome).withColumn("planned_sleep_us", F.when(F.lit(sleep_mode) & (F.col("outcome") == "executed"), nap).otherwise(F.lit(0).cast("long")))


def replay_statistics(plan: DataFrame) -> DataFrame:
    """dimension (function, category, all), name, total, executed, filtered, failed: one pass, three groupings."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    rows = plan.select(F.expr("stack(3, 'function', func_name, 'category', cat, 'all', '') as (dimension, name)"), "outcome")
    return rows.groupBy("dimension", "name").agg(F.count(F.lit(1)).alias("total"), n("executed"), n("filtered"), n("failed"))


def replay_status(statistics: DataFrame) -> DataFrame:
    """Exit code (2 with failures, 0 with anything executed, else 1) and success rate of a replay."""
    whole = statistics.filter("dimension = 'all'")
    code = F.when(F.col("failed") > 0, 2).when(F.col("executed") > 0, 0).otherwise(1)
    return whole.select("total", "executed", "filtered", "failed", code.alias("exit_code"), S.percent(F.col("executed"), F.col("executed") + F.col("failed")).alias("success_rate"))


def planned_elapsed(events: DataFrame, file: str, order: str, scale: float = 1.0) -> DataFrame:
    """`events` with elapsed_us since their file's first event (by `order`), scaled, and that capped at ten seconds.

    The first events are one row per file, found by an aggregate and joined: no file is sorted in one task. They are
    broadcast where they are few, so a file with a third of all events isn't shuffled; else adaptive execution
    splits it.
    """
    first = cut(events.groupBy(file).agg(F.min_by("time_start", order).alias("_tl_first")))
    rows = events.drop("elapsed_us", "longest_wait_us").join(F.broadcast(first) if is_small(first, BROADCAST_ROWS) else first, file)
    elapsed = ((F.col("time_start") - F.col("_tl_first")) * F.lit(float(scale))).cast("long")
    return rows.withColumn("elapsed_us", elapsed).withColumn("longest_wait_us", F.least(F.greatest(F.col("elapsed_us"), F.lit(0)), F.lit(LONGEST_SLEEP_US)).cast("long")).drop("_tl_first")
