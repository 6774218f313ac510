"""Cutting traces into chunks of about one size, by whole lines.

The plan depends on a few numbers per file and is made in order, on the driver; lines are then tagged by a
join on file and line range. The plan has at most a row per file and chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import is_small

FULL = 0.95
MAX_FILES = 2_000_000
BROADCAST_ROWS = 500_000
_PLAN = "chunk long, file string, start_line long, end_line long, planned_mb double, planned_events long"


class FileInfo(NamedTuple):
    file: str
    size_mb: float
    total_lines: int
    valid_events: int


class Piece(NamedTuple):
    chunk: int
    file: str
    start_line: int
    end_line: int
    planned_mb: float
    planned_events: int


def plan_chunks(files: Iterable[FileInfo], target_mb: float) -> list[Piece]:
    """Pieces of chunks (numbered from 1) that together hold every line of every file with events once.

    A piece takes the events that fit, or all that are left where they fit or where not one does; its share of
    the file's lines is rounded up, so a chunk's real content may differ a little. A chunk is closed at 95 % of
    the target. Pieces without a line are left out.
    """
    if target_mb <= 0:
        raise ValueError("the target must be above 0")
    out: list[Piece] = []
    chunk, filled = 1, 0.0
    for f in files:
        if f.valid_events <= 0 or f.size_mb <= 0:
            continue
        each = f.size_mb / f.valid_events
        events, line = f.valid_events, 1
        while events:
            room = math.floor((target_mb - filled) / each) if filled < target_mb else 0
            take = room if 0 < room < events else events
            share = math.ceil(take / f.valid_events * f.total_lines) if take < events else f.total_lines
            upto = min(f.total_lines, line + share - 1)
            if upto >= line:
                out.append(Piece(chunk, f.file, line, upto, take * each, take))
            line, events = upto + 1, events - take
            filled += take * each
            if filled >= FULL * target_mb:
                chunk, filled = chunk + 1, 0.0
    return out


def plan_for(metadata: DataFrame, target_mb: float, max_files: int = MAX_FILES) -> DataFrame:
    """`plan_chunks` over file_metadata, in order of file names. Refused beyond `max_files` files."""
    rows = metadata.select("file", "size_mb", "end_line", "valid_events").orderBy("file").limit(max_files + 1).collect()
    if len(rows) > max_files:
        raise ValueError(f"more than {max_files} files: plan them in parts")
    return metadata.sparkSession.createDataFrame([tuple(p) for p in plan_chunks((FileInfo(*r) for r in rows), target_mb)], _PLAN)


def tag_lines(numbered: DataFrame, plan: DataFrame, keep: Sequence[str] = ("value",)) -> DataFrame:
    """chunk, file, line_no and `keep` of every planned line. Small plans are broadcast, larger ones joined by file."""
    small = is_small(plan.select("file", "chunk", "start_line", "end_line"), BROADCAST_ROWS)
    p = plan.select("chunk", "file", "start_line", "end_line")
    joined = numbered.select("file", "line_no", *keep).join(F.broadcast(p) if small else p, "file").filter(F.col("line_no").between(F.col("start_line"), F.col("end_line")))
    return joined.select("chunk", "file", "line_no", *keep)


def chunk_results(tagged: DataFrame, plan: DataFrame) -> DataFrame:
    """chunk, planned_events, events, ok: whether every chunk of a plan got lines."""
    want = plan.groupBy("chunk").agg(F.sum("planned_events").alias("planned_events"))
    got = tagged.groupBy("chunk").agg(F.count(F.lit(1)).alias("events"))
    return want.join(got, "chunk", "left").select("chunk", "planned_events", F.coalesce("events", F.lit(0)).alias("events"), F.col("events").isNotNull().alias("ok"))
