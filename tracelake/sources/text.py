"""Trace files as lines: discovery, exact line numbers and byte offsets, line and byte ranges.

Spark splits plain files and reads each gzip file (all its members) in one task. Neither gives line numbers,
so they are made in two steps without moving a line: within a split rows come in order, and one summary row
per split, summed over a file's splits, gives the lines and bytes before it.
"""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracelake.functions.lines import is_event_line, is_json_line, json_value, without_comma
from tracelake.session import is_small, ship
from tracelake.sources import fs

#: Splits up to which their summary is broadcast, if their names' bytes allow it too (`is_small`).
BROADCAST_SPLITS = 1_000_000


def scan_lines(spark: SparkSession, path: str | Sequence[str], recursive: bool = False, pattern: str = "*.pfw*") -> DataFrame:
    """value, file of every line under `path` (files or folders; names by `pattern`). Plain and .gz files."""
    r = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    r = r.option("pathGlobFilter", pattern) if pattern else r
    paths = [path] if isinstance(path, str) else list(path)
    return r.text(paths).select("value", F.col("_metadata.file_path").alias("file"))


def numbered_lines(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.pfw*") -> DataFrame:
    """value, file, line_no (from 1), begin, newline: bytes [begin, newline] of the uncompressed file hold the line.

    A last line without a newline counts; in a plain file its `newline` is its last byte, in a gzip file, whose
    text's size isn't known before it is read, the byte after. Offsets are of the uncompressed text; a carriage
    return before the newline is part of the line.
    """
    ship(spark)
    r = spark.read.option("lineSep", "\n")
    r = r.option("pathGlobFilter", pattern) if pattern else r
    rows = r.text([path] if isinstance(path, str) else list(path)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.when(~F.lower("_metadata.file_path").rlike(r"\.(gz|gzip)$"), F.col("_metadata.file_size")).alias("size"))
    inside = rows.mapInArrow(_number, "value string, file string, split long, size long, line_no long, begin long, newline long")
    # Sizes alone, which needs no worker; a split's lines are numbered when they are read for good.
    ends = rows.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 1).alias("bytes"))
    order = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("file", "split", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("bytes_before"))
    small = is_small(before, BROADCAST_SPLITS)
    joined = inside.join(F.broadcast(before) if small else before, ["file", "split"])
    shift = lambda c, by: (F.col(c) + F.col(by)).alias(c)
    newline = F.col("newline") + F.col("bytes_before")
    newline = F.when(newline == F.col("size"), newline - 1).otherwise(newline)
    return joined.select("value", "file", shift("line_no", "lines_before"), shift("begin", "bytes_before"), newline.alias("newline"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and offsets within each split; a task's rows come split by split, in order."""
    at: tuple | None = None
    lines = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        file, split = b.column(1), b.column(2).to_numpy(zero_copy_only=False)
        codes = file.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new = np.ones(len(split), bool)
        new[1:] = (split[1:] != split[:-1]) | (codes[1:] != codes[:-1])
        new[0] = at != (file[0].as_py(), int(split[0]))
        width = pc.binary_length(b.column(0).cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        upto = np.cumsum(width)
        index = np.arange(1, len(split) + 1)
        starts = np.flatnonzero(new)
        group = np.cumsum(new)
        line_base = np.concatenate([[-lines], starts])[group]
        byte_base = np.concatenate([[-size], upto[starts] - width[starts]])[group]
        no, end = index - line_base, upto - byte_base
        yield pa.record_batch([b.column(0), file, b.column(2), b.column(3), pa.array(no), pa.array(end - width), pa.array(end - 1)], names=["value", "file", "split", "size", "line_no", "begin", "newline"])
        at, lines, size = (file[-1].as_py(), int(split[-1])), int(no[-1]), int(end[-1])


def read_lines(numbered: DataFrame, first: int, last: int, strict: bool = False) -> DataFrame:
    """Lines first..last (from 1, both included) of each file. Raises ValueError for a range that can't be.

    `strict`: also for one that goes beyond the end of a file, which takes a count of the lines.
    """
    if first < 1 or last < first:
        raise ValueError(f"no such line range: {first}..{last}")
    if strict and (short := numbered.groupBy("file").agg(F.max("line_no").alias("n")).filter(F.col("n") < last).limit(1).collect()):
        raise ValueError(f"{short[0].file} ends at line {short[0].n}, before line {last}")
    return numbered.filter(F.col("line_no").between(first, last))


class LineProcessor:
    """Sees a file's lines one by one, in order; override what is needed. `rows` are what it leaves behind."""

    def begin(self, file: str) -> None:
        self.rows: list[tuple] = []

    def process(self, line_no: int, line: str) -> bool | None:
        """False ends this file; no later line is seen."""

    def end(self) -> None: ...


def process_lines(numbered: DataFrame, make: Callable[[], LineProcessor], schema: str) -> DataFrame:
    """The rows, of `schema`, that a processor of `make` leaves for each file of `numbered` (a range of it, as `read_lines` and `read_line_bytes` give).

    A callback in order needs a file's range in one task, where it is streamed; files run side by side. A file none
    of whose lines are in the range has no processor. Rows are handed on while the file is read.
    """
    ship(numbered.sparkSession)
    fields = T._parse_datatype_string(schema)
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    names = kinds.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        p: LineProcessor | None = None
        stopped = False

        def rows(final: bool) -> Iterator[pa.RecordBatch]:
            if final:
                p.end()
            if p.rows:
                cols = list(zip(*p.rows))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds.types)], names=names)
                p.rows = []

        for b in batches:
            for file, no, line in zip(*(c.to_pylist() for c in b.columns)):
                if p is None or file != at:
                    if p is not None:
                        yield from rows(True)
                    at, p, stopped = file, make(), False
                    p.begin(file)
                if not stopped:
                    stopped = p.process(no, line) is False
            if p is not None:
                yield from rows(False)
        if p is not None:
            yield from rows(True)

    ordered = numbered.select("file", F.col("line_no").cast("long"), "value").repartition("file").sortWithinPartitions("file", "line_no")
    return ordered.mapInArrow(run, fields)


def read_line_bytes(numbered: DataFrame, begin: int, end: int) -> DataFrame:
    """Whole lines of the byte range [begin, end) of each file: those whose newline lies in it.

    Neighbouring ranges share no line and miss none; a last line without a newline belongs to the range of its
    last byte.
    """
    if begin < 0 or end <= begin:
        raise ValueError(f"no such byte range: {begin}..{end}")
    return numbered.filter((F.col("newline") >= begin) & (F.col("newline") < end))


def read_bytes(spark: SparkSession, path: str, begin: int, end: int, block: int = 1 << 20) -> bytes:
    """Bytes [begin, end) of a plain or gzip file's uncompressed text, streamed on the driver. Raises ValueError beyond the end."""
    if begin < 0 or end <= begin:
        raise ValueError(f"no such byte range: {begin}..{end}")
    with fs.open_file(path) as raw:
        f = gzip.GzipFile(fileobj=raw) if path.lower().endswith((".gz", ".gzip")) else raw
        left = begin
        while left:
            skipped = len(f.read(min(block, left)))
            if not skipped:
                raise ValueError(f"{path} ends before byte {begin}")
            left -= skipped
        out = bytearray()
        while len(out) < end - begin:
            part = f.read(min(block, end - begin - len(out)))
            if not part:
                raise ValueError(f"{path} ends before byte {end}")
            out += part
        return bytes(out)


def json_documents(lines: DataFrame, value: str = "value") -> DataFrame:
    """`lines` with `doc`, the line as a VARIANT parsed on access; framing and broken lines are left out."""
    return lines.filter(is_json_line(F.col(value))).withColumn("doc", json_value(F.col(value))).filter("doc is not null")


def json_get(path: str, kind: str = "string", default: object = None, doc: str = "doc"):
    """A field of a document by path, `default` where it is absent or of another kind."""
    got = F.try_variant_get(doc, f"$.{path}", kind)
    return got if default is None else F.coalesce(got, F.lit(default))


def json_has(path: str, doc: str = "doc"):
    return F.try_variant_get(doc, f"$.{path}", "variant").isNotNull()


def json_keys(value: str = "value"):
    return F.json_object_keys(without_comma(F.col(value)))


def count_events(lines: DataFrame) -> DataFrame:
    """file, n_events; files without any event have 0."""
    return lines.groupBy("file").agg(F.count_if(is_event_line(F.col("value"))).alias("n_events"))


def file_metadata(lines: DataFrame) -> DataFrame:
    """file, bytes (of event lines), start_line, end_line, valid_events, size_mb, size_per_line."""
    event = is_event_line(F.col("value"))
    mb = F.col("bytes") / F.lit(float(1 << 20))
    out = lines.groupBy("file").agg(F.coalesce(F.sum(F.when(event, F.octet_length("value"))), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("end_line"), F.count_if(event).alias("valid_events"))
    return out.select("file", "bytes", F.lit(1).cast("long").alias("start_line"), "end_line", "valid_events", mb.alias("size_mb"), F.when(F.col("valid_events") > 0, mb / F.col("valid_events")).otherwise(F.lit(0.0)).alias("size_per_line"))


def synthetic_lines(spark: SparkSession, n: int) -> DataFrame:
    """n events {name, cat, dur} between framing lines, with their order: value, line_no."""
    i = F.col("id")
    body = spark.range(1, n + 1).select(
        F.to_json(F.struct(F.concat(F.lit("name_"), i).alias("name"), F.concat(F.lit("cat_"), i).alias("cat"), F.pmod(i * 123, F.lit(10000)).alias("dur"))).alias("value"), (i + 1).alias("line_no")
    )
    frame = spark.createDataFrame([("[", 1), ("]", n + 2)], "value string, line_no long")
    return body.unionByName(frame)
