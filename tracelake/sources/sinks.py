"""Writing traces and metrics: merged, split and compressed line files, CSV and Parquet."""

from __future__ import annotations

import gzip
import io
import itertools
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import vocab as V
from tracelake.functions.lines import is_event_line, without_comma
from tracelake.session import ship
from tracelake.sources import fs


def event_lines(lines: DataFrame) -> DataFrame:
    """Event lines only, trimmed, without the comma after their object."""
    return lines.filter(is_event_line(F.col("value"))).withColumn("value", without_comma(F.col("value")))


def _refuse(path: str, force: bool) -> None:
    if fs.exists(path):
        if not force:
            raise FileExistsError(path)
        fs.remove(path)


def write_lines(lines: DataFrame, out_dir: str, compress: bool = False, force: bool = False) -> None:
    """Event lines as line-delimited files, one per partition, in parallel; the input is never deleted."""
    w = event_lines(lines).select("value").write.mode("overwrite" if force else "errorifexists")
    (w.option("compression", "gzip") if compress else w).text(out_dir)


def merge_traces(lines: DataFrame, path: str, compress: bool = False, force: bool = False, strict: bool = False) -> int:
    """One file of all event lines between `[` and `]` (`strict`: with commas, a JSON array). Returns the events written.

    The name must end in .pfw (.pfw.gz when compressed). Parts are written in parallel and then joined byte by
    byte, in order of file and line where `lines` has line_no, so no task or driver holds the trace.
    """
    if not path.endswith(".pfw.gz" if compress else ".pfw"):
        raise ValueError(f"{path}: the name must end in .pfw{'.gz' if compress else ''}")
    _refuse(path, force)
    parts = f"{path}.{uuid.uuid4().hex}.parts"
    rows = event_lines(lines)
    if "line_no" in rows.columns:
        rows = rows.repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no")
    n = 0
    try:
        rows.select("value").write.option("lineSep", "\n").text(parts)
        with fs.finished(path, f"{path}.{uuid.uuid4().hex}.part") as raw:
            out = gzip.GzipFile(fileobj=raw, mode="wb") if compress else raw
            out.write(b"[\n")
            for p in (f for f in fs.names(parts) if f.startswith("part-")):
                with fs.open_file(fs.join(parts, p)) as f:
                    for line in io.BufferedReader(f, 1 << 20):
                        out.write((b",\n" if n and strict else b"") + (line.rstrip(b"\n") if strict else line))
                        n += 1
            out.write(b"\n]\n" if strict else b"]\n")
            if compress:
                out.close()
    finally:
        fs.remove(parts)
    return n


_GZIPPED = "path string, target string, original_bytes long, compressed_bytes long"


def gzip_files(files: DataFrame, out_dir: str, level: int = 6, block: int = 1 << 20) -> DataFrame:
    """Every file of `files` (path) compressed as it is, byte for byte, to `out_dir` under its name and .gz; the input stays.

    Returns path, target, original_bytes, compressed_bytes. Each file is streamed by one task, under another name
    that becomes its own once it is whole. Files of one name in different folders would overwrite each other and are
    refused.
    """
    ship(files.sparkSession)
    name = F.substring_index("path", "/", -1)
    twice = files.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several files are called {twice[0].name}")
    fs.make_folder(out_dir)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                target = fs.join(out_dir, p.rstrip("/").rsplit("/", 1)[-1] + ".gz")
                size = 0
                with fs.open_file(p) as src, fs.finished(target, f"{target}.{uuid.uuid4().hex}.part") as raw:
                    with gzip.GzipFile(filename="", fileobj=raw, mode="wb", compresslevel=level, mtime=0) as out:
                        while data := src.read(block):
                            out.write(data)
                            size += len(data)
                rows.append((p, target, size, fs.size(target)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _GZIPPED.split(", ")])

    return files.select("path").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "path").mapInPandas(run, _GZIPPED)


def compression_summary(done: DataFrame) -> DataFrame:
    """n_files, original_bytes, compressed_bytes, ratio (compressed to original, 0 without bytes) of what `gzip_files` returns."""
    sums = done.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("compressed_bytes"))
    return sums.withColumn("ratio", F.when(F.col("original_bytes") > 0, F.col("compressed_bytes") / F.col("original_bytes")).otherwise(F.lit(0.0)))


def write_chunks(tagged: DataFrame, out_dir: str, app: str = "app", compress: bool = True, force: bool = False) -> DataFrame:
    """One file <app>-<chunk>.pfw[.gz] per chunk of `tagged` (chunk, file, line_no, value). Returns chunk, path, n_events, n_bytes.

    Chunks are written in parallel, each by the task that holds it, in the order of their lines; a chunk is one
    output file by definition, and its lines are streamed through that task.
    """
    _refuse(out_dir, force)
    fs.make_folder(out_dir)
    ship(tagged.sparkSession)
    suffix = ".pfw.gz" if compress else ".pfw"
    rows = event_lines(tagged).select("chunk", "file", "line_no", "value").repartition("chunk").sortWithinPartitions("chunk", "file", "line_no")

    def write(chunk: int, lines: Iterator[str]) -> tuple[int, str, int, int]:
        target, n, size = fs.join(out_dir, f"{app}-{chunk}{suffix}"), 0, 0
        with fs.finished(target, fs.join(out_dir, f".{app}-{chunk}.{uuid.uuid4().hex}")) as raw:
            out = gzip.GzipFile(fileobj=raw, mode="wb") if compress else raw
            out.write(b"[\n")
            for v in lines:
                data = v.encode() + b"\n"
                out.write(data)
                n, size = n + 1, size + len(data)
            out.write(b"]\n")
            if compress:
                out.close()
        return chunk, target, n, size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat = ((int(c), v) for b in batches for c, v in zip(b["chunk"], b["value"]))
        for chunk, own in itertools.groupby(flat, key=lambda x: x[0]):
            yield pd.DataFrame([write(chunk, (v for _, v in own))], columns=["chunk", "path", "n_events", "n_bytes"])

    return rows.mapInPandas(run, "chunk long, path string, n_events long, n_bytes long")


def write_metrics_csv(metrics: DataFrame, out_dir: str, force: bool = False) -> None:
    """Metrics as CSV with a header; NULL is empty, sets are joined by `|`, blanks at a value's ends stay."""
    flat = metrics.select(*[F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in metrics.dtypes])
    flat.write.mode("overwrite" if force else "errorifexists").options(header=True, nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(out_dir)


def metrics_layout(metrics: DataFrame) -> DataFrame:
    """The fixed layout of stored metrics: key columns (NULL where they aren't keys), time, count, size, bins, then all else."""
    first = ["proc_name", "cat", "epoch", "acc_pat", "func_name", "io_cat", "time_range", "time", "count", "size", *V.BIN_COLUMNS]
    cols = [F.col(c) if c in metrics.columns else F.lit(None).cast("string").alias(c) for c in first]
    return metrics.select(*cols, *[c for c in metrics.columns if c not in first])
