"""Command line: python -m tracelake.cli COMMAND ... (reader, tar, map, event_count, pgzip, merge, split, replay)."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.operators import chunking, replay
from tracelake.operators import trace as T
from tracelake.operators.index import IndexStore
from tracelake.operators.smallfiles import list_files
from tracelake.plans.viewcache import cached_view, view_name
from tracelake.session import build_session, cut, scratch, ship
from tracelake.sources import archive, sinks, text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelake", description=__doc__)
    p.add_argument("--master", default=os.environ.get("SPARK_MASTER", "local[*]"))
    sub = p.add_subparsers(dest="command", required=True)

    r = sub.add_parser("reader", help="print a range of a plain, gzip or tar.gz trace")
    r.add_argument("file")
    r.add_argument("-s", "--start", type=int, default=-1)
    r.add_argument("-e", "--end", type=int, default=-1)
    r.add_argument("--check", action="store_true", help="only say whether the file's index has to be built again (exit code 1: yes)")
    r.add_argument("--index", help="folder of the index, for --check and --build")
    r.add_argument("--build", action="store_true", help="build the index where it is out of date")
    r.add_argument("--mode", choices=["bytes", "line_bytes", "lines"], default="bytes")
    t = sub.add_parser("tar", help="members and totals of tar archives")
    t.add_argument("files", nargs="+")
    t.add_argument("--list-files", action="store_true")
    t.add_argument("--info", action="store_true", help="format, sizes and members of each archive")
    t.add_argument("--member", help="print the lines of the members of this name")
    m = sub.add_parser("map", help="high-level metrics")
    m.add_argument("files", nargs="+")
    m.add_argument("-v", "--view-types", default="proc_name,file_name")
    m.add_argument("-g", "--granularity", type=float, default=1e6)
    m.add_argument("--checkpoint", action="store_true")
    m.add_argument("--checkpoint-dir")
    m.add_argument("-o", "--output", help="folder for Parquet; printed without")
    c = sub.add_parser("event_count", help="events per file and in all")
    c.add_argument("-d", "--directory", default=".")
    g = sub.add_parser("pgzip", help="compressed copies; the input stays")
    g.add_argument("-d", "--directory", default=".")
    g.add_argument("-o", "--output", required=True)
    for name, default in (("merge", "combined.pfw"), ("split", "./split")):
        q = sub.add_parser(name)
        q.add_argument("-d", "--directory", default=".")
        q.add_argument("-o", "--output", default=default)
        q.add_argument("-f", "--force", action="store_true")
        q.add_argument("-c", "--compress", action="store_true", default=name == "split")
        if name == "merge":
            q.add_argument("--array", action="store_true", help="a strict JSON array")
        else:
            q.add_argument("-n", "--app-name", default="app")
            q.add_argument("-s", "--chunk-size", type=float, default=4.0, help="MB")
            q.add_argument("--no-compress", dest="compress", action="store_false")
    y = sub.add_parser("replay", help="what a replay would do")
    y.add_argument("inputs", nargs="+")
    y.add_argument("--sleep-mode", dest="sleep_mode", action="store_true")
    y.add_argument("--no-sleep", action="store_true")
    y.add_argument("--no-timing", action="store_true", help="plan no waits between events")
    y.add_argument("--timing-scale", type=float, default=1.0)
    y.add_argument("--dry-run", action="store_true")
    y.add_argument("--functions", default="")
    y.add_argument("--exclude", default="")
    y.add_argument("--categories", default="")
    return p


def _show(df: DataFrame) -> None:
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    if archive.detect_format(path) == archive.TAR_GZ:
        return archive.tar_logical_lines(spark, [path])
    return text.numbered_lines(spark, path, pattern="")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or build_session(a.master, f"tracelake {a.command}")
    ship(spark)
    with scratch(spark):
        return _run(a, spark)


def _run(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.command == "reader":
        if a.check or a.build:
            if not a.index:
                print("--check and --build need --index", file=sys.stderr)
                return 1
            store = IndexStore(spark, a.index)
            if a.build:
                print(store.build(a.file, "*"))
                return 0
            stale = not store.stale(a.file, "*").isEmpty()
            print("rebuild" if stale else "valid")
            return int(stale)
        if a.mode == "bytes":
            if a.end < 0:
                print("bytes need --start and --end", file=sys.stderr)
                return 1
            tar = archive.detect_format(a.file) == archive.TAR_GZ
            data = archive.read_bytes(a.file, max(0, a.start), a.end) if tar else text.read_bytes(spark, a.file, max(0, a.start), a.end)
            sys.stdout.write(data.decode("utf-8", "replace"))
            return 0
        n = _numbered(spark, a.file)
        if a.mode == "lines":
            rows = text.read_lines(n, max(1, a.start), a.end if a.end >= 0 else 2**62)
        else:
            rows = text.read_line_bytes(n, max(0, a.start), a.end if a.end >= 0 else 2**62)
        for row in rows.orderBy("line_no").select("value").toLocalIterator():
            print(row[0])
    elif a.command == "tar":
        members = archive.tar_members(spark, a.files)
        if a.member:
            for row in archive.member_lines(spark, a.files, a.member).orderBy("archive", "uncompressed_offset", "member_line").select("value").toLocalIterator():
                print(row[0])
            return 0
        totals = members.groupBy("archive").agg(F.count(F.lit(1)).alias("members"), F.sum("file_size").alias("bytes"))
        if a.info:
            sizes = archive.gzip_sizes(spark.createDataFrame([(p,) for p in a.files], "path string")).select(F.col("path").alias("archive"), "compressed")
            totals = totals.join(sizes, "archive").withColumn("format", F.lit(archive.TAR_GZ))
        _show(archive.logical_offsets(members).orderBy("archive", "uncompressed_offset") if a.list_files else totals)
    elif a.command == "map":
        if a.checkpoint and not a.checkpoint_dir:
            print("--checkpoint needs --checkpoint-dir", file=sys.stderr)
            return 1
        compute = lambda: T.analyze(T.parse_trace(text.scan_lines(spark, a.files, pattern="")), a.view_types, a.granularity)
        views = T.views_of(a.view_types)
        out = cached_view(spark, a.checkpoint_dir, view_name("hlm", views, a.granularity), compute) if a.checkpoint else compute()
        if a.output:
            out.write.parquet(a.output)
        else:
            _show(out)
    elif a.command == "event_count":
        counts = text.count_events(text.scan_lines(spark, a.directory))
        _show(counts.orderBy("file"))
        print(counts.agg(F.coalesce(F.sum("n_events"), F.lit(0))).first()[0])
    elif a.command == "pgzip":
        done = cut(sinks.gzip_files(list_files(spark, a.directory, "*.pfw"), a.output))
        _show(done.orderBy("path"))
        _show(sinks.compression_summary(done))
    elif a.command == "merge":
        print(sinks.merge_traces(text.numbered_lines(spark, a.directory), a.output, a.compress, a.force, a.array))
    elif a.command == "split":
        n = text.numbered_lines(spark, a.directory)
        plan = chunking.plan_for(text.file_metadata(text.scan_lines(spark, a.directory)), a.chunk_size)
        _show(sinks.write_chunks(chunking.tag_lines(n, plan), a.output, a.app_name, a.compress, a.force))
    else:
        names = lambda x: tuple(v for v in x.split(",") if v)
        events = T.parse_trace(text.scan_lines(spark, a.inputs, pattern=""), mode="replay")
        config = replay.ReplayConfig(not a.no_timing, a.timing_scale, dry_run=a.dry_run, sleep_mode=a.sleep_mode and not a.no_sleep, functions=names(a.functions), without=names(a.exclude), categories=names(a.categories))
        plan = replay.configured_plan(events, config)
        stats = replay.replay_statistics(plan).cache()
        _show(stats.withColumn("rate", S.percent(F.col("executed"), F.col("total"))).orderBy("dimension", "name"))
        status = replay.replay_status(stats).first()
        return status.exit_code if status else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
