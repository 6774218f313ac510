"""Consolidation of very many small files: the plan, and the copy of Parquet blocks it drives.

The plan takes every content once and lays contents of one kind end to end into targets of a given size.
For Parquet the copy moves encoded row groups as they are and writes a new footer: no page is decoded.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.session import cut, ship
from tracelake.sources import parquet_blocks

SMALL = 65_535


def small_contents(files: DataFrame, tar_files: DataFrame, smallest: int = 1, largest: int = SMALL) -> DataFrame:
    """src_table, id, name, byte_size, n_rows of every content of `smallest`..`largest` bytes, each once.

    Files of equal size and equal known hash (not NULL, not 0) are one content, as are regular members of
    one archive at one data offset; the smallest id stands for it, n_rows counts its records. A row without
    hash, archive or offset is a content of its own. Unknown sizes are no contents; NULL ids are left out.
    """
    between = lambda c: F.col(c).between(smallest, largest) & F.col("id").isNotNull()
    row = F.col("id")
    whole = lambda ok: F.when(~F.coalesce(ok, F.lit(False)), row)  # noqa: E731  what makes a row its own content
    f = files.filter(between("byte_size")).select(
        F.lit("files").alias("src_table"), "id", F.col("logical_name").alias("name"), "byte_size", F.col("hash").alias("k1"), F.col("byte_size").alias("k2"), whole(F.col("hash") != 0).alias("k3")
    )
    regular = F.coalesce(F.trim("typeflag"), F.lit("")).isin("", "0")
    t = tar_files.filter(between("file_size") & regular).select(
        F.lit("tar_files").alias("src_table"),
        "id",
        F.col("file_name").alias("name"),
        F.col("file_size").alias("byte_size"),
        F.col("archive_id").alias("k1"),
        F.col("data_offset").alias("k2"),
        whole(F.col("archive_id").isNotNull() & F.col("data_offset").isNotNull()).alias("k3"),
    )
    one = F.min(F.struct("id", "name", "byte_size")).alias("c")
    merged = f.unionByName(t).groupBy("src_table", "k1", "k2", "k3").agg(one, F.count(F.lit(1)).alias("n_rows"))
    return merged.select("src_table", "c.id", "c.name", "c.byte_size", "n_rows")


def content_kind(name: Column) -> Column:
    """What may share a target: contents of one encoding, told by the name's suffix."""
    n = F.lower(F.coalesce(name, F.lit("")))
    return F.when(n.rlike(r"\.(gz|gzip|tgz)$"), "gzip").when(n.rlike(r"\.parquet$"), "parquet").when(n.rlike(r"\.(pfw|jsonl|ndjson|json|csv|txt)$"), "lines").otherwise("other")


def consolidation_plan(contents: DataFrame, target_bytes: int = 128 << 20, rows_per_lane: int = 1_000_000) -> DataFrame:
    """`contents` (src_table, id, name, byte_size, n_rows) with target_file, target_offset and target_bytes.

    Contents are spread evenly by a hash of their identity into lanes of about `rows_per_lane`, so an archive
    with a third of all members is no heavier than others; a lane fills its targets in order of name and id.
    Every target but a lane's last of each kind is within one content of `target_bytes`. Only contents of a target
    that they fill from its first byte to its last, each byte once, come out; that is all of them, or the plan is
    broken and what is missing shows it. The contents are materialised: their count sets the number of lanes, one
    shuffle lays them out.
    """
    rows = cut(contents.select("src_table", "id", "name", "byte_size", "n_rows", content_kind(F.col("name")).alias("kind")))
    n = rows.count()
    lanes = max(1, math.ceil(n / rows_per_lane))
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("src_table", "id"), F.lit(lanes)).cast("int"))
    order = Window.partitionBy("kind", "lane").orderBy("name", "src_table", "id")
    upto = F.sum("byte_size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.withColumn("at", F.coalesce(upto, F.lit(0))).withColumn("slot", F.floor(F.col("at") / F.lit(float(target_bytes))).cast("long"))
    inside = Window.partitionBy("kind", "lane", "slot")
    before = inside.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    first, end = F.min("at").over(inside), F.col("at") + F.col("byte_size")
    placed = placed.withColumns({"first": first, "total": F.sum("byte_size").over(inside), "last": F.max(end).over(inside), "gap": F.col("at") - F.coalesce(F.max(end).over(before), first)})
    sound = (F.max(F.abs("gap")).over(inside) == 0) & (F.col("last") - F.col("first") == F.col("total"))
    return placed.withColumn("sound", sound).filter("sound").select(
        "src_table", "id", "name", "byte_size", "n_rows", F.format_string("%s-%05d-%06d", "kind", "lane", "slot").alias("target_file"), (F.col("at") - F.col("first")).alias("target_offset"), F.col("total").alias("target_bytes")
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    """target_file, n_contents, n_records, n_bytes, holes: bytes of a target no content covers (0 in a sound plan)."""
    end = F.max(F.col("target_offset") + F.col("byte_size"))
    return plan.groupBy("target_file").agg(
        F.count(F.lit(1)).alias("n_contents"), F.sum("n_rows").alias("n_records"), F.sum("byte_size").alias("n_bytes"), (end - F.sum("byte_size")).alias("holes")
    )


def compact_parquet(spark: SparkSession, paths: Sequence[str] | DataFrame, out_dir: str, target_bytes: int = 128 << 20) -> DataFrame:
    """Copy the row groups of Parquet files into fewer files of about `target_bytes` under `out_dir`.

    `paths`: a list, or a frame with a column `path` (as `list_files` gives), on any filesystem `sources.fs` knows.
    Files of one schema share targets. Returns target, schema_id, n_files, n_blocks, n_rows, n_bytes of each
    file written. Footers are read on executors; the plan, a row per file, is laid out as in
    `consolidation_plan`. The written footers are read again: schema, block count and row total must equal
    those of the sources, or the task fails. Written under a temporary name and renamed, so a task that runs
    twice leaves one file. Files with no row group are valid sources without rows; an empty list gives no rows.
    """
    ship(spark)
    given = paths.select("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    infos = cut(given.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInPandas(parquet_blocks.describe, "path string, schema_id string, n_blocks long, n_rows long, n_bytes long"))
    lanes = max(1, math.ceil(infos.count() / 100_000))
    infos = infos.withColumn("lane", F.pmod(F.xxhash64("path"), F.lit(lanes)).cast("int"))
    order = Window.partitionBy("schema_id", "lane").orderBy("path")
    upto = F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1))
    slots = infos.withColumn("slot", F.floor(F.coalesce(upto, F.lit(0)) / F.lit(float(target_bytes))).cast("long"))
    write = parquet_blocks.writer(out_dir)
    return slots.groupBy("schema_id", "lane", "slot").applyInPandas(write, "target string, schema_id string, n_files long, n_blocks long, n_rows long, n_bytes long")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """path, byte_size of the files under `folder`, listed by Spark (in parallel where there are many); no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("byte_size"))


def copy_totals(df: DataFrame, folder: str, records_per_file: int = 2_000) -> DataFrame:
    """`df` written to `folder` as many small Parquet files and compacted from there: one row with n_rows, n_copied (by the copies' footers),
    same (whether the copies hold the same rows, by number and a sum of hashes) and fewer (whether there are no more files than before).

    Equal rows count as often as they come. The hash reads every column but maps, which have none.
    """
    spark = df.sparkSession
    small, large = f"{folder}/small", f"{folder}/large"
    df.write.option("maxRecordsPerFile", records_per_file).parquet(small)
    done = cut(compact_parquet(spark, list_files(spark, small), large)).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_copied"), (F.count(F.lit(1)) <= F.coalesce(F.sum("n_files"), F.lit(0))).alias("fewer"))
    columns = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")]
    known = lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))
    before, after = known(df), known(spark.read.schema(df.schema).parquet(large))
    same = lambda c: before.select(c).scalar().eqNullSafe(after.select(c).scalar())
    return done.select(before.select("n").scalar().alias("n_rows"), "n_copied", (same("n") & same("h")).alias("same"), "fewer")
