"""Index tables over trace files: totals, checkpoints, staleness, lookups. All are plain Parquet-able frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.chunked import running
from tracelake.session import cut
from tracelake.sources import fs
from tracelake.sources.text import numbered_lines

WINDOW, MAX_CHECKPOINT, MAX_PARTS = 32 << 10, 512 << 20, 100_000_000
DEFAULT_CHECKPOINT = 32 << 20
TEXT_RATIO, OTHER_RATIO = 8.0, 6.0


def index_path(path: str, tar: bool = False) -> str:
    return f"{path}.idx.tar" if tar else f"{path}.idx"


def checkpoint_size(asked: int, uncompressed: int, window: int = WINDOW, most: int = MAX_CHECKPOINT, parts: int = MAX_PARTS) -> int:
    """Distance of checkpoints in uncompressed bytes: what was asked, if the data is as large; else an even part of the data.

    Always at least a window and at most `most`. An even part is of whole windows, of about the size asked for (or
    256 KiB); so is what is given where the data's size isn't known (0 or less).
    """
    step = -(-max(window, asked or 256 << 10) // window) * window
    if 0 < asked <= uncompressed:
        size = asked
    elif uncompressed > 0:
        pieces = min(parts, max(1, round(uncompressed / min(step, most))))
        size = uncompressed // pieces // window * window
    else:
        size = step
    return max(window, min(size, most if 0 < asked <= uncompressed else most // window * window))


def uncompressed_estimate(compressed: int, trailer: int | None, several_members: bool, name: str = "") -> int:
    """Uncompressed size of a gzip file: its trailer, unless that can't be; else a ratio by the kind of contents."""
    wrapped = compressed > 4 << 30 and trailer is not None and trailer < 64 << 20
    if trailer and not several_members and not wrapped:
        return trailer
    ratio = TEXT_RATIO if name.lower().endswith((".pfw", ".json", ".jsonl", ".ndjson", ".txt", ".csv")) else OTHER_RATIO
    return max(compressed, int(compressed * ratio))


def index_files(numbered: DataFrame) -> DataFrame:
    """file, total_lines, total_bytes, fingerprint from numbered lines (see sources.text). One shuffle of a row per task and file.

    `value` may be the line or already its hash (a long); both give the same fingerprint.
    """
    line = F.col("value") if dict(numbered.dtypes)["value"] == "bigint" else F.xxhash64("value")
    return numbered.groupBy("file").agg(F.max("line_no").alias("total_lines"), (F.max("newline") + 1).alias("total_bytes"), F.bit_xor(F.xxhash64("line_no", line)).alias("fingerprint"))


def index_checkpoints(numbered: DataFrame, size: int = DEFAULT_CHECKPOINT) -> DataFrame:
    """file, checkpoint_idx, uc_offset, uc_size, num_lines, first_line, last_line: whole lines, cut every `size` bytes."""
    idx = F.call_function("div", F.col("begin"), F.lit(int(size)).cast("long"))
    return numbered.groupBy("file", idx.alias("checkpoint_idx")).agg(
        F.min("begin").alias("uc_offset"), (F.max("newline") + 1 - F.min("begin")).alias("uc_size"), F.count(F.lit(1)).alias("num_lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line")
    )


def stale_files(stored: DataFrame, current: DataFrame, key: str = "file") -> DataFrame:
    """Keys of `current` to be indexed again: not stored, without a fingerprint, or with another mtime, size or fingerprint."""
    s = stored.select(key, *[F.col(c).alias(f"_tl_{c}") for c in ("mtime", "size", "fingerprint")], F.lit(True).alias("_tl_there"))
    differs = F.col("_tl_there").isNull() | F.coalesce(F.col("_tl_fingerprint") == 0, F.lit(True))
    for c in ("mtime", "size", "fingerprint"):
        differs |= ~F.col(c).eqNullSafe(F.col(f"_tl_{c}"))
    return current.join(s, key, "left").filter(differs).select(key)


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "file") -> DataFrame:
    """`stored` with the rows of `fresh` in place of those of the same key."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def without_files(rows: DataFrame, gone: DataFrame, key: str = "file") -> DataFrame:
    """`rows` but those of files that were removed."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def checkpoint_asof(checkpoints: DataFrame, targets: DataFrame, file: str = "file") -> DataFrame:
    """Per target (file, target): the last checkpoint at or before it; NULL where there is none.

    Checkpoints and targets are put in one order by file and offset, and the last checkpoint seen is carried
    along: no pair of a target with each earlier checkpoint is made, and a file of any size is shared by several
    tasks.
    """
    none = F.lit(None).cast("long")
    c = checkpoints.select(file, F.col("uc_offset").alias("at"), F.lit(0).alias("kind"), none.alias("target"), "checkpoint_idx", "uc_offset")
    t = targets.select(file, F.col("target").alias("at"), F.lit(1).alias("kind"), "target", none.alias("checkpoint_idx"), none.alias("uc_offset"))
    seen = running(c.unionByName(t), [file], ["at", "kind"], {"checkpoint_idx": ("checkpoint_idx", "last"), "uc_offset": ("uc_offset", "last")})
    return seen.filter("kind = 1").select(file, "target", "checkpoint_idx", "uc_offset")


def checkpoints_overlapping(checkpoints: DataFrame, first: int | Column, last: int | Column) -> DataFrame:
    """Checkpoints that share a line with first..last."""
    return checkpoints.filter((F.col("first_line") <= last) & (F.col("last_line") >= first))


def max_bytes(checkpoints: DataFrame, totals: DataFrame, file: str = "file") -> DataFrame:
    """file, max_bytes: the end of the last checkpoint, or the total where there is none."""
    ends = checkpoints.groupBy(file).agg(F.max(F.col("uc_offset") + F.col("uc_size")).alias("e"))
    return totals.select(file, "total_bytes").join(ends, file, "left").select(file, F.coalesce(F.nullif("e", F.lit(0)), F.col("total_bytes")).alias("max_bytes"))


def archive_lookup(archives: DataFrame, files: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Archives with the file that holds them and, given members, their member counts and sizes (inner joins by key)."""
    out = archives.select(F.col("id").alias("archive_id"), "file_id", "archive_name", "total_files").join(files.select(F.col("id").alias("file_id"), "logical_name", "byte_size"), "file_id")
    if members is None:
        return out
    n = members.groupBy("archive_id").agg(F.count(F.lit(1)).alias("n_members"), F.sum("file_size").alias("member_bytes"))
    return out.join(n, "archive_id")


_FILES = "file string, size long, mtime long, fingerprint long, total_lines long, total_bytes long, checkpoint_size long"
_CHECKPOINTS = "file string, checkpoint_idx long, uc_offset long, uc_size long, num_lines long, first_line long, last_line long"


class IndexStore:
    """An index of trace files kept under a folder: a table of files and one of their checkpoints, in Parquet snapshots.

    A snapshot is written whole under a new number; readers take the highest that was completed, so a build that fails
    or is interrupted leaves the last one as it was. The one before is kept for readers that are still at it.
    """

    def __init__(self, spark: SparkSession, folder: str, checkpoint: int = DEFAULT_CHECKPOINT) -> None:
        self.spark, self.folder, self.checkpoint = spark, folder.rstrip("/"), checkpoint

    def _snapshots(self, name: str) -> list[int]:
        where = fs.join(self.folder, name)
        if not fs.exists(where):
            return []
        numbers = sorted(int(x[2:]) for x in fs.names(where) if x.startswith("v=") and x[2:].isdigit())
        return [n for n in numbers if fs.exists(fs.join(where, f"v={n}/_SUCCESS"))]

    def _read(self, name: str, schema: str) -> DataFrame:
        found = self._snapshots(name)
        if not found:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.parquet(f"{self.folder}/{name}/v={found[-1]}")
        if [f"{c} {t}" for c, t in df.dtypes] != [x.replace(" long", " bigint") for x in schema.split(", ")]:
            raise ValueError(f"{self.folder}/{name} is no index of this form: {df.dtypes}")
        return df

    def _write(self, name: str, df: DataFrame) -> None:
        found = self._snapshots(name)
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/v={found[-1] + 1 if found else 0}")
        for old in found[:-1]:
            fs.remove(f"{self.folder}/{name}/v={old}")

    def files(self) -> DataFrame:
        """file, size, mtime, fingerprint, total_lines, total_bytes, checkpoint_size. Raises ValueError for an index of another form."""
        return self._read("files", _FILES)

    def checkpoints(self) -> DataFrame:
        return self._read("checkpoints", _CHECKPOINTS)

    def current(self, path: str, pattern: str = "*.pfw*") -> DataFrame:
        """file, size, mtime (microseconds) of the files that hold anything; Spark doesn't list empty ones. Their contents aren't read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        return files.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.unix_micros("_metadata.file_modification_time").alias("mtime"))

    def stale(self, path: str, pattern: str = "*.pfw*", contents: bool = False) -> DataFrame:
        """file of what has to be indexed (again): new, of another size or time, without a fingerprint; with `contents`, which are read, also of another fingerprint."""
        now, stored = self.current(path, pattern), self.files()
        if contents:
            now = now.join(index_files(numbered_lines(self.spark, path, pattern)).select("file", "fingerprint"), "file", "left").withColumn("fingerprint", F.coalesce("fingerprint", F.lit(1).cast("long")))
        else:
            now = now.join(stored.select("file", "fingerprint"), "file", "left")
        return stale_files(stored, now)

    def build(self, path: str, pattern: str = "*.pfw*", force: bool = False, contents: bool = False) -> int:
        """Index what is stale (`force`: everything) and drop files that are gone from `path`'s folder listing. Returns how many files were read."""
        now = cut(self.current(path, pattern))
        todo = cut(now.select("file") if force else self.stale(path, pattern, contents))
        n = todo.count()
        kept = self.files().join(now.select("file"), "file", "left_semi")
        if not n and kept.count() == self.files().count():
            return 0
        lines = cut(numbered_lines(self.spark, path, pattern).join(todo, "file", "left_semi").withColumn("value", F.xxhash64("value")))
        totals = now.join(todo, "file", "left_semi").join(index_files(lines), "file", "left")
        fresh = totals.select("file", "size", "mtime", F.coalesce("fingerprint", F.lit(1).cast("long")).alias("fingerprint"), F.coalesce("total_lines", F.lit(0)).cast("long").alias("total_lines"), F.coalesce("total_bytes", F.lit(0)).cast("long").alias("total_bytes"), F.lit(self.checkpoint).cast("long").alias("checkpoint_size"))
        marks = index_checkpoints(lines, self.checkpoint).select(*[F.col(x.split()[0]).cast("long") if x.endswith("long") else x.split()[0] for x in _CHECKPOINTS.split(", ")])
        checkpoints = without_files(self.checkpoints().join(now.select("file"), "file", "left_semi"), todo).unionByName(marks)
        self._write("checkpoints", checkpoints)
        self._write("files", upsert(kept, fresh))
        return n
