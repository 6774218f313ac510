"""Queries over real files: the lines of raw_lines are written as trace files beside the checkpoints and read back by the sources, sinks and indexes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions import vocab as V
from tracelake.operators import chunking, index
from tracelake.plans import core_queries as C
from tracelake.plans.viewcache import cached_view
from tracelake.session import cut, scratch_folder, table
from tracelake.sources import archive, fs, sinks, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ARCHIVES = 8


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _written(spark: SparkSession, d: str, compression: str = "none") -> str:
    """A folder with one text file per file of raw_lines, in the order of its lines."""
    folder = scratch_folder(spark)
    rows = table(spark, d, "raw_lines").select("file_id", "line_no", F.col("line").alias("value")).repartition("file_id").sortWithinPartitions("file_id", "line_no")
    rows.select("file_id", "value").write.partitionBy("file_id").option("compression", compression).text(folder)
    return folder


def _id(path: str = "file") -> Column:
    return F.regexp_extract(path, r"file_id=(\d+)", 1).cast("long").alias("file")


def _numbered(spark: SparkSession, folder: str) -> DataFrame:
    return text.numbered_lines(spark, folder, pattern="*.txt*").withColumn("file", _id())


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt*").option("recursiveFileLookup", "true").load(folder)
    return files.select("path")


_N = C._NUMBERED


@query("SELECT file_id AS file, count(*) AS n_lines, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes FROM raw_lines GROUP BY 1")
def file_scan(spark, d):
    lines = text.scan_lines(spark, _written(spark, d), recursive=True, pattern="*.txt")
    return lines.groupBy(_id()).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("value")).alias("n_bytes"))


@query(f'WITH {_N} SELECT file, line_no, "begin", newline, value FROM nb')
def file_numbered(spark, d):
    return _numbered(spark, _written(spark, d)).select("file", "line_no", "begin", "newline", "value")


@query(f'WITH {_N} SELECT file, line_no, "begin", newline, value FROM nb')
def file_numbered_gzip(spark, d):
    return _numbered(spark, _written(spark, d, "gzip")).select("file", "line_no", "begin", "newline", "value")


class _UntilLong(text.LineProcessor):
    """Counts lines and their bytes up to the first line of more than 200 bytes, with it."""

    def begin(self, file: str) -> None:
        super().begin(file)
        self.file, self.n, self.size = int(file), 0, 0

    def process(self, line_no: int, line: str) -> bool:
        self.n, self.size = self.n + 1, self.size + len(line.encode())
        return len(line.encode()) <= 200

    def end(self) -> None:
        self.rows.append((self.file, self.n, self.size))


_UNTIL = """SELECT file, count(*) AS n_lines, CAST(sum(strlen(value)) AS BIGINT) AS n_bytes FROM (
  SELECT *, count(*) FILTER (strlen(value) > 200) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM nb WHERE {0}) WHERE before = 0 GROUP BY file"""


@query(f"WITH {_N} {_UNTIL.format('line_no BETWEEN 5 AND 300')}")
def file_lines_processed(spark, d):
    rows = text.read_lines(_numbered(spark, _written(spark, d)), 5, 300).withColumn("file", F.col("file").cast("string"))
    return text.process_lines(rows, _UntilLong, "file long, n_lines long, n_bytes long")


@query(f"WITH {_N} {_UNTIL.format('newline >= 4096 AND newline < 65536')}")
def file_bytes_processed(spark, d):
    rows = text.read_line_bytes(_numbered(spark, _written(spark, d)), 4096, 65536).withColumn("file", F.col("file").cast("string"))
    return text.process_lines(rows, _UntilLong, "file long, n_lines long, n_bytes long")


@query("SELECT file_id AS file, CAST(sum(strlen(line) + 1) AS BIGINT) AS original_bytes, CAST(sum(strlen(line) + 1) AS BIGINT) AS trailer, 1 AS members, count(*) AS n_lines FROM raw_lines GROUP BY 1")
def file_gzip_copies(spark, d):
    """Copies of all files, what their trailers say, and how many lines they hold when read again."""
    src, out = _written(spark, d), scratch_folder(spark)
    name = F.concat(F.regexp_extract("path", r"file_id=(\d+)", 1), F.lit(".txt"))
    flat = scratch_folder(spark)  # the files of partitions all have one name; they get their own
    fs.make_folder(flat)
    named = cut(_paths(spark, src).select("path", F.concat(F.lit(f"{flat}/"), name).alias("to")).mapInPandas(_rename, "path string"))
    done = cut(sinks.gzip_files(named, out))
    file = F.regexp_extract("path", r"(\d+)\.txt", 1).cast("long").alias("file")
    sizes = archive.gzip_sizes(done.select(F.col("target").alias("path"))).select(file, "trailer", "members")
    again = text.scan_lines(spark, out, pattern="*.gz").groupBy(F.regexp_extract("file", r"(\d+)\.txt", 1).cast("long").alias("file")).agg(F.count(F.lit(1)).alias("n_lines"))
    return done.select(file, "original_bytes").join(sizes, "file").join(again, "file")


def _rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, to in zip(b["path"], b["to"]):
            fs.move(path, to)
        yield b[["to"]].set_axis(["path"], axis=1)


_EVENTS = f"SELECT regexp_replace({C._TRIM}, ',$', '') AS value FROM raw_lines WHERE {C._EVENT_LINE}"


@query(_EVENTS)
def file_merged(spark, d):
    path = f"{scratch_folder(spark)}.pfw"
    sinks.merge_traces(_numbered(spark, _written(spark, d)), path)
    return text.scan_lines(spark, path, pattern="").filter("value not in ('[', ']')").select("value")


@query(_EVENTS)
def file_split(spark, d):
    folder = scratch_folder(spark)
    lines = _numbered(spark, _written(spark, d))
    cut(sinks.write_chunks(chunking.tag_lines(lines, chunking.plan_for(text.file_metadata(lines), 0.25)), folder))
    return text.scan_lines(spark, folder).filter("value not in ('[', ']')").select("value")


@query(f"SELECT file_id AS file, count(*) AS n_lines, count(*) AS n_different, CAST(1 AS BIGINT) AS first_line, count(*) AS last_line FROM raw_lines GROUP BY 1 HAVING count(*) FILTER ({C._EVENT_LINE}) > 0")
def chunk_coverage(spark, d):
    """Every line of every file with events is in one chunk."""
    tagged = C.split_lines(spark, d)
    return tagged.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("line_no").alias("n_different"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query(C.SQL["hlm_basic"])
def metrics_csv(spark, d):
    m, folder = C.hlm_basic(spark, d), scratch_folder(spark)
    sinks.write_metrics_csv(m, folder)
    return spark.read.schema(m.schema).option("header", True).csv(folder)


@query(C.SQL["hlm_basic"])
def metrics_cached(spark, d):
    folder = scratch_folder(spark)
    cached_view(spark, folder, "hlm", lambda: C.hlm_basic(spark, d))
    return cached_view(spark, folder, "hlm", lambda: C.hlm_basic(spark, d).limit(0))  # stored already, so not computed


_KEPT = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ("proc_name", "epoch", "acc_pat", "time_range"))


@query(f"SELECT {_KEPT}, cat, func_name, io_cat, time, count, CAST(NULL AS VARCHAR) AS size, {', '.join(f'CAST(NULL AS VARCHAR) AS {b}' for b in V.BIN_COLUMNS)} FROM ({C.SQL['hlm_basic']})")
def metrics_stored(spark, d):
    folder = scratch_folder(spark)
    sinks.metrics_layout(C.hlm_basic(spark, d)).write.parquet(folder)
    return spark.read.parquet(folder)


@query(
    f"""WITH {_N} SELECT file, max(line_no) AS total_lines, max(newline) + 1 AS total_bytes, max(newline) + 1 AS size, CAST(8192 AS BIGINT) AS checkpoint_size, count(DISTINCT "begin" // 8192) AS n_checkpoints,
  true AS same_fingerprint, false AS stale FROM nb GROUP BY file"""
)
def index_stored(spark, d):
    """A stored index, built, found up to date and read back; fingerprints as the lines of the table give them."""
    src = _written(spark, d)
    store = index.IndexStore(spark, scratch_folder(spark), 8192)
    store.build(src, "*.txt")
    store.build(src, "*.txt")  # nothing to do
    stale = store.stale(src, "*.txt", contents=True).select(_id(), F.lit(True).alias("stale"))
    want = index.index_files(C._numbered(spark, d)).select("file", F.col("fingerprint").alias("want"))
    marks = store.checkpoints().groupBy(_id()).agg(F.count(F.lit(1)).alias("n_checkpoints"))
    files = store.files().withColumn("file", _id()).join(want, "file").join(marks, "file").join(stale, "file", "left")
    return files.select("file", "total_lines", "total_bytes", "size", "checkpoint_size", "n_checkpoints", (F.col("fingerprint") == F.col("want")).alias("same_fingerprint"), F.coalesce("stale", F.lit(False)).alias("stale"))


def _archived(spark: SparkSession, d: str) -> list[str]:
    """ARCHIVES tar.gz files, each with the files of raw_lines whose id leaves its number, members in order of their ids."""
    import io
    import tarfile

    folder = scratch_folder(spark)
    fs.make_folder(folder)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        path = fs.join(folder, f"a{int(pdf['archive'].iloc[0])}.tar.gz")
        with fs.finished(path, f"{path}.part") as raw, tarfile.open(fileobj=raw, mode="w|gz") as tar:
            for file, own in pdf.sort_values(["file_id", "line_no"]).groupby("file_id", sort=True):
                data = "".join(x + "\n" for x in own["line"]).encode()
                info = tarfile.TarInfo(f"logs/{file}.pfw")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame([(path,)], columns=["path"])

    rows = table(spark, d, "raw_lines").select("file_id", "line_no", "line", (F.col("file_id") % ARCHIVES).alias("archive"))
    return sorted(r.path for r in rows.groupBy("archive").applyInPandas(write, "path string").collect())


def _archive() -> Column:
    return F.regexp_extract("archive", r"a(\d+)\.tar", 1).cast("long").alias("archive")


@query(f"SELECT file_id % {ARCHIVES} AS archive, 'logs/' || file_id || '.pfw' AS file_name, CAST(sum(strlen(line) + 1) AS BIGINT) AS file_size FROM raw_lines GROUP BY file_id")
def tar_listed(spark, d):
    return archive.tar_members(spark, _archived(spark, d)).select(_archive(), "file_name", "file_size")


@query("SELECT 'logs/' || file_id || '.pfw' AS file_name, line_no::BIGINT AS line_no, line AS value FROM raw_lines")
def tar_lines_read(spark, d):
    return archive.tar_lines(spark, _archived(spark, d)).select("file_name", F.col("member_line").alias("line_no"), "value")


@query("SELECT 'logs/' || file_id || '.pfw' AS file_name, line_no::BIGINT AS line_no, line AS value FROM raw_lines WHERE file_id = (SELECT min(file_id) FROM raw_lines)")
def tar_member_lines(spark, d):
    first = table(spark, d, "raw_lines").agg(F.min("file_id")).first()[0]
    return archive.member_lines(spark, _archived(spark, d), f"logs/{first}.pfw").select("file_name", F.col("member_line").alias("line_no"), "value")


@query(
    f"""WITH n AS (SELECT file_id % {ARCHIVES} AS archive, line AS value, row_number() OVER w AS line_no, CAST(sum(strlen(line) + 1) OVER w AS BIGINT) - 1 AS newline FROM raw_lines
  WINDOW w AS (PARTITION BY file_id % {ARCHIVES} ORDER BY file_id, line_no ROWS UNBOUNDED PRECEDING)) SELECT archive, line_no, newline - strlen(value) AS "begin", newline, value FROM n"""
)
def tar_logical_read(spark, d):
    lines = archive.tar_logical_lines(spark, _archived(spark, d)).withColumnRenamed("file", "archive")
    return lines.select(_archive(), "line_no", "begin", "newline", "value")


@query(f"SELECT file_id % {ARCHIVES} AS archive, 'tar.gz' AS format, CAST(200 AS BIGINT) AS n_bytes FROM raw_lines GROUP BY 1")
def tar_formats(spark, d):
    """What the archives' contents say they are, and 200 bytes of each across members' bounds."""
    rows = [(p, archive.detect_format(p), len(archive.read_bytes(p, 100, 300))) for p in _archived(spark, d)]
    return spark.createDataFrame(rows, "archive string, format string, n_bytes long").select(_archive(), "format", "n_bytes")


@query("""SELECT '{"name":"name_' || i || '","cat":"cat_' || i || '","dur":' || (i * 123 % 10000) || '}' AS value, i + 1 AS line_no FROM range(1, 1001) t(i) UNION ALL SELECT '[', 1 UNION ALL SELECT ']', 1002""")
def generated_lines(spark, d):
    return text.synthetic_lines(spark, 1000)
