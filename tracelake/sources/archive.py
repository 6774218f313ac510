"""Formats by name and content, and tar archives as rows, streamed so that no archive is held in memory."""

from __future__ import annotations

import gzip
import io
import tarfile
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.operators.chunked import running
from tracelake.session import ship
from tracelake.sources.fs import open_file

PLAIN, GZIP, TAR_GZ = "plain", "gzip", "tar.gz"
GZIP_MAGIC = b"\x1f\x8b"
BLOCK = 512


def format_by_name(path: str) -> str | None:
    p = path.lower()
    return TAR_GZ if p.endswith((".tar.gz", ".tgz")) else GZIP if p.endswith((".gz", ".gzip")) else None


def format_column(path: Column) -> Column:
    """format_by_name as a column; NULL where the name doesn't tell."""
    p = F.lower(path)
    return F.when(p.rlike(r"\.(tar\.gz|tgz)$"), TAR_GZ).when(p.rlike(r"\.(gz|gzip)$"), GZIP)


def is_tar_header(block: bytes) -> bool:
    """Whether 512 bytes are a tar header: its checksum holds, and its magic is ustar or empty (the old form)."""
    if len(block) < BLOCK or not block[0]:
        return False
    try:
        said = int(block[148:156].strip(b" \0") or b"-1", 8)
    except ValueError:
        return False
    return said == sum(block[:148]) + 8 * 32 + sum(block[156:]) and (block[257:262] == b"ustar" or not block[257:262].strip(b"\0 "))


def sniff(head: bytes) -> str:
    """Format by a file's first bytes."""
    if not head.startswith(GZIP_MAGIC):
        return PLAIN
    try:
        block = gzip.GzipFile(fileobj=io.BytesIO(head)).read1(BLOCK)
    except (OSError, EOFError):
        return GZIP
    return TAR_GZ if is_tar_header(block) else GZIP


def detect_format(path: str, head_bytes: int = 64 << 10) -> str:
    """By name where it tells, else by content."""
    by_name = format_by_name(path)
    if by_name:
        return by_name
    with open_file(path) as f:
        return sniff(f.read(head_bytes))


_MEMBERS = "archive string, file_name string, file_size long, file_mtime long, typeflag string, data_offset long, uncompressed_offset long"
_LINES = "archive string, file_name string, uncompressed_offset long, member_line long, member_begin long, newline boolean, value string"


def _archives(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    ship(spark)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))


def _members(path: str) -> Iterator[tuple[tarfile.TarFile, tarfile.TarInfo]]:
    with open_file(path) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
        for m in tar:
            yield tar, m


def tar_members(spark: SparkSession, paths: Sequence[str], regular_only: bool = True) -> DataFrame:
    """Headers of tar archives: one row per member (duplicate names stay apart by their offsets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                rows = []
                for _, m in _members(p):
                    if m.isreg() or not regular_only:
                        rows.append((p, m.name, m.size, int(m.mtime), m.type.decode("latin1").strip("\0"), m.offset_data, m.offset))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBERS.split(", ")])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MEMBERS.split(", ")])

    return _archives(spark, paths).mapInPandas(run, _MEMBERS)


def tar_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines of all regular members: archive, file_name, member (its header's offset), member_line, member_begin, newline, value."""
    names = [c.split()[0] for c in _LINES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                rows = []
                for tar, m in _members(p):
                    if not m.isreg():
                        continue
                    at = 0
                    for i, line in enumerate(tar.extractfile(m), 1):
                        whole = line.endswith(b"\n")
                        rows.append((p, m.name, m.offset, i, at, whole, line[: -1 if whole else None].decode("utf-8", "replace")))
                        at += len(line)
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return _archives(spark, paths).mapInPandas(run, _LINES)


def logical_offsets(members: DataFrame, archive: str = "archive") -> DataFrame:
    """Members with logical_begin and logical_end, their bytes in the archive's contents laid end to end.

    Members come in the order of uncompressed_offset (data_offset and name for ties); unknown sizes count as 0.
    An archive with most of all members is shared by several tasks.
    """
    out = running(members, [archive], ["uncompressed_offset", "data_offset", "file_name"], {"logical_end": ("file_size", "sum")})
    return out.withColumn("logical_begin", F.col("logical_end") - F.coalesce(F.col("file_size"), F.lit(0)))


def tar_logical_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """tar_lines with line_no, begin and newline over the archive's contents, for read_lines and read_line_bytes (file: the archive)."""
    lines = tar_lines(spark, paths)
    size = F.octet_length("value") + F.col("newline").cast("long")
    per = lines.groupBy("archive", "uncompressed_offset").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"))
    order = Window.partitionBy("archive").orderBy("uncompressed_offset").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("archive", "uncompressed_offset", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n0"), F.coalesce(F.sum("size").over(order), F.lit(0)).alias("b0"))
    out = lines.join(before, ["archive", "uncompressed_offset"])
    begin = F.col("member_begin") + F.col("b0")
    return out.select(F.col("archive").alias("file"), "file_name", (F.col("member_line") + F.col("n0")).alias("line_no"), begin.alias("begin"), (begin + F.octet_length("value")).alias("newline"), "value")


def find_members(members: DataFrame, name: str | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """Members by exact name, or by their header's offset in [begin, end)."""
    out = members
    if name is not None:
        out = out.filter(F.col("file_name") == name)
    if begin is not None:
        out = out.filter(F.col("uncompressed_offset") >= begin)
    return out if end is None else out.filter(F.col("uncompressed_offset") < end)


def read_bytes(path: str, begin: int, end: int, name: str | None = None, block: int = 1 << 20) -> bytes:
    """Bytes [begin, end) of an archive's regular members laid end to end, or of the first one called `name`; streamed on the driver.

    Raises ValueError for a range that can't be or goes beyond the end, and for a member that isn't there.
    """
    if begin < 0 or end <= begin:
        raise ValueError(f"no such byte range: {begin}..{end}")
    out, at = bytearray(), 0
    for tar, m in _members(path):
        if not m.isreg() or (name is not None and m.name != name):
            continue
        if at + m.size > begin and at < end:
            f = tar.extractfile(m)
            left = max(0, begin - at)
            while left:
                left -= len(f.read(min(block, left)))
            out += f.read(min(end, at + m.size) - max(begin, at))
        at += m.size
        if at >= end or name is not None:
            break
    if at < end:
        raise ValueError(f"{path} ends before byte {end}" if name is None or at else f"{path} has no member {name}")
    return bytes(out)


def member_lines(spark: SparkSession, paths: Sequence[str], name: str) -> DataFrame:
    """tar_lines of the members called `name`."""
    return tar_lines(spark, paths).filter(F.col("file_name") == name)


_GZIP = "path string, compressed long, trailer long, members long"


def gzip_sizes(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """path, compressed (bytes), trailer (the size the file's last four bytes say, of the last member, modulo 4 GB; NULL of files too short) and
    members (places where a member's header stands and its data inflates) of gzip files (`path`).

    Nothing is inflated but the beginning of what looks like a member, so this costs a read of the compressed bytes.
    """
    ship(files.sparkSession)

    def starts(path: str) -> int:
        n, tail = 0, b""
        with open_file(path) as f:
            while data := f.read(block):
                text = tail + data
                i = text.find(_MEMBER)
                while i >= 0:
                    if i + 64 <= len(text) or len(data) < block:
                        n += _inflates(text[i : i + 4096])
                        i = text.find(_MEMBER, i + 1)
                    else:
                        break
                tail = text[i:] if i >= 0 else text[-3:]
        return n + (len(tail) >= 10 and tail.startswith(_MEMBER) and _inflates(tail))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                with open_file(p) as f:
                    size = f.size()
                    f.seek(max(0, size - 4))
                    last = f.read(4)
                rows.append((p, size, int.from_bytes(last, "little") if size >= 18 else None, starts(p)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _GZIP.split(", ")])

    return files.select("path").mapInPandas(run, _GZIP)


# Fixed value: magic and method of a gzip member.
_MEMBER = b"\x1f\x8b\x08"


def _inflates(data: bytes) -> bool:
    """Whether a gzip member begins here: no reserved flag is set, and what follows the header can be inflated."""
    if len(data) < 10 or data[3] & 0xE0:
        return False
    try:
        zlib.decompressobj(31).decompress(data, 4096)
    except zlib.error:
        return False
    return True
