"""Parquet files as sequences of encoded blocks: reading footers, copying row groups, writing footers.

A footer is a Thrift compact structure. It is read into a plain tree and written back from it, so fields
this module doesn't know survive. Only file offsets change; page and bloom indexes, which lie outside of
the row groups, are dropped.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd

from tracelake.sources import fs

MAGIC = b"PAR1"
# Thrift compact types, and the field ids of the Parquet footer that are used here.
BOOL_TRUE, BOOL_FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)
FILE_SCHEMA, FILE_ROWS, FILE_GROUPS = 2, 3, 4
GROUP_COLUMNS, GROUP_BYTES, GROUP_ROWS, GROUP_OFFSET, GROUP_ORDINAL = 1, 2, 3, 5, 7
CHUNK_OFFSET, CHUNK_META, CHUNK_INDEXES = 2, 3, (4, 5, 6, 7)
META_SIZE, META_DATA, META_INDEX, META_DICT, META_BLOOM = 7, 9, 10, 11, (14, 15)


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def varint(self) -> int:
        value = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    def number(self) -> int:
        z = self.varint()
        return (z >> 1) ^ -(z & 1)

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int):
        if kind in (BOOL_TRUE, BOOL_FALSE):
            return self.raw(1)[0] == BOOL_TRUE
        if kind == BYTE:
            return self.raw(1)
        if kind in (I16, I32, I64):
            return self.number()
        if kind == DOUBLE:
            return self.raw(8)
        if kind == BINARY:
            return self.raw(self.varint())
        if kind in (LIST, SET):
            head = self.raw(1)[0]
            n = self.varint() if head >> 4 == 15 else head >> 4
            return head & 15, [self.value(head & 15) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.raw(1)[0] if n else 0
            return kinds, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)]
        if kind == STRUCT:
            fields, field = {}, 0
            while head := self.raw(1)[0]:
                field = field + (head >> 4) if head >> 4 else self.number()
                kind = head & 15
                fields[field] = (kind, kind == BOOL_TRUE if kind in (BOOL_TRUE, BOOL_FALSE) else self.value(kind))
            return fields
        raise ValueError(f"not a footer: type {kind}")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(n: int) -> bytes:
    return _varint((n << 1) ^ (n >> 63))


def _write(kind: int, v) -> bytes:
    if kind in (BOOL_TRUE, BOOL_FALSE):
        return bytes([BOOL_TRUE if v else BOOL_FALSE])
    if kind in (BYTE, DOUBLE):
        return v
    if kind in (I16, I32, I64):
        return _number(v)
    if kind == BINARY:
        return _varint(len(v)) + v
    if kind in (LIST, SET):
        of, items = v
        head = bytes([len(items) << 4 | of]) if len(items) < 15 else bytes([0xF0 | of]) + _varint(len(items))
        return head + b"".join(_write(of, x) for x in items)
    if kind == MAP:
        kinds, items = v
        return _varint(len(items)) + (bytes([kinds]) if items else b"") + b"".join(_write(kinds >> 4, a) + _write(kinds & 15, b) for a, b in items)
    out, last = bytearray(), 0
    for field in sorted(v):
        k, x = v[field]
        if k in (BOOL_TRUE, BOOL_FALSE):
            k = BOOL_TRUE if x else BOOL_FALSE
        step = field - last
        out += bytes([step << 4 | k]) if 0 < step < 16 else bytes([k]) + _number(field)
        if k not in (BOOL_TRUE, BOOL_FALSE):
            out += _write(k, x)
        last = field
    return bytes(out) + b"\0"


def read_footer(path: str) -> dict:
    """The footer's tree. Raises ValueError where the file isn't plain Parquet."""
    with fs.open_file(path) as f:
        size = f.size()
        if size < 12:
            raise ValueError(f"{path}: too short")
        f.seek(size - 8)
        n, magic = struct.unpack("<I4s", f.read(8))
        if magic != MAGIC or n > size - 12:
            raise ValueError(f"{path}: no footer")
        f.seek(size - 8 - n)
        return _Reader(f.read(n)).value(STRUCT)


def groups(footer: dict) -> list[dict]:
    return footer[FILE_GROUPS][1][1] if FILE_GROUPS in footer else []


def schema_id(footer: dict) -> str:
    return hashlib.sha256(_write(*footer[FILE_SCHEMA])).hexdigest()[:16]


def extent(group: dict) -> tuple[int, int]:
    """First byte of a row group and the byte after its last."""
    first, last = [], []
    for c in group[GROUP_COLUMNS][1][1]:
        if CHUNK_META not in c:
            raise ValueError("column data in another file")
        meta = c[CHUNK_META][1]
        at = min(meta[k][1] for k in (META_DATA, META_INDEX, META_DICT) if k in meta and meta[k][1] > 0)
        first.append(at)
        last.append(at + meta[META_SIZE][1])
    return min(first), max(last)


def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for p in b["path"]:
            f = read_footer(p)
            g = groups(f)
            rows.append((p, schema_id(f), len(g), f[FILE_ROWS][1], sum(z - a for a, z in map(extent, g))))
        yield pd.DataFrame(rows, columns=["path", "schema_id", "n_blocks", "n_rows", "n_bytes"])


def _moved(group: dict, by: int, ordinal: int) -> dict:
    """A row group's entry after its bytes moved `by`."""
    chunks = []
    for c in group[GROUP_COLUMNS][1][1]:
        c = {k: v for k, v in c.items() if k not in CHUNK_INDEXES}
        meta = {k: (t, v + by if k in (META_DATA, META_INDEX, META_DICT) and v > 0 else v) for k, (t, v) in c[CHUNK_META][1].items() if k not in META_BLOOM}
        c[CHUNK_META] = (STRUCT, meta)
        if CHUNK_OFFSET in c and c[CHUNK_OFFSET][1] > 0:
            c[CHUNK_OFFSET] = (I64, c[CHUNK_OFFSET][1] + by)
        chunks.append(c)
    out = {k: v for k, v in group.items()} | {GROUP_COLUMNS: (LIST, (STRUCT, chunks))}
    if GROUP_OFFSET in out:
        out[GROUP_OFFSET] = (I64, out[GROUP_OFFSET][1] + by)
    if GROUP_ORDINAL in out:
        if ordinal < 2**15:
            out[GROUP_ORDINAL] = (I16, ordinal)
        else:
            del out[GROUP_ORDINAL]
    return out


def concatenate(paths: list[str], target: str) -> tuple[int, int, int]:
    """Write `target` from the row groups of `paths` (one schema). Returns blocks, rows and bytes copied.

    It is written under another name, read again and renamed, so a reader never sees half of it.
    """
    part = f"{target}.{uuid.uuid4().hex}.part"
    moved: list[dict] = []
    rows = copied = 0
    base: dict | None = None
    with fs.finished(target, part) as out:
        out.write(MAGIC)
        for p in paths:
            footer = read_footer(p)
            if base is None:
                base = footer
            elif schema_id(footer) != schema_id(base):
                raise ValueError(f"{p}: another schema than {paths[0]}")
            rows += footer[FILE_ROWS][1]
            with fs.open_file(p) as src:
                for g in groups(footer):
                    a, z = extent(g)
                    moved.append(_moved(g, out.tell() - a, len(moved)))
                    src.seek(a)
                    left = z - a
                    while left:
                        block = src.read(min(left, 1 << 20))
                        if not block:
                            raise ValueError(f"{p}: shorter than its footer says")
                        out.write(block)
                        left -= len(block)
                    copied += z - a
        if base is None:
            raise ValueError("no files to join")
        tail = _write(STRUCT, base | {FILE_ROWS: (I64, rows), FILE_GROUPS: (LIST, (STRUCT, moved))})
        out.write(tail + struct.pack("<I", len(tail)) + MAGIC)
        out.close()
        again = read_footer(part)
        found = (schema_id(again), len(groups(again)), again[FILE_ROWS][1], sum(g[GROUP_ROWS][1] for g in groups(again)))
        if found != (schema_id(base), len(moved), rows, rows):
            raise ValueError(f"{target}: schema, blocks or rows differ from the sources: {found}")
    return len(moved), rows, copied


def writer(out_dir: str):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        fs.make_folder(out_dir)
        pdf = pdf.sort_values("path")
        sid = pdf["schema_id"].iloc[0]
        target = fs.join(out_dir, f"{sid}-{pdf['lane'].iloc[0]:05d}-{pdf['slot'].iloc[0]:06d}.parquet")
        blocks, rows, size = concatenate(list(pdf["path"]), target)
        if (blocks, rows) != (int(pdf["n_blocks"].sum()), int(pdf["n_rows"].sum())):
            raise ValueError(f"{target}: a source changed while it was copied")
        return pd.DataFrame([(target, sid, len(pdf), blocks, rows, size)], columns=["target", "schema_id", "n_files", "n_blocks", "n_rows", "n_bytes"])

    return write
