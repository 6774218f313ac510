"""Scalar rules of trace analytics, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions import vocab as V


def time_range(t: Column, granularity: float) -> Column:
    """Time bucket: t div granularity, 0 for a granularity of 0 or less."""
    g = int(granularity)
    return F.lit(0).cast("long") if g <= 0 else F.call_function("div", t.cast("long"), F.lit(g).cast("long"))


def io_category_code(func: Column) -> Column:
    """READ 1, WRITE 2, METADATA 3, PCTL 4, IPC 5, OTHER 6, SYNC 7; NULL names are OTHER."""
    c = F.when(func.isin(V.METADATA), V.IO_CODES["METADATA"])
    for k in ("READ", "WRITE", "SYNC", "PCTL", "IPC"):
        c = c.when(func.isin(getattr(V, k)), V.IO_CODES[k])
    return c.otherwise(V.IO_CODES["OTHER"])


def io_category_label(func: Column) -> Column:
    """The record's own label: metadata, read, write, open, stat or other."""
    c = F.when(func.isin(V.METADATA), "metadata")
    for label, names in V.LABELS.items():
        c = c.when(func.isin(names), label)
    return c.otherwise("other")


def size_bins(size: Column) -> dict[str, Column]:
    """The twelve bin columns: 1 in the bin that holds the size, else NULL; all NULL for NULL or negative sizes."""
    out = {}
    for i, name in enumerate(V.BIN_COLUMNS):
        inside = size >= V.BIN_BOUNDS[i]
        if i + 1 < len(V.BIN_BOUNDS):
            inside &= size < V.BIN_BOUNDS[i + 1]
        out[name] = F.when(inside, F.lit(1))
    return out


def size_label(size: Column, labels: Sequence[str] = V.BIN_LABELS) -> Column:
    """The size's bin as a reader's label (V.BIN_LABELS: from and to; V.BIN_NAMES: one bound); NULL without a size."""
    c = F.when(size < 0, F.lit(None).cast("string"))
    for bound, label in zip(V.BIN_BOUNDS[1:], labels):
        c = c.when(size < bound, label)
    return c.when(size.isNotNull(), labels[-1])


def known_size(cat: Column, func: Column, ret: Column) -> Column:
    """A transfer's size: what a posix or stdio read or write returned, if above 0."""
    return F.when(cat.isin("posix", "stdio") & io_category_label(func).isin("read", "write") & (ret > 0), ret)


def ignored_function(func: Column) -> Column:
    hit = func.isin(V.IGNORED_FUNCTIONS)
    for part in V.IGNORED_PARTS:
        hit |= func.contains(part)
    return F.coalesce(hit, F.lit(False))


def ignored_path(file_name: Column) -> Column:
    """Whether a file isn't analysed; unknown and empty names are."""
    return F.coalesce(file_name.rlike("|".join(re.escape(p) for p in V.IGNORED_PATHS)), F.lit(False))


def enriched_category(cat: Column, file_name: Column) -> Column:
    """posix and stdio get a suffix by the first part that the file's name contains."""
    suffix = F.lit(None).cast("string")
    for part, add in reversed(V.PATH_SUFFIXES):
        suffix = F.when(file_name.contains(part), add).otherwise(suffix)
    return F.when(cat.isin("posix", "stdio") & suffix.isNotNull(), F.concat(cat, suffix)).otherwise(cat)


def process_name(host: Column, pid: Column, tid: Column) -> Column:
    """app#host#pid#tid, `unknown` for a host that is NULL or empty."""
    known = F.coalesce(F.nullif(host, F.lit("")), F.lit("unknown"))
    return F.concat_ws("#", F.lit("app"), known, pid.cast("string"), tid.cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 for a whole of 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part * F.lit(100.0) / whole)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def logical_views(file_name: Column, proc_name: Column) -> dict[str, Column]:
    """Views that follow from a file's or a process's name (V.LOGICAL_VIEWS).

    A process's name has four parts: application, host, process and thread. Its node is its host without the domain;
    it holds no rank, which is NULL.
    """
    part = lambda i: F.get(F.split(proc_name, "#"), F.lit(i))
    made = {
        "file_dir": F.when(file_name.contains("/"), F.regexp_replace(file_name, r"/[^/]*$", "")).otherwise(F.lit("")),
        "file_pattern": F.regexp_replace(file_name, "[0-9]+", "[0-9]"),
        "app_name": part(0),
        "host_name": part(1),
        "node_name": F.substring_index(part(1), ".", 1),
        "proc_id": part(2),
        "rank": F.lit(None).cast("string"),
        "thread_id": part(3),
    }
    return {v: made[v] for views in V.LOGICAL_VIEWS.values() for v in views}


def _looked_up(value: Column, labels: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for pair in labels.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def metric_label(name: Column) -> Column:
    """A metric's name for readers; others stay."""
    return _looked_up(name, V.METRIC_LABELS)


def view_label(name: Column) -> Column:
    """A view's name for readers; others stay."""
    return _looked_up(name, V.VIEW_LABELS)


def io_type(func: Column) -> Column:
    """read, write or metadata; NULL for other functions."""
    code = io_category_code(func)
    c = F.lit(None).cast("string")
    for t in V.IO_TYPES:
        c = F.when(code == V.IO_CODES[t.upper()], t).otherwise(c)
    return c


def compact_io_type(kind: Column) -> Column:
    """The letter of an `io_type`."""
    c = F.lit(None).cast("string")
    for t, letter in zip(V.IO_TYPES, V.COMPACT_IO_TYPES):
        c = F.when(kind == t, letter).otherwise(c)
    return c


def metadata_operation(func: Column) -> Column:
    """What a metadata function does: the first of close, open, seek and stat that its name contains; else NULL."""
    c = F.lit(None).cast("string")
    for x in reversed(V.DERIVED_METADATA_OPERATIONS):
        c = F.when(func.contains(x), x).otherwise(c)
    return F.when(func.isin(V.METADATA), c)


def is_epoch_event(cat: Column, func: Column) -> Column:
    return (cat == V.EPOCH_CATEGORY) & func.isin(V.EPOCH_NAMES)


def estimated_lines(span: Column, total_lines: Column, total_bytes: Column) -> Column:
    """Lines a byte range is likely to hold: a tenth above the average, 0 without bytes."""
    return F.when(total_bytes > 0, F.floor(span * (total_lines / total_bytes) * F.lit(1.1))).otherwise(F.lit(0)).cast("long")
