"""Comparing a query's rows with SQL run by DuckDB on the same tables (a development and test helper)."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings trace file_hashes host_hashes raw_lines files tar_archives tar_files source_targets pack_capacities".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            src = path if os.path.isfile(path) else f"{path}/*.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(src)!r})")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return x


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> tuple[list[str], list[str], Counter, Counter]:
    """Columns of both sides, rows only Spark has, rows only SQL has."""
    con = connect(sf_dir)
    rel = con.sql(sql)
    a, b = bag(df.columns, [tuple(r) for r in df.collect()]), bag(rel.columns, rel.fetchall())
    return sorted(df.columns), sorted(rel.columns), a - b, b - a
