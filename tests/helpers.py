"""Small traces for tests."""

from __future__ import annotations

import random

TRACE = "event_id long, func_name string, cat string, pid long, tid long, hhash string, fhash string, time_start long, time_end long, duration double, epoch long, size long, is_valid boolean, ingested_at timestamp"


def trace(spark, rows):
    """rows: dicts; what they leave out is NULL, but for is_valid, which is true."""
    names = [c.split()[0] for c in TRACE.split(", ")]
    return spark.createDataFrame([tuple(({"is_valid": True} | r).get(n) for n in names) for r in rows], TRACE)


def random_trace(r: random.Random, n: int, spread: int = 40_000):
    rows = []
    for i in range(n):
        start = r.choice([None, r.randrange(-spread, spread)]) if r.random() < 0.03 else r.randrange(0, spread)
        length = r.choice([0, 1, 5, 50, 900, 1000, 1001, 20_000, 10**13])
        rows.append(
            {
                "event_id": None if r.random() < 0.02 else i,
                "func_name": r.choice(["read", "READ", " read", "read#3", "read()", "pread", "pread64", "a::b", "a.b", None, "", "​read", "read@@V_2"]),
                "cat": r.choice(["posix", "POSIX ", None, "stdio"]),
                "pid": r.choice([1, 1, 1, 2, None]),
                "tid": r.choice([1, 2, None]),
                "fhash": r.choice([None, "", "00000000000000aa", "0XAA", " 00000000000000AA\t", "bb", "zz", "cc"]),
                "hhash": r.choice([None, "00000000000000dd", "ee"]),
                "time_start": start,
                "time_end": None if start is None or r.random() < 0.1 else start + (length if r.random() < 0.95 else -5),
                "duration": r.choice([None, float("nan"), float("inf"), 1.25, 3.0, 1e15]),
                "epoch": r.choice([1, 1, 2, 0, None]),
                "size": r.choice([None, -1, 0, 4096, 10**12]),
                "is_valid": r.choice([True, True, True, True, False, None]),
            }
        )
    again = [dict(x) for x in r.sample(rows, n // 10) if x["event_id"] is not None]
    return rows + again
