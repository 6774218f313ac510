"""Operators of the core against brute force: nulls, ties, repeated rows, hot keys, empty tables, clashing names."""

import random
from collections import Counter, defaultdict

from helpers import TRACE, random_trace, trace
from pyspark.sql import functions as F

from tracelake.operators import hotkeys, intervals, orphans, smallfiles
from tracelake.operators.events import day_of, function_key, plain_spellings


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def periods(rows, pause):
    groups = defaultdict(list)
    for r in rows:
        if r["time_start"] is not None and r["time_end"] is not None and r["time_end"] >= r["time_start"]:
            groups[r["pid"], r["epoch"]].append((r["time_start"], r["time_end"]))
    out = Counter()
    for k, spans in groups.items():
        spans.sort()
        a, z = spans[0]
        for s, e in spans[1:]:
            if s > z + pause:
                out[(*k, "period", a, z)] += 1
                out[(*k, "gap", z, s)] += 1
                a, z = s, e
            else:
                z = max(z, e)
        out[(*k, "period", a, z)] += 1
    return out


def test_periods_and_gaps(spark):
    r = random.Random(3)
    for shard in (7, 1500, 10**7):
        rows = random_trace(r, 400, 2_000_000 if shard > 7 else 40_000)
        df = trace(spark, rows).withColumn("kind", F.lit("clash")).withColumn("from_time", F.lit(1))
        got = bag(intervals.periods_and_gaps(df, ["pid", "epoch"], shard_us=shard))
        assert got == periods(rows, 1000)


def test_periods_of_nothing_and_extremes(spark):
    assert intervals.periods_and_gaps(trace(spark, []), ["pid"]).count() == 0
    big = 2**63 - 1
    rows = [{"pid": 1, "time_start": 0, "time_end": big}, {"pid": 1, "time_start": big, "time_end": big}]
    assert bag(intervals.periods_and_gaps(trace(spark, rows), ["pid"])) == {(1, "period", 0, big): 1}


def test_key_totals_and_heavy_keys(spark):
    rows = random_trace(random.Random(4), 600)
    df = trace(spark, rows).withColumn("field", F.lit(0)).withColumn("n_events", F.lit(0))
    events, seen = [], set()
    for x in rows:
        if x["is_valid"] is not False and (x["event_id"] is None or x["event_id"] not in seen):
            seen.add(x["event_id"])
            events.append(x)
    want = Counter()
    for x in events:
        want["fhash", x["fhash"]] += 1
        want["func_name", x["func_name"]] += 1
    totals = hotkeys.key_totals(df)
    assert {(r.field, r.hot_key): r.n_events for r in totals.collect()} == want
    sizes = {r.hot_key: r.total_size for r in totals.filter("field = 'func_name'").collect()}
    assert sizes["READ"] == (sum(x["size"] for x in events if x["func_name"] == "READ" and (x["size"] or -1) >= 0))
    heavy = {(r.field, r.hot_key) for r in hotkeys.heavy_keys(totals, (1, 8)).collect()}
    assert heavy == {k for k, n in want.items() if k[1] and n * 8 >= len(events)}
    assert hotkeys.heavy_keys(hotkeys.key_totals(trace(spark, []))).count() == 0


def number(h):
    t = (h or "").strip("\t \n​").lower().removeprefix("0x")
    try:
        return int(t, 16) if t and len(t.lstrip("0")) <= 16 else None
    except ValueError:
        return None


def test_key_totals_of_huge_durations(spark):
    rows = [{"event_id": i, "fhash": k, "func_name": "read", "duration": d} for i, (k, d) in enumerate([("a", 2e16), ("a", 1.25), ("b", 3e30), ("b", 1e30), ("c", 1e27), ("c", 5.0), ("d", float("inf")), ("d", None), ("e", 4.5)])]
    got = {x.hot_key: x.total_duration for x in hotkeys.key_totals(trace(spark, rows), fields=("fhash",)).collect()}
    assert got == {"a": 2e16 + 1.25, "b": 4e30, "c": 1e27 + 5.0, "d": None, "e": 4.5}


def test_orphans_against_all_pairs(spark):
    r = random.Random(5)
    files = [("aa", 100, 20_000), ("0xAA", 30_000, None), ("BB", 39_000, None), ("bb", None, None), ("00aa", 10, 10), ("AA", 50, 5), ("cc", None, 3)]
    hosts = [("dd", 0, None), ("DD", 0, None)]
    rows = random_trace(r, 800)
    for _ in range(1500):  # one hash holds most rows and spans the chunks
        rows.append({"event_id": 10_000 + _, "fhash": "AA", "time_start": r.randrange(0, 40_000)})
    schema = "h string, registered_at long, deleted_at long"
    parents = {"file_hashes": (spark.createDataFrame(files, schema), "h"), "host_hashes": (spark.createDataFrame(hosts, schema), "h")}
    df = trace(spark, rows).withColumn("tab", F.lit("clash")).withColumn("h", F.lit("clash"))
    want = Counter()
    seen = set()
    for x in rows:
        if x.get("is_valid") is False:
            continue
        for name, col, recs in (("file_hashes", "fhash", files), ("host_hashes", "hhash", hosts)):
            h, t = x.get(col), x.get("time_start")
            if not (h or "").strip():
                continue
            own = [(a, z) for k, a, z in recs if number(h) is not None and number(k) == number(h)]
            alive = any(a is not None and t is not None and a <= t and (z is None or z > t) for a, z in own)
            if alive or (x["event_id"] is not None and (name, x["event_id"]) in seen):
                continue
            seen.add((name, x["event_id"]))
            started = any(a is not None and t is not None and a <= t for a, _ in own)
            want[name, x["event_id"], t, "missing" if not own else "deleted" if started else "late"] += 1
    found = orphans.orphan_references(df, parents, {"file_hashes": "fhash", "host_hashes": "hhash"})
    assert bag(found) == want
    report = orphans.orphan_report(found)
    assert sum(x.n_orphans for x in report.collect()) == sum(want.values())
    empty = {k: (v[0].limit(0), "h") for k, v in parents.items()}
    all_missing = orphans.orphan_references(df, empty, {"file_hashes": "fhash"})
    assert {x.reason for x in all_missing.collect()} == {"missing"}
    assert orphans.orphan_references(trace(spark, []), parents, {"file_hashes": "fhash"}).count() == 0


def test_small_contents_and_plan(spark):
    f = [(1, "a.pfw", 10, 5), (2, "b.pfw", 10, 5), (3, "c.pfw", 10, 0), (4, "d.pfw", 10, 0), (5, "e.pfw", 10, None), (6, "f", 11, 5), (7, None, 0, 5), (8, "g", 65_536, 5), (9, "h", None, 5), (None, "x", 3, 3)]
    t = [(1, 1, "a.gz", 5, "0", 512), (2, 1, "b.gz", 5, "", 512), (3, 2, "c.gz", 5, "0", 512), (4, 1, "d", 5, "5", 512), (5, 1, "e", None, "0", 9), (6, None, "f", 5, "0", 512), (7, None, "f", 5, None, 512), (8, 1, "z", 65_535, "0", None)]
    files = spark.createDataFrame(f, "id long, logical_name string, byte_size long, hash long").withColumn("k1", F.lit(1)).withColumn("name", F.lit(2))
    tars = spark.createDataFrame(t, "id long, archive_id long, file_name string, file_size long, typeflag string, data_offset long").withColumn("src_table", F.lit(1))
    contents = smallfiles.small_contents(files, tars)
    got = {(r.src_table, r.id): r.n_rows for r in contents.collect()}
    assert got == {("files", 1): 2, ("files", 3): 1, ("files", 4): 1, ("files", 5): 1, ("files", 6): 1, ("tar_files", 1): 2, ("tar_files", 3): 1, ("tar_files", 6): 1, ("tar_files", 7): 1, ("tar_files", 8): 1}
    for lane in (2, 1000):
        plan = smallfiles.consolidation_plan(contents, target_bytes=15, rows_per_lane=lane)
        assert {(r.src_table, r.id) for r in plan.collect()} == set(got) and plan.count() == len(got)
        totals = smallfiles.plan_totals(plan).collect()
        assert all(x.holes == 0 for x in totals) and sum(x.n_records for x in totals) == sum(got.values())
    assert smallfiles.consolidation_plan(smallfiles.small_contents(files.limit(0), tars.limit(0))).count() == 0


def test_hot_archive_is_spread(spark):
    tars = spark.range(20_000).select(F.col("id"), F.lit(1).cast("long").alias("archive_id"), F.format_string("m%d.pfw", "id").alias("file_name"), (F.col("id") % 900 + 1).alias("file_size"), F.lit("0").alias("typeflag"), (F.col("id") * 1024).alias("data_offset"))
    files = spark.createDataFrame([], "id long, logical_name string, byte_size long, hash long")
    plan = smallfiles.consolidation_plan(smallfiles.small_contents(files, tars), target_bytes=100_000, rows_per_lane=1000)
    totals = smallfiles.plan_totals(plan).collect()
    assert sum(x.n_contents for x in totals) == 20_000 and all(x.holes == 0 for x in totals)
    assert max(x.n_bytes for x in totals) <= 101_000
    assert sum(x.n_bytes < 99_000 for x in totals) <= 20  # one per lane


def test_compact_parquet_copies_blocks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = []
    paths = []
    for i in range(23):
        n = 0 if i == 5 else 50 + i
        t = pa.table({"a": pa.array(range(i * 100, i * 100 + n), pa.int64()), "s": pa.array([f"v{j % 3}" if j % 4 else None for j in range(n)], pa.string()), "l": pa.array([[j, j + 1] for j in range(n)], pa.list_(pa.int32()))})
        p = str(tmp_path / f"in-{i:02d}.parquet")
        pq.write_table(t, p, row_group_size=20, compression="zstd" if i % 2 else "snappy", use_dictionary=i % 3 != 0)
        rows += [str(r) for r in t.to_pylist()]
        paths.append(p)
    other = str(tmp_path / "other.parquet")
    pq.write_table(pa.table({"b": [True, False]}), other)
    out = smallfiles.compact_parquet(spark, [*paths, other], str(tmp_path / "out"), target_bytes=6_000).collect()
    assert sum(r.n_rows for r in out) == len(rows) + 2 and sum(r.n_files for r in out) == 24 and 2 < len(out) < 12
    same = [r.target for r in out if pq.read_schema(r.target).names == ["a", "s", "l"]]
    got = [str(x) for p in same for x in pq.read_table(p).to_pylist()]
    assert sorted(got) == sorted(rows)
    assert spark.read.parquet(*same).count() == len(rows)
    assert spark.read.parquet(*same).filter("s = 'v1' and a > 2150").count() == sum("'v1'" in r and int(r.split("'a': ")[1].split(",")[0]) > 2150 for r in rows)
    assert smallfiles.compact_parquet(spark, [], str(tmp_path / "none")).count() == 0


def test_function_key_and_spellings(spark):
    names = ["read", "READ", " read\t", "​read", "read()", "read#3051", "read@@LIB_2.4", "pread64", "a::b", "A.b", "", None, "  ", "x@", "#1"]
    df = spark.createDataFrame([(n,) for n in names], "func_name string")
    got = [r[0] for r in df.select(function_key(F.col("func_name"))).collect()]
    assert got == ["read"] * 7 + ["pread64", "a.b", "a.b", None, None, None, "x", None]
    assert {r.function_key: r.plain_name for r in plain_spellings(df.unionAll(df.limit(1))).collect()}["read"] == "read"


def test_day_of(spark):
    df = spark.createDataFrame([(0,), (-1,), (1738372064984989,), (None,)], "t long")
    assert [r[0] for r in df.select(day_of(F.col("t"))).collect()] == ["1970-01-01", "1969-12-31", "2025-02-01", None]


def test_schema_string_is_whole():
    assert "ingested_at" in TRACE


def test_many_intervals_of_one_start(spark):
    rows = [{"pid": 1, "epoch": 1, "time_start": 5, "time_end": 5 + i % 7} for i in range(30_000)] + [{"pid": None, "epoch": 1, "time_start": 5, "time_end": 9}] * 3
    df = trace(spark, rows).repartition(4)
    assert bag(intervals.periods_and_gaps(df, ["pid", "epoch"])) == {(1, 1, "period", 5, 11): 1, (None, 1, "period", 5, 9): 1}


def test_copies_prove_themselves(spark, tmp_path):
    df = spark.range(5000).select("id", F.col("id").cast("string").alias("s"), F.array("id").alias("a"))
    for d, name in ((df, "whole"), (df.limit(0), "empty"), (df.union(df), "twice")):
        r = smallfiles.copy_totals(d, str(tmp_path / name), records_per_file=400).first()
        assert (r.n_rows, r.n_copied, r.same, r.fewer) == (d.count(), d.count(), True, True)
    few = len(list((tmp_path / "whole" / "large").iterdir()))
    assert few < len(list((tmp_path / "whole" / "small").glob("*.parquet")))
