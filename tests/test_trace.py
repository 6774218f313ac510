"""Parsing, metrics and epochs on a trace small enough to check by hand."""

from pyspark.sql import functions as F

from tracelake.functions import scalar as S
from tracelake.functions import vocab as V
from tracelake.operators import replay
from tracelake.operators import trace as T
from tracelake.plans.viewcache import cached_view, view_name

LINES = [
    "[", "]", "][", "", "  ", "{", '{"a":1}', "not json at all",
    '{"name":"FH","ph":"M","cat":"meta","pid":1,"tid":1,"args":{"name":"/data/x1.npz","value":"f1"}},',
    '{"name":"FH","ph":"M","cat":"meta","pid":1,"tid":1,"args":{"name":"/usr/lib/y.so","value":"f2"}}',
    '{"name":"HH","ph":"M","cat":"meta","pid":1,"tid":1,"args":{"name":"node1","value":"h1"}}',
    '{"name":"SH","ph":"M","cat":"meta","pid":1,"tid":1,"args":{"name":"s","value":"s1"}}',
    '{"name":"PR","ph":"M","cat":"meta","pid":1,"tid":1,"args":{"name":"p","value":"p1"}}',
    '{"name":"zz","ph":"M","cat":"meta","pid":1,"tid":1,"args":{"name":"o","value":"o1"}}',
    '{"name":"read","ph":"X","cat":"POSIX","pid":1,"tid":2,"ts":1000000,"dur":10.9,"args":{"fhash":"f1","hhash":"h1","ret":5000,"offset":"7","epoch":"1"}}',
    '{"name":"read","ph":"X","cat":"POSIX","pid":1,"tid":2,"ts":2500000,"dur":10,"args":{"fhash":"f2","hhash":"h1","ret":5000}}',
    '{"name":"write","ph":"X","cat":"posix","pid":1,"tid":2,"ts":3000000,"dur":5,"args":{"fhash":"nope","hhash":"","ret":"0","offset":9,"epoch":"bad"}}',
    '{"name":"fread","ph":"X","cat":"STDIO","pid":1,"tid":2,"ts":3000000,"dur":5,"args":{"fhash":"f1","ret":-1}}',
    '{"name":"TFReader.next","ph":"X","cat":"reader","pid":1,"tid":2,"ts":1,"dur":5}',
    '{"name":"a.save_state","ph":"X","cat":"app","pid":1,"tid":2,"ts":1,"dur":5}',
    '{"name":"step","ph":"X","cat":"","pid":1,"tid":2,"ts":1,"dur":5}',
    '{"name":"step","ph":"X","cat":"App","pid":1,"tid":2,"ts":9000000,"dur":5,"args":{"image_idx":"4"}}',
]


def lines(spark):
    return spark.createDataFrame([(x, i) for i, x in enumerate(LINES)], "value string, n int")


def test_parse(spark):
    e = {r.n: r for r in T.parse_trace(lines(spark)).collect()}
    assert set(e) == {*range(8, len(LINES))} and all(x not in e for x in range(8))
    assert [e[i].type for i in range(8, 15)] == [1, 1, 2, 3, 4, 5, 0]
    assert e[8].func_name == "/data/x1.npz" and e[8].fhash == "f1" and e[10].hhash == "h1"
    r = e[14]
    assert (r.cat, r.io_cat, r.size, r.offset, r.epoch, r.time_end, r.acc_pat) == ("posix", "read", 5000, 7, 1, 1000010, "0")
    assert r.size_bin_4kib_16kib == 1 and r.size_bin_0_4kib is None
    assert (e[16].size, e[16].offset, e[16].epoch, e[16].io_cat) == (None, 9, 0, "write")
    assert (e[17].size, e[17].io_cat) == (None, "other")
    assert (e[21].image_id, e[21].io_cat, e[21].cat) == (4, "other", "app")
    p = {r.n: r for r in T.parse_trace(lines(spark), mode="replay").collect()}
    assert p[14].cat == "POSIX" and p[11].type == 5 and p[14].size is None


def test_analyze(spark):
    m = T.analyze(T.parse_trace(lines(spark)), "file_name")
    rows = {(r.func_name, r.cat): r for r in m.collect()}
    assert set(rows) == {("read", "posix_reader"), ("write", "posix"), ("fread", "stdio_reader"), ("step", "app")}
    r = rows["read", "posix_reader"]
    assert (r.proc_name, r.file_name, r.io_cat, r["count"], r["size"], round(r.time, 9)) == ("app#node1#1#2", "/data/x1.npz", "1", 1, 5000, 0.0000109)
    assert rows["fread", "stdio_reader"].io_cat == "1" and rows["fread", "stdio_reader"]["size"] is None
    assert rows["write", "posix"].proc_name == "app#unknown#1#2"
    assert T.metric_totals(m).first().total_count == 4
    by_time = {r.time_range for r in T.analyze(T.parse_trace(lines(spark)), "time_range").collect()}
    assert by_time == {0, 2, 8}


def test_bins_and_categories(spark):
    sizes = [0, 4095, 4096, 16383, 16384, *[b - 1 for b in V.BIN_BOUNDS[3:]], *V.BIN_BOUNDS[3:], 4 << 30, None, -1]
    df = spark.createDataFrame([(s,) for s in sizes], "s long").select("s", *[c.alias(k) for k, c in S.size_bins(F.col("s")).items()])
    for r in df.collect():
        hits = [i for i, c in enumerate(V.BIN_COLUMNS) if r[c] == 1]
        assert hits == ([] if r.s is None or r.s < 0 else [max(i for i, b in enumerate(V.BIN_BOUNDS) if r.s >= b)])
    assert V.BIN_BOUNDS[-1] == 4 << 30 and len(V.BIN_BOUNDS) == 12
    names = ["fread", "fwrite", "pread64", "pwrite64", "openat", "lstat", "fsync", "open", "semop", "fork", "x", None]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(S.io_category_code(F.col("n")).alias("c"), S.io_category_label(F.col("n")).alias("l"))
    assert [tuple(r) for r in df.collect()] == [(1, "other"), (2, "other"), (6, "read"), (6, "write"), (6, "open"), (6, "stat"), (7, "other"), (3, "metadata"), (5, "other"), (4, "other"), (6, "other"), (6, "other")]


def test_epochs(spark):
    marks = [(1, "pipeline", "epoch", 10, 10_000_000, 30_000_000), (1, "pipeline", "epoch", 0, 0, 5_000_000), (2, "pipeline", "epoch.block", 25, 25_000_000, 40_000_000), (2, "pipeline", "epoch", 26, 26_000_000, 41_000_000), (0, "pipeline", "epoch", 0, 0, 90_000_000)]
    events = [(0, "posix", "read", t, t * 1_000_000, t * 1_000_000) for t in (3, 9, 10, 27, 30, 31, 40, 41)]
    df = spark.createDataFrame(marks + events, "epoch long, cat string, func_name string, time_range long, time_start long, time_end long")
    spans = T.epoch_spans(df)
    assert {tuple(r) for r in spans.collect()} == {(1, 10, 30, 20), (2, 25, 40, 15)}
    want = [(10, 1), (27, 1), (30, 1), (31, 2), (40, 2)]
    for chain in (500, 0):
        got = T.assign_epochs(df.filter("cat = 'posix'"), spans, chain=chain)
        assert sorted((r.time_range, r.epoch) for r in got.collect()) == want
    assert T.assign_epochs(df, spans.limit(0)).count() == 0 == T.assign_epochs(df, spans.limit(0), chain=-1).count()


def test_resolution_without_broadcast(spark):
    e = spark.createDataFrame([("a", "x"), ("b", None), (None, "y")], "fhash string, hhash string")
    d = T.hash_dictionary(spark.createDataFrame([("a", "1"), ("a", "2"), ("", "3"), (None, "4")], "h string, n string"), "h", "n")
    for most in (10, 0):
        got = T.resolve_hashes(e, d, d, broadcast_rows=most)
        assert sorted(str((r.fhash, r.file_name, r.host_name)) for r in got.collect()) == sorted(map(str, [("a", "2", None), ("b", None, None), (None, None, None)]))


def test_views_and_cache(spark, tmp_path):
    assert T.views_of(" file_name, ,time_range") == ["file_name", "proc_name", "time_range"]
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    name = view_name("hlm", ["a", "b"], 1e6)
    for _ in range(2):
        assert cached_view(spark, str(tmp_path), name, compute).count() == 3
    assert len(calls) == 1 and name == "hlm_a_b_1000000"


def test_replay(spark):
    rows = [("read", "posix", 0, 10, 15), ("mmap", "posix", 0, 20, 9000), ("read", "STDIO", 0, 30, 30), ("x", "posix", 1, 40, 41)]
    df = spark.createDataFrame(rows, "func_name string, cat string, type int, time_start long, time_end long")
    out = lambda **k: [r.outcome for r in replay.replay_plan(df, **k).orderBy("time_start").collect()]
    assert out() == ["executed", "executed", "failed", "filtered"]
    assert out(dry_run=False) == ["executed", "failed", "failed", "filtered"]
    assert out(functions=("read",), categories=("posix",)) == ["executed", "filtered", "filtered", "filtered"]
    assert out(sleep_mode=True, without=("mmap",)) == ["executed", "filtered", "executed", "filtered"]
    assert [r.planned_sleep_us for r in replay.replay_plan(df, sleep_mode=True).orderBy("time_start").collect()] == [5, 1000, 0, 0]
    s = replay.replay_statistics(replay.replay_plan(df))
    assert replay.replay_status(s).first().exit_code == 2
    assert {(r.dimension, r.name): r.total for r in s.collect()} == {("function", "read"): 2, ("function", "mmap"): 1, ("function", "x"): 1, ("category", "posix"): 3, ("category", "STDIO"): 1, ("all", ""): 4}


def test_clashing_and_missing_columns(spark):
    clash = lines(spark).withColumn("cat", F.lit("old")).withColumn("size", F.lit(-7)).withColumn("size_bin_0_4kib", F.lit(1))
    assert [r.cat for r in T.parse_trace(clash).filter("n = 14").collect()] == ["posix"]
    e = T.parse_trace(clash).withColumn("file_name", F.lit("old")).withColumn("host_name", F.lit("old"))
    assert T.analyze(e, "file_name").count() == 4
    nothing = spark.createDataFrame([(None,), ("",)], "value string")
    assert T.parse_trace(nothing).count() == 0 and T.analyze(T.parse_trace(nothing)).count() == 0


def test_odd_numbers(spark):
    text = ['{"name":"a","cat":"c","ts":9223372036854775807,"dur":1e300}', '{"name":"a","cat":"c","ts":"5","dur":"NaN"}', '{"name":"a","cat":"c","ts":-3,"dur":-2.5,"pid":"x"}', '{"name":1,"cat":[1],"ts":{},"dur":null}']
    df = T.parse_trace(spark.createDataFrame([(t,) for t in text], "value string")).collect()
    assert [(r.time_start, r.time_end, r.pid) for r in df] == [(2**63 - 1, None, 0), (5, None, 0), (-3, -5, 0), (0, 0, 0)]


def test_epochs_that_end_before_they_start(spark):
    spans = spark.createDataFrame([(1, 5, 3), (2, 4, 6), (3, 9, 9)], "epoch long, span_start long, span_end long")
    events = spark.createDataFrame([(i,) for i in range(11)], "time_range long").withColumn("epoch", F.lit(0).cast("long"))
    for chain in (500, 0):
        got = {x.time_range: x.epoch for x in T.assign_epochs(events, spans, chain=chain).collect()}
        assert got == {4: 2, 5: 2, 6: 2, 9: 3}, chain


def test_stretches_against_every_bucket(spark):
    import random

    r = random.Random(2)
    rows = [(e, a, a + r.choice([-3, 0, 1, 5, 30])) for e, a in ((r.randint(1, 40), r.randint(-20, 80)) for _ in range(60))]
    rows += [(99, -(10**15), 10**15)]  # one span over everything: no bucket of it is made
    spans = spark.createDataFrame(rows, "epoch long, span_start long, span_end long")
    want = {t: min(e for e, a, z in rows if a <= t <= z) for t in range(-30, 120)}
    got = T.stretches(spans).collect()
    assert {t: [x.epoch for x in got if x.a <= t <= x.z] for t in want} == {t: [e] for t, e in want.items()}
    events = spark.range(-30, 120).select(F.col("id").alias("time_range"), F.lit(0).cast("long").alias("epoch"))
    assert {x.time_range: x.epoch for x in T.assign_epochs(events.unionByName(events), spans, chain=5).collect()} == want
    assert T.stretches(spans.limit(0)).count() == 0


def test_sets_and_members(spark, monkeypatch):
    rows = [("p", "posix", "read", f"f{i % 5}") for i in range(20)] + [("q", "posix", "read", None), ("r", "posix", "read", "only"), (None, "posix", "read", "n")]
    e = spark.createDataFrame(rows, "proc_name string, cat string, func_name string, file_name string").selectExpr("*", "'0' as acc_pat", "1.0D as duration", "1L as count", "cast(null as long) as size")
    sets = lambda: {x.proc_name: x.file_name_set for x in T.high_level_metrics(e, "").collect()}
    assert sets() == {"p": [f"f{i}" for i in range(5)], "q": [], "r": ["only"], None: ["n"]}
    monkeypatch.setattr(T, "MAX_SET", 4)
    assert sets() == {"p": None, "q": [], "r": ["only"], None: ["n"]}
    assert sorted(x.file_name for x in T.unique_members(e, "file_name", "").collect()) == ["f0", "f1", "f2", "f3", "f4", "n", "only"]


def test_labels_and_kinds(spark):
    names = ["read", "pwrite", "open64", "closedir", "__xstat64", "fseek", "rename", "fsync", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    kind = S.io_type(F.col("n"))
    got = [tuple(r) for r in df.select(kind.alias("k"), S.compact_io_type(kind).alias("c"), S.metadata_operation(F.col("n")).alias("o")).collect()]
    m = ("metadata", "M")
    assert got == [("read", "R", None), ("write", "W", None), (*m, "open"), (*m, "close"), (*m, "stat"), (*m, "seek"), (*m, None), (None, None, None), (None, None, None)]
    labels = spark.createDataFrame([("rank",), ("bw",), ("other",), (None,)], "x string").select(S.view_label(F.col("x")), S.metric_label(F.col("x"))).collect()
    assert [tuple(r) for r in labels] == [("Rank", "rank"), ("bw", "I/O Bandwidth"), ("other", "other"), (None, None)]
    v = spark.createDataFrame([("/a/b12.c", "app#host7.site#1#2"), (None, None), ("plain", "app#h")], "f string, p string")
    out = [r.asDict() for r in v.select(*[c.alias(k) for k, c in S.logical_views(F.col("f"), F.col("p")).items()]).collect()]
    assert out[0] == {"file_dir": "/a", "file_pattern": "/a/b[0-9].c", "app_name": "app", "host_name": "host7.site", "node_name": "host7", "proc_id": "1", "rank": None, "thread_id": "2"}
    assert out[2]["thread_id"] is None and out[2]["file_dir"] == "" and set(out[1].values()) <= {None, ""}


def test_configured_replay(spark):
    import pytest

    rows = [("a", "read", "posix", 0, 100, 130), ("a", "close", "posix", 0, 25_000_000, 25_000_010), ("b", "read", "posix", 0, 5, 6), ("b", "mmap", "other", 0, 9, 9)]
    df = spark.createDataFrame(rows, "file string, func_name string, cat string, type int, time_start long, time_end long").withColumn("longest_wait_us", F.lit("clash"))
    waits = lambda **k: sorted((r.file, r.longest_wait_us, r.outcome) for r in replay.configured_plan(df, replay.ReplayConfig(**k)).collect())
    assert waits() == [("a", 0, "executed"), ("a", 10_000_000, "executed"), ("b", 0, "executed"), ("b", 4, "failed")]
    assert waits(timing_scale=0.5, start_time_offset=77)[3] == ("b", 2, "failed") and {w for _, w, _ in waits(maintain_timing=False)} == {0}
    assert [o for _, _, o in waits(sleep_mode=True, functions=("read",))] == ["executed", "filtered", "executed", "filtered"]
    for bad in ({"timing_scale": 0}, {"max_file_size": -1}):
        with pytest.raises(ValueError):
            replay.ReplayConfig(**bad)


def test_lines_of_more_than_one_value(spark):
    from tracelake.sources import text

    whole = '{"name":"read","cat":"posix","ph":"X","pid":1,"tid":1,"ts":5,"dur":1}'
    bad = [whole + t for t in ("}", "]", ";", "]],", whole, "," + whole, " 7", ',"y":2', ", 7]", "],[1")] + [whole[:-1], "[" + whole]
    good = [whole, whole + ",", f" {whole} ,"]
    df = spark.createDataFrame([(x,) for x in bad + good], "value string")
    assert [r.value for r in T.parse_trace(df.withColumn("line", F.col("value"))).withColumnRenamed("line", "value").collect()] == good
    assert text.json_documents(df).count() == len(good)
