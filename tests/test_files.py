"""Real files: numbering, exactly-once ranges, chunks, archives, sinks, indexes, streams."""

import gzip
import io
import json
import os
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from tracelake.operators import chunking, index
from tracelake.sources import archive, sinks, text
from tracelake.streaming import ingest


def make_lines(n, r):
    out = ["["]
    for i in range(n):
        pad = r.choice(["", "ü" * r.randint(0, 40), "x" * r.choice([0, 700, 2000])])
        out.append(json.dumps({"id": i, "name": f"name_{i}", "cat": "POSIX", "ph": "X", "pid": 1, "tid": 1, "ts": i * 1_000_000, "dur": 2, "data": pad}, ensure_ascii=False) + r.choice(["", ","]))
        if r.random() < 0.05:
            out.append(r.choice(["", " ", "{}"]))
    return [*out, "]"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("traces")
    r = random.Random(8)
    texts = {}
    for name, end in (("a.pfw", "\n"), ("b.pfw", ""), ("c.pfw.gz", "\n")):
        t = "\n".join(make_lines(300, r)) + end
        texts[name] = t
        data = t.encode()
        if name.endswith(".gz"):
            half = data.index(b"\n", len(data) // 2) + 1
            data = gzip.compress(data[:half]) + gzip.compress(data[half:])  # two members
        (d / name).write_bytes(data)
    (d / "ignored.txt").write_text("no")
    return d, texts


def expected(t):
    body = t[:-1] if t.endswith("\n") else t
    return body.split("\n")


def test_numbering_and_ranges(spark, folder):
    d, texts = folder
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several splits a file
    try:
        n = text.numbered_lines(spark, str(d)).cache()
        got = {}
        for r in n.collect():
            got.setdefault(os.path.basename(r.file), {})[r.line_no] = r
        for name, t in texts.items():
            lines, at = expected(t), 0
            assert [got[name][i + 1].value for i in range(len(lines))] == lines
            for i, line in enumerate(lines, 1):
                row, size = got[name][i], len(line.encode())
                end = at + size - (1 if i == len(lines) and name == "b.pfw" else 0)
                assert (row.begin, row.newline) == (at, end)
                at += size + 1
        for step in (97, 1000, 8192, 10**6):
            seen = []
            for s in range(0, max(len(t.encode()) for t in texts.values()) + 1, step):
                seen += [(r.file, r.line_no) for r in text.read_line_bytes(n, s, s + step).collect()] if step > 5000 else []
            if step > 5000:
                assert len(seen) == len(set(seen)) == sum(len(expected(t)) for t in texts.values())
        assert sorted({r.line_no for r in text.read_lines(n, 5, 9).collect()}) == [5, 6, 7, 8, 9]
        for bad in ((0, 5), (5, 4)):
            with pytest.raises(ValueError):
                text.read_lines(n, *bad)
        with pytest.raises(ValueError):
            text.read_line_bytes(n, 10, 10)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_raw_bytes(folder):
    d, texts = folder
    for name in texts:
        whole = texts[name].encode()
        assert text.read_bytes(None, str(d / name), 100, 5000) == whole[100:5000]
        with pytest.raises(ValueError):
            text.read_bytes(None, str(d / name), 0, len(whole) + 1)
    with pytest.raises(ValueError):
        text.read_bytes(None, str(d / "a.pfw"), 5, 5)


def test_counts_and_chunks(spark, folder, tmp_path):
    d, _ = folder
    lines = text.scan_lines(spark, str(d))
    assert {os.path.basename(r.file): r.n_events for r in text.count_events(lines).collect()} == {"a.pfw": 300, "b.pfw": 300, "c.pfw.gz": 300}
    meta, numbered = text.file_metadata(lines), text.numbered_lines(spark, str(d))
    for k, target in enumerate((0.0005, 0.01, 0.1, 50)):
        plan = chunking.plan_for(meta, target)
        tagged = chunking.tag_lines(numbered, plan)
        assert tagged.count() == numbered.count() == tagged.select("file", "line_no").distinct().count()
        assert all(r.ok for r in chunking.chunk_results(tagged, plan).collect())
        if 0.001 < target < 1:
            done = sinks.write_chunks(tagged, str(tmp_path / f"out{k}"), "app", compress=target == 0.1).collect()
            assert sum(r.n_events for r in done) == 900
            again = text.scan_lines(spark, str(tmp_path / f"out{k}"))
            assert text.count_events(again).agg(F.sum("n_events")).first()[0] == 900


def test_chunk_planner():
    f = chunking.FileInfo
    assert chunking.plan_chunks([], 4) == [] == chunking.plan_chunks([f("a", 0.0, 5, 0)], 4)
    assert [(p.chunk, p.start_line, p.end_line) for p in chunking.plan_chunks([f("a", 4, 100, 100)], 4)] == [(1, 1, 100)]
    big = chunking.plan_chunks([f("a", 10, 102, 100), f("b", 1, 10, 10)], 4)
    assert [p.chunk for p in big] == [1, 2, 3, 3] and [p for p in big if p.file == "a"][-1].end_line == 102
    huge = chunking.plan_chunks([f("a", 10, 3, 2)], 4)  # no event fits: the rest is taken whole
    assert [(p.start_line, p.end_line) for p in huge] == [(1, 3)]
    with pytest.raises(ValueError):
        chunking.plan_chunks([], 0)


def test_merge_and_write(spark, folder, tmp_path):
    d, _ = folder
    numbered = text.numbered_lines(spark, str(d))
    for strict, compress in ((False, False), (True, False), (True, True)):
        path = str(tmp_path / ("m.pfw.gz" if compress else f"m{strict}.pfw"))
        assert sinks.merge_traces(numbered, path, compress=compress, strict=strict) == 900
        with pytest.raises(FileExistsError):
            sinks.merge_traces(numbered, path, compress=compress)
        t = (gzip.open if compress else open)(path, "rb").read().decode()
        if strict:
            ids = [x["id"] for x in json.loads(t)]
            assert ids == list(range(300)) * 3
        assert sinks.merge_traces(numbered, path, compress=compress, force=True) == 900
    with pytest.raises(ValueError):
        sinks.merge_traces(numbered, str(tmp_path / "x.txt"))
    sinks.write_lines(numbered, str(tmp_path / "lines"), compress=True)
    assert spark.read.text(str(tmp_path / "lines")).count() == 900


def test_metrics_files(spark, tmp_path):
    m = spark.createDataFrame([("p", "c", "f", "3", 1.5, 2, None, ["a", "b"])], "proc_name string, cat string, func_name string, io_cat string, time double, count long, size long, file_name_set array<string>")
    sinks.write_metrics_csv(m, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().file_name_set == "a|b"
    assert sinks.metrics_layout(m).columns[:4] == ["proc_name", "cat", "epoch", "acc_pat"] and len(sinks.metrics_layout(m).columns) == 23


def tar(path, members, fmt):
    with tarfile.open(path, "w:gz", format=fmt) as t:
        for name, data in members:
            i = tarfile.TarInfo(name)
            i.size = len(data)
            t.addfile(i, io.BytesIO(data))
        t.addfile(tarfile.TarInfo("folder")) if False else None
        i = tarfile.TarInfo("folder/")
        i.type = tarfile.DIRTYPE
        t.addfile(i)


def test_archives(spark, tmp_path):
    members = [("main.jsonl", b'{"id":1}\n{"id":2}\n'), ("logs/deep/x.jsonl", "ü\nlast".encode()), ("empty", b""), ("main.jsonl", b"again\n")]
    paths = []
    for k, fmt in enumerate((tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT)):
        paths.append(str(tmp_path / f"t{k}.tar.gz"))
        tar(paths[-1], members, fmt)
        os.link(paths[-1], str(tmp_path / f"noname{k}"))
        assert archive.detect_format(str(tmp_path / f"noname{k}")) == "tar.gz"
    (tmp_path / "g").write_bytes(gzip.compress(b"hello"))
    (tmp_path / "p").write_bytes(b"hello")
    assert [archive.detect_format(str(tmp_path / x)) for x in ("g", "p", "t0.tar.gz")] == ["gzip", "plain", "tar.gz"]
    m = archive.tar_members(spark, paths)
    assert m.count() == 8 and archive.tar_members(spark, paths, regular_only=False).count() == 10
    logical = archive.logical_offsets(m).filter(F.col("archive") == paths[0]).orderBy("uncompressed_offset").collect()
    assert [(r.logical_begin, r.logical_end) for r in logical] == [(0, 18), (18, 25), (25, 25), (25, 31)]
    assert archive.find_members(m, "main.jsonl").count() == 4
    lines = archive.tar_logical_lines(spark, paths[:1])
    got = [(r.line_no, r.begin, r.newline, r.value) for r in lines.orderBy("line_no").collect()]
    assert got == [(1, 0, 8, '{"id":1}'), (2, 9, 17, '{"id":2}'), (3, 18, 20, "ü"), (4, 21, 25, "last"), (5, 25, 30, "again")]
    assert text.read_lines(lines, 2, 3).count() == 2


def test_index(spark, folder):
    d, texts = folder
    n = text.numbered_lines(spark, str(d))
    totals = {os.path.basename(r.file): r for r in index.index_files(n).collect()}
    assert totals["a.pfw"].total_bytes == len(texts["a.pfw"].encode()) and totals["b.pfw"].total_lines == len(expected(texts["b.pfw"]))
    cps = index.index_checkpoints(n, 4096)
    assert cps.agg(F.sum("num_lines")).first()[0] == n.count()
    stored = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 2, 0), ("c", 1, 2, None), ("d", 1, 2, 3)], "file string, mtime long, size long, fingerprint long")
    current = spark.createDataFrame([("a", 1, 2, 3), ("b", 1, 2, 0), ("c", 1, 2, None), ("d", 9, 2, 3), ("e", 1, 1, 1)], stored.schema)
    assert sorted(r.file for r in index.stale_files(stored, current).collect()) == ["b", "c", "d", "e"]
    assert index.upsert(stored, current).count() == 5 and index.without_files(stored, current).count() == 0
    assert (index.index_path("x"), index.index_path("x", True)) == ("x.idx", "x.idx.tar")
    assert index.checkpoint_size(0, 0) == 256 << 10 and index.checkpoint_size(1 << 20, 1 << 30) == 1 << 20 and index.checkpoint_size(1, 1 << 30) == 32 << 10
    c = index.checkpoint_size(0, 100 << 20)
    assert c % (32 << 10) == 0 and c <= 256 << 10
    assert index.uncompressed_estimate(100, 777, False) == 777 and index.uncompressed_estimate(100, 777, True, "a.pfw") == 800 and index.uncompressed_estimate(100, None, False, "a.bin") == 600


def test_synthetic_and_json(spark):
    s = text.synthetic_lines(spark, 20)
    assert s.count() == 22
    docs = text.json_documents(s)
    assert docs.count() == 20 and docs.filter(text.json_has("dur")).count() == 20
    assert docs.select(text.json_get("nope", "long", 7).alias("x")).distinct().collect()[0].x == 7
    assert docs.select(F.sort_array(text.json_keys())).first()[0] == ["cat", "dur", "name"]


def test_stream(spark, folder, tmp_path):
    d, _ = folder
    events = ingest.stream_events(spark, str(d))
    ingest.stage(events, str(tmp_path / "o"), str(tmp_path / "c"), once=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 900
    q = ingest.windowed_metrics(ingest.stream_events(spark, str(d))).writeStream.format("memory").queryName("wm").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(count) from wm").first()[0] == 900


def test_line_processors(spark, folder):
    d, texts = folder
    n = text.numbered_lines(spark, str(d))

    class Stops(text.LineProcessor):
        def begin(self, file):
            super().begin(file)
            self.file, self.seen = os.path.basename(file), 0

        def process(self, line_no, line):
            self.seen += 1
            self.rows.append((self.file, line_no, len(line.encode())))
            return self.seen < 7

    got = text.process_lines(text.read_lines(n, 3, 100), Stops, "file string, line_no long, size int").collect()
    want = [(name, i, len(expected(t)[i - 1].encode())) for name, t in texts.items() for i in range(3, 10)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert text.process_lines(text.read_lines(n, 10**6, 10**6), Stops, "file string, line_no long, size int").count() == 0
    silent = text.process_lines(text.read_lines(n, 1, 5), text.LineProcessor, "x long")  # gives nothing, and None goes on
    assert silent.count() == 0 and silent.columns == ["x"]
    with pytest.raises(ValueError):
        text.read_lines(n, 1, 10**6, strict=True)
    assert text.read_lines(n, 1, 2, strict=True).count() == 6


def test_gzip_files_and_sizes(spark, folder, tmp_path):
    d, texts = folder
    done = {os.path.basename(r.path): r for r in sinks.gzip_files(spark.createDataFrame([(str(d / x),) for x in texts], "path string"), str(tmp_path / "z")).collect()}
    for name, r in done.items():
        assert gzip.decompress(open(r.target, "rb").read()) == (d / name).read_bytes() and r.original_bytes == (d / name).stat().st_size and r.compressed_bytes == os.path.getsize(r.target)
    two = d / "c.pfw.gz"
    (tmp_path / "tiny.gz").write_bytes(b"short")
    sizes = {os.path.basename(r.path): r for r in archive.gzip_sizes(spark.createDataFrame([(str(two),), (done["a.pfw"].target,), (str(tmp_path / "tiny.gz"),)], "path string"), block=100).collect()}
    assert (sizes["c.pfw.gz"].members, sizes["a.pfw.gz"].members, sizes["a.pfw.gz"].trailer, sizes["tiny.gz"].members, sizes["tiny.gz"].trailer) == (2, 1, len(texts["a.pfw"].encode()), 0, None)
    assert sizes["c.pfw.gz"].trailer < len(texts["c.pfw.gz"].encode())
    assert sinks.compression_summary(spark.createDataFrame([], "path string, target string, original_bytes long, compressed_bytes long")).first().ratio == 0.0
    with pytest.raises(ValueError):
        sinks.gzip_files(spark.createDataFrame([("/x/a",), ("/y/a",)], "path string"), str(tmp_path / "q"))


def test_bytes_of_archives(tmp_path):
    import tarfile

    parts = {"a": b"0123456789", "empty": b"", "d/b": b"x" * 3000, "a2": b"tail"}
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name, data in parts.items():
            (tmp_path / "m").write_bytes(data)
            t.add(tmp_path / "m", name)
    path, whole = str(tmp_path / "t.tar.gz"), b"".join(parts.values())
    for a, z in ((0, 1), (5, 15), (9, 10), (0, len(whole)), (3008, 3014)):
        assert archive.read_bytes(path, a, z, block=7) == whole[a:z]
    assert archive.read_bytes(path, 1, 3, name="a2") == b"ai"
    for a, z, name in ((0, len(whole) + 1, None), (5, 5, None), (0, 1, "nope"), (0, 5, "a2")):
        with pytest.raises(ValueError):
            archive.read_bytes(path, a, z, name)


def test_stored_index(spark, folder, tmp_path):
    import shutil

    d, texts = folder
    src = tmp_path / "src"
    shutil.copytree(d, src)
    store = index.IndexStore(spark, str(tmp_path / "i"), 4096)
    assert store.files().count() == 0 and store.stale(str(src)).count() == 3
    assert store.build(str(src)) == 3 and store.stale(str(src)).count() == 0 == store.build(str(src))
    assert {os.path.basename(r.file): r.total_lines for r in store.files().collect()} == {k: len(expected(t)) for k, t in texts.items()}
    before = store.checkpoints().count()
    (src / "a.pfw").write_text("[\nx\n]\n")
    (src / "empty.pfw").write_text("")
    os.remove(src / "b.pfw")
    assert store.build(str(src)) == 1  # empty files have nothing to index
    assert {os.path.basename(r.file): r.total_lines for r in store.files().collect()} == {"a.pfw": 3, "c.pfw.gz": len(expected(texts["c.pfw.gz"]))} and store.checkpoints().count() < before
    assert store.build(str(src)) == 0 and store.build(str(src), contents=True) == 0
    os.utime(src / "a.pfw", (1, 1))
    assert [os.path.basename(r.file) for r in store.stale(str(src)).collect()] == ["a.pfw"]
    os.makedirs(tmp_path / "i" / "files" / "v=77")  # a build that was interrupted
    assert store.files().count() == 2 and store.build(str(src), force=True) == 2
    spark.range(3).write.parquet(str(tmp_path / "other" / "files" / "v=0"))
    with pytest.raises(ValueError):
        index.IndexStore(spark, str(tmp_path / "other")).files()
