import gzip
import json
import tarfile

from tracelake import cli


def test_commands(spark, tmp_path, capsys):
    lines = [json.dumps({"name": "read", "cat": "posix", "ph": "X", "pid": 1, "tid": 1, "ts": i, "dur": 1}) for i in range(20)]
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.pfw").write_text("[\n" + "\n".join(lines) + "\n]\n")
    (d / "b.pfw.gz").write_bytes(gzip.compress("\n".join(lines).encode()))

    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr().out.splitlines()

    assert run("event_count", "-d", str(d))[1][-1] == "40"
    assert run("reader", str(d / "a.pfw"), "--mode", "lines", "-s", "2", "-e", "3")[1] == lines[:2]
    assert run("reader", str(d / "b.pfw.gz"), "-s", "0", "-e", "10")[1] == [lines[0][:10]]
    assert run("reader", str(d / "a.pfw"))[0] == 1
    assert run("merge", "-d", str(d), "-o", str(tmp_path / "m.pfw"))[1] == ["40"]
    assert len(run("split", "-d", str(d), "-o", str(tmp_path / "s"), "-s", "0.001")[1]) == 3
    assert run("replay", str(d))[0] == 0
    assert len(run("map", str(d), "-v", "time_range")[1]) == 2
    assert run("map", str(d), "--checkpoint")[0] == 1
    for _ in range(2):
        assert run("map", str(d), "--checkpoint", "--checkpoint-dir", str(tmp_path / "c"), "-o", str(tmp_path / f"o{_}"))[0] == 0
    code, out = run("pgzip", "-d", str(d), "-o", str(tmp_path / "z"))
    assert code == 0 and gzip.decompress((tmp_path / "z" / "a.pfw.gz").read_bytes()) == (d / "a.pfw").read_bytes()  # every byte, framing lines too
    assert spark.read.text(str(tmp_path / "z")).count() == 22 and (d / "a.pfw").exists()
    size = len((d / "a.pfw").read_bytes())
    assert out[-1].split("\t")[:2] == ["1", str(size)] and 0 < float(out[-1].split("\t")[3]) < 1
    with tarfile.open(d / "t.tar.gz", "w:gz") as t:
        for name in ("a.pfw", "b.pfw.gz"):
            t.add(d / name, name)
    both = (d / "a.pfw").read_bytes() + (d / "b.pfw.gz").read_bytes()
    cli.main(["reader", str(d / "t.tar.gz"), "-s", str(size - 30), "-e", str(size - 2)], spark)
    assert capsys.readouterr().out == both[size - 30 : size - 2].decode()
    assert run("tar", str(d / "t.tar.gz"), "--member", "a.pfw")[1] == ["[", *lines, "]"]
    assert run("tar", str(d / "t.tar.gz"), "--info")[1][1].split("\t")[1:3] == ["2", str(len(both))]
    index = ["--index", str(tmp_path / "i")]
    assert run("reader", str(d / "a.pfw"), "--check", *index)[0] == 1
    assert run("reader", str(d / "a.pfw"), "--build", *index)[1] == ["1"] and run("reader", str(d / "a.pfw"), "--check", *index)[0] == 0
    assert run("reader", str(d / "a.pfw"), "--build", *index)[1] == ["0"] and run("reader", str(d / "a.pfw"), "--check")[0] == 1
    (d / "a.pfw").write_text("[\nchanged and of another size\n]\n")
    assert run("reader", str(d / "a.pfw"), "--check", *index)[0] == 1 and run("reader", str(d / "a.pfw"), "--build", *index)[1] == ["1"]
    assert run("replay", str(d / "b.pfw.gz"), "--no-timing", "--dry-run")[0] == 0
