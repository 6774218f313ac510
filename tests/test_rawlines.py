"""The line loader against a reading of the rules one character at a time."""

import json
import random
import re

from tracelake.operators import rawlines


def csv_reason(line: str) -> str | None:
    fields, i, n = [], 0, len(line)
    while True:
        j = i
        while j < n and line[j] in " \t":
            j += 1
        if j < n and line[j] == '"':
            value, j = "", j + 1
            while True:
                if j >= n:
                    return "quoting"
                if line[j] == '"':
                    if j + 1 < n and line[j + 1] == '"':
                        value, j = value + '"', j + 2
                        continue
                    j += 1
                    break
                value, j = value + line[j], j + 1
            while j < n and line[j] in " \t":
                j += 1
            if j < n and line[j] != ",":
                return "quoting"
        else:
            k = line.find(",", i)
            k = n if k < 0 else k
            value, j = line[i:k], k
            if '"' in value:
                return "quoting"
        fields.append(value.strip(" \t"))
        if j >= n:
            break
        i = j + 1
    if len(fields) != 12:
        return "columns"
    digits = re.compile(r"[0-9]{1,18}")
    f, c, pid, tid, ts, dur, hh, fh, size, epoch, valid, _ = fields
    ok = f and c and all(digits.fullmatch(x) for x in (pid, tid, ts)) and re.fullmatch(r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]{1,2})?", dur)
    ok = ok and all(x == "" or re.fullmatch("[0-9a-fA-F]{16}", x) for x in (hh, fh)) and all(x == "" or digits.fullmatch(x) for x in (size, epoch))
    return None if ok and valid.lower() in ("true", "false") else "value"


def json_reason(line: str) -> str | None:
    body = line[:-1] if line.endswith(",") else line

    def no(x):
        raise ValueError

    try:
        o = json.loads(body, parse_constant=no)
    except ValueError:
        return "syntax"
    if not isinstance(o, dict):
        return "syntax"
    if not {"name", "cat", "ph", "pid", "tid", "ts", "dur"} <= set(o):
        return "columns"
    whole = lambda x: type(x) is int and x >= 0
    ok = all(isinstance(o[k], str) and o[k].strip() for k in ("name", "cat")) and o["ph"] in ("X", "M") and all(whole(o[k]) for k in ("pid", "tid", "ts"))
    ok = ok and type(o["dur"]) in (int, float) and o["dur"] >= 0 and isinstance(o.get("args", {}), dict)
    return None if ok else "value"


def expected(fmt, line):
    """None: framing; else (reason,)."""
    t = (line or "").strip(" \t\r\n")
    if t in ("", "[", "]", "{", "}", "][") or fmt == "csv" and t == ",".join(rawlines.CSV_COLUMNS):
        return None
    return (csv_reason(t) if fmt == "csv" else json_reason(t),)


GOOD = "read,POSIX,1,2,3,4.5,0123456789abcdef,0123456789ABCDEF,7,8,true,note"


def mutated(r: random.Random) -> str:
    s = list(GOOD if r.random() < 0.5 else GOOD.replace("note", '"a ""b"", c"').replace("read", ' "read" '))
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(s))
        s[k : k + r.randint(0, 1)] = r.choice(['"', ",", " ", "\t", "x", "", "ü", '""', "9", "٣", "e5"])
    return "".join(s)


def check(spark, rows):
    got = {x.line_id: (x.reason,) for x in rawlines.load_lines(spark.createDataFrame(rows, "line_id long, file_id long, line_no int, fmt string, line string")).collect()}
    want = {i: w for i, _, _, f, t in rows if (w := expected(f, t)) is not None}
    wrong = {i: (got.get(i), want.get(i), rows[i]) for i in set(got) | set(want) if got.get(i) != want.get(i)}
    assert not wrong, list(wrong.items())[:5]


def test_mutated_lines(spark):
    r = random.Random(1)
    rows = [(i, 0, i, "csv", mutated(r)) for i in range(4000)]
    check(spark, rows)


def test_all_given_lines(spark):
    rows = [tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/raw_lines.parquet").select("line_id", "file_id", "line_no", "fmt", "line").collect()]
    rows = [(i, *x[1:]) for i, x in enumerate(rows)]
    check(spark, rows)


def test_edges(spark):
    j = '{"name":"r","cat":"c","ph":"X","pid":1,"tid":1,"ts":5,"dur":1.5,"args":{"ret":3,"epoch":"2"}}'
    lines = [
        ("csv", None), ("csv", ""), ("json", " [ \r\n"), ("csv", '"'), ("csv", "," * 11), ("csv", GOOD + "\r"), ("csv", GOOD + ',"'), ("csv", '"' + "x" * 5000), ("json", j + ","), ("json", j + ";"),
        ("json", j + j), ("json", "[]"), ("json", "5"), ("json", "{},"), ("json", j.replace("1.5", "NaN")), ("json", j.replace('"ts":5', '"ts":true')), ("json", j.replace('"ts":5', '"ts":' + "9" * 30)),
        ("json", j.replace('"r"', '" "')), ("json", "[" * 5000), ("csv", GOOD.replace("note", "y" * 100_000)), ("csv", ",".join(rawlines.CSV_COLUMNS)), ("json", j.replace('{"ret":3,"epoch":"2"}', "[]")),
    ]
    rows = [(i, None, None, f, t) for i, (f, t) in enumerate(lines)]
    skip = {18}
    check(spark, [r for r in rows if r[0] not in skip][:18])
    out = {x.line_id: x for x in rawlines.load_lines(spark.createDataFrame(rows, "line_id long, file_id long, line_no int, fmt string, line string")).collect()}
    assert out[18].reason == "syntax"
    assert out[8].reason is None and out[8].time_end == 6 and out[8].size == 3 and out[8].epoch == 2 and out[8].is_valid
    assert out[5].hhash == "0123456789abcdef" and out[5].duration == 4.5 and out[5].note == "note"
    assert out[6].reason == "quoting" and out[6].error_offset == len(GOOD) + 2
    assert out[16].reason is None and out[16].time_start is None
    other = rawlines.load_lines(spark.createDataFrame([(1, 1, 1, None, "x", "y")], "line_id long, file_id long, line_no int, fmt string, line string, reason string")).collect()
    assert [x.reason for x in other] == ["format"]
    assert rawlines.load_lines(spark.createDataFrame([], "line_id long, file_id long, line_no int, fmt string, line string")).count() == 0


def test_chunk_size_does_not_matter():
    r = random.Random(5)
    records = [mutated(r).encode() for _ in range(300)]
    a, b = rawlines.tokenize(records, 7), rawlines.tokenize(records, 4096)
    assert all((x == y).all() for x, y in zip(a, b))


JSON = '{"name":" r ","cat":"c","ph":"X","pid":1,"tid":1,"ts":5,"dur":1.5,"args":{"ret":3,"epoch":"2","hhash":"ab","fhash":"","note":"\u00e9\\t","x":[1,{"y":[]}]}}'


def broken(r: random.Random) -> str:
    s = list(JSON)
    for _ in range(r.randint(0, 3)):
        k = r.randrange(len(s))
        s[k : k + r.randint(0, 2)] = r.choice(['"', ",", " ", "\t", "x", "", "\u00fc", "\\", '\\"', "\\u00e9", "\\u12", "{", "}", "[", "]", ":", "-", "0", "1e5", "null", "true", "NaN", '"a":1,', "\x01", " \n "])
    return "".join(s)


def test_mutated_json(spark):
    r = random.Random(7)
    check(spark, [(i, 0, i, "json", broken(r)) for i in range(6000)])


def test_json_values(spark):
    j = JSON
    lines = [
        j, j + " ,", j.replace('"note"', '"n\\u006fte"'), j.replace('"args"', '"\\u0061rgs"'), j.replace("[]", "[" * 80 + "]" * 80), j.replace('"2"', '"' + "9" * 20 + '"'), j.replace("3", '"-12"'), j.replace("1.5", "1e400"),
        j.replace("1.5", "1e400").replace('"note"', '"n\\u006fte"'), j.replace("1.5", "-0.0"), j.replace('"ts":5', '"ts":' + "9" * 18), j.replace('"ts":5', '"ts":' + "9" * 19), j.replace('"dur":1.5', '"dur":5,"dur":2'), "[" * 90, '{"a":' * 90 + "1" + "}" * 90,
        j.replace('"c"', "5"), j.replace(',"dur":1.5', ""), j[:-3],
    ]
    rows = [(i, 0, i, "json", t) for i, t in enumerate(lines)]
    check(spark, rows)
    out = {x.line_id: x for x in rawlines.load_lines(spark.createDataFrame(rows, "line_id long, file_id long, line_no int, fmt string, line string")).collect()}
    for i in (0, 1, 2, 3, 4):
        x = out[i]
        assert (x.reason, x.func_name, x.cat, x.ph, x.pid, x.time_start, x.time_end, x.duration, x.size, x.epoch, x.hhash, x.fhash, x.note) == (None, "r", "c", "X", 1, 5, 6, 1.5, 3, 2, "ab", None, "\u00e9\t"), i
    assert (out[5].epoch, out[6].size, out[7].duration, out[8].duration, out[9].duration, out[12].duration) == (None, None, None, None, 0.0, 2.0)
    assert out[10].time_end == 10**18 and out[11].time_start is None
    assert (out[15].error_field, out[15].error_offset) == ("cat", j.index('"cat"')) and (out[16].error_field, out[16].error_offset) == ("dur", len(lines[16].encode()))
    assert out[17].error_offset == len(lines[17].encode()) and out[13].error_offset == 0


def test_chunk_size_does_not_matter_for_json():
    import pyarrow as pa

    r = random.Random(9)
    lines = pa.array([broken(r).strip(rawlines.EDGE) for _ in range(300)])
    a, b = rawlines._json(lines, 5), rawlines._json(lines, 4096)
    assert all(str(a[c]) == str(b[c]) for c in a)
