"""Loading trace lines: sound lines become typed rows, the others come out with their reason.

Lines are read by finite-state tokenizers over the bytes of a whole batch. The bytes are cut into equal
chunks regardless of where lines end. First every chunk is run from all states at once, which gives its
state transition function; composing those functions (a parallel prefix) gives the state each chunk
really starts in; a second run then gives the state before every byte. For csv the states tell separators
and the first byte that breaks the quoting. For json they tell which bytes are inside strings; tokens, their
depth (a running sum) and the container each lies in follow, and each token is checked against the one before
it. Fields are slices of the batch's bytes, made all at once; nothing is done a line at a time but for lines the
tokens can't decide (`_undecided`). Both work line by line: nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracelake.session import ship

# Fixed values of the two line formats.
CSV_COLUMNS = ["func_name", "cat", "pid", "tid", "time_start", "duration", "hhash", "fhash", "size", "epoch", "is_valid", "note"]
JSON_REQUIRED = ["name", "cat", "ph", "pid", "tid", "ts", "dur"]
FRAMING = ["", "[", "]", "{", "}", "]["]
_DIGITS = "^[0-9]{1,18}$"
CSV_RULES = {
    "func_name": "(?s)^.+$",
    "cat": "(?s)^.+$",
    "pid": _DIGITS,
    "tid": _DIGITS,
    "time_start": _DIGITS,
    "duration": r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]{1,2})?$",
    "hhash": "^([0-9a-fA-F]{16})?$",
    "fhash": "^([0-9a-fA-F]{16})?$",
    "size": "^([0-9]{1,18})?$",
    "epoch": "^([0-9]{1,18})?$",
    "is_valid": "(?i)^(true|false)$",
}
EDGE = " \t\r\n"

# The tokenizer's states: at a field's start, in a bare field, in an enclosed one, after a quote in an
# enclosed one, in blanks after an enclosed one, broken. Bytes: other, quote, comma, blank, end of record.
START, BARE, ENCLOSED, QUOTE, AFTER, BROKEN = range(6)
OTHER_BYTE, QUOTE_BYTE, COMMA_BYTE, BLANK_BYTE, END_BYTE = range(5)
STEP = np.array(
    [
        [BARE, ENCLOSED, START, START, START],
        [BARE, BROKEN, START, BARE, START],
        [ENCLOSED, QUOTE, ENCLOSED, ENCLOSED, START],
        [BROKEN, ENCLOSED, START, AFTER, START],
        [BROKEN, BROKEN, START, AFTER, START],
        [BROKEN, BROKEN, BROKEN, BROKEN, START],
    ],
    np.uint8,
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord('"'), ord(","), ord(" "), ord("\t")]] = [QUOTE_BYTE, COMMA_BYTE, BLANK_BYTE, BLANK_BYTE]

_FIELDS = [
    ("line_id", pa.int64()), ("file_id", pa.int64()), ("line_no", pa.int32()), ("reason", pa.string()), ("error_offset", pa.int32()), ("error_field", pa.string()),
    ("func_name", pa.string()), ("cat", pa.string()), ("ph", pa.string()), ("pid", pa.int64()), ("tid", pa.int64()), ("time_start", pa.int64()), ("time_end", pa.int64()),
    ("duration", pa.float64()), ("hhash", pa.string()), ("fhash", pa.string()), ("size", pa.int64()), ("epoch", pa.int64()), ("is_valid", pa.bool_()), ("note", pa.string()),
]
SCHEMA = ", ".join(f"{n} " + {"int64": "long", "int32": "int", "double": "double", "bool": "boolean"}.get(str(t), "string") for n, t in _FIELDS)


def load_lines(raw: DataFrame, chunk_bytes: int = 512, values: bool = True) -> DataFrame:
    """All lines of `raw` (line_id, file_id, line_no, fmt, line) but the framing ones, as typed rows or with a reason.

    reason is NULL for sound lines, whose trace columns are set and `is_valid` is true; else the first that
    holds of csv `quoting`, `columns`, `value`, json `syntax`, `columns`, `value`, with the byte offset in the
    trimmed line and the field where it showed. NULL lines and empty ones are framing, as are the lines
    `[ ] { } ][` and csv lines equal to the column list. A `fmt` other than json or csv (NULL too) gives the
    reason `format`. A number that doesn't fit its column (json integers of 64 bits or more) is loaded as
    NULL. Repeated rows stay; further columns are ignored. Without `values` only the reasons are made, and the
    trace columns are all NULL.
    """
    ship(raw.sparkSession)
    rows = raw.selectExpr("cast(line_id as long)", "cast(file_id as long)", "cast(line_no as int)", "lower(trim(cast(fmt as string))) as fmt", "cast(line as string) as line")
    return rows.mapInArrow(lambda it: _load(it, chunk_bytes, values), SCHEMA)


def rejected(loaded: DataFrame) -> DataFrame:
    return loaded.filter("reason is not null").select("line_id", "file_id", "line_no", "reason", "error_offset", "error_field")


def accepted(loaded: DataFrame) -> DataFrame:
    return loaded.filter("reason is null").drop("reason", "error_offset", "error_field")


def _load(batches: Iterator[pa.RecordBatch], chunk_bytes: int, values: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = pc.utf8_trim(pc.fill_null(b.column(4), ""), characters=EDGE)
        fmt = b.column(3)
        csv, js = (pc.fill_null(pc.equal(fmt, f), False) for f in ("csv", "json"))
        framing = pc.or_(pc.is_in(lines, pa.array(FRAMING)), pc.and_(csv, pc.equal(lines, ",".join(CSV_COLUMNS))))
        other = pc.invert(pc.or_(csv, js))
        for kind, of_kind in (("csv", csv), ("json", js), ("", other)):
            own = pc.and_not(of_kind, framing)
            n = pc.sum(own).as_py() or 0
            if not n:
                continue
            text = lines.filter(own)
            cols = _csv(text, chunk_bytes, values) if kind == "csv" else _json(text, chunk_bytes, values) if kind else {"reason": pa.array(["format"] * n)}
            for i, c in enumerate(("line_id", "file_id", "line_no")):
                cols[c] = b.column(i).filter(own)
            yield pa.record_batch([cols[c].cast(t) if c in cols else pa.nulls(n, t) for c, t in _FIELDS], names=[c for c, _ in _FIELDS])


def _laid_out(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines' bytes end to end, with one byte after each; where each begins and where it ends."""
    lines = pc.binary_join_element_wise(lines.cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
    at = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2], np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    return data, at[:-1], at[1:] - 1


def _slices(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> pa.Array:
    """Texts data[first:after], which ascend and don't overlap: offsets into the same bytes, every other one of which is a gap."""
    if not len(first):
        return pa.array([], pa.string())
    at = np.empty(2 * len(first), np.int64)
    at[0::2], at[1::2] = first, after
    whole = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    return whole.take(pa.array(np.arange(0, len(at) - 1, 2))).cast(pa.string())


class Automaton:
    """A finite automaton (state, class -> state; it begins in state 0) with all transition functions that strings can have, numbered, 0 being none.

    There are few of them, so a chunk's function is one number, one lookup goes on by a byte, and another composes two chunks.
    """

    def __init__(self, step: np.ndarray):
        states, kinds = step.shape
        same = tuple(range(states))
        number, todo = {same: 0}, [same]
        for f in todo:  # grows while it is read
            for k in range(kinds):
                g = tuple(int(step[x, k]) for x in f)
                if g not in number:
                    number[g] = len(number)
                    todo.append(g)
        self.kinds = kinds
        self.ends = np.array(todo, np.uint8)
        self.next = np.array([[number[tuple(int(step[x, k]) for x in f)] for k in range(kinds)] for f in todo], np.intp).ravel()
        self.both = np.array([[number[tuple(g[x] for x in f)] for g in todo] for f in todo], np.intp)

    def before(self, classes: np.ndarray, chunk_bytes: int) -> np.ndarray:
        """The state before each byte of the given classes."""
        total = len(classes)
        width = -(-total // chunk_bytes)
        padded = np.zeros(width * chunk_bytes, np.uint8)
        padded[:total] = classes
        chunks = np.ascontiguousarray(padded.reshape(width, chunk_bytes).T)
        now = np.zeros(width, np.intp)
        functions = np.empty((chunk_bytes, width), np.uint16)
        for j in range(chunk_bytes):
            functions[j] = now
            now *= self.kinds
            now += chunks[j]
            now = self.next.take(now)
        reach = 1
        while reach < width:  # after this, now[c] leads from before the first chunk to after chunk c
            now[reach:] = self.both[now[:-reach], now[reach:]]
            reach *= 2
        start = np.concatenate([[0], self.ends[now[:-1], 0]]).astype(np.intp)
        states = self.ends.ravel().take(functions.astype(np.intp) * self.ends.shape[1] + start)
        return states.T.reshape(-1)[:total]


_CSV = Automaton(STEP)


def tokenize(records: list[bytes], chunk_bytes: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the records' bytes laid end to end (with one byte after each): the records' begins, the offsets of the
    separators, the record of each separator, and for each record the byte at which it breaks the quoting (-1: sound)."""
    data, begins, ends = _laid_out(pa.array(records, pa.large_binary()))
    return begins, *_separators(data, begins, ends, chunk_bytes)


def _separators(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, chunk_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    classes = _CLASS[data]
    classes[ends] = END_BYTE
    before = _CSV.before(classes, chunk_bytes)
    commas = np.flatnonzero((classes == COMMA_BYTE) & (before != ENCLOSED) & (before != BROKEN))
    bad = np.full(len(begins), -1, np.int64)
    broke = np.flatnonzero((before != BROKEN) & (STEP[before, classes] == BROKEN))
    rec = np.searchsorted(ends, broke)
    bad[rec[::-1]] = (broke - begins[rec])[::-1]
    open_ = np.flatnonzero(before[ends] == ENCLOSED)
    bad[open_] = (ends - begins)[open_]
    return commas, np.searchsorted(ends, commas), bad


def _csv(lines: pa.Array, chunk_bytes: int, typed: bool = True) -> dict[str, pa.Array]:
    data, begins, ends = _laid_out(lines)
    commas, owner, bad = _separators(data, begins, ends, chunk_bytes)
    n, k = len(begins), len(CSV_COLUMNS)
    count = np.bincount(owner, minlength=n) + 1
    reason = np.full(n, None, object)
    offset = np.full(n, -1, np.int64)
    field = np.full(n, None, object)
    reason[bad >= 0], offset[bad >= 0] = "quoting", bad[bad >= 0]
    wide = (bad < 0) & (count != k)
    reason[wide] = "columns"
    size = ends - begins
    offset[wide] = size[wide]
    is_sound = (bad < 0) & (count == k)
    sound = np.flatnonzero(is_sound)
    cut = commas[is_sound[owner]].reshape(-1, k - 1)
    first = np.hstack([begins[sound][:, None], cut + 1])
    after = np.hstack([cut, ends[sound][:, None]])
    values: dict[str, pa.Array] = {}
    wrong = np.full(len(sound), -1)
    for j in range(k - 1, -1, -1):
        name = CSV_COLUMNS[j]
        v = pc.utf8_trim(_slices(data, first[:, j], after[:, j]), characters=" \t")
        quoted = pc.starts_with(v, '"')
        if pc.any(quoted).as_py():
            inner = pc.replace_substring(pc.utf8_slice_codeunits(v, 1, -1), '""', '"')
            v = pc.if_else(quoted, pc.utf8_trim(inner, characters=" \t") if name != "note" else inner, v)
        values[name] = v
        if name in CSV_RULES:
            wrong[~pc.match_substring_regex(v, CSV_RULES[name]).to_numpy(zero_copy_only=False)] = j
    first = first - begins[sound][:, None]
    miss = np.flatnonzero(wrong >= 0)
    reason[sound[miss]] = "value"
    offset[sound[miss]] = first[miss, wrong[miss]]
    field[sound[miss]] = np.array(CSV_COLUMNS, object)[wrong[miss]]

    said = {"reason": pa.array(list(reason), pa.string()), "error_offset": pa.array(offset, mask=offset < 0), "error_field": pa.array(list(field), pa.string())}
    if not typed:
        return said
    good = sound[wrong < 0]
    keep = pa.array(wrong < 0)
    place = np.full(n, -1)
    place[good] = np.arange(len(good))
    spread = pa.array(place, mask=place < 0)
    out = {c: v.filter(keep) for c, v in values.items()}
    blank = lambda v: pc.if_else(pc.equal(v, ""), pa.scalar(None, pa.string()), v)
    for c in ("pid", "tid", "time_start", "size", "epoch"):
        out[c] = blank(out[c]).cast(pa.int64())
    out["duration"] = out["duration"].cast(pa.float64())
    out["time_end"] = _end(out["time_start"], out["duration"])
    for c in ("hhash", "fhash"):
        out[c] = blank(out[c])
    out["is_valid"] = pa.array([True] * len(good), pa.bool_())
    out = {c: v.take(spread) for c, v in out.items()}
    return out | said


def _end(start: pa.Array, duration: pa.Array) -> pa.Array:
    """start + whole microseconds of duration; NULL where that doesn't fit."""
    us = pc.if_else(pc.less(duration, 4e18), duration, pa.scalar(None, pa.float64()))
    return pc.add(start, pc.floor(us).cast(pa.int64()))


# The states of json: outside of strings, inside, after a backslash inside. Bytes: other, quote, backslash, end of record.
OUT, IN, ESCAPED = range(3)
JSON_STEP = np.array([[OUT, IN, OUT, OUT], [IN, OUT, ESCAPED, OUT], [IN, IN, IN, OUT]], np.uint8)
_JSON_STRINGS = Automaton(JSON_STEP)
_JSON_CLASS = np.zeros(256, np.uint8)
_JSON_CLASS[[ord('"'), ord("\\")]] = [1, 2]
_JSON_END = 3
# Kinds of tokens. Blanks are none; whatever else is outside of strings is part of a number or a word.
OBJECT, OBJECT_END, ARRAY, ARRAY_END, COLON, COMMA, STRING, PLAIN, BLANK, NONE = range(10)
_KIND = np.full(256, PLAIN, np.uint8)
_KIND[[ord(c) for c in '{}[]:,"']] = [OBJECT, OBJECT_END, ARRAY, ARRAY_END, COLON, COMMA, STRING]
_KIND[[ord(c) for c in EDGE]] = BLANK
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_ESCAPES = np.zeros(256, bool)
_ESCAPES[[ord(c) for c in '"\\/bfnrtu']] = True
_NUMBER = r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?"
#: Levels of nesting beyond which a line is read by itself.
MAX_DEPTH = 64
_ARGS = ["ret", "hhash", "fhash", "epoch", "note"]


class _Json:
    """The tokens of many json records: kind, first and after (bytes), rec, level and holder (the token that opened the container it lies in), and for
    each record the byte of its first error (-1: none) and whether it nests too deep to be decided here."""

    def __init__(self, lines: pa.Array, chunk_bytes: int):
        data, begins, ends = _laid_out(lines)
        n = len(begins)
        classes = _JSON_CLASS[data]
        classes[ends] = _JSON_END
        before = _JSON_STRINGS.before(classes, chunk_bytes)
        out = before == OUT
        kinds = np.where(out, _KIND[data], BLANK)
        kinds[ends] = BLANK
        plain = kinds == PLAIN
        edge = np.diff(np.concatenate([[0], plain.view(np.int8), [0]]))
        starts = kinds < PLAIN
        starts |= edge[:-1] == 1
        first = np.flatnonzero(starts)
        kind = kinds[first].astype(np.int64)
        after = first + 1
        after[kind == PLAIN] = np.flatnonzero(edge == -1)
        after[kind == STRING] = np.flatnonzero(~out & ((classes == 1) & (before == IN) | (classes == _JSON_END))) + 1
        rec = np.searchsorted(ends, first)
        self.data, self.begins, self.ends, self.kind, self.first, self.after, self.rec = data, begins, ends, kind, first, after, rec
        self.error = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(self.error, np.flatnonzero(before[ends] != OUT), ends[before[ends] != OUT])
        self._check_strings(before, classes)
        self._check_order(n)
        self._check_plain()
        empty = np.ones(n, bool)
        empty[rec] = False
        self.error[empty] = begins[empty]
        self.error = np.where(self.error == np.iinfo(np.int64).max, -1, self.error - begins)

    def _wrong(self, at: np.ndarray) -> None:
        """Errors at bytes `at`."""
        np.minimum.at(self.error, np.searchsorted(self.ends, at), at)

    def _check_strings(self, before: np.ndarray, classes: np.ndarray) -> None:
        inside = (before != OUT) & (classes != _JSON_END)
        self._wrong(np.flatnonzero(inside & (self.data < 32)))
        named = np.flatnonzero(inside & (before == ESCAPED))
        self._wrong(named[~_ESCAPES[self.data[named]]])
        u = named[self.data[named] == ord("u")]
        hex_ = np.ones(len(u), bool)
        for i in range(1, 5):
            hex_ &= _HEX[self.data[np.minimum(u + i, len(self.data) - 1)]]
        self._wrong(u[~hex_])

    def _check_order(self, n: int) -> None:
        kind, rec = self.kind, self.rec
        opens, closes = (kind == OBJECT) | (kind == ARRAY), (kind == OBJECT_END) | (kind == ARRAY_END)
        upto = np.cumsum(opens.astype(np.int64) - closes)
        new = np.ones(len(kind), bool)
        new[1:] = rec[1:] != rec[:-1]
        head = np.flatnonzero(new)
        base = np.zeros(len(kind), np.int64)
        if len(head):
            base = np.repeat(np.concatenate([[0], upto[head[1:] - 1]]), np.diff(np.append(head, len(kind))))
        inner = upto - base  # depth after the token
        self.level = level = inner - opens + closes  # of the container it lies in or closes
        self.deep = np.zeros(n, bool)
        self.deep[rec[level > MAX_DEPTH]] = True
        self.holder = np.full(len(kind), -1)
        for d in range(1, min(int(level.max(initial=0)), MAX_DEPTH) + 1):
            opened, lie = np.flatnonzero(opens & (level == d - 1)), np.flatnonzero(level == d)
            at = np.searchsorted(opened, lie) - 1
            known = at >= 0
            known[known] = rec[opened[at[known]]] == rec[lie[known]]
            self.holder[lie[known]] = opened[at[known]]
        previous = np.concatenate([[NONE], kind[:-1]])
        previous[new] = NONE
        within = np.where(self.holder >= 0, kind[self.holder], NONE)
        in_object, in_array = within == OBJECT, within == ARRAY
        self.is_key = (kind == STRING) & in_object & ((previous == OBJECT) | (previous == COMMA))
        was_key = np.concatenate([[False], self.is_key[:-1]])
        valued = (previous == PLAIN) | (previous == OBJECT_END) | (previous == ARRAY_END) | ((previous == STRING) & ~was_key)
        value = opens | (kind == STRING) | (kind == PLAIN)
        ok = new & (kind == OBJECT)  # the one value of a record
        ok |= self.is_key
        ok |= value & in_object & (previous == COLON)
        ok |= value & in_array & ((previous == ARRAY) | (previous == COMMA))
        ok |= (kind == COLON) & in_object & (previous == STRING) & was_key
        ok |= (kind == COMMA) & (in_object | in_array) & valued
        ok |= (kind == OBJECT_END) & in_object & ((previous == OBJECT) | valued)
        ok |= (kind == ARRAY_END) & in_array & ((previous == ARRAY) | valued)
        ok |= level > MAX_DEPTH
        self._wrong(self.first[~ok])
        last = np.append(head[1:], len(kind)) - 1 if len(head) else head
        self._wrong(self.ends[rec[last[inner[last] != 0]]])

    def _check_plain(self) -> None:
        at = np.flatnonzero(self.kind == PLAIN)
        good = pc.match_substring_regex(_slices(self.data, self.first[at], self.after[at]), f"^({_NUMBER}|true|false|null)$").to_numpy(zero_copy_only=False)
        self._wrong(self.first[at[~good]])

    def members(self, names: list[str], keys: np.ndarray) -> dict[str, np.ndarray]:
        """For each name the token of its value in each record (-1: none), of the key tokens `keys`. Of a name given twice the last counts, as usual."""
        which = pc.fill_null(pc.index_in(_slices(self.data, self.first[keys] + 1, self.after[keys] - 1), pa.array(names)), -1).to_numpy(zero_copy_only=False)
        out = {c: np.full(len(self.begins), -1) for c in names}
        for i, c in enumerate(names):
            own = keys[which == i]
            out[c][self.rec[own]] = own + 2
        return out

    def texts(self, at: np.ndarray, kind: int) -> pa.Array:
        """The text of tokens `at` of a kind (strings without their quotes, escapes resolved), NULL where the token is of another or none."""
        own = np.flatnonzero((at >= 0) & (self.kind[at] == kind))
        q = int(kind == STRING)
        found = _slices(self.data, self.first[at[own]] + q, self.after[at[own]] - q)
        if q and pc.any(slashed := pc.match_substring(found, "\\")).as_py():
            found = pa.array([json.loads(f'"{x}"').encode("utf-8", "replace").decode() if s else x for x, s in zip(found.to_pylist(), slashed.to_pylist())], pa.string())
        place = np.full(len(at), -1)
        place[own] = np.arange(len(own))
        return found.take(pa.array(place, mask=place < 0))


def _longs(plain: pa.Array, strings: pa.Array | None = None) -> pa.Array:
    """Whole numbers that a BIGINT holds, of numbers or texts that spell them; else NULL."""
    both = plain if strings is None else pc.coalesce(plain, strings)
    short = pc.fill_null(pc.match_substring_regex(both, "^-?[0-9]{1,18}$"), False)
    out = pc.if_else(short, both, pa.scalar(None, pa.string())).cast(pa.int64())
    left = pc.and_not(pc.is_valid(both), short)
    if not pc.any(left).as_py():
        return out
    return pc.replace_with_mask(out, left, pa.array([_long(x) for x in both.filter(left).to_pylist()], pa.int64()))


def _long(x: str) -> int | None:
    digits = x.strip().lstrip("-")
    v = int(x) if digits.isascii() and digits.isdigit() and len(x) < 30 and x.count("-") <= 1 else None
    return v if v is not None and -(2**63) <= v < 2**63 else None


def _doubles(text: pa.Array) -> pa.Array:
    try:
        return text.cast(pa.float64())
    except pa.ArrowInvalid:  # out of range
        return pa.array([None if x is None else float(x) for x in text.to_pylist()], pa.float64())


def _json(lines: pa.Array, chunk_bytes: int, typed: bool = True) -> dict[str, pa.Array]:
    comma = pc.ends_with(lines, ",")
    bodies = pc.if_else(comma, pc.utf8_rtrim(pc.utf8_slice_codeunits(lines, 0, -1), characters=EDGE), lines)
    t = _Json(bodies, chunk_bytes)
    n = len(lines)
    sound = (t.error < 0) & ~t.deep
    outer = np.flatnonzero(t.is_key & (t.level == 1) & sound[t.rec])
    # a key written with escapes could spell any name
    escaped = pc.match_substring(_slices(t.data, t.first[outer], t.after[outer]), "\\").to_numpy(zero_copy_only=False)
    deferred = t.deep & (t.error < 0)
    deferred[t.rec[outer[escaped]]] = True
    at = t.members([*JSON_REQUIRED, "args"], outer)
    inner = np.flatnonzero(t.is_key & (t.level == 2) & sound[t.rec])
    inner = inner[t.holder[inner] == at["args"][t.rec[inner]]]
    escaped = pc.match_substring(_slices(t.data, t.first[inner], t.after[inner]), "\\").to_numpy(zero_copy_only=False)
    deferred[t.rec[inner[escaped]]] = True
    args = t.members(_ARGS, inner) if typed else {}

    text = {c: t.texts(at[c], STRING) for c in ("name", "cat", "ph")}
    plain = {c: t.texts(at[c], PLAIN) for c in ("pid", "tid", "ts", "dur")}
    yes = lambda x: pc.fill_null(x, False).to_numpy(zero_copy_only=False)
    trimmed = {c: pc.utf8_trim_whitespace(text[c]) for c in ("name", "cat")}
    number = pc.if_else(pc.match_substring_regex(plain["dur"], f"^{_NUMBER}$"), plain["dur"], pa.scalar(None, pa.string()))
    duration = _doubles(number)
    right = {c: yes(pc.not_equal(trimmed[c], "")) for c in trimmed}
    right["ph"] = yes(pc.is_in(text["ph"], pa.array(["X", "M"])))
    right |= {c: yes(pc.match_substring_regex(plain[c], "^(-?0|[1-9][0-9]*)$")) for c in ("pid", "tid", "ts")}
    right["dur"] = yes(pc.greater_equal(duration, 0.0))
    right["args"] = (at["args"] < 0) | (t.kind[at["args"]] == OBJECT)

    reason, field = np.full(n, None, object), np.full(n, None, object)
    offset = np.where(t.error >= 0, t.error, -1)
    reason[t.error >= 0] = "syntax"
    size = t.ends - t.begins
    for word, tests in (("columns", {c: at[c] >= 0 for c in JSON_REQUIRED}), ("value", right)):
        for c, test in tests.items():
            new = sound & (reason == None) & ~test  # noqa: E711
            reason[new], field[new] = word, c
            offset[new] = size[new] if word == "columns" else (t.first[at[c][new] - 2] - t.begins[new])
    said = {"reason": pa.array(list(reason), pa.string()), "error_offset": pa.array(offset, mask=offset < 0), "error_field": pa.array(list(field), pa.string())}
    if not typed:
        return _undecided(said, bodies, deferred) if deferred.any() else said
    start = _longs(plain["ts"])
    known = pc.if_else(pc.less(duration, 1e300), duration, pa.scalar(None, pa.float64()))
    ret = _longs(t.texts(args["ret"], PLAIN), t.texts(args["ret"], STRING))
    given = {c: t.texts(args[c], STRING) for c in ("hhash", "fhash", "note")}
    out = {
        "func_name": trimmed["name"], "cat": trimmed["cat"], "ph": text["ph"], "pid": _longs(plain["pid"]), "tid": _longs(plain["tid"]), "time_start": start, "time_end": _end(start, known), "duration": known,
        **{c: pc.if_else(pc.equal(v, ""), pa.scalar(None, pa.string()), v) for c, v in given.items()},
        "size": pc.if_else(pc.greater(ret, 0), ret, pa.scalar(None, pa.int64())), "epoch": _longs(t.texts(args["epoch"], PLAIN), t.texts(args["epoch"], STRING)), "is_valid": pa.array([True] * n, pa.bool_()),
    }
    loaded = pa.array([r is None for r in reason])
    out = {c: pc.if_else(loaded, v, pa.scalar(None, v.type)) for c, v in out.items()}
    out |= said
    return _undecided(out, bodies, deferred) if deferred.any() else out


def _undecided(out: dict[str, pa.Array], bodies: pa.Array, deferred: np.ndarray) -> dict[str, pa.Array]:
    """`out` with the lines `deferred` read one by one: those that nest deeper than MAX_DEPTH, and those whose keys are spelled with escapes, which are spelled plainly and read again."""
    again = [_plainly(bodies[int(i)].as_py()) for i in np.flatnonzero(deferred)]
    read = _json(pa.array([x or "?" for x in again]), 512)
    read["error_offset"] = pa.nulls(len(again), pa.int64())  # of another spelling
    return {c: pc.replace_with_mask(v, pa.array(deferred), read[c].cast(v.type)) for c, v in out.items()}


def _plainly(body: str) -> str | None:
    """The object a line holds, spelled plainly; None for anything else."""
    try:
        o = _STRICT.decode(body)
        return _shallow(o) if isinstance(o, dict) else None
    except (ValueError, RecursionError):
        return None


def _shallow(o: dict) -> str:
    """The object in plain keys, with what it holds beyond the members that are read left out."""
    flat = lambda v: {} if isinstance(v, dict) else [] if isinstance(v, list) else v
    keep = {k: o[k] for k in [*JSON_REQUIRED, "args"] if k in o}
    if isinstance(keep.get("args"), dict):
        keep["args"] = {k: flat(v) for k, v in keep["args"].items() if k in _ARGS}
    return json.dumps({k: v if k == "args" and isinstance(v, dict) else flat(v) for k, v in keep.items()}, ensure_ascii=True)


def _reject(word: str):
    raise ValueError(word)


_STRICT = json.JSONDecoder(parse_constant=_reject, parse_float=lambda x: min(max(float(x), -1.7e308), 1.7e308), parse_int=lambda x: int(x) if len(x) < 4000 else 10**30 * (-1 if x[0] == "-" else 1), strict=True)
