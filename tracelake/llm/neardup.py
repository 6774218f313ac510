"""Near copies of which one ends early, by min-hash banding of what comes before the end.

A text that was cut and its whole copy are alike up to the cut, however little of the text is left, but as whole
texts they may differ in nearly everything. So an asking text's signature covers its shingles up to its last
whole one, and a copy's signature is taken at every place where that last shingle stands in it: the two sets are
near copies of each other if the texts are. A band's key joins the shingle, how the next word begins and six
min-hashes, so texts meet only if they share the words at the end and, with probability 1 - (1 - s^6)^20 (0.998 at
a similarity of 0.8, 1 for a plain cut), those before. The key also holds the asking text's last word, with which
the copy's next word must begin.

What is moved grows with the asking texts, not with the places or keys at which others go on. First only the stems
(the last shingle and the last word) of asking texts are looked for, and each task combines what it finds per stem;
texts whose stem stands nowhere else ask no further. Keys are made for the others only, and of the texts that go
on at a key each task keeps the one that goes on for longest. Bit tables of bounded size keep nearly all other
stems and keys from being moved at all.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators.bits import WORDS, as_array, bit_table, perhaps, with_bit
from tracelake.session import cut, ship

SHINGLE_WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 6
_BLOCK = 8192
#: Places whose keys are made at once.
_PLACES = 4096
#: Most words of 64 bits that a bit table of asked places, stems or keys has.
MOST_WORDS = 1 << 22
#: Bytes of a last word that a stem holds at most.
STEM_BYTES = 24
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_MIX = _rng.integers(1, 2**63, max(SHINGLE_WORDS, BANDS), dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of words: ASCII letters, digits and underscores, and every byte of other characters.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words of some bytes; the running sums, and for each word the factor, by which `hashed` gives hashes of words and of how they begin."""
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _IN_WORD[b]
    edge = np.diff(inside)
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        power = np.full(len(b) + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        upto = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1], out=upto[1:])
        back = np.full(len(b) + 1, _INVERSE, np.uint64)
        back[0] = 1
        back = np.cumprod(back)[begins]
    return begins, ends, upto, back


def hashed(begins: np.ndarray, ends: np.ndarray, upto: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes, each a polynomial of its bytes."""
    with np.errstate(over="ignore"):
        return _scramble((upto[ends] - upto[begins]) * back)


def _joined(x: np.ndarray, y: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _scramble(x ^ ((np.asarray(y).astype(np.uint64) + np.uint64(1)) * _MIX[0]))


class Block:
    """Some texts as words, all at once: `starts` (the first word of each text, and the end), the words' `hashes`, and for each word
    `owner` (the text), `shingles` (the five words from it; only where `whole`) and `places` (the shingle and how the next word
    begins; only where `followed`)."""

    def __init__(self, coded: Sequence[bytes]):
        self.data = b" ".join(coded)
        self.begins, self.ends, self.upto, self.back = words(self.data)
        self.hashes = hashed(self.begins, self.ends, self.upto, self.back)
        n = len(self.hashes)
        self.starts = np.append(np.searchsorted(self.begins, np.cumsum([0] + [len(c) + 1 for c in coded[:-1]])), n)
        self.owner = np.repeat(np.arange(len(coded)), np.diff(self.starts))
        padded = np.concatenate([self.hashes, np.zeros(SHINGLE_WORDS, np.uint64)])
        self.shingles = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(SHINGLE_WORDS):
                self.shingles = (self.shingles ^ padded[i : i + n]) * _MIX[i]
                self.shingles ^= self.shingles >> np.uint64(29)
        left = self.starts[self.owner + 1] - np.arange(n)
        self.whole, self.followed = left >= SHINGLE_WORDS, left > SHINGLE_WORDS
        head = np.zeros(n + SHINGLE_WORDS, np.uint8)
        head[:n] = np.frombuffer(self.data, np.uint8)[self.begins]
        self.places = _joined(self.shingles, head[SHINGLE_WORDS:])

    def begun(self, word: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of the first `size` bytes of words."""
        return hashed(self.begins[word], self.begins[word] + size, self.upto, self.back[word])

    def last(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text that has a place: its number, its last place, and the hash of its last word, which may be cut.

        Of that word only what stands before its first byte that isn't ASCII (but at least a byte), and STEM_BYTES
        at most: a dash or quote that isn't ASCII may stand apart in a copy.
        """
        texts = np.flatnonzero(np.diff(self.starts) > SHINGLE_WORDS)
        word = self.starts[texts + 1] - 1
        size = []
        for a, z in zip(self.begins[word].tolist(), self.ends[word].tolist()):
            w = self.data[a : min(z, a + STEM_BYTES)]
            size.append(max(1, len(w) if w.isascii() else next(i for i, c in enumerate(w) if c > 127)))
        return texts, word - SHINGLE_WORDS, self.begun(word, np.array(size, np.int64))

    def stems(self, asked: np.ndarray, stems: np.ndarray, full: Sequence[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Places, and the hash of how the next word begins, where `asked` (places) and `stems` (those with that hash) may be asked for.

        What ends there too has to end with a longer word, or with a full stop (`full`, of each text). Where a text
        has a place several times and one of them goes on as asked, all where it goes on count: what stands before
        another of them may be more like the asking text.
        """
        hits = np.flatnonzero(self.followed & perhaps(asked, self.places.view(np.int64)))
        word = hits + SHINGLE_WORDS
        most = self.ends[word] - self.begins[word]
        closing = word + 1 == self.starts[self.owner[word] + 1]
        most -= closing & ~np.asarray(full, bool)[self.owner[word]]
        inner = hits[~closing]
        at, begun = [], []
        for n in range(1, min(STEM_BYTES, int(most.max(initial=0))) + 1):
            some = most >= n
            hits, word, most = hits[some], word[some], most[some]
            h = self.begun(word, n)
            found = perhaps(stems, _joined(self.places[hits], h).view(np.int64))
            at.append(hits[found])
            begun.append(h[found])
        if not at:
            return hits, np.zeros(0, np.uint64)
        at, begun = np.concatenate(at), np.concatenate(begun)
        of = _joined(self.places[inner], self.owner[inner])  # a text's place, wherever it stands
        order = np.argsort(of, kind="stable")
        asks = np.unique(np.stack([_joined(self.places[at], self.owner[at]), begun]), axis=1)
        low, high = np.searchsorted(of[order], asks[0], "left"), np.searchsorted(of[order], asks[0], "right")
        n = high - low
        each = inner[order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
        last = at + SHINGLE_WORDS + 1 == self.starts[self.owner[at] + 1]
        at, begun = np.concatenate([each, at[last]]), np.concatenate([np.repeat(asks[1], n), begun[last]])
        order = np.argsort(at, kind="stable")
        return at[order], begun[order]

    def minima(self, at: np.ndarray) -> np.ndarray:
        """The min-hashes of the shingles from the text's first to each of `at` (rows), which ascend."""
        own, counts = np.unique(self.owner[at], return_counts=True)
        out = np.empty((len(at), len(_MUL)), np.uint32)
        short = ((self.shingles >> np.uint64(32)) ^ self.shingles).astype(np.uint32)
        done = 0
        for text, k in zip(own.tolist(), counts.tolist()):
            here = at[done : done + k]
            low, first = None, int(self.starts[text])
            for i in range(0, k, _PLACES):
                some = here[i : i + _PLACES]
                cuts = np.append(first, some + 1)
                rows = _segment_minima(short, cuts)
                if low is not None:
                    rows[0] = np.minimum(rows[0], low)
                np.minimum.accumulate(rows, axis=0, out=out[done + i : done + i + len(some)])
                low, first = out[done + i + len(some) - 1], int(some[-1]) + 1
            done += k
        return out

    def keys(self, at: np.ndarray) -> np.ndarray:
        """A key per band (columns) of the texts up to each place of `at` (rows), which ascend."""
        m = self.minima(at).astype(np.uint64).reshape(len(at), BANDS, ROWS)
        with np.errstate(over="ignore"):
            h = self.places[at][:, None] ^ _MIX[:BANDS]
            for r in range(ROWS):
                h = (h ^ m[:, :, r]) * _MIX[r]
                h ^= h >> np.uint64(31)
        return _scramble(h).view(np.int64)

    def asking(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """Of each text that has a place: its number, its last place, and its keys there, one per band."""
        texts, at, begun = self.last()
        for k in range(0, len(at), _PLACES):
            keys = _joined(self.keys(at[k : k + _PLACES]).view(np.uint64), begun[k : k + _PLACES, None]).view(np.int64)
            yield from zip(texts[k : k + _PLACES].tolist(), self.places[at[k : k + _PLACES]].view(np.int64).tolist(), keys)


def _segment_minima(short: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The min-hashes of short[cuts[i] : cuts[i + 1]] for each i; a long stretch goes in blocks."""
    a, z = int(cuts[0]), int(cuts[-1])
    out = np.full((len(cuts) - 1, len(_MUL)), np.iinfo(np.uint32).max, np.uint32)
    for k in range(a, z, _BLOCK):
        end = min(z, k + _BLOCK)
        with np.errstate(over="ignore"):
            h = short[k:end, None] * _MUL + _ADD
        first = int(np.searchsorted(cuts, k, "right")) - 1
        inner = cuts[(cuts > k) & (cuts < end)]
        part = np.minimum.reduceat(h, np.append(k, inner) - k, axis=0)
        out[first : first + len(part)] = np.minimum(out[first : first + len(part)], part)
    return out


def blocks(texts: Sequence[str], enough: int = 1 << 19) -> Iterator[tuple[int, Block]]:
    """(number of the first text, block) of many texts at a time."""
    coded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    first = 0
    while first < len(coded):
        last, size = first, 0
        while last < len(coded) and (last == first or size + len(coded[last]) < enough):
            size += len(coded[last]) + 1
            last += 1
        yield first, Block(coded[first:last])
        first = last


def shingle_sets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of a text, and those that a word follows."""
    _, b = next(blocks([text]))
    return np.unique(b.shingles[b.whole]), np.unique(b.shingles[b.followed])


@functools.lru_cache(512)
def _sets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text is compared with several others, one after another."""
    return shingle_sets(text)


def share_in(x: np.ndarray, y: np.ndarray) -> float:
    return len(np.intersect1d(x, y, assume_unique=True)) / len(x) if len(x) else 0.0


def contained(a: str, b: str) -> float:
    """The share of the different shingles of `a`, its last word left out, that `b` has too."""
    return share_in(_sets(a)[1], _sets(b)[0])


GOES_ON = "key long, copy long, rest int"


def last_places(texts: Sequence[str]) -> Iterator[tuple[int, int, int]]:
    """Of each text that has a place: its number, its last place, and its stem: that place and the last word."""
    for first, block in blocks(texts):
        of, at, begun = block.last()
        yield from zip((first + of).tolist(), block.places[at].view(np.int64).tolist(), _joined(block.places[at], begun).view(np.int64).tolist())


def table_words(keys: int) -> int:
    """Words of a bit table for so many keys: one for each, but at least WORDS and at most MOST_WORDS."""
    return min(MOST_WORDS, max(WORDS, 1 << max(0, keys - 1).bit_length()))


def _tables(asking: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = table_words(n)
    return as_array(bit_table(asking, "last", size), size), as_array(bit_table(asking, "keys", size), size)


def full_stops(texts: Sequence[str]) -> list[bool]:
    return [t.rstrip().endswith((".", "!", "?")) for t in texts]


def met_texts(docs: DataFrame, asking: DataFrame) -> DataFrame:
    """Those of `asking` (copy, last, keys: as `last_places` gives them) at whose stem another text of `docs` (copy, text) goes on.

    A row per stem and task is moved, however many texts go on there.
    """
    spark = docs.sparkSession
    ship(spark)
    tables = spark.sparkContext.broadcast(_tables(asking, asking.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, stems = tables.value
        for b in batches:
            copies = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            full = full_stops(texts)
            for first, block in blocks(texts):
                at, begun = block.stems(asked, stems, full[first : first + len(block.starts) - 1])
                if len(at):
                    yield pa.record_batch([pa.array(_joined(block.places[at], begun).view(np.int64)), pa.array(copies[first + block.owner[at]])], names=["keys", "other"])

    found = docs.select("copy", "text").mapInArrow(run, "keys long, other long").groupBy("keys").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    return asking.join(found, "keys").filter("lo <> copy or hi <> copy").select("copy", "last", "keys")


def own_keys(docs: DataFrame, asking: DataFrame) -> DataFrame:
    """copy, band_keys of the texts of `asking` (copy), whose texts are read from `docs` (copy, text) once more."""
    from tracelake.llm.truncation import ending

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies = b.column(0).to_pylist()
            for first, block in blocks([ending(t)[0] for t in b.column(1).to_pylist()]):
                rows = [(copies[first + i], k) for i, _, k in block.asking()]
                yield pa.record_batch([pa.array([c for c, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.list_(pa.int64()))], names=["copy", "band_keys"])

    size = table_words(asking.count())
    some = with_bit(docs.select("copy", "text"), "copy", bit_table(asking, "copy", size), "_tl_in", size).filter("_tl_in").select("copy", "text")
    made = some.mapInArrow(run, "copy long, band_keys array<long>").groupBy("copy").agg(F.first("band_keys").alias("band_keys"))
    return made.join(asking.select("copy"), "copy", "left_semi")


def going_on(docs: DataFrame, asking: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of GOES_ON: the texts of `docs` (copy, text) that go on at one of `keys` (key), which texts of `asking` (last, keys) ask for, perhaps among others that nobody asks for.

    `rest`: words that follow. A text may come more than once at a key only if `docs` has it more than once.
    """
    spark = docs.sparkSession
    size = table_words(keys.count())
    tables = spark.sparkContext.broadcast((*_tables(asking, asking.count()), as_array(bit_table(keys, "key", size), size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, stems, wanted = tables.value
        for b in batches:
            copies = b.column(0).to_numpy(zero_copy_only=False)
            texts = b.column(1).to_pylist()
            full = full_stops(texts)
            for first, block in blocks(texts):
                at, begun = block.stems(asked, stems, full[first : first + len(block.starts) - 1])
                for i in range(0, len(at), _PLACES):
                    here, of = np.unique(at[i : i + _PLACES], return_inverse=True)
                    k = _joined(block.keys(here).view(np.uint64)[of], begun[i : i + _PLACES, None]).view(np.int64)
                    hit, band = np.nonzero(perhaps(wanted, k))
                    if not len(hit):
                        continue
                    place = here[of[hit]]
                    key, text = k[hit, band], block.owner[place]
                    rest = (block.starts[text + 1] - place - SHINGLE_WORDS).astype(np.int32)
                    order = np.lexsort((-rest, text, key))
                    once = np.ones(len(order), bool)
                    once[1:] = (np.diff(key[order]) != 0) | (np.diff(text[order]) != 0)
                    order = order[once]
                    yield pa.record_batch([pa.array(key[order]), pa.array(copies[first + text[order]]), pa.array(rest[order])], names=["key", "copy", "rest"])

    return docs.select("copy", "text").mapInArrow(run, GOES_ON)


def meetings(docs: DataFrame, asking: DataFrame) -> DataFrame:
    """key, copy, partner, n: the keys of texts of `asking` (copy, last, keys) at which a text of `docs` (copy, text) goes on.

    `partner`: the text that goes on for longest there; `n`: how many do, or more. Each task combines the texts of
    a key before they are moved, so a key of any size moves a row per task.
    """
    ship(docs.sparkSession)
    own = cut(own_keys(docs, asking)).select("copy", F.explode("band_keys").alias("key"))
    heads = going_on(docs, asking, own).groupBy("key").agg(F.max(F.struct("rest", "copy")).alias("head"), F.count(F.lit(1)).alias("n"))
    return own.join(heads, "key").select("key", "copy", F.col("head.copy").alias("partner"), "n")


def first_partners(met: DataFrame) -> DataFrame:
    """copy, partner: for each asking text, at each of its keys, the text that goes on for longest."""
    return met.filter("copy <> partner").select("copy", "partner").distinct()


def members(block: Block, stems: tuple[np.ndarray, np.ndarray], full: Sequence[bool], keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the texts of `block` that go on at one of `keys` (sorted): which key, the text and the words that follow.

    `stems`: the bit tables of places and stems that the texts of those keys ask for.
    """
    at, begun = block.stems(*stems, full)
    for i in range(0, len(at), _PLACES):
        here, of = np.unique(at[i : i + _PLACES], return_inverse=True)
        k = _joined(block.keys(here).view(np.uint64)[of], begun[i : i + _PLACES, None]).view(np.int64)
        which = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
        hit, band = np.nonzero(keys[which] == k)
        place = here[of[hit]]
        text = block.owner[place]
        yield which[hit, band], text, block.starts[text + 1] - place - SHINGLE_WORDS
