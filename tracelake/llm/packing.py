"""Filling containers of fixed capacity with whole texts that are alike.

Documents are range-sorted by their key on a space-filling curve, so a chunk, and each stretch of it, holds
texts of like contents. A stretch is packed best fit, longest first; containers with room left stay open for
the next stretch, which keeps the unused space small. Only a text longer than the capacity is split, into
full containers and a rest that is packed like any text.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracelake.llm.tokens import TOKENIZER, sized_vectors
from tracelake.operators.chunked import range_chunks
from tracelake.session import cut

_SCHEMA = "pack_kind string, container string, capacity_tokens long, container_tokens long, doc_id long, from_token long, n_tokens long"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
MAX_KINDS = 1000


class Packer:
    """Containers of one capacity. Items are (tokens, doc_id, from_token)."""

    def __init__(self, capacity: int, keep_open: int) -> None:
        self.capacity, self.keep_open = capacity, keep_open
        self.free: list[tuple[int, int]] = []  # (room, container), sorted
        self.items: dict[int, list[tuple[int, int, int]]] = {}
        self.made = 0

    def _new(self) -> int:
        self.made += 1
        self.items[self.made] = []
        return self.made

    def add(self, stretch: list[tuple[int, int, int]]) -> list[int]:
        """Pack a stretch; returns the containers that are done."""
        done, whole = [], []
        for size, doc, _ in stretch:
            at = 0
            while size - at > self.capacity:
                c = self._new()
                self.items[c].append((self.capacity, doc, at))
                done.append(c)
                at += self.capacity
            whole.append((size - at, doc, at))
        whole.sort(key=lambda x: (-x[0], x[1], x[2]))
        for item in whole:
            k = bisect_left(self.free, (item[0], 0))
            room, c = self.free.pop(k) if k < len(self.free) else (self.capacity, self._new())
            self.items[c].append(item)
            if room > item[0]:
                insort(self.free, (room - item[0], c))
            else:
                done.append(c)
        while len(self.free) > self.keep_open:  # the fullest are closed
            done.append(self.free.pop(0)[1])
        return done

    def rest(self) -> list[int]:
        done = [c for _, c in self.free]
        self.free = []
        return done


def pack(docs: DataFrame, capacities: DataFrame, path: str = TOKENIZER, stretch: int = 4096, keep_open: int = 64, docs_per_chunk: int = 100_000) -> DataFrame:
    """pack_kind, container, capacity_tokens, container_tokens (its fill), doc_id, from_token, n_tokens: one row per text or piece.

    Every non-NULL text is placed once in each capacity of `capacities` (pack_kind, capacity_tokens); empty texts
    take no room but are placed too. NULL texts have nothing to place; kinds without a capacity above 0 are left
    out. Repeated documents are placed as often as they occur. Chunks have about `docs_per_chunk` documents; each
    leaves at most `keep_open` containers that nothing more fits into. `capacities` is a setting with a row per
    kind, refused beyond MAX_KINDS.
    """
    kinds = [(r[0], int(r[1])) for r in capacities.select("pack_kind", "capacity_tokens").distinct().filter("capacity_tokens > 0").orderBy("pack_kind", "capacity_tokens").limit(MAX_KINDS + 1).collect()]
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} capacities")
    sized = cut(sized_vectors(docs, path=path))
    chunks = range_chunks(sized, ["curve", "doc_id", "n_tokens"], max(1, math.ceil(sized.count() / docs_per_chunk)))
    return chunks.mapInArrow(lambda it: _pack(it, kinds, stretch, keep_open), _SCHEMA)


def fills(packed: DataFrame) -> DataFrame:
    """pack_kind, capacity_tokens, n_containers, n_texts, n_tokens, fill: the filled share of all containers."""
    from pyspark.sql import functions as F

    n = F.countDistinct("container")
    return packed.groupBy("pack_kind", "capacity_tokens").agg(
        n.alias("n_containers"), F.count_if(F.col("from_token") == 0).alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), (F.sum("n_tokens") / (n * F.first("capacity_tokens"))).alias("fill")
    )


def _pack(batches: Iterator[pa.RecordBatch], kinds: list[tuple[str, int]], stretch: int, keep_open: int) -> Iterator[pa.RecordBatch]:
    chunk = TaskContext.get().partitionId()
    packers = [Packer(c, keep_open) for _, c in kinds]

    def rows(i: int, done: list[int]) -> Iterator[pa.RecordBatch]:
        name, p = kinds[i][0], packers[i]
        out = []
        for c in done:
            items = p.items.pop(c)
            fill = sum(x[0] for x in items)
            out += [(name, f"{name}-{p.capacity}-{chunk:05d}-{c:08d}", p.capacity, fill, doc, at, size) for size, doc, at in items]
        for k in range(0, len(out), 50_000):
            yield pa.record_batch([pa.array(list(col), t) for col, t in zip(zip(*out[k : k + 50_000]), _TYPES)], names=_NAMES)

    held: list[tuple[int, int, int]] = []
    for b in batches:
        held += [(n, doc, 0) for n, doc in zip(b.column(1).to_pylist(), b.column(0).to_pylist())]
        while len(held) >= stretch:
            for i, p in enumerate(packers):
                yield from rows(i, p.add(held[:stretch]))
            held = held[stretch:]
    for i, p in enumerate(packers):
        yield from rows(i, p.add(held) + p.rest())
