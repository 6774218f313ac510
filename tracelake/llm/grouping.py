"""Streaming whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def grouped_stream(batches: Iterator[pa.RecordBatch], keys: list[str], weight: str | None = None, enough: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups from batches sorted by `keys`: cut at a group's end once `enough` rows are held
    (or list items of `weight`). A group larger than that comes whole."""
    held: list[pa.RecordBatch] = []
    load = 0

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        if load >= enough:
            last = [held[-1].column(k)[-1].as_py() for k in keys]
            differs = np.zeros(b.num_rows, bool)
            for k, v in zip(keys, last):
                other = pc.is_valid(b.column(k)) if v is None else pc.fill_null(pc.not_equal(b.column(k), v), True)
                differs |= other.to_numpy(zero_copy_only=False)
            if differs.any():
                n = int(differs.argmax())
                yield joined([*held, b.slice(0, n)] if n else held)
                held, load, b = [], 0, b.slice(n)
        held.append(b)
        load += len(b.column(weight).flatten()) if weight else b.num_rows
    if held:
        yield joined(held)
