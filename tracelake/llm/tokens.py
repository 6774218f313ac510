"""Sizes of texts in tokens of a public tokenizer, and hashed vectors of their contents."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import ship

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMENSIONS, BITS = 3, 10


@functools.cache
def encoding(path: str = TOKENIZER):
    """The tokenizer of a rank file (one base64 token and its rank a line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f) if t}
    return tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(docs: DataFrame, text: str = "text", path: str = TOKENIZER) -> DataFrame:
    """`docs` with n_tokens of the whole text; NULL and empty texts have 0. The text itself is dropped."""
    ship(docs.sparkSession)
    rest = [c for c in docs.columns if c not in (text, "n_tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(0).to_pylist()]
            yield pa.record_batch([*b.columns[1:], pa.array(n, pa.int64())], names=[*b.schema.names[1:], "n_tokens"])

    rows = docs.select(F.col(text).cast("string").alias("_tl_text"), *[F.col(f"`{c}`") for c in rest])
    schema = rows.drop("_tl_text").schema.add("n_tokens", "long")
    return rows.mapInArrow(count, schema)


def sized_vectors(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str = TOKENIZER, seed: int = 7) -> DataFrame:
    """doc_id, n_tokens, curve of each non-NULL text: its size and its key on a Hilbert curve.

    A document's vector has one place per token id; it is projected to DIMENSIONS by a random sign per token and
    dimension, over the different tokens it has, and scaled to unit variance. Each coordinate goes through the
    normal distribution to a grid of 2^BITS cells. Texts of like vocabulary get near cells, and the curve passes
    near cells one after another.
    """

    ship(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (enc.max_token_value + 1, DIMENSIONS))
        for b in batches:
            sizes, points = [], np.zeros((b.num_rows, DIMENSIONS))
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = enc.encode_ordinary(t)
                sizes.append(len(ids))
                if ids:
                    own = np.unique(np.array(ids))
                    points[i] = signs[own].sum(axis=0, dtype=np.int64) / np.sqrt(len(own))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(hilbert(grid(points)))], names=["doc_id", "n_tokens", "curve"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text is not null")
    return rows.mapInArrow(measure, "doc_id long, n_tokens long, curve long")


def grid(points: np.ndarray) -> np.ndarray:
    """Standard normal coordinates -> cells 0..2^BITS - 1 of about equal mass (logistic form of the normal distribution)."""
    z = np.clip(points, -8, 8)
    u = 1 / (1 + np.exp(-1.5976 * z - 0.07056 * z**3))
    return np.minimum((u * 2**BITS).astype(np.int64), 2**BITS - 1)


def hilbert(cells: np.ndarray) -> np.ndarray:
    """Position of each cell on the Hilbert curve through the grid (transpose form, many cells at once)."""
    x = cells.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            t = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, t)
            x[:, i] ^= t
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (BITS - 1)
    while q > 1:
        t ^= np.where(x[:, n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(BITS - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key
