"""Bit tables: which keys are perhaps in a set, in a space that doesn't grow with the set.

A key's hash names a word of the table and four of its bits, which are set for every key of the set. Where one of
them isn't set, the key is proven absent; else it may pass to an exact join. So most rows that would find no partner
are dropped where they are read, and nothing depends on how full the table is but the number of rows that pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits, and so rows, that a table has at most, unless said otherwise. A power of two.
WORDS = 1 << 18
_BITS = (0, 32, 38, 44)


def _place(key: Column, words: int) -> tuple[Column, Column]:
    h = F.xxhash64(key.cast("long"))
    one = F.lit(1).cast("long")
    mask = None
    for by in _BITS:
        bit = F.call_function("shiftleft", one, F.shiftright(h, by).bitwiseAND(F.lit(63)).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.shiftright(h, 6).bitwiseAND(F.lit(words - 1)), mask


def bit_table(df: DataFrame, key: str, words: int | None = None) -> DataFrame:
    """_tl_word, _tl_bits: the table of the whole numbers in `key` (NULL is none). At most `words` rows, combined before the shuffle."""
    word, mask = _place(F.col(key), words or WORDS)
    return df.filter(F.col(key).isNotNull()).select(word.alias("_tl_word"), mask.alias("_tl_bits")).groupBy("_tl_word").agg(F.bit_or("_tl_bits").alias("_tl_bits"))


def with_bit(df: DataFrame, key: str, table: DataFrame, flag: str, words: int | None = None) -> DataFrame:
    """`df` with the column `flag`: whether `key` is perhaps among those of `table` (made with the same `words`), which is broadcast."""
    word, mask = _place(F.col(key), words or WORDS)
    joined = df.withColumn("_tl_word", word).join(F.broadcast(table), "_tl_word", "left")
    return joined.withColumn(flag, F.coalesce(F.col(key).isNotNull() & (F.col("_tl_bits").bitwiseAND(mask) == mask), F.lit(False))).drop("_tl_word", "_tl_bits")


def as_array(table: DataFrame, words: int | None = None) -> np.ndarray:
    """The whole table on the driver, for use by Python workers: `words` numbers, however many keys were set."""
    out = np.zeros(words or WORDS, np.int64)
    rows = table.toArrow()
    out[rows.column("_tl_word").to_numpy()] = rows.column("_tl_bits").to_numpy()
    return out


def table_of(keys: np.ndarray, words: int | None = None) -> np.ndarray:
    """What `as_array` gives for the set of `keys`."""
    out = np.zeros(words or WORDS, np.int64)
    h = _xxhash64(keys)
    mask = np.zeros(len(h), np.int64)
    for by in _BITS:
        mask |= np.int64(1) << ((h >> by) & 63)
    np.bitwise_or.at(out, (h >> 6) & (len(out) - 1), mask)
    return out


def perhaps(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of `keys` is perhaps in the set of `as_array`."""
    h = _xxhash64(keys)
    bits = table[(h >> 6) & (len(table) - 1)]
    out = np.ones(h.shape, bool)
    for by in _BITS:
        out &= (bits >> ((h >> by) & 63)) & 1 == 1
    return out


# The primes of the 64-bit xxHash, by which both sides place a key.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _xxhash64(keys: np.ndarray) -> np.ndarray:
    """What F.xxhash64 gives for longs."""
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = turn(keys.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        h = turn((np.uint64(42 + 8) + _P5) ^ h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)
