"""Bitmaps of 64-bit identifiers, of bounded size: they may say yes wrongly, but never no."""

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20  # 64-bit words of a bitmap
BITS = 64 * WORDS


def has(bitmap: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(ids), bool)
    return (bitmap[(ids & np.uint64(WORDS - 1)).astype(np.int64)] >> ((ids >> np.uint64(32)) & np.uint64(63))) & np.uint64(1) != 0


def packed(bitmap: np.ndarray | None) -> bytes | None:
    """A bitmap as it is broadcast: each executor keeps a file of it, which takes few bytes where few bits are set."""
    return None if bitmap is None else zlib.compress(bitmap, 1)


def unpacked(data: bytes | None) -> np.ndarray | None:
    return None if data is None else np.frombuffer(zlib.decompress(data), np.uint64)


def bitmap(df: DataFrame, column: str) -> np.ndarray:
    """A bitmap of a column of 64-bit identifiers; at most ``WORDS`` rows come to the driver."""
    c = F.col(column)
    word = F.expr(f"cast({column} & {WORDS - 1}L as int)").alias("word")
    bit = F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, 32) & 63L as int))")).alias("bits")
    got = df.where(c.isNotNull()).groupBy(word).agg(bit).toArrow()
    out = np.zeros(WORDS, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out
