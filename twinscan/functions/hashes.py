"""Perceptual hashes as column expressions, and the DCT hash as an Arrow function.

Hashes are 64-bit patterns in a long; null means no hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Integer brightness of a pixel: 30, 59 and 11 hundredths, truncated."""
    return F.floor((30 * r + 59 * g + 11 * b) / 100).cast("int")


def mean_gray(grid: Column) -> Column:
    """Integer mean of an array of grays (sum, then truncated division by its length)."""
    total = F.aggregate(grid, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.floor(total / F.size(grid)).cast("long")


def average_hash(grid: Column) -> Column:
    """Bit i is set where gray i is at least the mean; null unless there are 64 grays, none null."""
    held = F.transform(F.array(F.struct(grid.alias("g"), mean_gray(grid).alias("m"))), _pack)
    return F.when((F.size(grid) == 64) & ~F.exists(grid, lambda x: x.isNull()), F.element_at(held, 1))


def _pack(x: Column) -> Column:
    bits = F.transform(x["g"], lambda v, i: F.when(v >= x["m"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def popcount(h: Column) -> Column:
    return F.bit_count(h)


def hamming(a: Column, b: Column, mask: int | None = None) -> Column:
    """Differing bits of two hashes under ``mask``; 64 if either is missing."""
    diff = a.bitwiseXOR(b)
    diff = diff if mask is None else diff.bitwiseAND(F.lit(mask).cast("long"))
    return F.coalesce(F.bit_count(diff), F.lit(64))


def peak_hash(f1: Column, f2: Column, dt: Column) -> Column:
    """First 10 hexadecimal digits of SHA-1 of ``f1|f2|dt``."""
    return F.substring(F.sha1(F.concat_ws("|", f1.cast("string"), f2.cast("string"), dt.cast("string"))), 1, 10)


SIDE = 32
_ROW = np.arange(SIDE)[:, None]
#: Orthonormal DCT-II basis.
BASIS = np.where(_ROW == 0, SIDE**-0.5, (2 / SIDE) ** 0.5 * np.cos(np.pi * _ROW * (np.arange(SIDE)[None, :] + 0.5) / SIDE))


def dct_hashes(grids: np.ndarray) -> np.ndarray:
    """Hashes of (n, 32, 32) grays: low bytes of the top-left 8x8 coefficients against their mean."""
    low = (np.trunc(BASIS @ grids @ BASIS.T).astype(np.int64) & 255)[:, :8, :8].reshape(len(grids), 64)
    bits = low >= (low.sum(1) // 64)[:, None]
    return np.bitwise_or.reduce(bits.astype(np.uint64) << np.arange(64, dtype=np.uint64), axis=1).astype(np.int64) if len(grids) else np.zeros(0, np.int64)


@F.pandas_udf(T.LongType())
def phash(grid: pd.Series) -> pd.Series:
    """DCT hash of an array of 1024 grays; null for any other."""
    fine = grid.map(lambda g: g is not None and len(g) == SIDE * SIDE)
    out = pd.Series(pd.NA, index=grid.index, dtype="Int64")
    if fine.any():
        out[fine] = dct_hashes(np.stack(grid[fine].to_list()).astype(float).reshape(-1, SIDE, SIDE))
    return out


def register(spark: SparkSession) -> None:
    """SQL functions ``ahash, hamming, peak_hash, phash`` for callers of ``spark.sql``."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION ahash(g ARRAY<INT>) RETURNS BIGINT RETURN
        CASE WHEN size(g) = 64 THEN aggregate(sequence(0, 63), 0L, (a, i) -> a | if(g[i] >= aggregate(g, 0L, (s, x) -> s + x) div 64, shiftleft(1L, i), 0L)) END"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION hamming(a BIGINT, b BIGINT) RETURNS INT RETURN coalesce(bit_count(a ^ b), 64)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION peak_hash(f1 INT, f2 INT, dt INT) RETURNS STRING RETURN substring(sha1(concat_ws('|', f1, f2, dt)), 1, 10)")
    spark.udf.register("phash", phash)
