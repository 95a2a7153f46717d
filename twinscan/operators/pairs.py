"""Self-joins on hash distance and on duration bands.

A row is (``id``, ``ord``, ``h``): pairs come with the smaller ``ord`` on the left. A distance must be
strictly below the limit, so a limit of 0 matches nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import hamming
from ..settings import DURATION_BANDS
from ..storage import materialize

FULL = (1 << 64) - 1
#: Values near one band's that a row may come with.
MOST_PROBES = 1000
#: Comparisons of two hashes in an array that cost what a row of a join does.
COMPARISONS = 100
#: Hashes of a block that is compared with another one at once, and the most blocks (larger ones from there on).
BLOCK, MOST_BLOCKS = 4096, 64


def bands_of(limit: int, mask: int | None = None, bands: int | None = None) -> list[int]:
    """Masks that split the compared bits into ``bands`` bands of nearly equal width (``limit`` if not given).

    Fewer than ``limit`` differing bits leave a band with at most (limit - 1) // bands of them. No band is
    without a bit: with fewer bits than bands, there are as many as bits.
    """
    bits = [i for i in range(64) if (FULL if mask is None else mask) >> i & 1]
    n = max(1, min(bands or limit, len(bits)))
    cut = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cut, cut[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _probes(width: int, flips: int) -> int:
    """Values within ``flips`` bits of one of ``width`` bits."""
    return sum(math.comb(width, k) for k in range(flips + 1))


def band_cost(n: int, limit: int, mask: int | None, bands: int) -> float:
    """Rows that probe, and rows that meet in the join, for n hashes."""
    width, flips = bin(FULL if mask is None else mask).count("1") / bands, (limit - 1) // bands
    probes = _probes(math.ceil(width), flips)
    return bands * probes * (n + n * n / 2 / 2**width) if probes <= MOST_PROBES else math.inf


def band_count(n: int, limit: int, mask: int | None = None) -> int:
    """How many bands cost least for n hashes."""
    bits = bin(FULL if mask is None else mask).count("1")
    return min(range(1, max(1, min(limit, bits)) + 1), key=lambda bands: band_cost(n, limit, mask, bands))


def in_blocks(n: int, limit: int, mask: int | None = None) -> bool:
    """Whether comparing all of n hashes in arrays costs less than the join of bands: far limits, few bits."""
    return n * n / 2 / COMPARISONS < band_cost(n, limit, mask, band_count(n, limit, mask))


def flips_of(mask: int, flips: int) -> list[int]:
    """All patterns of at most ``flips`` bits of ``mask``."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [_signed(sum(c)) for k in range(min(flips, len(bits)) + 1) for c in combinations(bits, k)]


def hash_pairs(seen: DataFrame, limit: int, mask: int | None, keys: list[str], n: int, other: DataFrame | None = None) -> DataFrame:
    """``keys..., ha, hb`` of the distinct hashes in ``seen`` with a distance below ``limit``, ha <= hb.

    other: the distinct hashes that hb is from, if not the same (then in any order).

    Pigeonhole join: two such hashes differ in some band by at most (limit - 1) // bands bits, so one side
    comes with its bands and the other with all values that near. Where that would make more rows than it
    saves (``in_blocks``), blocks of hashes are compared whole. Both are lossless. The join is a merge: a table
    of hashes is small, its bands are not, and the planner would send them through the driver.
    """
    if limit > bin(FULL if mask is None else mask).count("1"):
        raise ValueError("limit is above the number of compared bits: every pair is below it")
    if not keys and in_blocks(n, limit, mask):
        return _blocks(seen, limit, mask, n, other)
    return _banded(seen, limit, mask, keys, n, other)


def _banded(seen: DataFrame, limit: int, mask: int | None, keys: list[str], n: int, other: DataFrame | None) -> DataFrame:
    masks = bands_of(limit, mask, band_count(n, limit, mask))
    h, flips = F.col("h"), (limit - 1) // len(masks)

    def band(i: int, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(i).alias("_band"), v.alias("_value")))

    def bands(of: Callable[[int, Column], Column]) -> Column:
        return F.explode(F.flatten(F.array(*[band(i, of(m, h.bitwiseAND(F.lit(_signed(m)).cast("long")))) for i, m in enumerate(masks)])))

    def near(m: int, value: Column) -> Column:
        patterns = flips_of(m, flips)
        return F.transform(F.lit(patterns).cast("array<bigint>"), lambda x: value.bitwiseXOR(x)) if len(patterns) > 1 else F.array(value)

    a = seen.select(*keys, h.alias("ha"), bands(lambda m, v: F.array(v)).alias("c")).select(*keys, "ha", "c.*")
    b = (seen if other is None else other).select(*keys, h.alias("hb"), bands(near).alias("c")).select(*keys, "hb", "c.*")
    met = a.join(b.hint("merge"), [*keys, "_band", "_value"])
    order = F.col("ha") <= F.col("hb") if other is None else F.lit(True)
    return met.where(order & (hamming(F.col("ha"), F.col("hb"), mask) < limit)).select(*keys, "ha", "hb").distinct()


def near_hashes(left: np.ndarray, right: np.ndarray, limit: int, mask: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in two arrays of hashes whose distance is below ``limit``, some rows of ``left`` at a time."""
    full = FULL if mask is None else mask
    kind = np.uint32 if full < 1 << 32 else np.uint64
    x, y = ((v.view(np.uint64) & np.uint64(full)).astype(kind) for v in (left, right))
    rows = max(1, (1 << 16) // max(1, len(y)))
    diff, bits, near = (np.empty((rows, len(y)), t) for t in (kind, np.uint8, np.bool_))
    for at in range(0, len(x), rows):
        k = min(rows, len(x) - at)
        np.bitwise_xor(x[at : at + k, None], y[None], out=diff[:k])
        np.bitwise_count(diff[:k], out=bits[:k])
        np.less(bits[:k], limit, out=near[:k])
        i, j = np.divmod(np.flatnonzero(near[:k]), len(y))
        yield i + at, j


def _blocks(seen: DataFrame, limit: int, mask: int | None, n: int, other: DataFrame | None) -> DataFrame:
    """``ha, hb`` by comparing every block of hashes with itself and all others, each pair of blocks once."""
    spark = seen.sparkSession
    count, alone = max(1, min(MOST_BLOCKS, -(-n // BLOCK))), other is None

    def dealt(hashes: DataFrame) -> DataFrame:
        return materialize(hashes.groupBy(F.pmod(F.xxhash64("h"), F.lit(count)).alias("k")).agg(F.collect_list("h").alias("held")), "hash-blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["ha", "hb"])

        found, many = [], 0
        for b in batches:
            for same, left, right in zip(*b.columns, strict=True):
                x, y = left.values.to_numpy(), right.values.to_numpy()
                for i, j in near_hashes(x, y, limit, mask):
                    p, q = x[i], y[j]
                    if same.as_py():
                        p, q = p[p <= q], q[p <= q]
                    elif alone:
                        p, q = np.minimum(p, q), np.maximum(p, q)
                    found.append((p, q))
                    many += len(p)
                    if many > 1 << 18 or len(found) > 1 << 14:
                        yield batch()
                        found, many = [], 0
        if found:
            yield batch()

    a = dealt(seen)
    b = a if alone else dealt(other)
    least = F.col("k") if alone else F.lit(0).cast("long")
    left = a.select("k", F.col("held").alias("left"), F.explode(F.sequence(least, F.lit(count - 1).cast("long"))).alias("j"))
    met = left.join(b.select(F.col("k").alias("j"), F.col("held").alias("right")).hint("merge"), "j")
    same = (F.col("k") == F.col("j")) & F.lit(alone)
    tasks = min(count * (count + 1), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return met.select(same.alias("same"), "left", "right").repartition(tasks).mapInArrow(compare, "ha long, hb long")


def _held(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, int]:
    """Rows with a hash, the distinct hashes, and their number, which chooses the bands."""
    held = rows.where(F.col("h").isNotNull())
    seen = materialize(held.select(*keys, "h").distinct(), "hashes-seen")
    return held, seen, seen.count()


def hamming_pairs(rows: DataFrame, limit: int, mask: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Pairs with a distance below ``limit``: ``keys..., id_a, id_b, distance``.

    Rows of one hash are folded before the join, so large groups of equal hashes meet as single rows until
    the pairs are listed (``hamming_links`` doesn't list them). keys: columns that must be equal as well.
    Rows without a hash have no pairs.
    """
    keys = keys or []
    if limit <= 0:
        return rows.select(*keys, F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.lit(0).alias("distance")).where("false")
    held, seen, n = _held(rows, keys)
    met = hash_pairs(seen, limit, mask, keys, n)
    return _listed(met, held, held, mask, keys)


def _listed(met: DataFrame, a: DataFrame, b: DataFrame, mask: int | None, keys: list[str]) -> DataFrame:
    """Rows of pairs of hashes, the smaller ``ord`` first."""
    left = a.select(*keys, F.col("h").alias("ha"), F.col("id").alias("i"), F.col("ord").alias("oi"))
    right = b.select(*keys, F.col("h").alias("hb"), F.col("id").alias("j"), F.col("ord").alias("oj"))
    listed = met.join(left, [*keys, "ha"]).join(right, [*keys, "hb"])
    if a is b:
        listed = listed.where((F.col("ha") != F.col("hb")) | (F.col("oi") < F.col("oj")))
    first = F.col("oi") < F.col("oj")
    return listed.select(
        *keys,
        F.when(first, F.col("i")).otherwise(F.col("j")).alias("id_a"),
        F.when(first, F.col("j")).otherwise(F.col("i")).alias("id_b"),
        hamming(F.col("ha"), F.col("hb"), mask).alias("distance"),
    )


def hamming_matches(new: DataFrame, known: DataFrame, limit: int, mask: int | None = None) -> DataFrame:
    """Pairs of a row of ``new`` with another row of ``new`` or a row of ``known``: ``id_a, id_b, distance``.

    Known rows are not joined with each other. No id may be in both.
    """
    own = hamming_pairs(new, limit, mask)
    if limit <= 0:
        return own
    (mine, seen, n), (theirs, other, m) = _held(new, []), _held(known, [])
    return own.unionByName(_listed(hash_pairs(seen, limit, mask, [], max(n, m), other), mine, theirs, mask, []))


def hamming_links(rows: DataFrame, limit: int, mask: int | None = None) -> DataFrame:
    """``id_a, id_b`` that connect what ``hamming_pairs`` does, for grouping: linear in groups of equal hashes.

    The least row of a hash stands for it in pairs of hashes, and its other rows lead to it.
    """
    held, seen, n = _held(rows, [])
    least = materialize(held.groupBy("h").agg(F.min("id").alias("id_a")), "hash-least")
    star = held.join(least, "h").where("id != id_a").select("id_a", F.col("id").alias("id_b"))
    if limit <= 0:
        return star.where("false")
    met = hash_pairs(seen, limit, mask, [], n).where("ha != hb")
    other = least.select(F.col("h").alias("hb"), F.col("id_a").alias("id_b"))
    return star.unionByName(met.join(least.withColumnRenamed("h", "ha"), "ha").join(other, "hb").select("id_a", "id_b"))


def band_table(spark: SparkSession, bands: tuple[tuple[int, int, int], ...] = DURATION_BANDS) -> DataFrame:
    """The bands as a table of as many rows: ``band, lo, hi, seek``."""
    held = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(s).alias("seek")) for i, (lo, hi, s) in enumerate(bands)])
    return spark.range(1).select(F.inline(held))


def duration_bands(rows: DataFrame, bands: tuple[tuple[int, int, int], ...] = DURATION_BANDS, length: Column | None = None) -> DataFrame:
    """Rows once per band that their length is in (both ends count): adds ``band, seek, tail_at``."""
    length = F.col("length") if length is None else length
    inside = F.array_compact(
        F.array(*[F.when(length.between(lo, hi), F.struct(F.lit(i).alias("band"), F.lit(s).alias("seek"))) for i, (lo, hi, s) in enumerate(bands)])
    )
    return rows.withColumn("_b", F.explode(inside)).select(*rows.columns, "_b.band", "_b.seek", (length - F.col("_b.seek")).alias("tail_at"))


def head_tail_pairs(rows: DataFrame, limit: int, mask: int | None = None) -> DataFrame:
    """Pairs inside a band alike at their head, or else at their tail.

    rows: ``id, ord, band, head, tail``. Returns ``band, id_a, id_b, kind`` (HEAD or TAIL); a pair may
    come once per band that both are in.
    """
    base = rows.select("id", "ord", "band", "head", "tail")
    head = hamming_pairs(base.withColumn("h", F.col("head")), limit, mask, ["band"])
    tail = hamming_pairs(base.withColumn("h", F.col("tail")), limit, mask, ["band"])
    both = head.select("band", "id_a", "id_b", F.lit("HEAD").alias("kind")).unionByName(tail.select("band", "id_a", "id_b", F.lit("TAIL").alias("kind")))
    return both.groupBy("band", "id_a", "id_b").agg(F.min("kind").alias("kind"))
