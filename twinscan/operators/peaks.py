"""Constellation hashes of peak sequences, and the self-join on shared ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashes import peak_hash
from ..settings import PEAK_RATES, RATIO_MODES

FAN = 4
FARTHEST = 200
#: Files of one hash that a task joins with others.
SPLIT = 4096


def constellation(peaks: DataFrame, key: str = "id") -> DataFrame:
    """``key, hash, t``: every peak with each of its next four, at most 200 steps later.

    peaks: ``key, f, t``; their order is by (t, f). One window per key, one pass.
    """
    at = Window.partitionBy(key).orderBy("t", "f")
    ahead = [F.lead(F.struct("f", "t"), k).over(at).alias(f"_{k}") for k in range(1, FAN + 1)]
    paired = peaks.select(key, "f", "t", *ahead).select(key, "f", "t", F.explode(F.array(*[f"_{k}" for k in range(1, FAN + 1)])).alias("p"))
    near = paired.where(F.col("p").isNotNull() & (F.col("p.t") - F.col("t")).between(0, FARTHEST))
    return near.select(key, peak_hash(F.col("f"), F.col("p.f"), F.col("p.t") - F.col("t")).alias("hash"), "t")


def constellation_of(ordered: Column, timed: bool = False) -> Column:
    """The same for peaks that a row holds as an array of struct(f, t) in order: array<string>.

    timed: array<struct<hash, t>> instead. No shuffle: for sources that deliver a file's peaks together.
    """

    def all_pairs(held: Column) -> Column:
        def pairs(p: Column, i: Column) -> Column:
            near = F.filter(F.slice(held, i + 2, F.lit(FAN)), lambda q: (q["t"] - p["t"]).between(0, FARTHEST))
            hashed = lambda q: peak_hash(p["f"], q["f"], q["t"] - p["t"])
            return F.transform(near, lambda q: F.struct(hashed(q).alias("hash"), p["t"].alias("t")) if timed else hashed(q))

        return F.flatten(F.transform(held, pairs))

    # through an array of one, so that the peaks are computed once and not for every peak
    return F.element_at(F.transform(F.array(ordered), all_pairs), 1)


def fold(hashes: DataFrame, key: str = "id") -> DataFrame:
    """``key, hash, n``: equal hashes of a file as one row."""
    return hashes.groupBy(key, "hash").agg(F.count(F.lit(1)).alias("n"))


def sizes(folded: DataFrame, key: str = "id") -> DataFrame:
    """``key, size``: peaks of each file, repeated ones counted."""
    return folded.groupBy(key).agg(F.sum("n").alias("size"))


def required(a: Column, b: Column, distance: int) -> Column:
    """Shared peaks that a pair needs: a share of the smaller file's, at least 1."""
    if not 0 <= distance < len(PEAK_RATES):
        raise ValueError(f"distance must be 0 to {len(PEAK_RATES) - 1}")
    return F.greatest(F.lit(1).cast("long"), F.floor(F.least(a, b) * F.lit(PEAK_RATES[distance]) / 100).cast("long"))


def ratio_allows(a: Column, b: Column, mode: int) -> Column:
    """Whether two durations are near enough; mode 0 allows all."""
    k = RATIO_MODES[mode]
    return F.lit(True) if k == 0 else F.least(a, b) * (k + 1) >= F.greatest(a, b)


def shared_peaks(folded: DataFrame, key: str = "id", order: str = "ord", keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``id_a, id_b, hits``: peaks of the lower file that also occur in the other.

    Not symmetric: the lower file's repeated peaks all count. folded: ``key, order, hash, n``, and other
    columns, which come as ``a_`` and ``b_``; it is read three times and should be a written table.
    keep: a filter of pairs, applied before hits are summed. Both sides are folded, and hits are summed before
    they are shuffled. A hash of more than ``SPLIT`` files is split: its left rows are dealt to parts, and its
    right rows go to every part, so no task has all pairs of a frequent hash. None is dropped.
    """
    others = [c for c in folded.columns if c not in (key, order, "hash", "n")]
    common = folded.groupBy("hash").agg(F.count(F.lit(1)).alias("k")).where(f"k > {SPLIT}").select("hash", F.ceil(F.col("k") / SPLIT).cast("int").alias("parts"))
    parted = folded.join(common, "hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = parted.select(F.col(key).alias("id_a"), F.col(order).alias("oa"), "hash", "n", F.pmod(F.xxhash64(key), "parts").cast("int").alias("part"), *[F.col(c).alias(f"a_{c}") for c in others])
    b = parted.select(F.col(key).alias("id_b"), F.col(order).alias("ob"), "hash", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *[F.col(c).alias(f"b_{c}") for c in others])
    met = a.join(b, ["hash", "part"]).where("oa < ob")
    return (keep(met) if keep else met).groupBy("id_a", "id_b").agg(F.sum("n").alias("hits"))


def audio_pairs(folded: DataFrame, distance: int = 2, lengths: DataFrame | None = None, ratio_mode: int = 0, key: str = "id", order: str = "ord") -> DataFrame:
    """``id_a, id_b, hits, need``: pairs that share enough peaks.

    One equi-join of folded hashes, hits summed before the shuffle. A filter by rarest hashes first
    was slower here: small files need so few peaks that most pairs stay candidates.
    lengths: ``id, length`` for the ratio filter, applied before hits are summed.
    """
    if not 0 <= distance < len(PEAK_RATES):
        raise ValueError(f"distance must be 0 to {len(PEAK_RATES) - 1}")
    size = sizes(folded, key)
    if ratio_mode:
        long = folded.join(lengths.select(F.col("id").alias(key), "length"), key)
        hits = shared_peaks(long, key, order, lambda met: met.where(ratio_allows(F.col("a_length"), F.col("b_length"), ratio_mode)))
    else:
        hits = shared_peaks(folded, key, order)
    sized = hits.join(size.withColumnRenamed(key, "id_a").withColumnRenamed("size", "na"), "id_a").join(size.withColumnRenamed(key, "id_b").withColumnRenamed("size", "nb"), "id_b")
    return sized.withColumn("need", required(F.col("na"), F.col("nb"), distance)).where("hits >= need").select("id_a", "id_b", "hits", "need")
