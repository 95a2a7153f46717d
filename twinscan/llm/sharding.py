"""Sharding of documents by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts by default) are aggregated on the executors; the driver only sees how many
groups there are of each size. That histogram has at most sqrt(2 * total bytes) entries, since
k different sizes need at least k*k/2 bytes. Same-size groups are interchangeable, so packing
the histogram is packing the groups: best fit puts the next group of a size into the bin that
took the last one while that still fits, hence whole runs are placed at once. Open bins sit in a
balanced tree by remaining capacity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, rank_within


class CapacityTree:
    """AVL tree of (remaining capacity, bin): insert, remove, and the tightest bin that fits."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list | None = None  # node: [key, left, right, height]

    @staticmethod
    def _height(node: list | None) -> int:
        return node[3] if node else 0

    def _fix(self, node: list) -> list:
        left, right = self._height(node[1]), self._height(node[2])
        if left > right + 1:
            if self._height(node[1][1]) < self._height(node[1][2]):
                node[1] = self._turn(node[1], 2)
            return self._turn(node, 1)
        if right > left + 1:
            if self._height(node[2][2]) < self._height(node[2][1]):
                node[2] = self._turn(node[2], 1)
            return self._turn(node, 2)
        node[3] = 1 + max(left, right)
        return node

    def _turn(self, node: list, side: int) -> list:
        up = node[side]
        node[side], up[3 - side] = up[3 - side], node
        node[3] = 1 + max(self._height(node[1]), self._height(node[2]))
        up[3] = 1 + max(self._height(up[1]), self._height(up[2]))
        return up

    def insert(self, key: tuple[int, int]) -> None:
        def put(node: list | None) -> list:
            if node is None:
                return [key, None, None, 1]
            side = 1 if key < node[0] else 2
            node[side] = put(node[side])
            return self._fix(node)

        self.root = put(self.root)

    def remove(self, key: tuple[int, int]) -> None:
        def cut_first(node: list) -> tuple[list, list | None]:
            if node[1] is None:
                return node, node[2]
            first, node[1] = cut_first(node[1])
            return first, self._fix(node)

        def take(node: list | None) -> list | None:
            if node is None:
                raise KeyError(key)
            if key != node[0]:
                side = 1 if key < node[0] else 2
                node[side] = take(node[side])
                return self._fix(node)
            if node[1] is None or node[2] is None:
                return node[1] or node[2]
            first, rest = cut_first(node[2])
            first[1], first[2] = node[1], rest
            return self._fix(first)

        self.root = take(self.root)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) with remaining >= size."""
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                best, node = node[0], node[1]
            else:
                node = node[2]
        return best


@dataclass
class Packing:
    """Where the groups of each size go: runs (size, first rank, last rank + 1, bin, per bin).

    Ranks lo..hi-1 of that size go to bin + (rank - lo) // per_bin.
    """

    capacity: int
    bins: int
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def best_fit_decreasing(histogram: dict[int, int], capacity: int, most_bins: int | None = None) -> Packing | None:
    """Pack ``histogram`` (size -> groups) into bins of ``capacity``.

    A group above the capacity gets a bin of its own, as it can't be divided. None if more than
    ``most_bins`` bins were needed.
    """
    tree, out = CapacityTree(), Packing(capacity, 0)
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            key = tree.tightest(size)
            if key is None:
                break
            remaining, where = key
            k = min(left, remaining // size) if size else left
            tree.remove(key)
            tree.insert((remaining - k * size, where))
            out.runs.append((size, rank, rank + k, where, k))
            left, rank = left - k, rank + k
        if left:
            per = max(1, capacity // size) if size else left
            opened = -(-left // per)
            if most_bins is not None and out.bins + opened > most_bins:
                return None
            out.runs.append((size, rank, rank + left, out.bins, per))
            for i in range(opened):
                held = min(per, left - i * per)
                tree.insert((max(0, capacity - held * size), out.bins + i))
            out.bins += opened
    return out


def fit_into(histogram: dict[int, int], bins: int) -> Packing:
    """Groups above a fair share get bins of their own; the others the smallest capacity (by
    bisection) at which best fit needs at most the remaining bins.

    A fair share is the bytes by bin of what is not set apart yet.
    """
    rest, total, alone = dict(histogram), sum(s * n for s, n in histogram.items()), []
    for size in sorted(histogram, reverse=True):
        apart = 0
        # at most bins - 1 groups in all can be above the share of what is left
        while apart < histogram[size] and size * bins > total:
            apart, bins, total = apart + 1, bins - 1, total - size
        if apart:
            alone.append((size, apart))
            rest[size] -= apart
        if apart < histogram[size]:
            break
    rest = {s: n for s, n in rest.items() if n}
    if not alone:
        return _even(rest, bins)
    plan = _even(rest, bins) if rest else Packing(0, 0)
    held = dict(alone)
    # the groups apart are the first ranks of their sizes
    runs = [(s, a + held.get(s, 0), b + held.get(s, 0), where, per) for s, a, b, where, per in plan.runs]
    for size, n in alone:
        runs.append((size, 0, n, plan.bins, 1))
        plan.bins += n
    return Packing(max(plan.capacity, alone[0][0]), plan.bins, runs)


def _even(histogram: dict[int, int], bins: int) -> Packing:
    """The smallest capacity (by bisection) at which best fit needs at most ``bins`` bins."""
    total = sum(s * n for s, n in histogram.items())
    low = max(-(-total // bins), max(histogram, default=0), 1)
    high = low
    while (best := best_fit_decreasing(histogram, high, bins)) is None:
        low, high = high + 1, high + max(1, high // 64)
    while low < high:
        middle = (low + high) // 2
        found = best_fit_decreasing(histogram, middle, bins)
        if found is None:
            low = middle + 1
        else:
            best, high = found, middle
    return best


def shard(docs: DataFrame, bins: int | None = 8, capacity: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Give every row of ``docs`` a shard; rows of equal text stay together.

    ``bins``: that many shards, sizes as near equal as best fit gets them; or ``capacity``: as few
    shards as best fit needs of at most that size. Size of a row: UTF-8 bytes of its text plus 1;
    a null text counts as empty. Returns ``key, size, text_crc32, shard, slot``; slots are gapless
    from 0 in each shard. No rows give no rows; repeated rows are separate rows of one group.
    A group larger than a fair share fills a shard alone, as it can't be divided; the other groups
    are spread evenly over the other shards. Long texts are hashed whole; other columns don't matter.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.unhex(F.md5(body)).alias("_group"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_size"))
    histogram = {r[0]: r[1] for r in groups.groupBy("_size").agg(F.count(F.lit(1))).toLocalIterator()}
    plan = best_fit_decreasing(histogram, capacity) if capacity else fit_into(histogram, bins or 1)
    where = T.StructType([T.StructField(x, T.LongType(), False) for x in ("_size", "_lo", "_hi", "_bin", "_per")])
    runs = spark.createDataFrame(plan.runs, where)
    placed = (
        rank_within(groups, ["_size"], ["_group"], "_rank")
        .join(runs, "_size")
        .where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
        .select("_group", (F.col("_bin") + F.floor((F.col("_rank") - F.col("_lo")) / F.col("_per"))).cast("int").alias("shard"))
    )
    held = rows.join(placed, "_group").select(key, "size", "text_crc32", "shard")
    return rank_within(held, ["shard"], [key, "text_crc32"], "slot")
