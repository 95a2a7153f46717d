"""Packing of token sequences into fixed-length training sequences by bin completion.

Pieces of one length are interchangeable, so the problem the driver solves has at most ``limit``
size classes however many documents there are. It is solved on that histogram:

* best-fit decreasing, whole runs of a size at a time, gives the first incumbent;
* if it needs more sequences than the lower bound (of volume, or of lengths that can't share a
  sequence), bin completion searches on: take the largest length left, enumerate all undominated
  fillings of the room beside it, fullest first, apply one as often as the classes allow, then less
  often, and go on depth first; branches whose waste rules out a better packing than the incumbent are
  cut. The search ends with a proven optimum, or after ``nodes`` nodes with the incumbent.

The solution is a list of runs per length, and every row finds its place by its rank in its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, materialize, rank_within, unused
from .tokens import default_path, tokenizer

#: Open nodes of the search whose fillings are held.
HELD = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_END = (1).to_bytes(4, "little")


def pieces(docs: DataFrame, limit: int = 4096, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenise every whole text, add the end id 1, cut what is longer than ``limit``.

    A null or empty text is one piece, the end id alone.
    """
    bounded_batches(docs.sparkSession)
    path, width = path or default_path(), 4 * limit

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            out: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for k, ids in zip(keys, tok.ids(batch.column(1).to_pylist()), strict=True):
                held = ids + _END
                out += [
                    (k, i // width, i // 4, min(width, len(held) - i) // 4, zlib.crc32(held[i : i + width]))
                    for i in range(0, len(held), width)
                ]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(cut, PIECES)


@dataclass(frozen=True)
class Bin:
    """``times`` sequences of the same content: lengths in order of their offsets."""

    times: int
    lengths: tuple[int, ...]


def best_fit(histogram: dict[int, int], limit: int) -> list[Bin]:
    """Best-fit decreasing over a histogram; equal sequences stay one ``Bin``."""
    room: dict[int, dict[tuple[int, ...], int]] = {}  # remaining -> content -> times
    keys: list[int] = []  # sorted remaining capacities

    def add(rest: int, content: tuple[int, ...], times: int) -> None:
        if rest not in room:
            keys.insert(bisect_left(keys, rest), rest)
            room[rest] = {}
        room[rest][content] = room[rest].get(content, 0) + times

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(keys, size)
            if at == len(keys):
                k = limit // size
                full, over = divmod(left, k)
                if full:
                    add(limit - k * size, (size,) * k, full)
                if over:
                    add(limit - over * size, (size,) * over, 1)
                break
            rest = keys[at]
            content, times = next(iter(room[rest].items()))
            k = rest // size
            full, over = divmod(min(left, k * times), k)
            del room[rest][content]
            if not room[rest]:
                del room[rest]
                keys.pop(at)
            if full:
                add(rest - k * size, content + (size,) * k, full)
            if over:
                add(rest - over * size, content + (size,) * over, 1)
            if times - full - (over > 0):
                add(rest, content, times - full - (over > 0))
            left -= full * k + over
    return [Bin(n, content) for held in room.values() for content, n in held.items()]


def _sums(counts: dict[int, int], sizes: list[int], room: int) -> list[int]:
    """Bit sets: sums up to ``room`` of the first i of the ``sizes``, for every i."""
    mask, held, out = (1 << (room + 1)) - 1, 1, [1]
    never = (1 << sizes[0]) - 2 if sizes else 0  # sums below the least length
    for i, size in enumerate(sizes):
        if held | never == mask:
            return out + [held] * (len(sizes) - i)
        n, k = min(counts[size], room // size), 1
        while n > 0:
            times = min(k, n)
            held |= (held << (size * times)) & mask
            n, k = n - times, 2 * k
        out.append(held)
    return out


def dominated(filling: tuple[int, ...], room: int, others: int) -> bool:
    """Whether a length of the bit set ``others`` fits in besides, or could take the place of some of the filling's.

    The latter is so if it is at least as large as their sum and fits into their place and the room left,
    but for one length in the place of an equal one.
    """
    if others & ((1 << (room - sum(filling) + 1)) - 1):
        return True
    one = many = 0
    for size in filling:
        many |= (many << size) | (one << size)
        one |= 1 << size
    slack = room - sum(filling)
    larger = 0  # the same sums and 1 to ``slack`` more
    if slack:
        larger, width = one | many, 1
        while 2 * width <= slack:
            larger, width = larger | (larger << width), 2 * width
        larger = (larger | (larger << (slack - width))) << 1
    return bool(others & (many | larger))


def fillings(counts: dict[int, int], sizes: list[int], room: int, least: int = 0) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` that sum to at least ``least``, fullest first.

    sizes: ascending, those with a count. Sums that the lengths can't reach are never tried.
    """
    if counts.get(room, 0) > 0:
        yield (room,)  # dominates all others
        return
    sizes = sizes[: bisect_left(sizes, room + 1)]
    sums = _sums(counts, sizes, room)
    others = sum(1 << s for s in sizes)

    def exact(rest: int, below: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        for i in range(min(below, bisect_left(sizes, rest + 1)) - 1, -1, -1):
            if not sums[i + 1] >> rest & 1:
                return  # nor do fewer sizes reach it
            size = sizes[i]
            for n in range(min(counts[size], rest // size), 0, -1):
                if sums[i] >> (rest - n * size) & 1:
                    for more in exact(rest - n * size, i):
                        yield (size,) * n + more

    for total in range(room, max(least, 0) - 1, -1):
        if sums[-1] >> total & 1:
            for filling in exact(total, len(sizes)):
                used_up = sum(1 << s for s in set(filling) if filling.count(s) == counts[s])
                if not dominated(filling, room, others & ~used_up):
                    yield filling


def lower_bound(histogram: dict[int, int], limit: int) -> int:
    """The larger of the volume bound and Martello and Toth's: lengths above limit - x can't share with those of x and more."""
    sizes = sorted(histogram)
    count = [0, *accumulate(histogram[s] for s in sizes)]
    volume = [0, *accumulate(s * histogram[s] for s in sizes)]
    half = bisect_right(sizes, limit // 2)  # the first that can't share with its like
    bound = max(-(-volume[-1] // limit), count[-1] - count[half])
    for i, x in enumerate(sizes[:half]):
        alone = max(half, bisect_right(sizes, limit - x))
        n = count[alone] - count[half]
        free = n * limit - (volume[alone] - volume[half])
        small = volume[half] - volume[i]
        bound = max(bound, count[-1] - count[half] + max(0, -(-(small - free) // limit)))
    return bound


def complete(histogram: dict[int, int], limit: int, nodes: int | None = 20_000) -> tuple[list[Bin], int]:
    """Pack by bin completion; returns the sequences and a lower bound of their number.

    nodes: a bound of the search's effort; None searches until the optimum is proven. Every piece
    is packed whatever it is.
    """
    total = sum(s * n for s, n in histogram.items())
    best = best_fit(histogram, limit)
    most = sum(b.times for b in best)
    if most == -(-total // limit):
        return best, most
    bound = lower_bound(histogram, limit)
    counts = dict(histogram)
    used = waste = 0

    def options() -> Iterator[Bin]:
        """Sequences around the largest length left, each as often as possible first."""
        sizes = [s for s in sorted(counts) if counts[s]]
        largest = sizes[-1]
        room = limit - largest
        spare = (most - 1) * limit - total - waste  # what may still go unused
        if spare < 0:
            return
        held = {s: counts[s] for s in sizes}
        held[largest] -= 1
        for filling in fillings(held, [s for s in sizes if held[s]], room, room - spare):
            lengths = (largest, *filling)
            for times in range(min(counts[s] // lengths.count(s) for s in set(lengths)), 0, -1):
                yield Bin(times, lengths)

    def turn(b: Bin, sign: int) -> None:
        nonlocal used, waste
        for s in b.lengths:
            counts[s] -= sign * b.times
        used += sign * b.times
        waste += sign * b.times * (limit - sum(b.lengths))

    path: list[Bin] = []
    # how many options of each open node were tried; the latest nodes' options are held, others are made again
    tried: list[int] = [0] if most > bound else []
    held: dict[int, Iterator[Bin]] = {}
    while tried and most > bound:
        depth = len(tried) - 1
        if len(path) == len(tried):
            turn(path.pop(), -1)
        if depth not in held:
            held[depth] = islice(options(), tried[depth], None)
            held.pop(depth - HELD, None)
        step = next(held[depth], None)
        if step is None:
            tried.pop()
            del held[depth]
            continue
        tried[depth] += 1
        if nodes is not None:
            nodes -= 1
            if nodes < 0:
                break
        turn(step, 1)
        path.append(step)
        if (most - 1) * limit - total - waste < 0:
            continue
        if any(counts.values()):
            tried.append(0)
        elif used < most:
            most, best = used, list(path)
    return best, max(bound, most) if not tried else bound


def runs(bins: list[Bin]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, in each sequence, offset of the first)."""
    out, ranks, sequence = [], {}, 0
    for b in sorted(bins, key=lambda b: b.lengths, reverse=True):
        offset, i = 0, 0
        while i < len(b.lengths):
            size, j = b.lengths[i], i
            while j < len(b.lengths) and b.lengths[j] == size:
                j += 1
            first = ranks.get(size, 0)
            ranks[size] = first + b.times * (j - i)
            out.append((size, first, ranks[size], sequence, j - i, offset))
            offset, i = offset + size * (j - i), j
        sequence += b.times
    return out


def place(cut: DataFrame, limit: int = 4096, length: str = "length", order: list[str] | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` from 1 to ``limit``.

    ``cut`` is read twice: it should be a written table. Rows equal in ``order`` are interchangeable; other
    columns are kept, whatever their names. No rows give no rows.
    """
    spark = cut.sparkSession
    histogram = {r[0]: r[1] for r in cut.groupBy(length).count().collect()}  # at most ``limit`` rows
    plan, _ = complete(histogram, limit)
    at, lo, hi, seq, each, off = unused(cut.columns, "_at", "_lo", "_hi", "_seq", "_in", "_off")
    kind = T.StructType([T.StructField(x, T.LongType(), False) for x in (length, lo, hi, seq, each, off)])
    where = spark.createDataFrame(runs(plan), kind)
    rank = F.col(at) - F.col(lo)
    return (
        rank_within(cut, [length], order or ["doc_id", "piece"], at)
        .join(where, length)
        .where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi)))
        .select(
            *cut.columns,
            (F.col(seq) + F.floor(rank / F.col(each))).alias("sequence_id"),
            (F.col(off) + F.pmod(rank, F.col(each)) * F.col(length)).alias("offset"),
        )
    )


def pack(docs: DataFrame, limit: int = 4096, path: str | None = None) -> DataFrame:
    """Pack all documents: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text counts as empty, a null key stays null. Repeated rows are packed each. Long texts are cut
    into pieces of ``limit``. No rows give no rows; other columns don't matter.
    """
    return place(materialize(pieces(docs, limit, path), "pieces"), limit)
