"""Binary token-id shards under Re-Pair grammar compression, with random-access decoding.

A shard holds the ids of consecutive whole documents. Re-Pair replaces frequent pairs of
neighbouring ids by nonterminals, round after round, until no pair is frequent. Each document's last
id is written as a barrier symbol that no pair spans (the same id may occur inside texts), so every
document keeps its own run of the compressed sequence and is decoded without its neighbours. A round
replaces all pairs that are frequent at its start, the most frequent first where they overlap.

File format of a shard, all integers little-endian:

    8 bytes   magic "TWRPAIR2"
    7 * u64   first nonterminal, rules, symbols, documents, ids, end id, documents without a key
              (the symbol below the first nonterminal is the barrier, it stands for the end id)
    u32[2*rules]        the pair of each rule; a rule refers to ids and earlier rules only
    u32[rules]          ids that each rule expands to
    u32[symbols]        the compressed sequence
    i64[documents]      document keys; documents without a key come first and have 0
    u64[documents+1]    first symbol of each document
    u64[documents+1]    first id of each document, within the shard

Shards are rows of a Parquet table (``part``, ``shard``, ``first_key``, ``docs``, ``ids``, ``blob``), in
the order of ``part, shard``: Spark's writer commits whole files on any store, and a task that is run
again writes the same shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .tokens import default_path, tokenizer

MAGIC = b"TWRPAIR2"
_HEAD = struct.Struct("<8s7Q")


_FAR = np.iinfo(np.int32).max
_SPREAD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]


def _frequent(pair: np.ndarray, least: int) -> np.ndarray:
    """Kinds of pairs that occur at least ``least`` times, the most frequent first."""
    if not len(pair):
        return pair
    held = np.sort(pair)
    at = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1], [True])))
    count = np.diff(at)
    often = np.flatnonzero(count >= least)
    return held[at[often[np.argsort(-count[often], kind="stable")]]]


def _ranks(pair: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Index in ``kinds`` of each pair, ``_FAR`` for others.

    By tables of hashes; kinds that lose their place to another one are looked up in a further table.
    """
    out = np.full(len(pair), _FAR, np.int32)
    left, open_, turn = np.arange(len(kinds), dtype=np.int32), None, 0
    while len(left):
        shift = np.uint64(64 - min(20, max(10, len(left).bit_length() + 4)))
        spread = _SPREAD[turn % 2] + np.uint64(2 * turn)
        table = np.full(1 << (64 - int(shift)), left[0], np.int32)
        slot = (kinds[left] * spread) >> shift
        table[slot] = left
        some = pair if open_ is None else pair[open_]
        found = table[(some * spread) >> shift]
        hit = kinds[found] == some
        if open_ is None:
            out = np.where(hit, found, out)
            open_ = np.flatnonzero(~hit)
        else:
            out[open_[hit]] = found[hit]
            open_ = open_[~hit]
        left, turn = left[table[slot] != left], turn + 1
    return out


def _chosen(where: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the pairs at ascending places are replaced: the lower rank wins where two overlap, until none is free."""
    take = np.zeros(len(where), bool)
    alive = np.arange(len(where))
    # in a run of one symbol every second pair counts
    alike = (where[1:] == where[:-1] + 1) & (rank[1:] == rank[:-1])
    if alike.any():
        at = np.flatnonzero(np.concatenate(([False], alike)))
        begin = at[np.concatenate(([True], np.diff(at) > 1))] - 1
        begin = begin[np.searchsorted(begin, at, "left") - 1]
        odd = np.zeros(len(where), bool)
        odd[at[(at - begin) % 2 == 1]] = True
        alive = alive[~odd]
    while len(alive):
        w, r = where[alive], rank[alive]
        touch = w[1:] == w[:-1] + 1
        best = np.ones(len(alive), bool)
        best[1:] &= ~touch | (r[1:] < r[:-1])
        best[:-1] &= ~touch | (r[:-1] < r[1:])
        take[alive[best]] = True
        gone = best.copy()
        gone[1:] |= touch & best[:-1]
        gone[:-1] |= touch & best[1:]
        alive = alive[~gone]
    return take


def compress(ids: np.ndarray, first: int, barrier: int, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: (sequence, rules, expansion lengths). first: smallest nonterminal, above all ids.

    A round replaces all pairs that are frequent at its start; rounds go on until no pair can be replaced
    ``least`` times. After the first round only pairs beside a new symbol, or frequent and not
    replaced, can be frequent, so only their places are looked at.
    """
    sequence = ids.astype(np.uint32)
    rules, lengths = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
    where = np.arange(max(0, len(sequence) - 1))
    while True:
        left, right = sequence[where], sequence[where + 1]
        free = (left != barrier) & (right != barrier)
        if not free.all():
            where, left, right = where[free], left[free], right[free]
        pair = (left.astype(np.uint64) << np.uint64(32)) | right
        kinds = _frequent(pair, least)
        if not len(kinds):
            break
        rank = _ranks(pair, kinds)
        some = rank != _FAR
        where, rank = where[some], rank[some]
        base = 0
        while True:
            take = _chosen(where, rank)
            used = np.bincount(rank[take], minlength=len(kinds))
            kept = used >= least
            # the best kind is stopped by nothing but itself (runs of one symbol): then it can't be replaced
            if kept.any() or base >= len(kinds):
                break
            stays = rank != base
            where, rank, base = where[stays], rank[stays], base + 1
        if not kept.any():
            break
        done = take & kept[rank]
        at, over = where[done], where[~done]
        symbol = np.zeros(len(kinds), np.uint32)
        made = np.flatnonzero(kept)
        symbol[made] = first + len(rules) + np.arange(len(made), dtype=np.uint32)
        sequence[at] = symbol[rank[done]]
        stays = np.ones(len(sequence), bool)
        stays[at + 1] = False
        sequence = sequence[stays]
        fresh = at - np.arange(len(at))
        over = over - np.searchsorted(at, over, "left")
        near = np.zeros(len(sequence) + 1, bool)
        near[fresh] = near[over] = True
        near[fresh - 1] = True  # before the first place: the last one, which starts no pair
        where = np.flatnonzero(near[: max(0, len(sequence) - 1)])
        new = np.stack([kinds[made] >> np.uint64(32), kinds[made] & np.uint64(0xFFFFFFFF)], 1)
        ruled = new >= first
        sizes = np.ones(new.shape, np.int64)
        sizes[ruled] = lengths[(new[ruled] - first).astype(np.int64)]
        rules, lengths = np.concatenate([rules, new]), np.concatenate([lengths, sizes.sum(1)])
    return sequence.astype("<u4"), rules.astype("<u4"), lengths.astype("<u4")


def expand(sequence: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Ids of a run of compressed symbols."""
    out = sequence
    while len(at := np.flatnonzero(out >= first)):
        times = np.ones(len(out), np.int64)
        times[at] = 2
        pairs = rules[out[at] - first]
        begin = np.cumsum(times)[at] - 2
        out = np.repeat(out, times)
        out[begin], out[begin + 1] = pairs[:, 0], pairs[:, 1]
    return out


def encode(keys: list[int | None], documents: list[np.ndarray], end: int) -> bytes:
    """One shard of ``documents``, each ending with the id ``end``; those without a key come first."""
    without = sum(k is None for k in keys)
    ids = np.concatenate([*documents, np.zeros(0, "<u4")])
    id_at = np.cumsum([0, *map(len, documents)])
    barrier = int(ids.max(initial=0)) + 1
    first = barrier + 1
    ids[id_at[1:] - 1] = barrier
    sequence, rules, lengths = compress(ids, first, barrier)
    id_at = id_at.astype("<u8")
    symbol_at = np.concatenate([[0], np.flatnonzero(sequence == barrier) + 1]).astype("<u8")
    head = _HEAD.pack(MAGIC, first, len(rules), len(sequence), len(keys), len(ids), end, without)
    return b"".join([head, rules.tobytes(), lengths.tobytes(), sequence.tobytes(), np.asarray([k or 0 for k in keys], "<i8").tobytes(), symbol_at.tobytes(), id_at.tobytes()])


class Shard:
    """Reader of one shard: whole documents or any range of ids, without decoding the rest."""

    def __init__(self, blob: bytes) -> None:
        magic, self.first, n_rules, n_symbols, n_docs, self.n_ids, self.end, self.without = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(blob, kind, n, at)
            at += got.nbytes
            return got

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules)
        self.sequence = take("<u4", n_symbols)
        self.keys = take("<i8", n_docs)
        self.symbol_at = take("<u8", n_docs + 1).astype(np.int64)
        self.id_at = take("<u8", n_docs + 1).astype(np.int64)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        out = expand(symbols, self.rules, self.first)
        return np.where(out == self.first - 1, np.uint32(self.end), out)

    def document(self, i: int) -> np.ndarray:
        return self._expand(self.sequence[self.symbol_at[i] : self.symbol_at[i + 1]])

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop-1 of the shard; symbols outside are skipped by their expansion lengths."""
        i = int(np.searchsorted(self.id_at, start, "right")) - 1
        j = int(np.searchsorted(self.id_at, stop, "left"))
        part = self.sequence[self.symbol_at[i] : self.symbol_at[j]]
        size = np.ones(len(part), np.int64)
        ruled = part >= self.first
        size[ruled] = self.lengths[part[ruled] - self.first]
        ends = self.id_at[i] + np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        got = self._expand(part[a:b])
        skip = start - (int(ends[a - 1]) if a else int(self.id_at[i]))
        return got[skip : skip + stop - start]

    def all(self) -> np.ndarray:
        return self._expand(self.sequence)


def write_shards(docs: DataFrame, path: str | None = None, end: int = 2, shard_ids: int = 1 << 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenise whole texts in ascending key order and write them as shards of about ``shard_ids``.

    A document is never divided, however long; a null text counts as empty and holds the end id alone.
    Rows without a key come first. Rows of one key are ordered by a hash of their texts, may be in several
    shards, and are dealt to several tasks if there are many. No rows give no shards; other columns don't matter. Returns the
    written table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or default_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, stop, part = tokenizer(path), int(end).to_bytes(4, "little"), TaskContext.get().partitionId()
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = shard = 0

        def row() -> pa.RecordBatch:
            blob = encode(keys, held, end)
            numbers = {"part": part, "shard": shard, "first_key": keys[0], "docs": len(keys), "ids": size}
            return pa.RecordBatch.from_pydict({k: pa.array([v], pa.int64()) for k, v in numbers.items()} | {"blob": pa.array([blob], pa.binary())})

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), tok.ids(batch.column(1).to_pylist()), strict=True):
                got = np.frombuffer(ids + stop, "<u4")
                if held and size + len(got) > shard_ids:
                    yield row()
                    keys, held, size, shard = [], [], 0, shard + 1
                keys.append(k)
                held.append(got)
                size += len(got)
        if held:
            yield row()

    body = F.col(text).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("k"), body.alias("t"), F.xxhash64(body).alias("h"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    return materialize(ordered.mapInArrow(pack, "part long, shard long, first_key long, docs long, ids long, blob binary"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Decode shards: ``doc_id, start, n_tokens, ids_crc32``; start counts over all shards.

    Blobs are decoded where they are read; only the decoded rows meet the shards' first ids. These are
    summed in two steps: within a part, and over the parts, which are at most the partitions written.
    """
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("ids").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("ids").alias("ids"))
    earlier = parts.select("part", F.coalesce(F.sum("ids").over(before(Window.orderBy("part"))), F.lit(0)).alias("_part"))
    starts = shards.select("part", "shard", inside.alias("_in")).join(earlier, "part").select("part", "shard", (F.col("_part") + F.col("_in")).alias("_first"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(blob.as_buffer())
                raw, at = shard.all().astype("<u4").tobytes(), shard.id_at
                n = len(shard.keys)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int64)),
                        pa.array(np.full(n, number, np.int64)),
                        pa.array(shard.keys, mask=np.arange(n) < shard.without),
                        pa.array(at[:-1]),
                        pa.array(np.diff(at)),
                        pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    decoded = shards.select("part", "shard", "blob").mapInArrow(decode, "part long, shard long, doc_id long, at long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "shard"]).select("doc_id", (F.col("_first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
