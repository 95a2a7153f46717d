"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice.

A text is cut before every space; spaces become the piece alphabet's meta symbol. Inside such a
chunk the lattice has an edge for every vocabulary piece and, per byte, an edge for its byte piece.
An edge weighs ``exp(theta * log p)``, p falling with the piece's rank (Zipf's law), byte pieces far
below all others. Forward filtering sums weights up to every position; backward sampling walks from
the end and takes an edge by its share. So a segmentation is drawn from its exact posterior.

Draws are a hash of the row key, a seed and the position in the text: the same row is sampled alike
in any run, partition or batch, and another seed is another sample.

Decoding is lossless: a literal meta symbol in a text is only ever written as byte pieces, and
concatenating bytes gives the text back, byte for byte; nothing is normalised.

Chunks repeat a lot, so lattices are computed once per distinct chunk of a batch, for all chunks of
a batch together in numpy; all occurrences walk back together too. Chunks above ``SEGMENT`` bytes are
filtered in segments that carry the sums of the last positions on, and walked back in the same
segments, so memory stays bounded and pieces cross all borders.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .wordgrid import buffers, mix

META = "▁".encode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


SHARE_BITS = 36
SHARE = 1 << SHARE_BITS
SEGMENT = 1 << 16
_SALT = mix(np.arange(256, dtype=np.uint64), 31) | np.uint64(1)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Lattice:
    """The vocabulary as a table of string hashes, and sampling over batches of texts."""

    def __init__(self, path: str, theta: float = 1.0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.zeros(256, np.int64)
        strings, ids = [], []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of[i] = bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                raw = piece.encode()
                inner = raw[3:] if raw.startswith(META) else raw
                if META in inner or b" " in raw:
                    continue  # pieces that span spaces: chunks hold one each, in front
                strings.append((b" " + inner) if raw.startswith(META) else raw)
                self.bytes_of[i] = strings[-1]
                ids.append(i)
        rank = np.arange(1, len(ids) + 1)
        weight = -theta * np.log(rank + 2.0)
        # the table also holds all beginnings of pieces, so that longer substrings are given up early
        entry = {s: i for i, s in enumerate(strings)}
        begun = {s[:k] for s in strings for k in range(1, len(s))} - entry.keys()
        hashed = np.array([self._hash_of(s) for s in [*strings, *sorted(begun)]], np.uint64)
        order = np.argsort(hashed)
        self.keys, self.entry = hashed[order], np.where(order < len(strings), order, -1)
        self.ids, self.weight = np.array(ids), weight
        self.longest = max(map(len, strings))
        self.byte_weight = float(-theta * np.log(50.0 * len(ids)))
        bits = 20
        self.shift = np.uint64(64 - bits)
        # bucket starts of the sorted hashes, for a lookup without a search
        self.begin = np.searchsorted(self.keys, np.arange((1 << bits) + 1, dtype=np.uint64) << self.shift).astype(np.int32)
        self.begin[-1] = len(self.keys)

    @staticmethod
    def _hash_of(raw: bytes) -> int:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for b in raw:
                h = (h + _SALT[b]) * _STEP
                h ^= h >> np.uint64(29)
        return int(h)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash in the table, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        at, stop = self.begin[slot], self.begin[slot + 1]
        hit = (at < stop) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h)
        out = np.where(hit, at, -1).astype(np.int64)
        rest = np.flatnonzero(~hit & (at + 1 < stop))  # the few buckets of several entries
        while len(rest):
            at[rest] += 1
            hit = self.keys[at[rest]] == h[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[~hit & (at[rest] + 1 < stop[rest])]
        return out

    def sample(self, data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each text."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(bounds) - 1, np.int64)
        first = data == 32
        first[bounds[:-1][bounds[:-1] < n]] = True
        starts = np.flatnonzero(first)
        size = np.diff(np.append(starts, n))
        text = np.searchsorted(bounds, starts, "right") - 1
        salt = mix(keys.astype(np.uint64) ^ mix(np.array([seed], np.uint64), 51), 52)[text]
        begin, walks = bounds[text], []
        long = size > SEGMENT
        for i in np.flatnonzero(long).tolist():
            walks += self._stream(data[starts[i] : starts[i] + size[i]], starts[i], begin[i], salt[i])
        # distinct chunks by hash and length
        if not long.all():
            place = np.arange(n) - np.repeat(starts, size)
            value = mix(data.astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)), 41)
            both = np.add.reduceat(value, starts) ^ mix(size.astype(np.uint64), 42)
            starts, size, both, begin, salt = (x[~long] for x in (starts, size, both, begin, salt))
            _, one, which = np.unique(both, return_index=True, return_inverse=True)
            which = which.reshape(-1)
            edge, _ = self._edges(data, starts[one], size[one])
            walks.append(self._walk(edge, starts, size, which, begin, salt)[:2])
        at, found = (np.concatenate(x) for x in zip(*walks, strict=True))
        # into the order of places
        piece, here = np.zeros(n, np.int64), np.zeros(n, bool)
        piece[at], here[at] = found, True
        found = piece[here]
        real = np.where(found >= 0, self.ids[np.maximum(found, 0)], self.byte_id[np.where(found < 0, -1 - found, 0)])
        return real, np.diff(np.concatenate([[0], np.cumsum(here)])[bounds])

    def _stream(self, data: np.ndarray, start: int, begin: int, salt: np.uint64) -> list[tuple[np.ndarray, np.ndarray]]:
        """``_walk`` of one long chunk: places and pieces, segment by segment from its end.

        start, begin: where the chunk and its text begin. The first pass keeps the last positions'
        sums before each segment; the second computes the segment's edges again.
        """
        cuts, known, held = range(0, len(data), SEGMENT), np.zeros(1), []
        for s in cuts:
            held.append(known)
            lo, e = s + 1 - len(known), min(s + SEGMENT, len(data))
            _, alpha = self._edges(data, np.array([lo]), np.array([e - lo]), known)
            known = alpha[-min(self.longest, e + 1) :]
            known = known - known[-1]
        out, left = [], len(data)
        for s, known in zip(cuts[::-1], held[::-1], strict=True):
            lo, e = s + 1 - len(known), min(s + SEGMENT, len(data))
            if left <= s:
                continue
            edge, _ = self._edges(data, np.array([lo]), np.array([e - lo]), known)
            at, found, rest = self._walk(edge, np.array([start + lo]), np.array([left - lo]), np.zeros(1, int), np.array([begin]), np.array([salt]), s - lo)
            out.append((at, found))
            left = lo + int(rest[0])
        return out

    def _edges(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, known: np.ndarray | None = None) -> tuple[tuple, np.ndarray]:
        """Forward filtering of distinct chunks: per position, its edges' cumulated shares.

        Rows are positions of chunks, position by position, the longest chunk first: position p of the
        chunk of rank c is row base[p] + c; a row's edges end there. Returns (base, ranks, first edge
        of each row, row and cumulated share as one number, length, index of the piece or -1 - byte),
        and the logarithm of every row's sum. known: these of the first rows of the only chunk.
        """
        by = np.argsort(-size, kind="stable")
        rank = np.empty(len(size), np.int64)
        rank[by] = np.arange(len(size))
        longest = int(size.max())
        # chunks that have position p; the first of p + 1 are the first of p
        having = len(size) - np.searchsorted(np.sort(size), np.arange(longest + 2), "left")
        base = np.concatenate([[0], np.cumsum(having)])
        rows = int(base[-1])
        alpha = np.full(rows, -np.inf)
        alpha[: len(size)] = 0.0
        before = 0
        if known is not None:
            alpha[: len(known)], before = known, len(known) - 1
        # edges start at all positions but the last: substrings that a piece begins with grow byte by byte
        depth = np.repeat(np.arange(longest), having[1 : longest + 1])
        total = len(depth)
        chunk = np.arange(total) - np.concatenate([[0], np.cumsum(having[1:longest])])[depth]
        source = (base[depth] + chunk).astype(np.int32)
        sized, where = size[by][chunk], starts[by][chunk] + depth
        room = sized - depth
        salted = _SALT[data[where]]
        # byte edges, slot 0, go to the next position
        groups = [(base[depth + 1] + chunk, source, 1, -1 - data[where].astype(np.int32), None)]
        h, live = np.zeros(total, np.uint64), np.arange(total)
        for k in range(1, min(self.longest, longest) + 1):
            if k > 1:
                inside = room[live] >= k
                live, h = live[inside], h[inside]
                if not len(live):
                    break
                salted = _SALT[data[where[live] + k - 1]]
            with np.errstate(over="ignore"):
                h = (h + salted) * _STEP
                h ^= h >> np.uint64(29)
            place = self.lookup(h)
            found = place >= 0
            live, h, entry = live[found], h[found], self.entry[place[found]]
            piece = entry >= 0
            some, entry = live[piece], entry[piece]
            groups.append((base[depth[some] + k] + chunk[some], source[some], k, entry.astype(np.int32), self.weight[entry]))
        if before:
            groups = [(row[new], src[new], k, ids[new], None if w is None else w[new]) for row, src, k, ids, w in groups for new in [row > before]]
        # an edge's place: behind the shorter ones that end in its row; a length ends in a row once
        filled = np.zeros(rows, np.int64)
        for row, *_ in groups:
            filled[row] += 1
        begin = np.concatenate([[0], np.cumsum(filled)])
        edges = int(begin[-1])
        source, length, ids, weight = np.empty(edges, np.int32), np.empty(edges, np.int16), np.empty(edges, np.int32), np.empty(edges)
        filled[:] = begin[:-1]
        for row, src, k, entry, w in groups:
            at = filled[row]
            filled[row] += 1
            source[at], length[at], ids[at], weight[at] = src, k, entry, self.byte_weight if w is None else w
        # forward filtering, position by position for all chunks
        share = np.empty(edges)
        for p in range(before + 1, longest + 1):
            lo, hi = base[p], base[p + 1]
            part = slice(begin[lo], begin[hi])
            value = alpha[source[part]] + weight[part]
            new, count = begin[lo:hi] - begin[lo], begin[lo + 1 : hi + 1] - begin[lo:hi]
            top = np.maximum.reduceat(value, new)
            e = np.exp(value - np.repeat(top, count))
            sum_ = np.add.reduceat(e, new)
            alpha[lo:hi] = top + np.log(sum_)
            share[part] = e / np.repeat(sum_, count)
        # whole numbers, so that sums don't depend on the other chunks of a batch
        run = np.cumsum((share * SHARE).astype(np.int64))
        earlier = np.concatenate([[0], run])[begin[:-1]]
        of = np.repeat(np.arange(rows) * (2 * SHARE) - earlier, np.diff(begin))
        return (base, rank, begin, of + run, length, ids), alpha

    def _walk(self, edge: tuple, starts: np.ndarray, size: np.ndarray, which: np.ndarray, first: np.ndarray, salt: np.ndarray, stop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and pieces of all chunks, from their ends to ``stop``, and what is left of each.

        first, salt: of each chunk's text.
        """
        base, rank, begin, cumulated, length, ids = edge
        place = rank[which]
        left = size.copy()
        active = np.argsort(which, kind="stable")  # neighbours look up neighbouring rows
        out_at, out_id = [], []
        while len(active):
            row = base[left[active]] + place[active]
            # the draw at a text position: hash of key, seed and the position in the text
            position = (starts[active] + left[active] - first[active]).astype(np.uint64)
            draw = (mix(salt[active] + position, 53) >> np.uint64(64 - SHARE_BITS)).astype(np.int64)
            pick = np.searchsorted(cumulated, row * (2 * SHARE) + draw, "right")
            pick = np.clip(pick, begin[row], begin[row + 1] - 1)
            step = length[pick].astype(np.int64)
            left[active] -= step
            out_at.append(starts[active] + left[active])
            out_id.append(ids[pick])
            active = active[left[active] > stop]
        return np.concatenate(out_at), np.concatenate(out_id), left

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes."""
        return b"".join([self.bytes_of[i] for i in ids.tolist()])


_HELD: dict[tuple[str, float], Lattice] = {}


def lattice(path: str, theta: float) -> Lattice:
    if (path, theta) not in _HELD:
        _HELD[path, theta] = Lattice(path, theta)
    return _HELD[path, theta]


def encode(docs: DataFrame, seed: int = 0, theta: float = 1.0, path: str | None = None, key: str = "doc_id", text: str = "text", with_ids: bool = True, source: str | None = None) -> DataFrame:
    """One sampled segmentation of every whole text.

    Returns ``key, ids`` (array<int>, if asked for), ``n_pieces, n_bytes, ids_crc32,
    lossless``; the last tells whether decoding the ids gave the text back. A null text counts as
    empty and has no ids. A null key is sampled as key -1. Rows that repeat a key are sampled alike
    where their texts are. Keys must be integers. Long texts are sampled whole. No rows give no rows, and
    other columns don't matter. source: name of a column
    to return the text in, for a check by ``decode``; there is no ``lossless`` then.
    """
    bounded_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, theta)
        for batch in batches:
            raw, at = buffers(batch.column(1))
            keys = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            i = 0
            while i < len(keys):
                j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), "right")) - 1)
                data, bounds = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                ids, count = model.sample(data, bounds, keys[i:j], seed)
                cut = np.concatenate([[0], np.cumsum(count)])
                small = ids.astype("<u4")
                crc = [zlib.crc32(small[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                whole = b"" if source else data.tobytes()
                if source:
                    fine = None
                elif model.decode(ids) == whole:
                    fine = [True] * (j - i)
                else:
                    fine = [model.decode(ids[a:b]) == whole[x:y] for a, b, x, y in zip(cut[:-1], cut[1:], bounds[:-1], bounds[1:], strict=True)]
                columns = [batch.column(0).slice(i, j - i), pa.array(count), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
                names = [key, "n_pieces", "n_bytes", "ids_crc32"]
                if not source:
                    columns.append(pa.array(fine))
                    names.append("lossless")
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                if source:
                    columns.append(batch.column(1).slice(i, j - i))
                    names.append(source)
                yield pa.RecordBatch.from_arrays(columns, names=names)
                i = j

    schema = f"`{key}` long, n_pieces long, n_bytes long, ids_crc32 long" + ("" if source else ", lossless boolean") + (", ids array<int>" if with_ids else "") + (f", `{source}` string" if source else "")
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``key, text`` from ids, and the columns ``keep``; null ids give an empty text."""
    rest = encoded.select(*keep).schema.fields if keep else []
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(path, 1.0)
        for batch in batches:
            got = [(b"" if not x.is_valid else model.decode(x.values.to_numpy(zero_copy_only=False))).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.string()), *batch.columns[2:]], names=[key, "text", *keep])

    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("text", T.StringType()), *rest])
    return encoded.select(F.col(key).cast("long"), F.col(ids), *keep).mapInArrow(run, schema)
