"""N-gram Jaccard self-join by chosen paths (Christiani, Pagh and Sivertsen, CPSJoin, 2018).

Texts are sets of five-word shingles (lower case, words between white space; a text of fewer words
is one shingle). Sets are embedded by ``T`` minhashes: a coordinate's value is a consistently
sampled token, and two sets share it with a probability equal to their Jaccard similarity.

* Rows of equal sets are folded first; they are one vertex with a number of copies.
* A run starts from ``FAN`` sampled coordinates; sets that share a sampled token meet in a bucket. A
  bucket above ``LEAF`` sets is split again on ``FAN`` coordinates sampled by its path, until it
  is small. A pair of similarity s survives a split unless all its sampled coordinates differ, so per
  run it is lost with at most the extinction probability e = (1 - s + s e)^FAN of that
  branching, and runs repeat until e**runs is below 1 - ``recall``.
* Sets that are alike would stay together at every split and multiply. So before a split, a bucket's
  dense core is taken out: sets within ``CORE`` places of the bucket's middle (the commonest value of
  every coordinate). Any set that differs from one of these in at most ``FAR`` places is, by
  the triangle inequality, within ``CORE + FAR`` places of the middle; all those are joined to one
  candidate component, and the core takes no further part. The rest is split.
* Small buckets are compared by brute force on the embedding, which gives candidate links; their
  connected components bring sets together that may be linked.
* All sets of a component are compared exactly, in blocks if there are many. Links are counted and
  joined into classes, never listed pair by pair.

A bucket is split within one task; one above ``LARGE`` sets is first split over all tasks, by the
same rules. Nothing is capped: blocks only divide the work. Joins are merges at any size, so that a
small input is worked on as a large one is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import bounded_batches, free, groups_of, materialize, unused
from .wordgrid import Words, grams, mix, words

WORDS_IN_SHINGLE = 5
T, FAN, LEAF, LARGE, DEEPEST = 64, 3, 256, 1 << 15, 24
#: Places in which the embeddings of a linked pair may differ (of T; five standard deviations above
#: the mean at the least similarity), and in which a core may differ from its bucket's middle.
FAR, CORE = 28, 18
#: A core is taken out of a bucket if it is at least this share of it.
DENSE = 1 / 16
#: Sets, and shingles in all, of a block that is compared exactly with another.
BLOCK, SHINGLES = 2048, 1 << 19
#: Smaller blocks spread a component over more tasks, up to so many blocks of at least so many sets.
BLOCKS, LEAST = 20, 128
#: Bytes of text, and columns of a block's incidence matrix, that a worker handles at a time.
CHUNK, COLUMNS = 1 << 18, 2048
#: Shingles in at most so many sets of a block are counted pair by pair, others by matrix products.
RARE = 12
_FACTOR = mix(np.arange(T, dtype=np.uint64), 77) | np.uint64(1)


def runs_for(recall: float, similarity: float, fan: int = FAN) -> int:
    """Runs after which a pair of that similarity is missed with at most 1 - recall."""
    lost = 0.0
    for _ in range(200):
        lost = (1 - similarity + similarity * lost) ** fan
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingle_sets(chunk: Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and where each text's begin."""
    gram, at = grams(chunk, WORDS_IN_SHINGLE)
    owner = np.repeat(np.arange(chunk.texts), np.diff(at))
    order = np.lexsort((gram, owner))
    gram = gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    count = np.bincount(owner[new], minlength=chunk.texts)
    return gram[new], np.concatenate([[0], np.cumsum(count)])


def set_keys(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, 2) uint64 that stand for each set."""
    size = np.diff(at)
    out = np.zeros((len(size), 2), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        out[full, 0] = np.add.reduceat(mix(gram, 5), at[:-1][full])
        out[full, 1] = np.bitwise_xor.reduceat(mix(gram, 6), at[:-1][full])
    out[:, 0] += size.astype(np.uint64)
    return out


def minhashes(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, T) uint32 minhashes; an empty set has zeros."""
    out = np.zeros((len(at) - 1, T), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        for j in range(T):
            value = ((gram * _FACTOR[j]) >> np.uint64(32)).astype(np.uint32)
            out[full, j] = np.minimum.reduceat(value, at[:-1][full])
    return out


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, id, hash, text``; id: the key, or a hash of the text; id and hash name a row but for its repetitions."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hashed = F.xxhash64(body)
    return docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(key).cast("long"), hashed).alias("id"), hashed.alias("hash"), body.alias("text"))


def _describe(docs: DataFrame, key: str, text: str, runs: int) -> DataFrame:
    """``key, id, hash, set_key, size, sketch, roots`` of every row."""
    bounded_batches(docs.sparkSession)
    coordinate = (mix(np.arange(runs * FAN, dtype=np.uint64), 91) % np.uint64(T)).astype(int)
    for i in range(1, len(coordinate)):  # different coordinates while there are any
        while coordinate[i] in coordinate[:i] and i < T:
            coordinate[i] = (coordinate[i] + 1) % T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in words(batch.column(0), CHUNK):
                gram, at = shingle_sets(chunk)
                size = np.diff(at)
                low = minhashes(gram, at)
                sums = set_keys(gram, at)
                salt = mix(np.arange(runs * FAN, dtype=np.uint64), 92)
                roots = mix(low[:, coordinate].astype(np.uint64) ^ salt).astype(np.int64)
                sketch = (low & np.uint32(255)).astype(np.uint8)
                part = slice(chunk.first, chunk.first + chunk.texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1)[part],
                        batch.column(2)[part],
                        batch.column(3)[part],
                        pa.array([x.tobytes() for x in sums], pa.binary()),
                        pa.array(size.astype(np.int64)),
                        pa.array([x.tobytes() for x in sketch], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, roots.size + 1, runs * FAN, dtype=np.int32)), pa.array(roots.reshape(-1))),
                    ],
                    names=["key", "id", "hash", "set_key", "size", "sketch", "roots"],
                )

    rows = _named(docs, key, text).select("text", "key", "id", "hash")
    return rows.mapInArrow(run, "key long, id long, hash long, set_key binary, size long, sketch binary, roots array<long>")


# ------------------------------------------------------------------ candidates


def middle(sketch: np.ndarray) -> np.ndarray:
    """The commonest value of every coordinate; the least of several."""
    flat = sketch.astype(np.int64) + 256 * np.arange(T)
    return np.bincount(flat.reshape(-1), minlength=256 * T).reshape(T, 256).argmax(1).astype(np.uint8)


def coordinates(node: int, depth: int) -> np.ndarray:
    """The ``FAN`` different coordinates on which a bucket is split."""
    rest, out = list(range(T)), []
    for j in range(FAN):
        h = mix(np.array([node & 0xFFFFFFFFFFFFFFFF], np.uint64), 1000 * depth + j)[0]
        out.append(rest.pop(int(h % np.uint64(len(rest)))))
    return np.array(out)


def _alike(sketch: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """Matrix of pairs that may be linked, by their sizes and embeddings."""
    n = len(size)
    out = np.zeros((n, n), bool)
    for s in range(0, n, 32):
        differ = (sketch[s : s + 32, None, :] != sketch[None, :, :]).sum(2, dtype=np.uint8)
        fits = np.minimum(size[s : s + 32, None], size[None, :]) >= similarity * np.maximum(size[s : s + 32, None], size[None, :])
        out[s : s + 32] = (differ <= FAR) & fits
    return out


def spread(linked: np.ndarray) -> np.ndarray:
    """Connected components of a symmetric matrix with a true diagonal: each vertex's least one."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label[None, :], len(linked)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def chosen_paths(node: int, sketch: np.ndarray, size: np.ndarray, similarity: float, depth: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Candidate links of one bucket, as (rows, row that each is joined to)."""
    out = []
    todo = [(node, np.arange(len(size)), depth)]
    while todo:
        node, own, depth = todo.pop()
        while len(own) > LEAF:
            away = (sketch[own] != middle(sketch[own])).sum(1)
            core = away <= CORE if depth < DEEPEST else np.ones(len(own), bool)
            if core.mean() < DENSE:
                break
            near = own[(away <= CORE + FAR) | core]
            out.append((near[1:], np.full(len(near) - 1, near[0])))
            own = own[~core]
        if len(own) <= LEAF:
            if len(own) > 1:
                label = spread(_alike(sketch[own], size[own], similarity))
                far = np.flatnonzero(label != np.arange(len(own)))
                out.append((own[far], own[label[far]]))
            continue
        for c in coordinates(node, depth).tolist():
            value = sketch[own, c]
            order = np.argsort(value, kind="stable")
            cut = np.flatnonzero(np.concatenate(([True], np.diff(value[order]) != 0)))
            for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                if e - s > 1:
                    child = int(mix(np.array([(node ^ (c << 8 | int(value[order[s]]))) & 0xFFFFFFFFFFFFFFFF], np.uint64), depth)[0])
                    todo.append((child, own[order[s:e]], depth + 1))
    return out


def _split(big: DataFrame, counts: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """One level for buckets above ``LARGE``: candidate links, and the rows of the next level.

    A bucket's middle is that of about 256 of its sets, chosen by hash.
    """
    n = big.join(counts.hint("merge"), "node")
    some = n.where(F.pmod(F.xxhash64("rep", "node", F.lit(3)), F.col("n")) < 256).select("node", "sketch")

    def middles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 0):
            task, data = table["node"].to_numpy(), np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, T)
            begin = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1]))) if len(task) else np.zeros(0, int)
            if len(begin):
                got = [middle(x).tobytes() for x in np.split(data, begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(task[begin]), pa.array(got, pa.binary())], names=["node", "middle"])

    centre = materialize(some.repartition("node").sortWithinPartitions("node").mapInArrow(middles, "node long, middle binary"), "path-middles")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch, mid = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, T) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], batch.column(0), pa.array((sketch != mid).sum(1))], names=["node", "n", "rep", "size", "sketch", "away"])

    joined = n.join(centre.hint("merge"), "node").select("sketch", "middle", "node", "n", "rep", "size")
    away = materialize(joined.mapInArrow(measure, "node long, n long, rep long, size long, sketch binary, away long"), "path-away")
    cores = materialize(away.groupBy("node").agg(F.count(F.when(F.col("away") <= CORE, 1)).alias("core"), F.min(F.when(F.col("away") <= CORE + FAR, F.col("rep"))).alias("a"), F.min("rep").alias("least")), "path-cores")
    known = away.join(cores.hint("merge"), "node").withColumn("dense", F.col("core") >= DENSE * F.col("n"))
    last = depth >= DEEPEST  # then all that is left is compared exactly, as one candidate component
    links = known.where(F.lit(last) | (F.col("dense") & (F.col("away") <= CORE + FAR))).select(F.col("least" if last else "a").alias("a"), F.col("rep").alias("b"))
    rest = known.where(F.lit(not last) & ~(F.col("dense") & (F.col("away") <= CORE)))
    # a dense bucket is looked at again without its core; another one is split
    places = F.array(*[F.pmod(F.xxhash64("node", F.lit(1000 * depth + j)), F.lit(T)).cast("int") for j in range(FAN)])
    child = F.xxhash64("node", "c", F.expr("substring(sketch, c + 1, 1)"))
    again = rest.select("dense", "node", "rep", "size", "sketch", F.explode(F.when(F.col("dense"), F.array(F.lit(-1))).otherwise(F.array_distinct(places))).alias("c"))
    return links, again.select(F.when(F.col("dense"), F.col("node")).otherwise(child).alias("node"), "rep", "size", "sketch")


def _candidates(sets: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: links between sets that may be linked; about one for every set and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 0):
            node = table["node"].to_numpy()
            if len(node) < 2:
                continue
            beside = node[1:] == node[:-1]
            keep = np.flatnonzero(np.concatenate(([False], beside)) | np.concatenate((beside, [False])))
            if not len(keep):
                continue
            table = table.take(pa.array(keep))
            node, rep, size = table["node"].to_numpy(), table["rep"].to_numpy(), table["size"].to_numpy()
            data = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, T)
            begin = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            count = np.diff(np.append(begin, len(node)))
            out_a, out_b = [], []
            # small buckets together: rows some steps apart in one bucket
            small = np.repeat(count <= 6, count)
            for step in range(1, 6):
                i = np.flatnonzero(small[:-step] & (node[step:] == node[:-step])) if len(node) > step else np.zeros(0, int)
                j = i + step
                fits = (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])) & ((data[i] != data[j]).sum(1) <= FAR)
                out_a.append(rep[i[fits]])
                out_b.append(rep[j[fits]])
            for s, n in zip(begin[count > 6].tolist(), count[count > 6].tolist(), strict=True):
                # the least one first: links lead to it wherever that is possible
                order = s + np.argsort(rep[s : s + n], kind="stable")
                for i, j in chosen_paths(int(node[s]), data[order], size[order], similarity):
                    out_a.append(rep[order[i]])
                    out_b.append(rep[order[j]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                both = both[both[:, 0] != both[:, 1]]
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    rows = sets.where("size > 0").select(F.explode("roots").alias("node"), "rep", "size", "sketch")
    links, depth = None, 0
    while True:
        hot = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(f"n > {LARGE}"), "path-hot")
        if hot.isEmpty():
            break
        rows = materialize(rows, "paths")
        some, more = _split(rows, hot, depth)
        links = some if links is None else links.unionByName(some)
        rows = rows.join(hot.hint("merge"), "node", "left_anti").select("node", "rep", "size", "sketch").unionByName(more)
        depth += 1
    found = rows.repartition(F.col("node")).sortWithinPartitions("node").mapInArrow(run, "a long, b long")
    return found if links is None else found.unionByName(links)


# ------------------------------------------------------------------ exact links


def intersections(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of all intersections of sorted distinct arrays; without ``right``, of left with left."""
    sets = left if right is None else [*left, *right]
    na, n = len(left), len(sets)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in sets])
    gram = np.concatenate([*sets, np.zeros(0, np.uint64)])
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    new = np.concatenate(([True], gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(gram)))
    width = na if right is None else n - na
    out = np.zeros((na, width), np.float32)
    # rare shingles: the rows of a shingle ascend, so those of the left side come first
    many = np.repeat(count, count)
    at, row_few = np.cumsum(new)[many <= RARE], row[many <= RARE]
    found = []
    for step in range(1, RARE):
        if len(at) <= step:
            break
        same = np.flatnonzero(at[step:] == at[:-step])
        i, j = row_few[same].astype(np.int64), row_few[same + step].astype(np.int64)
        if right is not None:
            across = (i < na) & (j >= na)
            i, j = i[across], j[across] - na
        found.append(i * width + j)
    if found:
        out += np.bincount(np.concatenate(found), minlength=na * width).reshape(na, width).astype(np.float32)
    if right is None:
        out += out.T.copy()
        if len(row_few):
            out[np.arange(na), np.arange(na)] += np.bincount(row_few, minlength=na)
    # others: products of incidence matrices
    seat = np.cumsum(count > RARE)[np.cumsum(new) - 1] - 1 if len(gram) else np.zeros(0, int)
    row_often, seat = row[many > RARE], seat[many > RARE]
    for lo in range(0, int(seat.max(initial=-1)) + 1, COLUMNS):
        first, last = np.searchsorted(seat, [lo, lo + COLUMNS])
        dense = np.zeros((n, int(seat[last - 1]) - lo + 1), np.float32)
        dense[row_often[first:last], seat[first:last] - lo] = 1
        out += dense[:na] @ (dense if right is None else dense[na:]).T
    return out


def _dealt(members: DataFrame) -> DataFrame:
    """Deal a component's sets to pairs of blocks: adds ``task``, ``side`` (0 left, 1 right, 2 both) and ``whole`` (there is one block)."""
    spread_out = F.least(F.ceil(F.col("n") / LEAST), F.lit(BLOCKS))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / SHINGLES), spread_out, F.lit(1)).cast("int")
    mine = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("_nb")).cast("int")
    pairs = members.withColumn("_nb", blocks).withColumn("_mine", mine).select("*", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_other"))
    side = F.when(F.col("_mine") == F.col("_other"), 2).when(F.col("_mine") < F.col("_other"), 0).otherwise(1)
    task = F.xxhash64("component", F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return pairs.withColumn("task", task).withColumn("side", side).withColumn("whole", F.col("_nb") == 1).drop("_nb", "_mine", "_other")


def _verified(members: DataFrame, tenths: int) -> DataFrame:
    """Exact links within components: rows (a, b, links, whole).

    b null: a has so many links in this task. Otherwise a is connected to b, and ``whole`` tells
    whether b is the final root of a, as one task has seen the whole component.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 0):
            if not table.num_rows:
                continue
            sets: list[np.ndarray] = []
            found: list[np.ndarray] = []
            for chunk in words(table["text"].combine_chunks(), CHUNK):
                gram, at = shingle_sets(chunk)
                sets += np.split(gram, at[1:-1])
                found.append(set_keys(gram, at))
            task, side, whole = (table[x].to_numpy() for x in ("task", "side", "whole"))
            rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
            # a document may be read more than once, or with other texts under its key
            meant = np.frombuffer(b"".join(table["set_key"].to_pylist()), np.uint64).reshape(-1, 2)
            right_text = np.flatnonzero((meant == np.concatenate(found)).all(1))
            _, first = np.unique(np.stack([task[right_text], rep[right_text]], 1), axis=0, return_index=True)
            keep = right_text[np.sort(first)]
            task, side, whole, rep, copies, sets = task[keep], side[keep], whole[keep], rep[keep], copies[keep], [sets[i] for i in keep]
            if not len(task):
                continue
            begin = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1])))
            out: list[tuple[np.ndarray, ...]] = []

            def counted(who: np.ndarray, n: np.ndarray, out: list = out) -> None:
                some = n > 0
                out.append((who[some], np.zeros(int(some.sum()), np.int64), n[some], np.zeros(int(some.sum()), bool), np.ones(int(some.sum()), bool)))

            for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(task)], strict=True):
                left, right = s + np.flatnonzero(side[s:e] != 1), s + np.flatnonzero(side[s:e] != 0)
                same = len(left) == e - s and len(right) == e - s
                if not len(left) or not len(right):
                    continue
                both = intersections([sets[i] for i in left], None if same else [sets[j] for j in right])
                size = np.array([len(x) for x in sets[s:e]], np.float64)
                link = np.empty(both.shape, bool)
                for i in range(0, len(left), 256):  # whole numbers below 2**53: exact
                    part = both[i : i + 256].astype(np.float64)
                    link[i : i + 256] = 10 * part >= tenths * (size[left[i : i + 256] - s][:, None] + size[right - s][None, :] - part)
                if same:
                    np.fill_diagonal(link, False)
                if not link.any():
                    continue
                counted(rep[left], _weighted(link, copies[right]))
                if same:
                    matrix, who = link, rep[left]
                else:
                    counted(rep[right], _weighted(link.T, copies[left]))
                    matrix, who = np.zeros((e - s, e - s), bool), np.concatenate([rep[left], rep[right]])
                    matrix[: len(left), len(left) :] = link
                    matrix[len(left) :, : len(left)] = link.T
                np.fill_diagonal(matrix, True)
                label = spread(matrix)
                if same and whole[s]:
                    some = np.bincount(label, minlength=len(label))[label] > 1
                else:
                    some = label != np.arange(len(label))
                n = int(some.sum())
                out.append((who[some], who[label[some]], np.zeros(n, np.int64), np.full(n, bool(same and whole[s])), np.zeros(n, bool)))
            if out:
                a, b, n, final, null = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=null), pa.array(n, mask=~null), pa.array(final)], names=["a", "b", "links", "whole"])

    dealt = _dealt(members).select("task", "side", "whole", "rep", "copies", "set_key", "text")
    return dealt.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(run, "a long, b long, links long, whole boolean")


def _weighted(link: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """Copies on the other side of each row's links."""
    out = np.zeros(len(link), np.int64)
    for i in range(0, len(link), 256):
        out[i : i + 256] = link[i : i + 256] @ copies
    return out


def _classes(docs: DataFrame, tenths: int, recall: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Every row as described, and ``set_key, root, class_id, n_links`` of every set."""
    similarity = tenths / 10
    described = materialize(_describe(docs, key, text, runs_for(recall, similarity)), "sets")
    sets = materialize(
        described.groupBy("set_key").agg(
            F.xxhash64("set_key").alias("rep"),
            F.min("id").alias("id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("size").alias("size"),
            F.first("sketch").alias("sketch"),
            F.first("roots").alias("roots"),
        ),
        "reps",
    )
    candidate = materialize(components(_candidates(sets, similarity)).withColumnRenamed("id", "rep").join(sets.select("rep", "id", "copies", "size", "set_key").hint("merge"), "rep"), "candidates")
    sizes = materialize(candidate.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")), "candidate-sizes")
    members = materialize(candidate.join(sizes.hint("merge"), "component"), "members")
    checked = materialize(_verified(_named(docs, key, text).select("id", "text").join(members.hint("merge"), "id"), tenths), "links")
    links = checked.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    final = checked.where("b is not null and whole").select(F.col("a").alias("rep"), F.col("b").alias("component"))
    others = components(checked.where("b is not null and not whole").select("a", "b")).withColumnRenamed("id", "rep")
    known = materialize(
        sets.select("set_key", "rep", "id", "copies")
        .join(links.hint("merge"), "rep", "left")
        .join(final.unionByName(others).hint("merge"), "rep", "left")
        .select("set_key", "id", F.coalesce("component", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")),
        "known",
    )
    named = materialize(known.groupBy("root").agg(F.min("id").alias("class_id")), "class-names")
    out = materialize(known.join(named.hint("merge"), "root").select("set_key", "root", "class_id", "n_links"), "classes")
    free(sets, candidate, sizes, members, checked, known, named)
    return described, out


def near_duplicates(docs: DataFrame, tenths: int = 8, recall: float = 0.9999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, class_id, n_links, set_size, member_id`` for every row; member_id: the key, or a hash of the text where that is null.

    tenths: the least Jaccard similarity, in tenths. class_id: least member_id among the documents that
    links connect. n_links: other documents linked to this one, copies included. A null text counts
    as empty; texts without words are copies of one another and linked to nothing else. Repeated
    rows are copies. Rows without a key take part; a class of such rows alone has a hash as its id. Long
    texts are compared whole. No rows give no rows. Other columns don't matter, whatever their names.
    """
    described, known = _classes(docs, tenths, recall, key, text)
    return described.select("key", "id", "set_key", "size").join(known.hint("merge"), "set_key").select(
        F.col("key").alias(key), "class_id", "n_links", F.col("size").alias("set_size"), F.col("id").alias("member_id")
    )


def keep_one(docs: DataFrame, tenths: int = 8, recall: float = 0.9999, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, one of each class of near duplicates: that of the least key.

    A row without a key goes by a hash of its text. Of rows with that key, the one whose text has the
    least hash stays; of repetitions of a row, one. Texts that share a key but are not alike are
    different classes, and each keeps a row. All texts without words are one class. Columns
    of any name are kept as they are. No rows give no rows.
    """
    described, known = _classes(docs, tenths, recall, key, text)
    least = described.join(known.hint("merge"), "set_key").groupBy("root").agg(F.min(F.struct("id", "hash")).alias("r"))
    held, hashed, row = unused(docs.columns, "_id", "_hash", "_row")
    stays = materialize(least.select(F.col("r.id").alias(held), F.col("r.hash").alias(hashed)), "kept")
    body = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    named = docs.withColumn(hashed, body).withColumn(held, F.coalesce(F.col(key).cast("long"), F.col(hashed)))
    first = Window.partitionBy(held, hashed).orderBy(F.col(text).isNull(), text)
    kept = named.join(stays.hint("merge"), [held, hashed], "left_semi").withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    return kept.select(*docs.columns)
