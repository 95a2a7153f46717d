"""Exact top-k inner-product search by dual cover trees (Curtin and Ram, 2014).

Queries and candidates are dealt to blocks, and every pair of blocks is one task, which indexes both
sides by a cover tree: a node's children are points of the set, more than half the node's radius
apart from each other, and every point is within its node's radius. Both trees are walked together,
depth first and the most promising pair of nodes first. A pair of nodes is pruned when no query below
one and no candidate below the other can reach the worst k-th score that the queries have found so
far: with centres g and p and radii r and s, a score is at most <g,p> + r|p| + s|g| + rs. Single points
are nodes of radius 0, and are tested in rows: candidates against a group's centre, queries against a
candidate node's centre. Below a pruned pair nothing is multiplied. The blocks' best are merged.

Scores are integers and exact: products of integers below 2**53 in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import groups_of

#: Points below which a node is not divided, singles that are scored at a time, and at first.
LEAF, ROW, SEED = 24, 512, 64


@dataclass
class Node:
    """A ball around a point of the set; ``rows``: all points in it, ``single``: children without a ball."""

    centre: int
    radius: float
    rows: np.ndarray
    single: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray) -> Node:
    """The tree of a set of at least one point; its root is around the first."""
    square = (x * x).sum(1)

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(square[a][:, None] + square[b][None, :] - 2 * (x[a] @ x[b].T), 0))

    def grow(centre: int, rows: np.ndarray, radius: float) -> Node:
        if len(rows) <= LEAF or radius == 0:
            return Node(centre, radius, rows, rows)
        node = Node(centre, radius, rows, rows[:0])
        single, left = [], np.concatenate([[centre], rows[rows != centre]])
        while len(left):
            # separate points among the next ones, then all that they cover
            some = left[:256]
            near = apart(some, some) <= radius / 2
            taken = np.zeros(len(some), bool)
            for j in range(len(some)):
                taken[j] = not (near[j] & taken).any()
            chosen = some[taken]
            away = apart(chosen, left)
            mine, gap = away.argmin(0), away.min(0)
            # a chosen point is its own, whatever rounding says of it and its copies
            mine[np.flatnonzero(taken)] = np.arange(len(chosen))
            gap[np.flatnonzero(taken)] = 0
            covered = gap <= radius / 2
            held, order = left[covered], np.argsort(mine[covered], kind="stable")
            reach = gap[covered][order]
            held, cut = held[order], np.searchsorted(mine[covered][order], np.arange(len(chosen) + 1))
            for j, one in enumerate(chosen.tolist()):
                part = held[cut[j] : cut[j + 1]]
                if len(part) == 1:
                    single.append(one)
                else:
                    node.children.append(grow(one, part, float(reach[cut[j] : cut[j + 1]].max())))
            left = left[~covered]
        node.single = np.array(single, np.int64)
        return node

    root = np.arange(len(x))
    return grow(0, root, float(apart(root[:1], root).max(initial=0)))


class Search:
    """The k best candidates of every query; ties to the candidate that comes first."""

    def __init__(self, queries: np.ndarray, candidates: np.ndarray, k: int, query_ids: np.ndarray, ids: np.ndarray) -> None:
        self.x, self.y, self.k, self.query_ids, self.ids = queries, candidates, k, query_ids, ids
        self.size_x, self.size_y = np.sqrt((queries**2).sum(1)), np.sqrt((candidates**2).sum(1))
        # room for rounding in norms and radii; scores themselves are exact
        self.slack = 1e-3 + 1e-9 * float(self.size_x.max(initial=0)) * float(self.size_y.max(initial=0))
        self.score = np.full((len(queries), k), -np.inf)
        self.row = np.full((len(queries), k), len(candidates))
        self.products = 0

    def run(self) -> None:
        if len(self.x) and len(self.y):
            q, c = cover_tree(self.x), cover_tree(self.y)
            self.pair(q, q.rows, c)

    def worst(self, rows: np.ndarray) -> float:
        return float(self.score[rows, -1].min())

    def pair(self, q: Node, asked: np.ndarray, c: Node) -> None:
        """All queries ``asked`` of a node against all candidates of another, both inner."""
        for rows, node in self.parts(q, asked):
            if node is None:
                # queries by themselves, those that can't gain anything left out
                self.products += len(rows)
                high = self.x[rows] @ self.y[c.centre] + c.radius * self.size_x[rows]
                self.candidates(rows[high >= self.score[rows, -1] - self.slack], None, c)
            elif self.bound(node, np.array([c.centre]), np.array([c.radius]))[0] >= self.worst(rows) - self.slack:
                self.candidates(rows, node, c)

    def parts(self, q: Node, asked: np.ndarray) -> list[tuple[np.ndarray, Node | None]]:
        """A query node's children, groups of singles among them."""
        found: list[tuple[np.ndarray, Node | None]] = [(child.rows, child) for child in q.children]
        return found + [(q.single[i : i + ROW], None) for i in range(0, len(q.single), ROW)]

    def bound(self, q: Node, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
        self.products += len(centre)
        score = self.y[centre] @ self.x[q.centre]
        return score + q.radius * self.size_y[centre] + radius * (self.size_x[q.centre] + q.radius)

    def candidates(self, rows: np.ndarray, q: Node | None, c: Node) -> None:
        """Queries ``rows``, of the node q if it is one, against a candidate node's children, the best first."""
        if not len(rows):
            return
        # a few singles give a first worst score, so that whole balls can be pruned
        self.singles(rows, q, c.single[:SEED])
        if c.children:
            centre, radius = np.array([x.centre for x in c.children]), np.array([x.radius for x in c.children])
            if q is not None:
                high = self.bound(q, centre, radius)
                for i in np.argsort(-high, kind="stable").tolist():
                    if high[i] < self.worst(rows) - self.slack:
                        break
                    if q.radius > c.children[i].radius and (q.children or len(q.single) < len(q.rows)):
                        self.pair(q, rows, c.children[i])
                    else:
                        self.candidates(rows, q, c.children[i])
            else:
                self.products += len(rows) * len(centre)
                high = self.x[rows] @ self.y[centre].T + radius[None, :] * self.size_x[rows][:, None]
                for i in np.argsort(-high.max(0), kind="stable").tolist():
                    some = high[:, i] >= self.score[rows, -1] - self.slack
                    if some.any():
                        self.candidates(rows[some], None, c.children[i])
        self.singles(rows, q, c.single[SEED:])

    def singles(self, rows: np.ndarray, q: Node | None, single: np.ndarray) -> None:
        for i in range(0, len(single), ROW):
            part = single[i : i + ROW]
            if q is not None and len(rows) > 1 and q.radius < self.size_x[q.centre]:
                high = self.bound(q, part, np.zeros(len(part)))
                part = part[high >= self.worst(rows) - self.slack]
            for j in range(0, len(rows), ROW):
                self.base(rows[j : j + ROW], part)

    def base(self, rows: np.ndarray, part: np.ndarray) -> None:
        """Scores of single queries and single candidates."""
        if not len(part):
            return
        self.products += len(rows) * len(part)
        score = self.x[rows] @ self.y[part].T
        score[self.query_ids[rows][:, None] == self.ids[part][None, :]] = -np.inf
        gains = (score >= self.score[rows, -1][:, None]) & (score > -np.inf)
        some = gains.any(1)
        if not some.any():
            return
        rows, score = rows[some], np.where(gains[some], score[some], -np.inf)
        found = np.concatenate([self.score[rows], score], 1)
        which = np.concatenate([self.row[rows], np.broadcast_to(part, score.shape)], 1)
        which = np.where(found > -np.inf, which, len(self.y))
        order = np.lexsort((which, -found), axis=1)[:, : self.k]
        self.score[rows], self.row[rows] = np.take_along_axis(found, order, 1), np.take_along_axis(which, order, 1)


def best(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query id's k best rows; ties to the smaller id.

    Of several query vectors of one id, a candidate row's best score holds.
    """
    by = np.argsort(ids, kind="stable")  # ties go to the row that comes first
    candidates, ids = candidates[by], ids[by]
    walk = Search(queries, candidates, k, query_ids, ids)
    walk.run()
    names, name = np.unique(query_ids, return_inverse=True)
    i, j = np.nonzero(walk.score > -np.inf)
    i, j, score = name.reshape(-1)[i], walk.row[i, j], walk.score[i, j].astype(np.int64)
    order = np.lexsort((-score, j, i))
    i, j, score = i[order], j[order], score[order]
    once = np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))) if len(i) else np.zeros(0, bool)
    i, j, score = i[once], j[once], score[once]
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    begin = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
    top = rank < k
    return names[i[top]], ids[j[top]], score[top]


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", block: int = 4096, query_block: int = 8192) -> DataFrame:
    """``query_id, rank, vec_id, score``: exact, each query against every row but its own.

    Components become floor(scale * x). Vectors of different lengths count as padded with zeros.
    Rows without a key or a usable vector take no part; a key's repeated rows are separate
    candidates, none of them for the key's own query. A key's repeated query rows are one query; where
    their vectors differ, a candidate's best score holds. Ties go to the smaller key. No rows give no
    rows; other columns don't matter.

    block, query_block: rows of a task's sides. A candidate is copied once per block of queries and a
    query once per block of candidates, so rows moved are n * nq * (1 / block + 1 / query_block).
    """
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    n, nq = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("q"), 1))).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-nq // query_block))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    place = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    sides = rows.select("id", "v", F.lit(False).alias("query"), place(blocks, 1).alias("b"), every(query_blocks).alias("a"))
    asked = rows.where("q").select("id", "v").distinct().select("id", "v", F.lit(True).alias("query"), every(blocks).alias("b"), place(query_blocks, 2).alias("a"))
    dealt = sides.unionByName(asked).select((F.col("a").cast("long") * blocks + F.col("b")).alias("task"), "query", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, 0):
            task = table["task"].to_numpy()
            begin = np.flatnonzero(np.concatenate(([True], task[1:] != task[:-1]))) if len(task) else np.zeros(0, int)
            for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(task)], strict=True):
                part = table.slice(s, e - s).combine_chunks()
                query = part["query"].to_numpy()
                if not query.any() or query.all():
                    continue
                found = [np.floor(scale * np.asarray(v, float)) for v in part["v"].to_pylist()]
                x = np.zeros((len(found), max(map(len, found))))
                for i, v in enumerate(found):
                    x[i, : len(v)] = v
                ids = part["id"].to_numpy()
                a, b, score = best(x[query], ids[query], x[~query], ids[~query], k)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(score)], names=["query_id", "vec_id", "score"])

    local = dealt.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(run, "query_id long, vec_id long, score long")
    at = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(at)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
