"""Connected components by contraction: every vertex joins its least neighbour, edges follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import free, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` for every vertex of an edge; component: its least vertex.

    A round points each vertex to the least of itself and its neighbours and replaces the ends of all
    edges by what they point to, until no edge is left; then the rounds are applied one after the other.
    Stars around a least vertex end in one round. The first round goes by the vertices' own order, the
    others by a hash, which shrinks chains by a share in every round. Each round is written to the
    shared folder. A vertex with very many neighbours costs no task more: minima are pre-aggregated,
    and the joins are merges of plain exchanges at any size, whose large partitions can be split.
    """
    pairs = materialize(edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y")).distinct(), "cc")
    rounds: list[DataFrame] = []
    while not rounds or not pairs.isEmpty():

        def rank(end: str) -> Column:
            own = F.col(end).alias("v")
            return F.struct(F.xxhash64(end).alias("h"), own) if rounds else F.struct(own)

        both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.select("x", rank("x").alias("own"), rank("y").alias("other")).groupBy("x").agg(F.least(F.min("own"), F.min("other"))["v"].alias("m"))
        near = materialize(least, "cc-near")
        # a join for each end
        left = near.select("x", F.col("m").alias("mx"))
        right = near.select(F.col("x").alias("y"), F.col("m").alias("my"))
        moved = pairs.join(left.hint("merge"), "x").join(right.hint("merge"), "y").where("mx != my")
        after = materialize(moved.select(F.col("mx").alias("x"), F.col("my").alias("y")).distinct(), "cc")
        free(pairs)
        pairs = after
        rounds.append(near)
    free(pairs)
    found = rounds[0].withColumnRenamed("m", "component")
    if len(rounds) == 1:
        return found.withColumnRenamed("x", "id")
    for near in rounds[1:]:
        step = near.select(F.col("x").alias("component"), "m")
        found = found.join(step.hint("merge"), "component", "left").select("x", F.coalesce("m", "component").alias("component"))
    found = materialize(found, "cc-roots")
    free(*rounds)
    names = materialize(found.groupBy("component").agg(F.min("x").alias("least")), "cc-names")
    return found.join(names.hint("merge"), "component").select(F.col("x").alias("id"), F.col("least").alias("component"))
