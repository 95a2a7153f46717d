"""Folding of pairs into duplicate groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components

GROUPS = "kind string, group_rank long, member_ord int, id long"


def fold_pairs(pairs: list[tuple[int, int, int]]) -> list[tuple[int, list[int]]]:
    """Greedy fold of (rank, a, b) in rank order: [(rank of the first pair, members)].

    A pair goes to the earliest group that holds either of its members; groups never merge, so a
    member may be in several.
    """
    groups: list[tuple[int, list[int]]] = []
    of: dict[int, list[int]] = {}  # member -> groups it is in, by creation
    for rank, a, b in sorted(pairs):
        first = min((of[x][0] for x in (a, b) if x in of), default=None)
        if first is None:
            first = len(groups)
            groups.append((rank, []))
        members = groups[first][1]
        for x in (a, b):
            if first not in of.get(x, ()):
                members.append(x)
                of.setdefault(x, []).append(first)
                of[x].sort()
    return groups


def greedy_groups(pairs: DataFrame, rank: list[str]) -> DataFrame:
    """``kind, group_rank, member_ord, id`` of groups in the order in which pairs were found.

    pairs: ``kind, id_a, id_b`` and the columns of ``rank``, which order them. A group of one
    component can't meet a pair of another, so components are folded in parallel, each by itself.
    Group_rank is unique per kind and grows with the pair that made the group.
    """
    held = pairs.select("kind", "id_a", "id_b", F.struct(*rank).alias("_r"))
    ends = held.select(F.struct("kind", F.col("id_a").alias("id")).alias("a"), F.struct("kind", F.col("id_b").alias("id")).alias("b"))
    of = components(ends).select(F.col("id.kind").alias("kind"), F.col("id.id").alias("id_a"), F.col("component.id").alias("_c"))
    ordered = held.join(of, ["kind", "id_a"]).select("kind", "_c", "id_a", "id_b", F.to_json("_r").alias("_key"), *[F.col(f"_r.{c}").alias(f"_o{i}") for i, c in enumerate(rank)])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([f"_o{i}" for i in range(len(rank))], kind="stable")
        found = fold_pairs(list(zip(range(len(pdf)), pdf["id_a"].tolist(), pdf["id_b"].tolist(), strict=True)))
        keys = pdf["_key"].tolist()
        kind = pdf["kind"].iloc[0]
        rows = [(kind, keys[r], n, m) for r, members in found for n, m in enumerate(members)]
        return pd.DataFrame(rows, columns=["kind", "first_pair", "member_ord", "id"])

    return ordered.groupBy("kind", "_c").applyInPandas(fold, "kind string, first_pair string, member_ord int, id long")


def component_groups(pairs: DataFrame) -> DataFrame:
    """``id, component``: groups that merge, as an alternative to the greedy fold."""
    return components(pairs, "id_a", "id_b")
