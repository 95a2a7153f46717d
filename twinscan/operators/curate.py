"""Choosing what to keep: filters, selection rules, delete plans, result rows.

members: ``group_id, member_ord, path, size, width, height, length`` (what a rule needs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import base_name, dir_name, human_size

#: What a rule orders by, and whether it takes the least.
RULES: dict[str, tuple[str, bool]] = {
    "small_file": ("size", True),
    "big_file": ("size", False),
    "small_area": ("width * height", True),
    "big_area": ("width * height", False),
    "short": ("length", True),
    "long": ("length", False),
}


def select(members: DataFrame, rule: str) -> DataFrame:
    """Adds ``selected``: one member of each group by ``rule``, the first of equal ones.

    "manual" selects none, "others" toggles a ``selected`` column.
    """
    if rule == "manual":
        return members.withColumn("selected", F.lit(False))
    if rule == "others":
        return members.withColumn("selected", ~F.col("selected"))
    value, least = RULES[rule]
    by = F.expr(value).asc_nulls_last() if least else F.expr(value).desc_nulls_last()
    at = Window.partitionBy("group_id").orderBy(by, "member_ord")
    return members.withColumn("selected", F.row_number().over(at) == 1)


def filter_groups(members: DataFrame, text: str | None) -> DataFrame:
    """Whole groups with ``text`` in any member's path, case-sensitive; no text keeps all."""
    if not text:
        return members
    hit = members.where(F.contains("path", F.lit(text))).select("group_id").distinct()
    return members.join(hit, "group_id", "left_semi")


def delete_plan(members: DataFrame) -> DataFrame:
    """``path`` of every selected member, once; nothing is deleted here."""
    return members.where("selected").select("path").distinct()


def shrink(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without the paths in ``gone``; a group of fewer than two is dropped."""
    left = members.join(gone.select("path"), "path", "left_anti")
    n = F.count(F.lit(1)).over(Window.partitionBy("group_id"))
    return left.withColumn("_n", n).where("_n > 1").drop("_n")


def sampling_plan(pairs: DataFrame, frames: int = 4) -> DataFrame:
    """Frames to look at of each pair: ``*, k, from_head, tail_a, tail_b``.

    pairs: ``length_a, length_b``. Times from the head are equal for both; from the tail they are
    taken back from each one's own end.
    """
    rate = F.floor(F.least("length_a", "length_b") / (frames + 1)).cast("int")
    steps = pairs.withColumn("_rate", rate).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(frames))))
    back = lambda c: F.floor(F.col(c) - F.col("_rate") * F.col("k")).cast("int")
    return steps.select(*pairs.columns, "k", (F.col("_rate") * F.col("k")).cast("int").alias("from_head"), back("length_a").alias("tail_a"), back("length_b").alias("tail_b"))


def counts(members: DataFrame) -> DataFrame:
    """``kind, n_groups, n_members`` of grouped members."""
    return members.groupBy("kind").agg(F.countDistinct("group_id").alias("n_groups"), F.count(F.lit(1)).alias("n_members"))


def describe(path: Column, size: Column, width: Column, height: Column, length: Column, kind: Column) -> list[Column]:
    """Columns of a result row: name, folder, ``w:h``, human size, length, format."""
    return [
        path.alias("path"),
        base_name(path).alias("name"),
        dir_name(path).alias("dir"),
        F.concat(width.cast("string"), F.lit(":"), height.cast("string")).alias("dimension"),
        human_size(size).alias("human_size"),
        F.when(length.isNotNull(), F.format_string("%.6f", length.cast("double"))).alias("length_text"),
        kind.alias("format"),
    ]
