"""File scans: listing below source folders, and classification by suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import kinds, real_path
from ..settings import Settings
from ..storage import materialize


def suffix_glob(suffixes: tuple[str, ...]) -> str:
    """File names with one of ``suffixes`` in any case, as Hadoop's glob."""
    anycase = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    return "*.{" + ",".join(map(anycase, suffixes)) + "}"


def _opened(spark: SparkSession, kind: str, roots: list[str], suffixes: tuple[str, ...] | None) -> DataFrame:
    reader = spark.read.format(kind).option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if suffixes is not None:
        reader = reader.option("pathGlobFilter", suffix_glob(suffixes))
    return reader.load([real_path(r) for r in roots])


def plain_path(uri: str | Column) -> Column:
    return F.regexp_replace(uri, "^file:/+", "/")


def listing(spark: SparkSession, roots: list[str], content: bool = False, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """``path, size, mtime`` (and ``content``) of every file below ``roots``, once each.

    A root is a folder or a file. suffixes: only files with one of these. Without ``content`` no file is
    opened: the column is pruned from the scan. Unreadable files are skipped with a warning of Spark's.
    """
    found = _opened(spark, "binaryFile", roots, suffixes)
    held = found.select(plain_path("path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))
    return held if content else held.distinct()


def pictures(spark: SparkSession, roots: list[str], suffixes: tuple[str, ...]) -> DataFrame:
    """``path, width, height, channels, data`` of images below ``roots``, decoded in the JVM; data: BGR rows.

    Unreadable images have no row.
    """
    found = _opened(spark, "image", roots, suffixes).select("image.*").where("height > 0 and width > 0")
    return found.select(plain_path("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")


def classify(files: DataFrame, settings: Settings) -> DataFrame:
    """Files once per enabled kind their suffix has: adds ``kind``."""
    return files.withColumn("kind", F.explode(kinds(F.col("path"), settings)))


def range_numbered(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Adds ``name``, the place from 1 of a row within ``keys`` in the order of ``order``; its ties in any order.

    Rows are range-partitioned, so no task sorts a key's rows alone: they are numbered inside their range,
    and shifted by the key's rows in earlier ranges. The ranges are written, as a second reading could cut them differently.
    """
    held = materialize(rows.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = held.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    placed = held.withColumn("_inside", inside).join(first, [*keys, "_range"])
    return placed.select(*rows.columns, (F.col("_before") + F.col("_inside")).cast("long").alias(name))


def numbered(files: DataFrame) -> DataFrame:
    """Adds ``ord``, the place of a path within its kind in the order of paths."""
    return range_numbered(files, ["kind"], "path", "ord")
