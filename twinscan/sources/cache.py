"""Fingerprint cache between runs: two Parquet tables, ``media`` and ``hash``.

``media``: path, size, mtime, and width, height, length, format where they are known. ``hash``: path, alg,
at, h (a perceptual hash, of a video's frame at a second) or f, t (a sound's peak). An entry holds as long
as its file's size and time are the same.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, remove

# Numbers of the algorithms in the cache.
IMAGE_HASH, IMAGE_PHASH, AUDIO_HASH = 0, 1, 0xFFFF

MEDIA = "path string, size long, mtime timestamp, width int, height int, length double, format string"
HASH = "path string, at double, h long, f int, t int, alg int"


def lookup(files: DataFrame, media: DataFrame, hashes: DataFrame, alg: int) -> tuple[DataFrame, DataFrame]:
    """(cached hash rows of ``files``, files that are not cached or have changed).

    files: ``path, size, mtime``. A file cached without hashes (unreadable) counts as a hit.
    """
    valid = media.join(files.select("path", "size", "mtime"), ["path", "size", "mtime"], "left_semi").select("path")
    hits = hashes.where(F.col("alg") == alg).join(valid, "path", "left_semi")
    return hits, files.join(valid, "path", "left_anti")


def vacuum(table: DataFrame, present: DataFrame) -> DataFrame:
    """Rows of ``table`` whose path is still there."""
    return table.join(present.select("path"), "path", "left_semi")


def without(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("path"), "path", "left_anti")


def _full(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with all columns of a schema, nulls where they lack one."""
    kinds = dict(c.split() for c in schema.split(", "))
    return rows.select(*[F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])


class Cache:
    """The tables below a folder. A rewrite goes to a new version folder, which a pointer file of one
    row then names, so a reader never sees a half-written table."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        if not exists(spark, f"{self.folder}/current"):
            self._commit(spark.createDataFrame([], MEDIA), spark.createDataFrame([], HASH))

    def _version(self) -> str:
        return self.spark.read.text(f"{self.folder}/current").first()[0]

    def _commit(self, media: DataFrame, hashes: DataFrame) -> None:
        version = uuid.uuid4().hex
        old = self._version() if exists(self.spark, f"{self.folder}/current") else None
        media.write.parquet(f"{self.folder}/{version}/media")
        hashes.write.partitionBy("alg").parquet(f"{self.folder}/{version}/hash")
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/current")
        if old:
            remove(self.spark, f"{self.folder}/{old}")

    @property
    def media(self) -> DataFrame:
        return self.spark.read.schema(MEDIA).parquet(f"{self.folder}/{self._version()}/media")

    @property
    def hashes(self) -> DataFrame:
        return self.spark.read.schema(HASH).parquet(f"{self.folder}/{self._version()}/hash")

    def lookup(self, files: DataFrame, alg: int) -> tuple[DataFrame, DataFrame]:
        return lookup(files, self.media, self.hashes, alg)

    def add(self, media: DataFrame, hashes: DataFrame) -> None:
        """Append rows of new files; both may lack columns that their algorithm has no use for."""
        version = self._version()
        _full(hashes, HASH).write.mode("append").partitionBy("alg").parquet(f"{self.folder}/{version}/hash")
        _full(media, MEDIA).write.mode("append").parquet(f"{self.folder}/{version}/media")

    def replace(self, media: DataFrame, hashes: DataFrame) -> None:
        """Put rows of files in the place of what is held of them. Both must not read the cache."""
        self._commit(without(self.media, media).unionByName(_full(media, MEDIA)), without(self.hashes, media).unionByName(_full(hashes, HASH)))

    def remove(self, gone: DataFrame) -> None:
        self._commit(without(self.media, gone), without(self.hashes, gone))

    def vacuum(self, present: DataFrame) -> None:
        self._commit(vacuum(self.media, present), vacuum(self.hashes, present))
