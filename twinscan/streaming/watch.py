"""Structured Streaming over arriving files. An extension: a one-off scan needs none of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pairs import hamming_matches
from ..settings import Settings
from ..sources.cache import IMAGE_HASH, Cache
from ..sources.decoders import Decoders
from ..sources.files import classify
from ..sources.media import hashes, probe


def watch_images(spark: SparkSession, folder: str, cache: Cache, checkpoint: str, on_pairs: Callable[[DataFrame], None], settings: Settings | None = None, decoders: Decoders | None = None, once: bool = True) -> StreamingQuery:
    """Hash images as they arrive below ``folder``; ``on_pairs`` gets the new pairs of each batch.

    A batch's rows are joined with each other and with the cache, then added to the cache. A batch that is run
    again after a failure finds its files cached and adds nothing twice.
    """
    settings = settings or Settings(proc_image=True)
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(folder)

    def batch(df: DataFrame, _: int) -> None:
        files = df.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
        files = classify(files, settings).where("kind = 'image'")
        _, new = cache.lookup(files, IMAGE_HASH)
        found = hashes(probe(new.select("path", "kind", "size", "content"), settings, decoders)).select("path", "h").where("h is not null").cache()
        known = cache.hashes.where(F.col("alg") == IMAGE_HASH).select("path", "h")
        rows = lambda df: df.select(F.col("path").alias("id"), F.col("path").alias("ord"), "h")
        before = known.join(found.select("path"), "path", "left_anti")
        on_pairs(hamming_matches(rows(found), rows(before), settings.image_distance, settings.mask))
        cache.add(new.select("path", "size", "mtime"), found.withColumn("alg", F.lit(IMAGE_HASH)).withColumn("at", F.lit(0.0)))
        found.unpersist()

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
