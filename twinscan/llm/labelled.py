"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches
from .wordgrid import words


def held_out(key: Column) -> Column:
    """Rows that no model learns from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def sample(labels: DataFrame, label: str, each: int, key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """At most ``each`` keys per class (0 and 1) that may be learned from, and the class counts.

    Keys go by hash, so the choice is the same in every run. Null labels or keys don't count; of
    several labels of one key the largest holds.
    """
    rows = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("_y"))
    )
    counts = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    kept = None
    for y in (0, 1):
        part = rows.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(each)
        kept = part if kept is None else kept.unionByName(part)
    return kept, counts


def with_scores(docs: DataFrame, model: object, name: str = "score", text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, and each whole text's score; null counts as empty.

    model: anything with ``scores(chunk)``, of bounded size, broadcast once. ``name`` must not be a
    column of ``docs``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [held.value.scores(chunk) for chunk in words(batch.column(place))]
            if got:
                yield batch.append_column(name, pa.array(np.concatenate(got), pa.float64()))

    return docs.mapInArrow(run, schema)
