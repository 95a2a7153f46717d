"""Helpers that the operators of this subpackage share.

Everything here keeps its driver-side state bounded: paths, a few bounds, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import free, materialize, shared_dir  # noqa: F401  for the operators


def unused(columns: list[str], *names: str) -> list[str]:
    """Each of ``names``, with so many underscores behind that it is none of ``columns`` (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader alone, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small: a batch holds whole texts, some of them very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Gapless rank from 0 within ``keys``, without bringing a key's rows into one task.

    Rows are dealt to ``(keys, bucket)``, ranked there, and shifted by the number of rows in
    the key's earlier buckets. The bucket is a hash of ``order``, so a task that is run again
    ranks alike. The rank is dense per key but follows no user-visible order; ``order`` must
    identify a row up to interchangeable ones.
    """
    n = shuffle_partitions(df.sparkSession)
    bucket, earlier, within, many = unused([*df.columns, name], "_bucket", "_before", "_inside", "_n")
    at = [*keys, bucket]
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order, F.lit(17)), F.lit(n)).cast("int"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*at).agg(F.count(F.lit(1)).alias(many))
    first = counts.select(*at, F.coalesce(F.sum(many).over(before), F.lit(0)).alias(earlier))
    inside = Window.partitionBy(*at).orderBy(*order)
    return (
        dealt.withColumn(within, F.row_number().over(inside) - 1)
        .join(first, at)
        .withColumn(name, F.col(earlier) + F.col(within))
        .drop(bucket, earlier, within)
    )


def id_bounds(ids: DataFrame, column: str, rows_per_bucket: int) -> list[int]:
    """Ascending values of ``column`` that start buckets of about ``rows_per_bucket`` rows.

    The first is the smallest value; each is a value that occurs. Empty for no rows.
    """
    n = ids.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)), F.min(column)).first()
    if not n or not n[0]:
        return []
    buckets = max(1, -(-n[0] // rows_per_bucket))
    at = [i / buckets for i in range(1, buckets)]
    found = ids.approxQuantile(column, at, 1 / (4 * buckets)) if at else []
    return sorted({int(n[1]), *(int(x) for x in found)})


def bucket_by(value: Column, bounds: list[int], held: Column) -> Column:
    """Index of the last bound that is at most ``value``: binary search as an expression.

    held: the bounds as a constant array. A null or smaller value is in bucket 0.
    """
    steps = [1 << i for i in reversed(range(max(1, len(bounds)).bit_length()))]
    last = len(bounds) - 1
    return F.aggregate(
        F.array(*[F.lit(x) for x in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= last) & (F.get(held, at + step) <= value), at + step
        ).otherwise(at),
    )


def groups_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Runs of whole groups (equal ``column``) of sorted rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        task = batch.column(column).to_numpy()
        last = int(np.searchsorted(task, task[-1], "left")) if (task[1:] >= task[:-1]).all() else 0
        if held and task[0] == task[-1] and held[-1].column(column)[-1].as_py() == task[0]:
            held.append(batch)
            continue
        if held or last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)
