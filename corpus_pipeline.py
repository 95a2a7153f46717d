"""A training corpus from raw documents: four stages, each written as Parquet and read again.

toxicity -> quality -> near duplicates -> packing. Each stage works on all that its predecessor
kept; all but the last return rows of ``documents`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinscan.llm import jaccard, labelled, packing, quality, toxicity
from twinscan.llm.common import materialize, table, unused

#: A document is rejected as toxic from this score on.
TOXIC = 0.3
#: A document is rejected as low quality below this score.
GOOD = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs``, unchanged, whose worst window scores below ``TOXIC``.

    A null, empty or blank text has a constant score, half the share of toxic labels, so it stays unless
    most labels are toxic. Long texts are scored whole. Repeated rows are kept or dropped alike. Without
    usable labels of both classes all texts score alike. No rows give no rows; columns of any name are kept.
    """
    net = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, net, lambda score: score < TOXIC)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs``, unchanged, whose quality scores at least ``GOOD``.

    A null text counts as empty; an empty text has the score of no features at all. Long texts are scored
    whole. Repeated rows are kept or dropped alike. Without usable labels of both classes all texts score
    alike, by the share of good labels. No rows give no rows; columns of any name are kept.
    """
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _scored(docs, model, lambda score: score >= GOOD)


def _scored(docs: DataFrame, model: object, keep: Callable[[Column], Column]) -> DataFrame:
    [name] = unused(docs.columns, "_score")
    return labelled.with_scores(docs, model, name).where(keep(F.col(name))).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of ``docs``, unchanged: one of each class of near duplicates (five-word shingles, similarity 0.8).

    The row of the least doc_id stays, of repeated rows one. Null, empty and blank texts are one class. A row
    without doc_id goes by a hash of its text; texts that share a doc_id but are not alike each keep a row. No
    rows give no rows; columns of any name are kept.
    """
    return jaccard.keep_one(docs, tenths=8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of at most 4096 tokens.

    A null text counts as empty: one piece, the end id. Repeated rows are packed each; a null doc_id stays
    null. Only longer texts are cut. No rows give no rows; other columns don't matter.
    """
    return packing.pack(docs, limit=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
