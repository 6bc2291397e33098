"""What the two classifiers share: the fold rule and label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(id: Column) -> Column:
    """True for ids that a model must not learn from: crc32 of the id's text, mod 5, is 0."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(labels: DataFrame, label: str, id: str = "doc_id") -> DataFrame:
    """`(doc_id, y)` of labelled rows that are not held out, one per id; null ids and labels other than 0 and 1 go."""
    rows = labels.select(F.col(id).alias("doc_id"), F.col(label).cast("int").alias("y"))
    return rows.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
