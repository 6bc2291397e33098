"""Places and running numbers within keys of any size: rows are dealt by ranges of key and order, so that one key may lie in many parts, and what a part needs to know of those before it is carried over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from assetloom.session import cut


def ranged(df: DataFrame, by: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows, written with `part__`: parts hold consecutive rows by key and order, whatever share of them one key has."""
    where = [F.col(c) for c in by] + order
    dealt = df.repartitionByRange(parts, *where) if parts else df.repartitionByRange(*where)
    return cut(dealt.withColumn("part__", F.spark_partition_id()))


def carry(rows: DataFrame, by: list[str], carried: DataFrame) -> DataFrame:
    """`rows` with the columns of `carried(part__, *by, ...)`, which has a row for each part that goes on with the key of the part before: one a part at most, so it is sent to all tasks."""
    named = carried.select([F.col(c).alias(f"c_{c}") for c in ("part__", *by)] + [c for c in carried.columns if c not in ("part__", *by)])
    on = F.col("part__") == F.col("c_part__")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"c_{c}"))
    return rows.join(F.broadcast(named), on, "left").drop("c_part__", *(f"c_{c}" for c in by))


def placed(df: DataFrame, by: list[str], order: list[Column], name: str = "place", parts: int | None = None) -> DataFrame:
    """Add `name`: each row's place, from 0, among the rows of its key by `order`. A null key is a key. A key with most of all rows is numbered in as many tasks as it has parts."""
    rows = ranged(df, by, order, parts)
    counts = rows.groupBy("part__", *by).agg(F.count("*").alias("n__"))
    before = F.sum("n__").over(W.Window.partitionBy(*by).orderBy("part__").rowsBetween(W.Window.unboundedPreceding, -1))
    carried = counts.withColumn("before__", before).where("before__ is not null").drop("n__")
    local = F.row_number().over(W.Window.partitionBy("part__", *by).orderBy(*order)) - 1
    return carry(rows.withColumn(name, local), by, carried).withColumn(name, (F.col(name) + F.coalesce("before__", F.lit(0))).cast("long")).drop("before__", "part__")
