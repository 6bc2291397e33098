"""Name search over kept trigram postings: candidates by the pattern's trigrams, then the pattern itself."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 64


def trigrams(name: Column) -> Column:
    """Distinct runs of three characters of a name, in lower case."""
    low = F.lower(name)
    n = F.length(low)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def write_postings(items: DataFrame, folder: str, key: str = "path", name: str = "fname", mode: str = "overwrite") -> None:
    """`(gram, key)` of all items, in `PARTS` folders by gram and sorted by it, so that a search reads few files and, of those, few row groups. Names that are null or under three characters have no rows."""
    rows = items.where(F.col(name).isNotNull()).select(F.col(key).alias("key"), F.explode(trigrams(F.col(name))).alias("gram")).withColumn("part", _part(F.col("gram")))
    rows.repartition("part", "gram").sortWithinPartitions("part", "gram").write.partitionBy("part").mode(mode).parquet(folder)


def literal_runs(pattern: str) -> list[str]:
    """The runs of a search text that stand for themselves: `%` and `_` stand for others."""
    return [r for r in re.split(r"[%_]", pattern) if r]


def candidates(spark: SparkSession, folder: str, pattern: str) -> DataFrame | None:
    """`(key)` of items that have every trigram of the pattern's literal runs; None where those are too short to tell.

    Each trigram's postings are filtered by it at the scan and its folder; the rarest come down to one count for each key,
    added up where they are read.
    """
    runs = literal_runs(pattern)
    if not any(len(r) >= 3 for r in runs):
        return None
    known = spark.range(1).select(F.flatten(F.array(*(trigrams(F.lit(r)) for r in runs))).alias("g")).select(F.array_distinct("g").alias("g"), F.transform("g", _part).alias("p")).first()
    if not known["g"]:  # characters that fold into fewer
        return None
    rows = spark.read.parquet(folder).where(F.col("part").isin(sorted(set(known["p"]))) & F.col("gram").isin(known["g"]))
    return rows.groupBy("key").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(known["g"])).select("key")


def search(items: DataFrame, folder: str, pattern: str, key: str = "path", name: str = "fname") -> DataFrame:
    """Items whose name holds the pattern, without regard to case; `_` stands for any one character and `%` for any. The same rows as `item_filter({"search": pattern})`; what the postings leave is compared with the pattern itself."""
    cond = F.col(name).ilike("%" + pattern.replace("\\", "\\\\") + "%")
    found = candidates(items.sparkSession, folder, pattern)
    rows = items if found is None else items.join(found.withColumnRenamed("key", key), key, "left_semi")
    return rows.where(cond) if pattern else items
