"""Counts and sums by group that are kept from version to version: a change takes back old rows and adds new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(rows: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """`(*by, n, *sums)`: rows and sums of each group. A null value adds nothing, and a group's sum of none but nulls is 0. Sums of whole numbers stay exact; counts are sums of 0 and 1."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in sums.items()))


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str], touched: DataFrame | None = None) -> DataFrame:
    """`(key, *columns, weight)`: old values of keys that changed or went, with weight -1, and new ones of those that changed or came, with 1.

    With `touched(key)`, the keys that a run wrote, both versions are read for those only. Rows that are equal in all
    columns are no change. A key occurs once in a version.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(key, F.struct(*columns).alias(name))
        return rows if touched is None else rows.join(touched.select(key).distinct(), key, "left_semi")

    both = side(old, "was").join(side(new, "now"), key, "full").where(~F.col("was").eqNullSafe(F.col("now")))
    pair = F.array(F.struct(F.lit(-1).alias("weight"), F.col("was").alias("x")), F.struct(F.lit(1).alias("weight"), F.col("now").alias("x")))
    each = both.select(key, F.explode(F.filter(pair, lambda p: p["x"].isNotNull())).alias("p"))
    return each.select(key, *(F.col("p.x")[c].alias(c) for c in columns), F.col("p.weight").alias("weight"))


def changed_rollup(kept: DataFrame, change: DataFrame, by: list[str], sums: dict[str, Column]) -> DataFrame:
    """The rollup of the new version from that of the old one and the change rows: only those and the groups are read. Groups that are empty now are gone."""
    weighed = change.groupBy(*by).agg(F.sum("weight").alias("n"), *(F.coalesce(F.sum(c * F.col("weight")), F.lit(0)).alias(k) for k, c in sums.items()))
    names = ["n", *sums]
    both = kept.select(*by, *names).unionByName(weighed.select(*by, *names))
    return both.groupBy(*by).agg(*(F.sum(c).alias(c) for c in names)).where("n <> 0")
