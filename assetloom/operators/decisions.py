"""People's decisions as an append-only log `(seq, path, kind, value)`, folded to a state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("star", "label", "pick", "scene")


def expand(log: DataFrame) -> DataFrame:
    """One row for each field that a decision sets: a pick P also sets star 5, a pick X star 0."""
    pick = F.array(F.struct(F.lit("label").alias("field"), F.col("value").alias("v")), F.struct(F.lit("star").alias("field"), F.when(F.col("value") == "P", "5").otherwise("0").alias("v")))
    one = F.array(F.struct(F.col("kind").alias("field"), F.col("value").alias("v")))
    return log.where(F.col("kind").isin(*KINDS)).select("seq", "path", F.explode(F.when(F.col("kind") == "pick", pick).otherwise(one)).alias("f")).select("seq", "path", "f.field", F.col("f.v").alias("value"))


def fold(log: DataFrame) -> DataFrame:
    """`(path, star, label, scene_manual)`: the latest value of each field. A star that is no whole number counts as none."""
    last = lambda f: F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq")))
    return expand(log).groupBy("path").agg(last("star").try_cast("int").alias("star"), last("label").alias("label"), last("scene").alias("scene_manual"))


def without_undone(log: DataFrame) -> DataFrame:
    """The log without decisions that an `undo` row (value: the decision's seq) cancels, and without the undo rows. An undo whose value is no number cancels nothing."""
    undone = log.where("kind = 'undo'").select(F.col("value").try_cast("bigint").alias("seq")).where("seq is not null")
    return log.where("kind <> 'undo'").join(undone, "seq", "left_anti")


def keep_only_best(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Decision rows that reject all members but the best: `(path, kind, value)` with pick X."""
    return members.select("path", "group_id").join(groups.where("best_path is not null").select("group_id", "best_path"), "group_id").where("path <> best_path").select("path", F.lit("pick").alias("kind"), F.lit("X").alias("value"))


def picked(paths: DataFrame) -> DataFrame:
    """Decision rows that keep candidates, or get back what lost to a near-duplicate: pick P."""
    return paths.select("path", F.lit("pick").alias("kind"), F.lit("P").alias("value"))


def removed(paths: DataFrame) -> DataFrame:
    """Decision rows that take items off the export list: star 0, and no label."""
    fields = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("value")) for k, v in (("star", "0"), ("label", ""))))
    return paths.select("path", F.explode(fields).alias("d")).select("path", "d.kind", "d.value")


def scene_set(paths: DataFrame, scene: str | None) -> DataFrame:
    """Decision rows that name a scene by hand; None goes back to the automatic one."""
    return paths.select("path", F.lit("scene").alias("kind"), F.lit(scene).cast("string").alias("value"))


def numbered(rows: DataFrame, after: int) -> DataFrame:
    """Decision rows `(path, kind, value)` as log rows with numbers above `after`, in no particular order."""
    return rows.withColumn("seq", F.lit(after + 1) + F.monotonically_increasing_id()).select("seq", "path", "kind", "value")
