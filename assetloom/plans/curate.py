"""The whole curation: resolve scenes, group, score, judge, roll up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.operators.decisions import fold, without_undone
from assetloom.operators.incremental import scene_resolve
from assetloom.operators.progress import Phases
from assetloom.operators.similarity import group_items
from assetloom.operators.verdict import group_scene, judge, score_items
from assetloom.session import cut


def curate(items: DataFrame, c: Config, overrides: DataFrame | None = None, decisions: DataFrame | None = None, watch: Phases | None = None) -> DataFrame:
    """Judged items. `items` has path, fname, ts_ms, fp, scene, scene_conf and the metrics.

    Decisions set stars, labels and manual scenes before judging; a manual star, 0 included, is not replaced. `watch` is
    told of the phases that end here: group and score; judging ends where the result is written.
    """
    df, saved = items, (lambda name, df: watch.run(name, df)) if watch else (lambda name, df: cut(df))
    if decisions is not None:
        d = fold(without_undone(decisions)).select("path", F.col("star").alias("star_by_hand"), F.col("label").alias("label"), "scene_manual")
        df = df.drop("label", "scene_manual").join(d, "path", "left")
    df = scene_resolve(df, overrides, c.forced_scene)
    df = saved("group", group_items(df, F.col("ts_ms"), c.burst_gap_ms, c.hash_threshold))
    scored = score_items(df.join(group_scene(df).select("group_id", "group_scene"), "group_id"), c, "group_scene")
    out = judge(saved("score", scored), c)
    return out.withColumn("star", F.coalesce("star_by_hand", "star")).drop("star_by_hand") if decisions is not None else out


def groups_of(judged: DataFrame) -> DataFrame:
    """`(group_id, size, best_path, is_uncertain, n_candidates)`; the first candidate stands for an undecided group's best."""
    return judged.groupBy("group_id").agg(F.count("*").alias("size"), F.coalesce(F.max(F.when(F.col("is_best"), F.col("path"))), F.max(F.when(F.col("candidate_rank") == 1, F.col("path")))).alias("best_path"), F.bool_or("is_uncertain").alias("is_uncertain"), F.count_if("is_candidate").alias("n_candidates"))


def run_summary(judged: DataFrame) -> DataFrame:
    g = groups_of(judged).agg(F.count("*").alias("groups"), F.count_if(F.col("is_uncertain")).alias("uncertain_groups"), F.count_if(~F.col("is_uncertain") & F.col("best_path").isNotNull()).alias("best_groups"))
    return g.crossJoin(judged.agg(F.count("*").alias("items"), F.count_if("is_waste").alias("waste"), F.count_if("is_candidate").alias("candidate_items")))  # one row each
