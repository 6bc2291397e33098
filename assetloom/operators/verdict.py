"""Scores, group verdicts, ranks and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from assetloom.config import Config
from assetloom.functions import exprs as X
from assetloom.operators.places import placed
from assetloom.session import cut


def score_items(items: DataFrame, c: Config, scene: str = "scene") -> DataFrame:
    """By the preset of column `scene`, add sub-scores, `comp_score`, `hard_reasons`, `hard_waste`. Missing metrics count as 0, a missing aesthetic as 50."""
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    blur, over, under = zero("blur_score"), zero("over_ratio"), zero("under_ratio")
    df = items.withColumns({
        "blur_n": F.when(F.col("quality").isNull(), X.norm_blur(blur)).otherwise(0.5 * X.norm_blur(blur) + 0.5 * X.norm_quality(F.col("quality"))),
        "expo_n": X.norm_exposure(over, under),
        "aes_n": X.norm_aesthetic(F.coalesce("aesthetic", F.lit(50.0))),
        "face_n": X.norm_face(F.col("is_face"), F.col("ear"), c),
        "closed": X.eyes_closed(F.col("ear"), F.col("eye_close_prob"), c),
    })
    parts = [F.col(n) for n in ("blur_n", "expo_n", "aes_n", "face_n")]
    hard = X.waste_reasons(blur, over, under, F.lit(False), F.col("closed"), F.col("is_face"), c)
    return df.withColumns({"comp_score": X.composite(parts, X.weights(F.col(scene), c)), "hard_reasons": hard}).withColumn("hard_waste", F.size("hard_reasons") > 0)


def _of_scenes() -> list[Column]:
    return [F.when(F.bool_or(F.col("scene") == "portrait"), "portrait").when(F.bool_or(F.col("scene") == "landscape"), "landscape").otherwise("other").alias("group_scene"), F.coalesce(F.avg("scene_conf"), F.lit(1.0)).alias("group_conf")]


def group_scene(items: DataFrame) -> DataFrame:
    """`(group_id, group_scene, group_conf)`: portrait if any member is, else landscape if any, else other; mean confidence."""
    return items.groupBy("group_id").agg(*_of_scenes())


def rank_in_group(scored: DataFrame) -> DataFrame:
    """Add `rank` of members that are not rejected, best first, ties by path; null for rejected ones. A group with most of all items is ranked in as many tasks as it has parts."""
    rows = placed(scored, ["group_id"], [F.col("hard_waste"), F.desc("comp_score"), F.col("path")], "rank")
    return rows.withColumn("rank", F.when(~F.col("hard_waste"), F.col("rank") + 1))


def verdicts(scored: DataFrame, c: Config) -> DataFrame:
    """One row for each group: `size`, `best_path`, `is_uncertain`, `n_candidates`, `gap`, `group_scene`, `group_conf`, `best_fp`, `top_paths`.

    No clean member: no best. Else undecided if the two best are closer than the score gap, or their dimensions differ
    by little and each wins somewhere, or the mean scene confidence is low. `top_paths` lists the best clean members, as
    many as there can be candidates. Only those few of each task's rows of a group travel, so a group with a large share
    of all rows is no large task.
    """
    dims, most = ("blur_n", "aes_n", "face_n"), max(2, c.max_candidates)
    w = W.Window.partitionBy("group_id").orderBy(F.desc("comp_score"), "path")
    tops = scored.where(~F.col("hard_waste")).select("group_id", "path", "fp", "comp_score", *dims, F.row_number().over(w).alias("rank")).where(F.col("rank") <= most)
    top = lambda r, n: F.max(F.when(F.col("rank") == r, F.col(n)))
    t = tops.groupBy("group_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("top_paths"), top(1, "path").alias("best_path"), top(1, "fp").alias("best_fp"), (top(1, "comp_score") - top(2, "comp_score")).alias("gap"),
        *((top(1, n) - top(2, n)).alias(f"d_{n}") for n in dims),
    )
    diff = [F.col(f"d_{n}") for n in dims]
    small = (F.abs(diff[0]) < c.dimension_gap) & (F.abs(diff[1]) < c.dimension_gap) & (F.abs(diff[2]) < c.dimension_gap)
    conflict = small & (F.greatest(*diff) > 0) & (F.least(*diff) < 0)
    sums = scored.groupBy("group_id").agg(F.count("*").alias("size"), F.count_if(~F.col("hard_waste")).alias("clean"), *_of_scenes())
    unsure = (F.col("clean") > 0) & (F.coalesce(F.col("gap") < c.score_gap, F.lit(False)) | F.coalesce(conflict, F.lit(False)) | (F.col("group_conf") < c.confidence_low))
    g = sums.join(t, "group_id", "left").withColumn("is_uncertain", unsure)
    return g.select("group_id", "size", "best_path", "is_uncertain", F.when(F.col("is_uncertain"), F.least(F.col("clean"), F.lit(c.max_candidates))).otherwise(0).cast("int").alias("n_candidates"), "gap", "group_scene", "group_conf", "best_fp", "top_paths")


def judge(scored: DataFrame, c: Config) -> DataFrame:
    """Marks of each item: best, candidate and its rank, near-duplicate of the best (waste) or loser, reasons, stars. `rank` is that of a group's best members, as many as there can be candidates."""
    v = cut(verdicts(scored, c).select("group_id", "size", "best_path", "is_uncertain", "n_candidates", "best_fp", "top_paths"))
    place = F.array_position("top_paths", F.col("path")).cast("int")
    df = scored.join(v, "group_id").withColumn("rank", F.when(place > 0, place))
    other = (F.col("size") > 1) & F.col("best_path").isNotNull() & (F.col("path") != F.col("best_path"))
    if not c.dup_in_uncertain:
        other = other & ~F.col("is_uncertain")
    near = X.hamming(F.col("fp"), F.col("best_fp")) <= c.strict_duplicate
    df = df.withColumns({"is_dup": other & near, "is_best": ~F.col("is_uncertain") & F.coalesce(F.col("path") == F.col("best_path"), F.lit(False))})
    df = df.withColumn("is_candidate", F.col("is_uncertain") & F.coalesce(F.col("rank") <= F.col("n_candidates"), F.lit(False)))
    zero = lambda n: F.coalesce(n, F.lit(0.0))
    reasons = X.waste_reasons(zero("blur_score"), zero("over_ratio"), zero("under_ratio"), F.col("is_dup"), F.col("closed"), F.col("is_face"), c)
    df = df.withColumns({"is_similar_loser": other & ~near, "candidate_rank": F.when(F.col("is_candidate"), F.col("rank")).otherwise(0).cast("int"), "reasons": reasons})
    old = F.col("star") if "star" in scored.columns else F.lit(0)
    return df.withColumns({"is_waste": F.size("reasons") > 0, "waste_reasons": X.reasons_text(F.col("reasons")), "star": X.sticky_star(old, F.col("is_best"))}).drop("size", "n_candidates", "best_path", "best_fp", "top_paths", "reasons")


def suggested_stars(judged: DataFrame) -> DataFrame:
    """`(path, suggested)`: 5 for a best, 4 for the first candidate of an undecided group."""
    return judged.select("path", F.when(F.col("is_best"), 5).when(F.col("candidate_rank") == 1, 4).otherwise(0).alias("suggested"))
