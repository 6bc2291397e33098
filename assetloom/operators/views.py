"""Filters, rollups, ranked views and export manifests over judged items."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from assetloom.config import ITEM_COLUMNS, Config
from assetloom.functions import exprs as X

_TEXT, _EQUAL = ("scene", "label", "search"), ("scene", "star", "is_waste", "is_best", "is_uncertain", "is_candidate", "group_id", "label")


def item_filter(filters: dict[str, Any]) -> Column:
    """Conjunction of the filters given; empty texts and absent keys do not filter. `search` heeds no case, and `_` and `%` in it stand for any one and any characters."""
    cond = F.lit(True)
    for k, v in filters.items():
        if v is None or (k in _TEXT and v == ""):
            continue
        if k in _EQUAL:
            cond = cond & (F.col(k) == v)
        elif k == "star_min":
            cond = cond & (F.coalesce("star", F.lit(0)) >= v)
        elif k == "search":
            cond = cond & F.col("fname").ilike("%" + v.replace("\\", "\\\\") + "%")
        else:
            raise ValueError(f"unknown filter {k}")
    return cond


def missing(items: DataFrame, field: str) -> DataFrame:
    """Paths of items that lack a value of `field`; none for a field that snapshots do not have."""
    if field not in ITEM_COLUMNS or field not in items.columns:
        return items.select("path").where(F.lit(False))
    return items.where(F.col(field).isNull()).select("path")


def leaderboard(judged: DataFrame, c: Config, scene: str = "", star_min: int = 0, hide_waste: bool = False, hide_losers: bool = False, only_best: bool = False, search: str = "", sort: str = "comp_desc") -> DataFrame:
    """Items that pass, in order: nulls last when rising, first when falling, ties by falling score, then path."""
    cond = F.coalesce("star", F.lit(0)) >= star_min
    cond = cond & (F.col("scene") == scene) if scene else cond
    cond = cond & ~F.col("is_waste") if hide_waste else cond
    cond = cond & ~(F.col("is_similar_loser") & ~F.col("is_waste")) if hide_losers else cond
    cond = cond & F.col("is_best") if only_best else cond
    cond = cond & F.lower("fname").contains(search.lower()) if search else cond
    name, _, way = sort.rpartition("_")
    col = {"comp": "comp_score", "ts": "ts", "star": "star", "name": "fname"}[name]
    return judged.where(cond).orderBy(F.col(col).asc_nulls_last() if way == "asc" else F.col(col).desc_nulls_first(), F.desc("comp_score"), "path")


def collection_stats(judged: DataFrame, groups: DataFrame) -> DataFrame:
    """Nine counts and `scenes`, a map of items by scene, in one pass over items and one over groups."""
    star = F.coalesce("star", F.lit(0))
    counts = {"total": F.count("*"), "waste": F.count_if("is_waste"), "starred": F.count_if(star > 0), "star5": F.count_if(star == 5), "best": F.count_if("is_best"), "uncertain_photos": F.count_if("is_uncertain"), "candidate_photos": F.count_if("is_candidate")}
    by_scene = judged.groupBy(F.coalesce("scene", F.lit("other")).alias("scene")).agg(*(n.alias(k) for k, n in counts.items()))
    i = by_scene.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in counts), F.map_from_entries(F.array_sort(F.collect_list(F.struct("scene", "total")))).alias("scenes"))
    g = groups.agg(F.count_if("is_uncertain").alias("uncertain_groups"), F.count("*").alias("groups"))
    return i.crossJoin(g)  # one row each


def reason_counts(judged: DataFrame) -> DataFrame:
    return judged.select(F.explode(F.split("waste_reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def cohens_d(df: DataFrame, value: Column, label: str) -> DataFrame:
    """Effect size between label 1 and 0: difference of means over the pooled deviation."""
    a = df.where(F.col(label).isin(0, 1) & value.isNotNull())
    on = lambda y, f: f(F.when(F.col(label) == y, value))
    s = a.agg(on(1, F.avg).alias("m1"), on(0, F.avg).alias("m0"), on(1, F.var_samp).alias("v1"), on(0, F.var_samp).alias("v0"), F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return s.select("n1", "n0", F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("d"))


def export_manifest(judged: DataFrame, c: Config, which: str = "keep") -> DataFrame:
    """Rows of the export list: which is keep, all or waste."""
    cond = {"keep": X.keep(F.col("star"), F.col("label"), c), "waste": F.col("is_waste"), "all": F.lit(True)}[which]
    r = lambda n, k: F.round(F.coalesce(n, F.lit(0.0)), k).alias(n)
    return judged.where(cond).select("fname", "path", "scene", r("scene_conf", 3), r("comp_score", 1), F.coalesce("star", F.lit(0)).alias("star"), F.coalesce("label", F.lit("")).alias("label"), F.coalesce("waste_reasons", F.lit("")).alias("waste_reasons"), F.col("is_best").cast("int").alias("is_best"), "group_id", r("blur_score", 1), r("over_ratio", 3), r("under_ratio", 3), r("aesthetic", 1))


def write_csv(manifest: DataFrame, path: str, files: int | None = 1) -> None:
    """Write the list with a header, as one file: it is made for people. `files=None` leaves as many parts as there are tasks, for lists that one task should not hold."""
    (manifest if files is None else manifest.coalesce(files)).write.mode("overwrite").csv(path, header=True)


def pair_levels(judged: DataFrame, c: Config) -> DataFrame:
    """The two best of each group side by side: `(group_id, a_path, b_path, comp_diff, dim, a_value, a_level, b_value, b_level)`, a row for each dimension."""
    long = judged.where("rank <= 2").select("group_id", "rank", "path", "comp_score", F.explode(X.breakdown(c)).alias("d"))
    one = lambda r, p: long.where(F.col("rank") == r).select("group_id", F.col("d.dim").alias("dim"), F.col("path").alias(f"{p}_path"), F.col("comp_score").alias(f"{p}_comp"), F.col("d.value").alias(f"{p}_value"), F.col("d.level").alias(f"{p}_level"))
    return one(1, "a").join(one(2, "b"), ["group_id", "dim"]).select("group_id", "a_path", "b_path", (F.col("a_comp") - F.col("b_comp")).alias("comp_diff"), "dim", "a_value", "a_level", "b_value", "b_level")


def copy_plan(chosen: DataFrame, folder: str = "photos") -> DataFrame:
    """`(src, dst)`, all `dst` different: the n-th of equal names gets `_n`, and where another file already has that name, a folder of its number beside `folder`."""
    n = F.row_number().over(W.Window.partitionBy("fname").orderBy("path"))
    stem, ext = F.regexp_extract("fname", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("fname", r"^(.*?)(\.[^.]*)?$", 2)
    named = chosen.select("path", "fname", n.alias("n")).withColumn("name", F.when(F.col("n") == 1, F.col("fname")).otherwise(F.concat(stem, F.lit("_"), F.col("n"), ext)))
    taken = chosen.select(F.col("fname").alias("name")).distinct().withColumn("taken", F.lit(True))
    # `stem_n` names differ from each other, so only a whole name can be in the way
    clash = (F.col("n") > 1) & F.coalesce("taken", F.lit(False))
    dst = F.when(clash, F.concat(F.lit(f"{folder}-"), F.col("n"), F.lit("/"), F.col("fname"))).otherwise(F.concat(F.lit(f"{folder}/"), F.col("name")))
    return named.join(taken, "name", "left").select(F.col("path").alias("src"), dst.alias("dst"))
