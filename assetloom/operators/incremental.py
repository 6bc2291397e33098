"""What a run must do anew, keyed merges, and overlays of fresh over stored values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.config import ITEM_COLUMNS


def model_signature(**models: str) -> str:
    """One text for the models that a run uses; it changes when any of them does."""
    return "|".join(f"{k}={models[k]}" for k in sorted(models))


def usable_prior(prior: DataFrame, signature: str | None = None, root: str | None = None) -> DataFrame:
    """The rows of a stored state that a run may build on. A row made by other models, or by none that is named, counts for
    nothing where a `signature` is given; so does one from another source where a `root` is given (a row that names no
    source stays)."""
    none = F.lit(None).cast("string")
    if signature is not None:
        prior = prior.where((F.col("model_signature") if "model_signature" in prior.columns else none).eqNullSafe(signature))
    if root is not None:
        prior = prior.where(F.coalesce(F.col("source_root") if "source_root" in prior.columns else none, F.lit(root)) == root)
    return prior


def incremental_plan(scanned: DataFrame, prior: DataFrame, signature: str | None = None, root: str | None = None) -> DataFrame:
    """`(path, need_features, need_scores)` for each scanned `(path, mtime)`.

    Features are needed unless the stored row has the same time (to a microsecond), a blur score and a fingerprint;
    scores if features are, or a stored score is missing. What of the prior counts is `usable_prior`'s rule.
    """
    p = usable_prior(prior, signature, root).select("path", F.col("mtime").alias("old_mtime"), "blur_score", "fp", "aesthetic", "scene")
    same = F.coalesce(F.abs(F.unix_micros("mtime") - F.unix_micros("old_mtime")) <= 1, F.lit(False))
    need = ~(same & F.col("blur_score").isNotNull() & F.col("fp").isNotNull())
    return scanned.select("path", "mtime").join(p, "path", "left").select("path", need.alias("need_features"), (need | F.col("aesthetic").isNull() | F.col("scene").isNull()).alias("need_scores"))


def known_columns(df: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns that a snapshot has, in the order of `df`."""
    return df.select([c for c in df.columns if c in ITEM_COLUMNS or c in also])


def upsert(old: DataFrame, new: DataFrame, key: str = "path", seq: str | None = None, insert: bool = True) -> DataFrame:
    """Insert or update by key; only columns that `new` has change. Of repeated keys in `new` the last by `seq` counts. Without columns to set only unknown keys are added.

    Rows of `new` without a key are refused: the job fails. With `insert` false unknown keys are left out.
    """
    values = [c for c in new.columns if c not in (key, seq)]
    if not values:  # nothing is set; unknown keys are still inserted
        return old.unionByName(new.where(F.col(key).isNotNull()).select(key).distinct().join(old.select(key), key, "left_anti"), allowMissingColumns=True) if insert else old
    checked = new.withColumn(key, F.when(F.col(key).isNull(), F.raise_error(F.lit("row without a key"))).otherwise(F.col(key)))
    order = F.struct(*([seq] if seq else []), *values)
    last = checked.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("new"))
    joined = old.withColumn("in_old", F.lit(True)).join(last.withColumn("in_new", F.lit(True)), key, "full" if insert else "left")
    names = [*old.columns, *(c for c in values if c not in old.columns)]
    pick = lambda c: F.when(F.col("in_new"), F.col("new")[c]).otherwise(F.col(c) if c in old.columns else None).alias(c) if c in values else F.col(c)
    return joined.select([pick(c) for c in names])


def overlay(base: DataFrame, fresh: DataFrame, stored: DataFrame, defaults: dict[str, Column], key: str = "path") -> DataFrame:
    """For each key of `base`: this run's value, else the stored one, else the default."""
    f = fresh.select(key, *(F.col(c).alias(f"f_{c}") for c in defaults))
    s = stored.select(key, *(F.col(c).alias(f"s_{c}") for c in defaults))
    return base.select(key).join(f, key, "left").join(s, key, "left").select(key, *(F.coalesce(f"f_{c}", f"s_{c}", d).alias(c) for c, d in defaults.items()))


def scene_resolve(items: DataFrame, overrides: DataFrame | None = None, forced: str | None = None) -> DataFrame:
    """Replace `scene` and `scene_conf`: run override, then forced, then manual (confidence 1 each), then the scene's own; none: other, 1.

    A stored confidence of 0 counts as 1.
    """
    df = items.join(overrides.select("path", F.col("scene").alias("over__")), "path", "left") if overrides is not None else items.withColumn("over__", F.lit(None).cast("string"))
    manual = F.col("scene_manual") if "scene_manual" in items.columns else F.lit(None).cast("string")
    named = F.coalesce("over__", F.lit(forced).cast("string"), manual)
    conf = F.when(named.isNotNull() | F.col("scene").isNull(), 1.0).otherwise(F.when(F.coalesce("scene_conf", F.lit(0.0)) == 0, 1.0).otherwise(F.col("scene_conf")))
    return df.withColumns({"scene_conf": conf, "scene": F.coalesce(named, "scene", F.lit("other"))}).drop("over__")


def stale_artifacts(sources: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Sources `(path, mtime)` whose derived artifact, keyed by the path's md5, is missing or older."""
    keyed = sources.select("path", "mtime", F.md5("path").alias("key"))
    return keyed.join(artifacts.select("key", "artifact_mtime"), "key", "left").where("artifact_mtime is null or artifact_mtime < mtime").select("path", "key")


def evolve(old: DataFrame, like: DataFrame) -> DataFrame:
    """An old snapshot with the columns that `like` adds, null; doing it again changes nothing."""
    return old.unionByName(like.limit(0), allowMissingColumns=True)
