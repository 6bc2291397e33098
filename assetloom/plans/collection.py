"""A run over a collection: what is new gets features and scores, everything is grouped and judged, a new version is published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.operators.features import fill_scores
from assetloom.operators.incremental import incremental_plan, usable_prior
from assetloom.operators.progress import Phases
from assetloom.plans.curate import curate
from assetloom.session import cut
from assetloom.sources.files import Snapshots
from assetloom.streaming.ledger import Ledger

#: Columns that extraction gives, that scoring gives, and that people's work leaves.
FEATURES = ("fname", "ts", "width", "height", "blur_score", "over_ratio", "under_ratio", "quality", "ear", "eye_close_prob", "is_face", "fp")
SCORES = ("aesthetic", "scene", "scene_conf")
BY_HAND = ("star", "label", "scene_manual")

TYPES = {"fname": "string", "ts": "timestamp", "width": "int", "height": "int", "is_face": "boolean", "fp": "bigint", "scene": "string", "star": "int", "label": "string", "scene_manual": "string"}

Stage = Callable[[DataFrame], DataFrame]


def typed(*names: str) -> str:
    return ", ".join(f"{c} {TYPES.get(c, 'double')}" for c in names)


def _shaped(made: DataFrame, also: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """`(*also, *names)` of what a stage has made, null where it has no such column."""
    return made.select(*also, *((F.col(c) if c in made.columns else F.lit(None)).cast(TYPES.get(c, "double")).alias(c) for c in names))


def refreshed(scanned: DataFrame, prior: DataFrame | None, features: Stage, scores: Stage, signature: str | None = None, root: str | None = None, ledger: Ledger | None = None, watch: Phases | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Items `(path, mtime, FEATURES, SCORES, BY_HAND)` for all of `scanned` `(path, mtime)`.

    `features` gets the scanned rows that are new or changed, or lack features, and returns `(path, FEATURES)`; `scores`
    gets items that lack a score and returns `(path, SCORES)`. Everything else comes from the prior, of which only what
    `usable_prior` lets through counts. Paths that are no longer scanned are gone; a file that cannot be read keeps its
    row without features and is tried again in the next run. A scene that a person set is no automatic one: it is kept
    apart in `scene_manual`.

    Both stages get only rows that they are asked for, and should read nothing else that grows with the collection:
    `features` gets all columns of `scanned`, `scores` those of the items and the `carried` ones of `scanned`.

    With a `ledger` both stages run in batches that are kept as they end. What earlier runs finished for the same file
    time counts as if it were in the prior, so a run after one that died does the rest only.
    """
    spark, saved = scanned.sparkSession, (lambda name, df: watch.run(name, df)) if watch else (lambda name, df: cut(df))
    old = None if prior is None else usable_prior(prior, signature, root)
    had = None if old is None else old.select("path", "mtime", *_columns(old, (*FEATURES, *SCORES, *BY_HAND)))
    if ledger:
        found = ledger.done("features", f"path string, mtime timestamp, {typed(*FEATURES)}")
        had = _with_done(had if had is not None else spark.createDataFrame([], f"path string, mtime timestamp, {typed(*FEATURES, *SCORES, *BY_HAND)}"), found)
    plan = scanned.select("path", F.lit(True).alias("need_features")) if had is None else incremental_plan(scanned, had).select("path", "need_features")
    plan = saved("plan", plan)
    todo = scanned.join(plan.where("need_features").select("path"), "path", "left_semi")
    if ledger:
        times = todo.select("path", "mtime")
        ledger.work("features", todo, lambda rows: _shaped(features(rows), ("path",), FEATURES).join(rows.select("path", "mtime"), "path"))
        found = ledger.done("features", f"path string, mtime timestamp, {typed(*FEATURES)}").withColumnRenamed("mtime", "done_for")
        fresh = cut(times.join(found, "path").where("mtime <=> done_for").select("path", *FEATURES))
    else:
        fresh = saved("features", _shaped(features(todo), ("path",), FEATURES))
    base = scanned.select("path", "mtime", *(F.col(c).alias(f"c_{c}") for c in carried)).join(plan, "path").join(fresh.select("path", *(F.col(c).alias(f"f_{c}") for c in FEATURES)), "path", "left")
    if had is not None:
        base = base.join(had.select("path", *(F.col(c).alias(f"p_{c}") for c in had.columns if c not in ("path", "mtime"))), "path", "left")

    def stored(c: str) -> Column:
        return F.col(f"p_{c}") if f"p_{c}" in base.columns else F.lit(None).cast(TYPES.get(c, "double"))

    new = F.col("need_features")
    cols = [F.when(new, F.col(f"f_{c}")).otherwise(stored(c)).alias(c) for c in FEATURES] + [F.when(~new, stored(c)).cast(TYPES.get(c, "double")).alias(c) for c in SCORES] + [stored(c).alias(c) for c in BY_HAND]
    items = cut(base.select("path", "mtime", *cols, *(F.col(f"c_{c}").alias(c) for c in carried)))
    return (second_stage(items, scores, ledger) if ledger else saved("scores", fill_scores(items, scores, SCORES))).drop(*carried)


def _columns(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [c for c in names if c in df.columns]


def _with_done(had: DataFrame, found: DataFrame) -> DataFrame:
    """The prior with what unpublished batches have made: their features and file time, no scores, and the prior's work by hand."""
    made = found.select("path", F.lit(True).alias("in_done"), F.col("mtime").alias("d_mtime"), *(F.col(c).alias(f"d_{c}") for c in FEATURES))
    both = had.join(made, "path", "full")
    of = lambda c: F.col(c) if c in had.columns else F.lit(None).cast(TYPES.get(c, "double"))
    done = F.coalesce("in_done", F.lit(False))
    return cut(both.select("path", F.when(done, F.col("d_mtime")).otherwise(F.col("mtime")).alias("mtime"), *(F.when(done, F.col(f"d_{c}")).otherwise(of(c)).alias(c) for c in FEATURES), *(F.when(~done, of(c)).cast(TYPES.get(c, "double")).alias(c) for c in SCORES), *(of(c).alias(c) for c in BY_HAND)))


def second_stage(items: DataFrame, scores: Stage, ledger: Ledger, key: str = "path") -> DataFrame:
    """Items with missing scores filled, in batches that are kept as they end: rows that lack a score, and whose score for
    the same file time no earlier run has finished, are a queue. A value that is there stays."""
    kind = f"{key} string, mtime timestamp, {typed(*SCORES)}"

    def filled(df: DataFrame) -> DataFrame:
        made = ledger.done("scores", kind, key).select(key, F.col("mtime").alias("m__"), *(F.col(c).alias(f"n_{c}") for c in SCORES))
        fresh = F.col("m__").eqNullSafe(F.col("mtime"))
        return cut(df.join(made, key, "left").withColumns({c: F.coalesce(c, F.when(fresh, F.col(f"n_{c}"))) for c in SCORES}).select(df.columns))

    items = filled(items)
    lacking = items.where(" or ".join(f"{c} is null" for c in SCORES))
    return filled(items) if ledger.work("scores", lacking, lambda rows: _shaped(scores(rows), (key,), SCORES).join(rows.select(key, "mtime"), key)) else items


def published(target: Snapshots) -> DataFrame | None:
    """The current version as a prior: with its automatic scenes, and the models and source that it names."""
    prior = target.read()
    named = {"model_signature": F.lit(target.meta("model_signature")).cast("string"), "source_root": F.lit(target.meta("source_root")).cast("string")}
    return None if prior is None else prior.withColumns({"scene": F.col("scene_auto"), "scene_conf": F.col("scene_conf_auto")} | named)


def run_collection(target: Snapshots, scanned: DataFrame, features: Stage, scores: Stage, c: Config, signature: str, root: str, overrides: DataFrame | None = None, decisions: DataFrame | None = None, batch_rows: int = 100_000, watch: Phases | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """One whole run: refresh against the published version, group, judge, publish with signature and root. Returns what was published.

    `scene` and `scene_conf` are the resolved ones; the automatic ones are published as `scene_auto` and `scene_conf_auto`,
    and a later run resolves them anew. A second run without change extracts and scores nothing. Features and scores are
    made in batches of `batch_rows`, each kept as it ends; a run after one that died goes on from there. `watch` is told of
    each phase's rows and seconds. `carried` names columns of `scanned` that `scores` reads beside the items' own.
    """
    watch = watch or Phases(scanned.sparkSession)
    ledger = Ledger(scanned.sparkSession, f"{target.root}/unfinished", signature, root, batch_rows, watch)
    items = refreshed(scanned, published(target), features, scores, signature, root, ledger, watch, carried).withColumns({"scene_auto": F.col("scene"), "scene_conf_auto": F.col("scene_conf"), "ts_ms": F.unix_micros("ts") / 1000.0})
    judged = curate(items, c, overrides, decisions, watch)
    watch.run("publish", judged, lambda df: target.publish(df, model_signature=signature, source_root=root))
    ledger.clear()
    return target.read()
