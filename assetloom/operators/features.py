"""Features from grids, vectors and landmarks, and hooks for a user's own models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assetloom.config import Config
from assetloom.functions import exprs as X
from assetloom.session import ready


def grid_metrics(df: DataFrame, grid: str, width: int, high: float, low: float) -> DataFrame:
    """Add focus (variance of the Laplacian), shares of the tails, and noise (mean absolute Laplacian / 255)."""
    lap = X.laplacian(F.col(grid), width)
    share = lambda f: F.size(F.filter(grid, f)) / F.size(grid)
    return df.withColumn("lap__", lap).withColumns({"laplacian_var": X.variance(F.col("lap__")), "over_ratio": share(lambda v: v >= high), "under_ratio": share(lambda v: v < low), "noise": X.mean(F.transform("lap__", lambda v: F.abs(v))) / 255.0}).drop("lap__")


def min_ear(df: DataFrame, faces: Column, eyes: tuple[tuple[int, ...], tuple[int, ...]]) -> DataFrame:
    """Add `ear` (least openness over faces) and `worst_face` (its number from 1). `faces` lists lists of points."""
    ears = F.transform(faces, lambda p: (X.eye_aspect(p, eyes[0]) + X.eye_aspect(p, eyes[1])) / 2.0)
    return df.withColumn("ears__", ears).withColumns({"ear": F.array_min("ears__"), "worst_face": F.array_position("ears__", F.array_min("ears__")).cast("int")}).drop("ears__")


def prototypes(df: DataFrame, vector: str, label: str) -> list[tuple[int, list[float]]]:
    """Mean unit vector of each class: one row for each class reaches the driver."""
    unit = df.withColumn("n__", X.norm2(F.col(vector))).select(label, F.posexplode(F.transform(vector, lambda x: x.cast("double") / F.col("n__"))).alias("i", "v"))
    rows = unit.groupBy(label, "i").agg(F.avg("v").alias("v")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("c")).orderBy(label).collect()
    return [(r[label], list(r["c"])) for r in rows]


def zero_shot(df: DataFrame, vector: str, protos: list[tuple[int, list[float]]], scale: float = 100.0, floor: float = 0.6) -> DataFrame:
    """Add `class` (first most likely label; -1 if its probability is under `floor`) and `confidence`."""
    logits = F.array(*(scale * X.dot(F.col(vector), F.array(*map(F.lit, c))) / X.norm2(F.col(vector)) for _, c in protos))
    p = df.withColumn("p__", X.softmax(logits))
    best = F.array_max("p__")
    label = F.element_at(F.array(*(F.lit(k) for k, _ in protos)), F.array_position("p__", best).cast("int"))
    return p.withColumns({"class": F.when(best < floor, -1).otherwise(label), "confidence": best}).drop("p__")


def prompt_score(df: DataFrame, vector: str, good: list[list[float]], bad: list[list[float]], scale: float = 100.0) -> DataFrame:
    """Add `prompt_score`: share of the softmax over all prompts that falls on the good ones, times 100."""
    logits = F.array(*(scale * X.dot(F.col(vector), F.array(*map(F.lit, c))) / X.norm2(F.col(vector)) for c in good + bad))
    return df.withColumn("p__", X.softmax(logits)).withColumn("prompt_score", 100.0 * F.aggregate(F.slice("p__", 1, len(good)), F.lit(0.0), lambda a, x: a + x)).drop("p__")


#: Models that this Python worker has loaded, by name.
_LOADED: dict[str, object] = {}


def loaded(name: str, load: Callable[[], object]) -> object:
    """A model by its name; `load` is called once in each Python worker, which Spark uses again for later tasks."""
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def score_batches(df: DataFrame, scorer: Callable[..., pd.Series], name: str, load: Callable[[], object] | None = None, model: str | None = None, profile: ResourceProfile | None = None) -> DataFrame:
    """Add a column by a user's pandas function. If a batch fails its rows are scored one by one; rows that fail are null.

    With `load` the function's second argument is what that returns: it is called once in each worker for a `model` name,
    which is the name of what is loaded and its version; a model that cannot be loaded fails the job. Executors and cores of
    the stage can be asked for by a `profile`, such as one with graphics cards.
    """
    if load and not model:
        raise ValueError("name the model that is loaded")
    ready(df.sparkSession)
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from assetloom.operators import features  # the worker's own module holds what it has loaded

        given = (features.loaded(model, load),) if load else ()

        def one(row: pd.DataFrame) -> float | None:
            try:
                return float(scorer(row, *given).iloc[0])
            except Exception:
                return None

        for pdf in batches:
            try:
                scores = scorer(pdf, *given).astype(float)
            except Exception:
                scores = pd.Series([one(pdf.iloc[i : i + 1]) for i in range(len(pdf))], index=pdf.index, dtype=float)
            yield pdf.assign(**{name: scores})[[*names, name]]

    schema = StructType([*df.schema.fields, StructField(name, DoubleType())])
    return df.mapInPandas(run, schema, profile=profile) if profile else df.mapInPandas(run, schema)


def cascade(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], c: Config, cheap: str = "ear") -> DataFrame:
    """Add `prob` and `closed`: the costly scorer sees only rows whose cheap score lies in the open band of the gate."""
    band = F.coalesce((F.col(cheap) >= max(c.gate_low, c.ear_closed)) & (F.col(cheap) <= c.gate_high), F.lit(False))
    rest = df.where(~band).withColumn("prob", F.lit(None).cast("double"))
    both = score_batches(df.where(band), scorer, "prob").unionByName(rest)
    return both.withColumn("closed", X.eyes_closed(F.col(cheap), F.col("prob"), c))


def fill_scores(items: DataFrame, score: Callable[[DataFrame], DataFrame], cols: tuple[str, ...], key: str = "path") -> DataFrame:
    """Items with missing `cols` filled: `score` gets only the rows that lack any of them and returns `(key, *cols)`; a value that is there stays, and so does one that `score` fails to give."""
    lacking = F.lit(False)
    for c in cols:
        lacking = lacking | F.col(c).isNull()
    fresh = score(items.where(lacking)).select(key, *(F.col(c).alias(f"new_{c}") for c in cols))
    filled = {c: F.coalesce(F.col(c), F.col(f"new_{c}")) for c in cols}
    return items.join(fresh, key, "left").withColumns(filled).select(items.columns)
