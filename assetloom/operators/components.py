"""Connected components by alternating large-star and small-star rounds (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.session import CUTS, cut, drop_cuts, ready


def _least(pairs: DataFrame) -> DataFrame:
    """`pairs(u, v)` with the least of u and its v's as `m`. The aggregate is cut first, so that the join may split a hub's rows."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(cut(least), "u")


#: Edges that one task connects at once.
SMALL = 16_384


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small: int = SMALL) -> DataFrame:
    """`(node, component)` for every node of an edge; the component is the least node that can be reached.

    Edges with a null end and loops are dropped; repeated edges count once. Each round is written to the shared folder,
    so lineage stays short and a lost executor costs one round; the round before is deleted then. At most `small` edges, counted, are connected by one task
    instead of by rounds. Fails if `max_rounds` do not suffice.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if small and e.count() <= small:
        ready(e.sparkSession)
        return cut(e.coalesce(1).mapInArrow(_connected, f"node {e.dtypes[0][1]}, component {e.dtypes[0][1]}"))
    mark = len(CUTS) - 1
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_ = _least(large)
        e = cut(small_.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop_cuts(e.sparkSession, CUTS[mark:-1])
        if _stars(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def changed_edges(stored: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a change leaves to connect: edges `(src, dst)`, and the stored labels that still name their component.

    Components that lost a node are taken apart: their old edges, without those of removed nodes, come again. Every other
    one is a single node, its label, so of all other edges only the added ones are seen, between labels.
    """
    gone = cut(removed.select("node").where("node is not null").distinct())
    lost = cut(stored.join(gone, "node", "left_semi").select("component").distinct())
    kept = cut(stored.join(lost, "component", "left_anti").select("node", "component"))
    redo = cut(stored.join(lost, "component", "left_semi").join(gone, "node", "left_anti").select("node"))
    at = lambda df, end: df.withColumnRenamed("node", end)
    again = edges.select("src", "dst").join(at(redo, "src"), "src", "left_semi").join(at(redo, "dst"), "dst", "left_semi").select("src", "dst")
    new = added.select("src", "dst").join(at(gone, "src"), "src", "left_anti").join(at(gone, "dst"), "dst", "left_anti")
    for end in ("src", "dst"):
        label = kept.select(F.col("node").alias("n__"), F.col("component").alias("c__"))
        new = new.join(label, new[end] == F.col("n__"), "left").withColumn(end, F.coalesce("c__", end)).drop("n__", "c__")
    return again.unionByName(new.select("src", "dst")), kept


def update_components(stored: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """`(node, component)` after a change, from the labels before it: the same as `connected_components` of `edges` and
    `added` without all edges of `removed` nodes. Rounds are run over `changed_edges` only.

    A node whose edges are all gone has no row, as there. A removed node that an added edge names stays removed. Labels of
    components that changed are rewritten by one join; a component's label is its least node before and after.
    """
    todo, kept = changed_edges(stored, edges, added, removed)
    parts = cut(connected_components(todo))
    merged = kept.join(parts.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
    return merged.unionByName(parts.join(kept, "node", "left_anti").select("node", "component"))


def roots(up: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of places x in a forest of arrays; what is passed on the way points closer to its root after."""
    r = up[x]
    while True:
        above = up[r]
        if np.array_equal(above, r):
            break
        r = above
    up[x] = r
    return r


def union_edges(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Connect place a[i] with b[i]; the least place of a component becomes its root."""
    while len(a):
        ra, rb = roots(up, a), roots(up, b)
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(up, np.maximum(ra, rb), np.minimum(ra, rb))


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the few edges of one task."""
    up: dict = {}

    def find(x: object) -> object:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.column("u").type
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = find(up.setdefault(u, u)), find(up.setdefault(v, v))
            if a != b:
                up[max(a, b)] = min(a, b)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), kind), pa.array([find(x) for x in up], kind)], ["node", "component"])


def _stars(e: DataFrame) -> bool:
    """Whether every node but the least of its component has one edge, to that least node."""
    if e.groupBy("u").count().where("count > 1").limit(1).count():
        return False
    return not e.select(F.col("v").alias("u")).distinct().join(e, "u", "left_semi").limit(1).count()
