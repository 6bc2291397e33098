"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm import text as tx
from assetloom.llm.labelled import held_out, training_rows
from assetloom.session import cut, ready

#: Lengths in bytes of the n-grams, and bits of their hash.
SIZES, BITS = (4, 5, 6, 7, 8), 22
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def grams(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashed n-gram at each place) of lower-cased bytes, text ends not heeded."""
    data = tx.LOWER[data].astype(np.uint64)
    packed = data.copy()
    for i in range(1, max(SIZES)):
        packed = packed[:-1] | (data[i:] << np.uint64(8 * i))
        if i + 1 in SIZES:
            h = (packed ^ (packed >> np.uint64(17))) * _MULTIPLIER + np.uint64(i)
            yield i + 1, (h * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int64)


def present(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, as two arrays; only features of `wanted` if given."""
    found = []
    for n, h in grams(data):
        place = np.flatnonzero(wanted[h]) if wanted is not None else np.arange(len(h))
        doc = np.searchsorted(at, place, "right") - 1
        whole = place + n <= at[doc + 1]
        found.append((doc[whole] << BITS) | h[place[whole]])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def features_of(batch: pa.RecordBatch, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, text numbers from the first, features) of the blocks of a batch; a long text is read in slices that overlap by one byte less than an n-gram."""
    for lo, slices in groupby(tx.text_slices(batch, max(SIZES) - 1), key=lambda x: int(x[0][0])):
        parts = [(len(own), *present(data, at, wanted)) for own, _, data, at in slices]
        n, doc, feature = parts[0] if len(parts) == 1 else (1, None, np.unique(np.concatenate([f for _, _, f in parts])))
        yield lo, lo + n, np.zeros(len(feature), np.int64) if doc is None else doc, feature


@dataclass(frozen=True)
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float64)
        out[self.features] = self.weights
        return out

    def scores(self, n: int, doc: np.ndarray, feature: np.ndarray, table: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(doc, table[feature], n)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(doc: np.ndarray, col: np.ndarray, y: np.ndarray, ratio: np.ndarray, prior: float, l2: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Logistic regression on features scaled by their log-count `ratio`; (doc, col) are the features present.

    `prior` is the share that label 1 counts for; sampled rows are weighted to it. `l2` weighs the squared weights
    against the mean loss. Steps have a rate for each weight (Duchi et al., JMLR 2011). Returns weights of the unscaled
    features, and the bias.
    """
    value = ratio[col]
    weight = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1))
    w, b = np.zeros(len(ratio)), float(np.log(prior / (1 - prior)))
    gw, gb = np.full(len(ratio), 1e-8), 1e-8
    for _ in range(rounds):
        z = b + np.bincount(doc, w[col] * value, len(y))
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.bincount(col, e[doc] * value, len(ratio)) + l2 * w
        gw, gb = gw + g * g, gb + e.sum() ** 2
        w, b = w - 0.1 * g / np.sqrt(gw), b - 0.1 * e.sum() / np.sqrt(gb)
    return w * ratio, float(b)


def telling_features(sample: DataFrame, n1: int, n0: int, alpha: float, least_docs: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, log-count ratios) of the `keep` features whose ratio is largest against its spread. Spark counts documents of each class for each feature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)  # one partition's counts
        for batch in batches:
            y = batch.column("y").to_numpy()
            for lo, hi, doc, feature in features_of(batch):
                for k in (0, 1):
                    n[k] += np.bincount(feature[y[lo:hi][doc] == k], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(n.any(0))
        for k in range(0, len(some), 100_000):
            part = some[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(n[i, part].astype(np.int64)) for i in (1, 0))], ["feature", "c1", "c0"])

    counts = sample.mapInArrow(run, "feature long, c1 long, c0 long").groupBy("feature").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    p1, p0 = (F.col("c1") + alpha) / (n1 + 2 * alpha), (F.col("c0") + alpha) / (n0 + 2 * alpha)
    ratio = F.log(p1 / p0) - F.log((1 - F.least(p1, F.lit(0.999))) / (1 - F.least(p0, F.lit(0.999))))
    spread = F.sqrt(1 / (F.col("c1") + alpha) + 1 / (F.col("c0") + alpha))
    rated = counts.where(F.col("c1") + F.col("c0") >= least_docs).select("feature", F.greatest(F.lit(-6.0), F.least(F.lit(6.0), ratio)).alias("ratio"), (F.abs(ratio) / spread).alias("telling"))
    rows = rated.where("ratio <> 0").orderBy(F.desc("telling"), "feature").limit(keep).collect()
    rows.sort(key=lambda r: r["feature"])
    return np.array([r["feature"] for r in rows], np.int64), np.array([r["ratio"] for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = 3000, alpha: float = 1.0, least_docs: int = 4, keep: int = 4096, least_share: float = 0.25) -> Model:
    """Fit on a bounded sample: at most `most` labelled rows of each class, in the order of a hash of their id.

    The bound is the parameter; the sample's ids are broadcast to the scan, so no text is shuffled. Spark counts the
    sample's n-grams and picks the `keep` most telling; which of those each sampled text has is what reaches the
    driver. Class shares are counted over all labelled rows that are not held out; a rare label 1 still counts for
    `least_share` of the loss.
    """
    ready(docs.sparkSession)
    rows = training_rows(labels, label)
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    pick = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    pick = F.broadcast(pick[0].unionByName(pick[1]))
    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text is not null").join(pick, "doc_id").select("y", "text")
    sample = cut(texts)
    have = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(have) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 4.0 if 1 in have else -4.0)
    chosen, ratio = telling_features(sample, have[1], have[0], alpha, least_docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[chosen] = True
        for batch in batches:
            for lo, hi, doc, feature in features_of(batch, wanted):
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                packed = np.searchsorted(chosen, feature).astype("<u2").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(lo, hi - lo), pa.array([packed[2 * a : 2 * b] for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["y", "f"])

    got = sample.mapInArrow(run, "y int, f binary").toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    parts = [np.frombuffer(f, "<u2") for f in got.column("f").to_pylist()]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    prior = min(max(n[1] / (n[0] + n[1]), least_share), 1 - 1e-3)
    weights, bias = train(doc, np.concatenate(parts).astype(np.int64), y, ratio, prior)
    return Model(chosen, weights, bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.5, most: int = 3000, least_docs: int = 4, keep: int = 4096, row: str | None = None) -> DataFrame:
    """Per row of `docs`: `doc_id`, `held_out`, `score` (0 to 1, higher: label 1 likelier), `predicted`.

    The model learns from at most `most` labelled rows of each class and has the `keep` most telling n-grams of those
    that `least_docs` of these rows hold. One pass over the whole texts, long ones in slices, looks the n-grams up in a
    table of fixed size.

    Null and empty texts have no n-grams and get the model's bias. Null ids are scored, never learned from; repeated rows
    are scored each. Labels that are null or neither 0 nor 1 do not count; of repeated ones 1 wins. With labels of one
    class only, all rows score for that class; with none, all rows score as label 0. Other columns are not read; an
    empty table gives an empty result. A column `row` that tells rows apart where ids do not may be named; it is returned too.
    """
    model = fit(docs, labels, id, text, label, most, least_docs=least_docs, keep=keep)
    kept = ["doc_id", *([row] if row else [])]
    rows = docs.select(F.col(id).alias("doc_id"), *kept[1:], F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        wanted = table != 0
        for batch in batches:
            for lo, hi, doc, feature in features_of(batch, wanted):
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in kept), pa.array(model.scores(hi - lo, doc, feature, table))], [*kept, "score"])

    scored = rows.mapInArrow(run, f"{kinds}, score double")
    return scored.select(*kept, held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
