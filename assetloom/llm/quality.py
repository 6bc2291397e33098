"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm import text as tx
from assetloom.llm.labelled import held_out, training_rows
from assetloom.session import cut, ready

FEATURES = ("bytes", "words", "word_bytes", "distinct", "repeated_pairs", "upper", "digit", "mark", "odd_mark", "mark_words", "line_words", "short_words", "sentence_ends", "other_bytes", "largest_word", "entropy")

_UPPER, _DIGIT, _LETTER, _MARK, _ODD = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_ODD[:] = _MARK
_ODD[[ord(c) for c in ".,;:'\"-()?"]] = False


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of transformed statistics (logs and logits, so that classes look more normal) for each text."""
    n = len(at) - 1
    size = (at[1:] - at[:-1]).astype(float)

    def share(flags: np.ndarray) -> np.ndarray:
        if n == 1:  # perhaps a very long text
            return np.array([np.count_nonzero(flags[data])])
        total = np.concatenate([[0], np.cumsum(flags[data], dtype=np.int64)])
        return total[at[1:]] - total[at[:-1]]

    h, start, end, doc = tx.word_hashes(data, at, tx.NOT_SPACE)
    per = lambda w=None: np.bincount(doc, w, n).astype(float)
    n_words, length = per(), (end - start).astype(float)
    order = np.lexsort((h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][first], minlength=n).astype(float)
    pairs, pair_doc = tx.windows(h, 2), doc[:-1]
    same = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
    pairs, pair_doc = (pairs[same], pair_doc[same]) if len(doc) > 1 else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.lexsort((pairs, pair_doc))
    first = np.ones(len(pairs), bool)
    first[1:] = (pairs[order][1:] != pairs[order][:-1]) | (pair_doc[order][1:] != pair_doc[order][:-1])
    n_pairs, distinct_pairs = np.bincount(pair_doc, minlength=n).astype(float), np.bincount(pair_doc[order][first], minlength=n).astype(float)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    letters, upper, digits, marks, odd = share(_LETTER), share(_UPPER), share(_DIGIT), share(_MARK), share(_ODD)
    lines = share(np.arange(256) == 10) + 1.0
    ends = per((np.isin(last, [46, 33, 63])).astype(float))
    odd_end = per(_ODD[last].astype(float))
    short = per((length <= 3).astype(float))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    if n == 1:
        cells = sum(np.bincount(data[k : k + tx.BLOCK] >> 2, minlength=64) for k in range(0, max(len(data), 1), tx.BLOCK)).reshape(1, 64)
    else:
        cells = np.bincount(np.repeat(np.arange(n), size.astype(np.int64)) * 64 + (data >> 2), minlength=n * 64).reshape(n, 64)
    p = cells / np.maximum(size, 1)[:, None]
    entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)

    logit = lambda part, whole: np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5 + 0.01 * whole))
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), np.log1p(per(length) / np.maximum(n_words, 1)), logit(distinct, n_words), logit(distinct_pairs, n_pairs), logit(upper, letters), logit(digits, size), logit(marks, size), logit(odd, size), logit(odd_end, n_words), np.log1p(n_words / lines), logit(short, n_words), logit(ends, n_words), logit(size - letters - digits - marks, size), np.log1p(longest), entropy,
    ])


def features(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """`(doc_id, x)`: the statistics of every whole text."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tx.text_blocks(batch):
                x = statistics(data, at)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), flat], ["doc_id", "x"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _forward(lower: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve lower @ x = b by forward substitution."""
    x = np.empty_like(b)
    for i in range(len(b)):
        x[i] = (b[i] - lower[i, :i] @ x[:i]) / lower[i, i]
    return x


@dataclass(frozen=True)
class Model:
    """Scaling, and for classes 0 and 1: mean, Cholesky factor of the covariance, its log determinant, log prior."""

    middle: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]
    reach: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.middle) / self.scale, -self.reach, self.reach)
        side = [c - 0.5 * (_forward(f, (z - m).T) ** 2).sum(0) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip(side[1] - side[0], -40, 40)))


def fit(labelled: DataFrame, shrink: float = 0.1, ridge: float = 1e-3, reach: float = 8.0) -> Model:
    """Fit on all rows `(x, y)`: Spark sums the moments of each class, so the driver gets a fixed number of rows.

    Covariances shrink by `shrink` towards the pooled one and by `ridge` towards the identity. A class without rows
    takes the other's moments, so both then score alike.
    """
    d = len(FEATURES)
    part = labelled.select("y", F.posexplode("x").alias("i", "v"))
    span = part.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    middle = np.array([r["m"] for r in span]) if span else np.zeros(d)
    scale = np.maximum(np.array([r["s"] for r in span]), 1e-6) if span else np.ones(d)
    z = [F.greatest(F.lit(-reach), F.least(F.lit(reach), (F.element_at("x", i + 1) - float(middle[i])) / float(scale[i]))).alias(f"z{i}") for i in range(d)]
    sums = [F.sum(f"z{i}").alias(f"a{i}") for i in range(d)] + [F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"b{i}_{j}") for i in range(d) for j in range(i + 1)]
    got = {r["y"]: r for r in labelled.select("y", *z).groupBy("y").agg(F.count("*").alias("n"), *sums).collect()}
    moments = {}
    for y, r in got.items():
        mean = np.array([r[f"a{i}"] for i in range(d)]) / r["n"]
        square = np.array([[r[f"b{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / r["n"]
        moments[y] = (r["n"], mean, square - np.outer(mean, mean))
    if not moments:
        moments[0] = (1, np.zeros(d), np.eye(d))
    for y in (0, 1):
        moments.setdefault(y, moments[1 - y] if 1 - y in moments else next(iter(moments.values())))
    total = moments[0][0] + moments[1][0]
    pooled = sum(moments[y][0] * moments[y][2] for y in (0, 1)) / total
    factors, constants = [], []
    for y in (0, 1):
        c = (1 - shrink) * moments[y][2] + shrink * pooled
        f = np.linalg.cholesky((1 - ridge) * c + ridge * np.eye(d))
        factors.append(f)
        constants.append(float(np.log(moments[y][0] / total) - np.log(np.diag(f)).sum()))
    return Model(middle, scale, (moments[0][1], moments[1][1]), tuple(factors), tuple(constants), reach)


def score_quality(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.3, shrink: float = 0.1) -> DataFrame:
    """Per row of `docs`: `doc_id`, `held_out`, `score` (0 to 1, higher: label 1 likelier), `predicted`.

    Statistics of every whole text are computed once and kept; the labelled rows among them, held-out ones left out,
    give the class moments; the score is the logistic of the difference of the two class log densities.

    Null and empty texts have the statistics of an empty text and are scored. Null ids are scored, never learned from.
    Repeated rows are scored each. Labels that are null or neither 0 nor 1 do not count; of repeated ones 1 wins. With no
    labels all rows score 0.5. Other columns are not read; an empty table gives an empty result.
    """
    rows = cut(features(docs, id, text))
    model = fit(rows.join(training_rows(labels, label), "doc_id").select("x", "y"), shrink)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
