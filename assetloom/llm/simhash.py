"""SimHash near-dedup with vantage-point trees.

A document's fingerprint has a bit set where more than half of its shingles' hashes have it. Fingerprints that differ in
few bits are linked. They meet by vantage points: a node of the tree has a fingerprint v and a distance m; fingerprints
within m of v go to the inner side, and those farther than m - radius to the outer side. Two that differ in at most
`radius` bits have, by the triangle inequality, distances from v that differ by no more, so both are on the inner side or
both on the outer one: only the ring of `radius` distances at the border is in both. So every pair meets in a leaf.

The upper levels deal the fingerprints to shards of `SHARD` at most; in each a task goes on with the same rule in memory,
and leaves out what is connected already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from assetloom.llm import text as tx
from assetloom.operators.components import connected_components
from assetloom.session import cut, ready

#: Fingerprints that a shard holds at most, where they can be told apart; those that a task compares pair by pair; bytes of text that are split into words at once.
SHARD, LEAF, SLICE = 8192, 96, 1 << 20
#: Fingerprints that the driver sees for the upper levels (1 MB), and those of them that a node needs to be split.
SAMPLE, LEAST_SAMPLE = 1 << 17, 32
#: Vantage points that each node tries. A split is worth making if no side keeps more than this share.
TRIES, WORTH = 4, 0.92
#: Ring at the border makes both sides larger than half: work grows with this power of the number of fingerprints.
_POWER = 1.36
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
SEED = 42


def shingle_hashes(text: bytes, k: int = 3) -> Iterator[np.ndarray]:
    """XXH64 of each k consecutive words, joined by spaces, of a text whose A-Z are lower-cased; of the whole sequence where there are fewer words. Some at a time."""
    at, words, full = 0, [], False
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.start() if found else len(text)
        words += text[at:end].lower().split()
        at = end
        if len(words) >= k:
            full = True
            joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(size + 1) - 1
            starts = ends - size
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)), np.uint64, len(words) - k + 1)
            words = words[len(words) - k + 1 :]
    if words and not full:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)


def fingerprint(text: bytes, k: int = 3, at_once: int = 1 << 16) -> int:
    """The 64 bits as a signed number; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, k):
        n += len(h)
        for a in range(0, len(h), at_once):
            ones += np.unpackbits(h[a : a + at_once].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """`(doc_id, fp)` for each row; no row is moved."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("t__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.raw(batch.column("t__"))
            fp = [fingerprint(data[a:b].tobytes(), words) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of x; what is passed on the way points closer to its root after."""
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            break
        r = up
    parent[x] = r
    return r


def _union(parent: np.ndarray, x: np.ndarray) -> None:
    roots = _find(parent, x)
    parent[roots] = roots.min()


def _union_edges(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Connect a[i] with b[i]."""
    while True:
        ra, rb = _find(parent, a), _find(parent, b)
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def _by_midpoints(parent: np.ndarray, some: np.ndarray, x: np.ndarray, radius: int) -> None:
    """Connect the points x within an even radius of each other: two are so near if a point lies half the radius, at most, from both."""
    flips = [np.uint64(sum(1 << i for i in bits)) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    passes = 1 + (len(x) * len(flips) >> 22)
    for k in range(passes):
        keys, own = [], []
        for f in flips:
            z = x ^ f
            here = tx.mix(z) % np.uint64(passes) == k if passes > 1 else slice(None)
            keys.append(z[here])
            own.append(some[here])
        z, o = np.concatenate(keys), np.concatenate(own)
        by = np.argsort(z, kind="stable")
        z, o = z[by], o[by]
        same = z[1:] == z[:-1]
        _union_edges(parent, o[:-1][same], o[1:][same])


def _split(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[int, np.ndarray, int]:
    """(vantage point, distances from it, border) of the best of a few tries."""
    best = None
    for v in rng.integers(0, len(points), TRIES).tolist():
        d = np.bitwise_count(points ^ points[v])
        upto = np.cumsum(np.bincount(d, minlength=65))
        outer = len(points) - np.concatenate([np.zeros(radius, np.int64), upto[: 65 - radius]])
        cost = upto.astype(float) ** _POWER + outer.astype(float) ** _POWER
        m = int(cost.argmin())
        if best is None or cost[m] < best[0]:
            best = (cost[m], v, d, m)
    return best[1], best[2], best[3]


def linked(points: np.ndarray, radius: int) -> np.ndarray:
    """For each of distinct fingerprints the place of a member of its component, the same for all of it; exact.

    Sides whose points are one component already are left out, so near copies in great number are not compared with each
    other. Points of a dense ball, which no vantage point tells apart, meet at the points between them (an even radius), or
    are compared where they are outside the largest component (an odd one).
    """
    parent, rng = np.arange(len(points)), np.random.default_rng(1)
    todo = [np.arange(len(points))]
    while todo:
        some = todo.pop()
        roots = _find(parent, some)
        if (roots == roots[0]).all():
            continue
        x = points[some]
        if len(some) <= LEAF:
            near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
            i, j = np.nonzero(near)
            _union_edges(parent, some[i], some[j])
            continue
        v, d, m = _split(x, radius, rng)
        _union(parent, some[d <= radius])
        inner, outer = some[d <= m], some[d > m - radius]
        if max(len(inner), len(outer)) <= WORTH * len(some):
            todo += [inner, outer]
            continue
        if radius % 2 == 0:
            _by_midpoints(parent, some, x, radius)
            continue
        for i in rng.integers(0, len(some), 64):
            _union(parent, some[np.bitwise_count(x ^ x[i]) <= radius])
        roots = _find(parent, some)
        names, n = np.unique(roots, return_counts=True)
        for i in np.flatnonzero(roots != names[n.argmax()]):
            _union(parent, some[np.bitwise_count(x ^ x[i]) <= radius])
    return _find(parent, np.arange(len(points)))


class Tree:
    """The upper levels as arrays, from a sample: of each node the vantage point, the border and its two sides, or the number of its leaf."""

    def __init__(self, sample: np.ndarray, radius: int, most: float):
        self.radius, self.point, self.border, self.sides, self.leaves = radius, [], [], [], 0
        rng, todo = np.random.default_rng(2), [(np.unique(sample), None)]
        while todo:
            x, above = todo.pop()
            k = len(self.point)
            if above:
                self.sides[above[0]][above[1]] = k
            inner = outer = x
            if len(x) > most:
                v, d, m = _split(x, radius, rng)
                inner, outer = x[d <= m], x[d > m - radius]
            if max(len(inner), len(outer)) <= WORTH * len(x) and len(x) > most:
                self.point.append(x[v])
                self.border.append(m)
                self.sides.append([-1, -1])
                todo += [(inner, (k, 0)), (outer, (k, 1))]
            else:
                self.leaves += 1
                self.point.append(np.uint64(0))
                self.border.append(-1)
                self.sides.append([self.leaves, self.leaves])

    def route(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, places in x) of the points in each leaf that some are in."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, some = todo.pop()
            if self.border[k] < 0:
                yield self.sides[k][0], some
                continue
            d = np.bitwise_count(x[some] ^ self.point[k])
            todo += [(side, part) for side, part in zip(self.sides[k], (some[d <= self.border[k]], some[d > self.border[k] - self.radius]), strict=True) if len(part)]


def vantage_shards(fps: DataFrame, radius: int, size: int | None = None) -> DataFrame:
    """`(shard, fp)`: distinct fingerprints `fp` in shards such that each pair within `radius` bits is together in one.

    A fingerprint is in every shard whose region its ball overlaps, which adds a fifth to a level's rows where bits are
    random. The upper levels come from `SAMPLE` fingerprints, chosen by hash, that the driver sees; every fingerprint is
    routed through them in one pass. Shards that are still too large are split by the same rule, a level a round, over all
    their fingerprints: vantage points are members, the border is the one of least expected work by the counts of all
    distances. A node stays whole where every try leaves more than `WORTH` of it on a side: fingerprints in a dense ball,
    whose number its radius bounds.
    """
    ready(fps.sparkSession)
    size = size or SHARD
    n = fps.count()
    rate = min(1.0, SAMPLE / max(n, 1))
    chosen = fps.where(F.pmod(F.xxhash64(F.lit(7), "fp"), F.lit(1 << 20)) < int(rate * (1 << 20))) if rate < 1 else fps
    sample = np.fromiter((r["fp"] for r in chosen.collect()), np.int64).view(np.uint64) if n > size else np.zeros(0, np.uint64)
    tree = Tree(sample, radius, max(size * rate, LEAST_SAMPLE if rate < 1 else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for leaf, some in tree.route(fp.view(np.uint64)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), leaf)), pa.array(fp[some])], ["shard", "fp"])

    rows, done = cut(fps.select("fp").mapInArrow(run, "shard bigint, fp bigint")), []
    for _ in range(40):
        picks = [F.min_by("fp", F.xxhash64(F.lit(j), "fp")).alias(f"v{j}") for j in range(TRIES)]
        big = cut(rows.groupBy("shard").agg(F.count("*").alias("n"), *picks).where(F.col("n") > size))
        if not big.limit(1).count():
            done.append(rows)
            break
        each = rows.join(big, "shard").select("shard", "n", F.explode(F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"v{j}").alias("v"), F.bit_count(F.col("fp").bitwiseXOR(F.col(f"v{j}"))).alias("d")) for j in range(TRIES)))).alias("x"))
        counts = each.groupBy("shard", "n", "x.j", "x.v", "x.d").agg(F.count("*").alias("c"))
        w = W.Window.partitionBy("shard", "j").orderBy("d")
        upto = F.sum("c").over(w.rangeBetween(W.Window.unboundedPreceding, 0))
        before = F.coalesce(F.sum("c").over(w.rangeBetween(W.Window.unboundedPreceding, -radius)), F.lit(0))
        sides = counts.select("shard", "n", "v", F.col("d").alias("m"), upto.alias("inner"), (F.col("n") - before).alias("outer"))
        worth = sides.where(F.greatest("inner", "outer") <= WORTH * F.col("n"))
        best = cut(worth.groupBy("shard").agg(F.min_by(F.struct("v", "m"), F.struct(F.pow("inner", F.lit(_POWER)) + F.pow("outer", F.lit(_POWER)), "v", "m")).alias("b")).select("shard", "b.v", "b.m"))
        marked = cut(rows.join(best, "shard", "left"))
        done.append(marked.where("v is null").select("shard", "fp"))
        d = F.bit_count(F.col("fp").bitwiseXOR(F.col("v")))
        s = F.col("shard") * 2
        sides = F.when(d <= F.col("m") - radius, F.array(s)).when(d <= F.col("m"), F.array(s, s + 1)).otherwise(F.array(s + 1))
        # nodes of one level have numbers of their own; those of other levels may share them, so the level is kept beside
        rows = marked.where("v is not null").select(F.explode(sides).alias("shard"), "fp")
    else:
        raise RuntimeError("fingerprints could not be dealt to shards")
    out = done[0].withColumn("level", F.lit(0))
    for level, more in enumerate(done[1:], 1):
        out = out.unionByName(more.withColumn("level", F.lit(level)))
    return out.select((F.col("shard") * 64 + F.col("level")).alias("shard"), "fp")


def hamming_components(fps: DataFrame, radius: int = 2, size: int | None = None) -> DataFrame:
    """`(fp, component)` for the distinct fingerprints `fp` that have a partner within `radius` bits; the component's name is its least fingerprint."""
    ready(fps.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tx.sorted_groups(batches, ["shard"]):
            fp = t.column("fp").to_numpy()
            first = linked(fp.view(np.uint64), radius)
            some = np.flatnonzero(first != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[some]), pa.array(fp[first[some]])], ["src", "dst"])

    shards = vantage_shards(fps, radius, size).repartition(F.col("shard")).sortWithinPartitions("shard")
    return connected_components(cut(shards.mapInArrow(run, "src bigint, dst bigint"))).withColumnsRenamed({"node": "fp"})


def simhash_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, size: int | None = None) -> DataFrame:
    """Near-duplicate classes of documents by fingerprint.

    Returns per row: `doc_id`, `fingerprint` (16 hex digits) and `component_id`, the least id that can be reached over
    links of at most `radius` differing bits, its own included.

    Null counts as empty; texts without words have fingerprint zero and are linked like any other. Rows that share an id
    are documents each. Rows with a null id link others too; a component of such rows alone has a null id. Equal
    fingerprints enter once, so copies, however many, are one point. Other columns are not read, whatever their names; an
    empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, id, text, words))
    points = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = cut(points.join(hamming_components(points.select("fp"), radius, size), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    names = cut(parts.groupBy("component").agg(F.min("least").alias("component_id")))
    named = cut(parts.join(names, "component").select("fp", "component_id"))
    # cut before the join, so that the rows of a common fingerprint may be split there
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
