"""N-gram Jaccard join: signature trees over word-shingle sets, exact links, connected components.

Sets that are equal enter once. A pair that reaches the threshold shares a token among the first few of both sets in any
fixed token order (prefix filter), so sets meet in groups: all sets that share such a token, and are of fitting size, meet
under the least of them, their hub. In each group a signature tree holds OR-combined token bitmaps and size ranges; a
traversal of the tree against itself prunes node pairs whose largest possible overlap is too small. That is done twice:
over bitmaps alone, so that sets without a possible partner never travel, then over the sets that are left, where pairs
that reach the leaves are compared exactly. Tokens that many sets hold come last in the order, so that passages which sets
have in common, be they spread thinly, do not make them meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm import text as tx
from assetloom.operators.components import connected_components
from assetloom.session import CUTS, cut, drop_cuts, ready

#: Tokens and sets that one task compares at once; larger groups are dealt out in blocks.
GROUP_TOKENS, GROUP_SETS = 1 << 21, 4096
#: A bitmap takes a sixteenth of its tokens' bytes at most, so one task has so many times the tokens by bitmaps.
BY_MAPS = 16
#: Common tokens that sets order last, and tokens that are counted at once to find them. It only steers which tokens sets
#: meet by; any choice gives the same links.
COMMON, COMMON_FROM, COUNTED, COUNTED_FROM = 100_000, 32, 1 << 22, 3
_FAN = 8


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, edges): sorted distinct shingle hashes of each text, edges[i] to edges[i+1]; fewer than k words are one shingle."""
    n = len(at) - 1
    h, _, _, doc = tx.word_hashes(data, at, tx.NOT_SPACE)
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    tokens = [tx.windows(h, k)]
    own = [doc[: len(tokens[0])]]
    whole = (np.arange(len(own[0])) + k) <= (first + counts)[own[0]]
    tokens[0], own[0] = tokens[0][whole], own[0][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    for m in np.unique(counts[short]):
        some = short[counts[short] == m]
        tokens.append(tx.windows(h[(first[some][:, None] + np.arange(m)).ravel()], int(m))[::m])
        own.append(some)
    t, o = np.concatenate(tokens), np.concatenate(own)
    order = np.lexsort((t, o))
    t, o = t[order], o[order]
    keep = np.ones(len(t), bool)
    keep[1:] = (t[1:] != t[:-1]) | (o[1:] != o[:-1])
    t, o = t[keep], o[keep]
    return t, np.searchsorted(o, np.arange(n + 1))


def set_keys(tokens: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each set."""
    out = []
    for seed in (0x243F6A8885A308D3, 0x452821E638D01377):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx.mix(tokens ^ np.uint64(seed)))])
        out.append(tx.mix(total[edges[1:]] - total[edges[:-1]] + np.uint64(seed)).view(np.int64))
    return out[0], out[1]


def bitmaps(tokens: np.ndarray, edges: np.ndarray) -> list[bytes]:
    """A bitmap of each set's tokens, of a power of two of bits, two for each token at least. The upper half folds onto the lower."""
    size = np.diff(edges)
    bits = 1 << np.ceil(np.log2(np.clip(2 * size, 64, 1 << 16))).astype(np.int64)
    first = np.cumsum(bits // 64) - bits // 64
    own = np.repeat(np.arange(len(size)), size)
    bit = ((tokens >> np.uint64(20)) & (bits[own] - 1).astype(np.uint64)).astype(np.int64)
    out = np.zeros(int((bits // 64).sum()), np.uint64)
    np.bitwise_or.at(out, first[own] + (bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return [out[a : a + n].tobytes() for a, n in zip(first.tolist(), (bits // 64).tolist(), strict=True)]


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of one matrix, of the width of the narrowest."""
    width = min(len(m) for m in maps) // 8
    return np.stack([np.bitwise_or.reduce(np.frombuffer(m, np.uint64).reshape(-1, width), 0) for m in maps])


class SignatureTree:
    """Levels of nodes over sets, leaves first: OR of the bitmaps, least and largest size, and the most tokens that share a bit."""

    def __init__(self, map_: np.ndarray, size: np.ndarray):
        self.levels = [(map_, size, size, size - np.bitwise_count(map_).sum(1))]
        while len(self.levels[-1][1]) > 1:
            m, lo, hi, slack = self.levels[-1]
            at = np.arange(0, len(lo), _FAN)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at)))

    def may_link(self, level: int, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """False for node pairs in which no two sets can reach the threshold."""
        m, lo, hi, slack = self.levels[level]
        most = np.minimum(np.bitwise_count(m[x] & m[y]).sum(1) + np.minimum(slack[x], slack[y]), np.minimum(hi[x], hi[y]))
        return (most * (100 + percent) >= percent * (lo[x] + lo[y])) & (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x])

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Batches of pairs i < j of sets that the bounds cannot rule out. At most 8 MB of bitmaps are looked at together."""
        at_once = min(1 << 16, max(_FAN * _FAN, (1 << 20) // self.levels[0][0].shape[1]))
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        child = np.arange(_FAN)
        while todo:
            level, x, y = todo.pop()
            if len(x) > at_once:
                half = len(x) // 2
                todo += [(level, x[half:], y[half:]), (level, x[:half], y[:half])]
                continue
            keep = self.may_link(level, x, y, percent)
            x, y = x[keep], y[keep]
            if not level:
                keep = x < y
                yield x[keep], y[keep]
                continue
            n = len(self.levels[level - 1][1])
            cx = np.repeat(x[:, None] * _FAN + child, _FAN, 1).ravel()
            cy = np.tile(y[:, None] * _FAN + child, _FAN).ravel()
            keep = (cx <= cy) & (cx < n) & (cy < n)
            if keep.any():
                todo.append((level - 1, cx[keep], cy[keep]))


def may_connect(maps: list[bytes], size: np.ndarray, percent: int) -> np.ndarray:
    """A label for each set: sets that chains of pairs within the bounds connect have one label."""
    m = folded(maps)
    order = np.lexsort((size, m[:, 0]))
    label = np.arange(len(size))
    for x, y in SignatureTree(m[order], size[order]).pairs(percent):
        while len(x):
            keep = label[x] != label[y]
            x, y = x[keep], y[keep]
            if len(x):
                label[label == label[y[0]]] = label[x[0]]
    out = np.empty(len(size), np.int64)
    out[order] = label
    return out


def may_link_parts(maps: list[bytes], size: np.ndarray, part: np.ndarray, percent: int) -> np.ndarray:
    """Whether each set is of a pair within the bounds whose sets have different parts."""
    m = folded(maps)
    order = np.lexsort((size, m[:, 0]))
    part, found = part[order], np.zeros(len(size), bool)
    for x, y in SignatureTree(m[order], size[order]).pairs(percent):
        keep = part[x] != part[y]
        found[x[keep]] = found[y[keep]] = True
    out = np.empty(len(size), bool)
    out[order] = found
    return out


def links(node: np.ndarray, tokens: list[np.ndarray], percent: int, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets of this group that are connected within it; sets of the same `part` count as joined already."""
    size = np.array([len(t) for t in tokens])
    order = np.lexsort((size, np.array([t[0] for t in tokens])))
    node, tokens, size = node[order], [tokens[i] for i in order], size[order]
    label = np.unique(part[order], return_inverse=True)[1] if part is not None else np.arange(len(node))
    out = []
    maps = folded(bitmaps(np.concatenate(tokens), np.concatenate([[0], np.cumsum(size)])))
    for x, y in SignatureTree(maps, size).pairs(percent):
        while len(x):
            keep = label[x] != label[y]
            x, y = x[keep], y[keep]
            done = len(x)
            for k, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                a, b = tokens[i], tokens[j]
                common = len(np.intersect1d(a, b, assume_unique=True))
                if common * (100 + percent) >= percent * (len(a) + len(b)):
                    out.append((int(node[i]), int(node[j])))
                    label[label == label[j]] = label[i]
                    done = k + 1
                    break
            x, y = x[done:], y[done:]
    return out


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: `(doc_id, n, k1, k2, map)` of each text, and `(token in k1, n)` of tokens that come a few times among those counted at once."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "k1", "k2", "common", "map"]

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        t = np.concatenate(held)
        held.clear()
        t.sort()
        first = np.flatnonzero(np.append(len(t) > 0, t[1:] != t[:-1]))
        n = np.diff(first, append=len(t))
        keep = n >= COUNTED_FROM
        t, n = t[first[keep]].view(np.int64), n[keep]
        none = pa.nulls(len(t))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), pa.array(n), pa.array(t), pa.array(np.zeros(len(t), np.int64)), pa.array(np.ones(len(t), bool)), none.cast(pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # tokens of sets not seen since the last count
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for lo, hi, data, at in tx.text_blocks(batch, most=2 << 20):
                tokens, edges = shingle_sets(data, at, k)
                k1, k2 = set_keys(tokens, edges)
                size = np.diff(edges)
                maps = pa.array(bitmaps(tokens, edges), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *map(pa.array, (size, k1, k2, np.zeros(len(size), bool))), maps], names)
                fresh = np.zeros(len(size), bool)
                fresh[np.unique(k1, return_index=True)[1]] = True
                fresh &= ~np.isin(k1, seen)
                seen = np.concatenate([seen, k1[fresh]])
                held.append(tokens[np.repeat(fresh, size)])
                if sum(map(len, held)) >= COUNTED:
                    yield counted(held)
                    seen = seen[:0]
        if held:
            yield counted(held)

    return docs.mapInArrow(run, f"doc_id {kind}, n long, k1 long, k2 long, common boolean, map binary")


def _prefixes(docs: DataFrame, k: int, percent: int, common: np.ndarray, much: np.ndarray) -> DataFrame:
    """`(token, k1)`: the tokens by which each set meets others, `common` ones last in the order, by how `much` they are so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, at in tx.text_blocks(batch):
                tokens, edges = shingle_sets(data, at, k)
                k1, _ = set_keys(tokens, edges)
                size = np.diff(edges)
                own = np.repeat(np.arange(len(size)), size)
                place = np.searchsorted(common, tokens)
                place = np.minimum(place, len(common) - 1)
                last = np.where(common[place] == tokens, much[place], 0) if len(common) else np.zeros(len(tokens), np.int64)
                order = np.lexsort((tokens, last, own))
                rank = np.arange(len(own)) - np.repeat(edges[:-1], size)
                fresh = np.zeros(len(size), bool)
                fresh[np.unique(k1, return_index=True)[1]] = True
                keep = (rank < (size - (-(-percent * size // 100)) + 1)[own]) & fresh[own]
                yield pa.RecordBatch.from_arrays([pa.array(tokens[order][keep].view(np.int64)), pa.array(k1[own][keep])], ["token", "k1"])

    return docs.mapInArrow(run, "token long, k1 long")


def _blocks(members: DataFrame, times: int = 1) -> DataFrame:
    """How many tasks share each group; `times` as many tokens as else are one task's."""
    return cut(members.groupBy("hub", "klass").agg(F.greatest(F.ceil(F.sum("n") / (times * GROUP_TOKENS)), F.ceil(F.count("*") / GROUP_SETS)).cast("long").alias("blocks")))


def _refined(members: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Groups without the sets that the trees of bitmaps rule out, taken apart where no pair within the bounds connects
    the parts; a part is named by its least set, so equal parts of several groups become one. Groups whose bitmaps are more
    than one task's stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in tx.sorted_groups(batches, ["hub", "klass"]):
            if g.num_rows < 2:
                continue
            node, n = g.column("node").to_numpy(), g.column("n").to_numpy()
            label, count = np.unique(may_connect(g.column("map").to_pylist(), n, percent), return_inverse=True, return_counts=True)[1:]
            least = np.full(len(count), np.iinfo(np.int64).max)
            np.minimum.at(least, label, node)
            keep = count[label] > 1
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(least[label][keep]), pa.array(g.column("klass").to_numpy()[keep]), pa.array(node[keep]), pa.array(n[keep])], ["hub", "klass", "node", "n"])

    dealt = _blocks(members, BY_MAPS)
    small = members.join(dealt.where("blocks = 1").select("hub", "klass"), ["hub", "klass"]).join(maps, "node")
    parts = small.select("hub", "klass", "node", "n", "map").repartition("hub", "klass").sortWithinPartitions("hub", "klass").mapInArrow(run, "hub long, klass int, node long, n long")
    return cut(parts.unionByName(members.join(dealt.where("blocks > 1").select("hub", "klass"), ["hub", "klass"])).distinct())


def _groups(docs: DataFrame, tasks: DataFrame, k: int, percent: int) -> DataFrame:
    """Links `(src, dst)` within each task. `tasks`: (hub, klass, block, node, part), one row for each set and task."""
    lists = tasks.groupBy("node").agg(F.collect_set(F.struct("hub", "klass", "block", "part")).alias("tasks"))
    texts = docs.join(lists, F.col("doc_id") == F.col("node")).select("node", "text", "tasks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tasks")
            for lo, hi, data, at in tx.text_blocks(batch):
                tokens, edges = shingle_sets(data, at, k)
                part = lists.slice(lo, hi - lo)
                own = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy())
                full = np.flatnonzero(np.diff(edges)[own])  # an id that repeats may have an empty text too
                flat, own = part.flatten().take(pa.array(full)), own[full]
                packed = [tokens[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
                for s in range(0, len(own), 2000):
                    some = own[s : s + 2000]
                    cols = [flat.slice(s, len(some)).field(x) for x in ("hub", "klass", "block", "part")]
                    yield pa.RecordBatch.from_arrays([*cols, batch.column("node").slice(lo, hi - lo).take(pa.array(some)), pa.array([packed[i] for i in some], pa.binary())], ["hub", "klass", "block", "part", "node", "tokens"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for g in tx.sorted_groups(batches, ["hub", "klass", "block"]):
            if g.num_rows > 1:
                tokens = [np.frombuffer(b, np.uint64) for b in g.column("tokens").to_pylist()]
                out += links(g.column("node").to_numpy(), tokens, percent, g.column("part").to_numpy())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["src", "dst"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["src", "dst"])

    rows = texts.mapInArrow(sets, "hub long, klass int, block long, part long, node long, tokens binary")
    return rows.repartition("hub", "klass", "block").sortWithinPartitions("hub", "klass", "block").mapInArrow(linked, "src long, dst long")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_shingles`, `component_id` (smallest id reachable by links, its own included).

    A text's set holds its distinct shingles of `words` words (`[^\\x20\\x09-\\x0D]+`, A-Z lower-cased); a text of fewer
    words is one shingle. Two texts link when 100 * common >= `percent` * union. Ids are whole numbers.

    Null texts, and texts without words, have no set: 0 shingles, linked with nothing. Rows that repeat an id are one
    document with the links of all its rows. A null id links through equal sets only. Other columns are not read; an
    empty table gives an empty result. Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    ready(spark)
    mark = len(CUTS)
    docs = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scan = cut(_scan(docs, words))
    rows = scan.where("not common").select("doc_id", "n", "k1", "k2", "map")
    hot = scan.where("common").groupBy("k1").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "k1").limit(COMMON).toArrow()
    common, much = hot.column("k1").to_numpy().view(np.uint64), np.frexp(hot.column("n").to_numpy())[1]
    order = np.argsort(common)
    common, much = common[order], much[order]

    sets = cut(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("node")))
    kept = CUTS[mark:]  # what the result reads; other tables go as soon as none needs them

    def only(*also: str) -> None:
        drop_cuts(spark, [p for p in CUTS[mark:] if p not in kept and p not in also])

    meet = cut(_prefixes(docs, words, percent, common, much))
    # aggregates are cut before they are joined back, so that Spark may split a hot key's rows in the join
    shared = cut(meet.groupBy("token").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("token"))
    klass = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * 1.001)).cast("int") if percent < 100 else F.col("n").cast("int")
    met = meet.join(shared, "token", "left_semi").distinct().join(sets.where("node is not null"), "k1").select("token", "node", "n", F.explode(F.array(klass, klass - 1)).alias("klass"))
    met = cut(met)
    only(CUTS[-1])
    hubs = cut(met.groupBy("token", "klass").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("token", "klass", "hub"))
    members = cut(met.join(hubs, ["token", "klass"]).select("hub", "klass", "node", "n").distinct())
    only(CUTS[-1])
    maps = rows.where("n > 0").select(F.col("doc_id").alias("node"), "map")
    members = _refined(members, maps, percent)
    only(CUTS[-1])
    dealt = _blocks(members)
    own_block = F.when(F.col("node") == F.col("hub"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks"))))
    tasks = members.join(dealt, ["hub", "klass"]).select("hub", "klass", F.explode(own_block).alias("block"), "node", F.col("node").alias("part"))
    found = cut(_groups(docs, tasks, words, percent).distinct())
    large = cut(dealt.where("blocks > 1"))
    if large.limit(1).count():
        found = found.unionByName(_across_blocks(docs, maps, members, large, found, words, percent))
    parts = cut(connected_components(found))
    only(CUTS[-1])
    named = sets.join(parts, sets["node"] == parts["node"], "left").select("k1", "k2", "n", F.coalesce("component", sets["node"]).alias("component"))
    return rows.drop("map").join(named, ["k1", "k2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _grid(m: DataFrame, times: int = 1) -> DataFrame:
    """Rows of `m` for each task of their group's grid, in which each `rest` set meets all sets of the group."""
    half = lambda cond: F.greatest(F.lit(1), F.ceil(2 * F.sum(F.when(cond, F.col("n")).otherwise(0)) / (times * GROUP_TOKENS)), F.ceil(2 * F.count_if(cond) / GROUP_SETS)).cast("long")
    grid = m.groupBy("hub", "klass").agg(half(F.col("rest")).alias("i_n"), half(F.lit(True)).alias("j_n"), F.count_if("rest").alias("rests")).where("rests > 0")
    m = m.join(grid, ["hub", "klass"])
    spread = lambda n: F.pmod(F.xxhash64("node", F.lit(7)), n)
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    as_rest = m.where("rest").withColumn("i", spread(F.col("i_n"))).withColumn("j", to("j_n"))
    as_any = m.withColumn("j", spread(F.col("j_n"))).withColumn("i", to("i_n"))
    return as_rest.unionByName(as_any).select("hub", "klass", (F.col("i") * F.col("j_n") + F.col("j")).alias("block"), "node", "n", "part", "rest").distinct()


def _across_blocks(docs: DataFrame, maps: DataFrame, members: DataFrame, large: DataFrame, found: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between blocks of large groups. Most sets of such a group are one component by now; each set outside its
    largest component is compared with all sets of the group, in blocks: first by bitmaps, then those that are left by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in tx.sorted_groups(batches, ["hub", "klass", "block"]):
            keep = may_link_parts(g.column("map").to_pylist(), g.column("n").to_numpy(), g.column("part").to_numpy(), percent)
            if keep.any():
                yield from g.filter(pa.array(keep)).select(["hub", "klass", "node", "n", "part", "rest"]).combine_chunks().to_batches()

    parts = connected_components(found)
    m = members.join(large.select("hub", "klass"), ["hub", "klass"]).join(parts, "node", "left").select("hub", "klass", "node", "n", F.coalesce("component", "node").alias("part"))
    m = cut(m)
    main = m.groupBy("hub", "klass", "part").agg(F.count("*").alias("c")).groupBy("hub", "klass").agg(F.max_by("part", F.struct("c", "part")).alias("main"))
    m = cut(m.join(main, ["hub", "klass"]).withColumn("rest", F.col("part") != F.col("main")))
    near = _grid(m, BY_MAPS).join(maps, "node").select("hub", "klass", "block", "node", "n", "part", "rest", "map")
    near = near.repartition("hub", "klass", "block").sortWithinPartitions("hub", "klass", "block")
    m = cut(near.mapInArrow(run, "hub long, klass int, node long, n long, part long, rest boolean").distinct())
    return cut(_groups(docs, _grid(m).drop("n", "rest"), words, percent).distinct())
