"""The prefix trie of conversations, by union-find over the common prefixes of sorted neighbours.

Turns become 16-byte tokens, a conversation the sequence of its tokens. Distinct sequences are sorted over all partitions.
In each partition the edges between neighbours, each as deep as their longest common prefix, are taken in descending
depth: a merge of two components makes a branching node at that depth, or adds a child to one. The nodes between a
branching node and the one above it have the same members, so they are read off the compressed forest.

A node that reaches a partition's border, where the neighbour beyond shares its prefix, is open. Such nodes, at most twice
a sequence's depth in each partition, are contracted to sums that add up (members, children, leaves, and the two terms of
saved tokens), and merged by their prefix; a node that goes on from the partition before is counted as new there only.

Sequences longer than `SEGMENT` turns are cut: each segment after the first is a row of the trie below its prefix. What
lies below a segment reaches the nodes above it by sums that each conversation brings along: every node's own share is
given to one of its members, the least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from assetloom.llm import text as tx
from assetloom.operators.places import placed
from assetloom.session import cut, ready

#: Turns of a row, sequences and bytes of a partition, ids that are joined to one text at a time.
SEGMENT, ROWS, BYTES, IDS = 1024, 50_000, 1 << 23, 4096
TOKEN = 16
_EMPTY = hashlib.sha256().hexdigest()
_AT = ["seg", "r1", "r2"]


def rebuilt_turns(conversations: DataFrame, mix: int = 6, block: int = 100) -> DataFrame:
    """`(conv_id, pos, tok, chars)` of rebuilt conversations, and one row without `pos` and `tok` for each of them."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    tok = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", tok.alias("tok"), F.length(text).cast("long").alias("chars"))
    id = F.col("conv_id")
    rows = cut(placed(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.col("tok")], "pos").select("conv_id", "pos", "tok", "chars", (id - id % block).alias("base"), (F.crc32(id.cast("string").cast("binary")) % mix).cast("int").alias("h")))
    heads = cut(rows.where((id == F.col("base")) & (F.col("pos") < mix - 1)).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("pos", "tok", "chars"))).alias("head")))
    ids = cut(rows.groupBy("conv_id", "base", "h").agg(F.lit(None).cast("long").alias("pos")))
    first = ids.join(heads, "base").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h"))).alias("x")).select("conv_id", "x.pos", "x.tok", "x.chars")
    sizes = cut(heads.select("base", F.size("head").alias("size")))
    own = rows.where("pos >= h").join(sizes, "base", "left").select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0)))).alias("pos"), "tok", "chars")
    return first.unionByName(own).unionByName(ids.select("conv_id", "pos", F.lit(None).cast("string").alias("tok"), F.lit(0).cast("long").alias("chars")))


def segments(turns: DataFrame, size: int) -> DataFrame:
    """`(conv_id, seg, seq, chars, r1, r2, e1, e2, last)`: tokens and code points of each segment; names of the prefixes before and after it."""
    one = F.when(F.col("tok").isNotNull(), F.struct("pos", "tok", "chars"))
    seg = F.coalesce(F.floor(F.col("pos") / size), F.lit(0)).cast("int")
    rows = turns.groupBy("conv_id", seg.alias("seg")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    rows = rows.select("conv_id", "seg", F.array_join(F.transform("x", lambda t: t["tok"]), "").alias("hex"), F.transform("x", lambda t: t["chars"]).alias("chars"))
    name = F.md5(F.concat_ws(":", "seg", "hex"))
    half = lambda at: F.conv(F.substring(name, at, 15), 16, 10).cast("long")
    w = W.Window.partitionBy("conv_id").orderBy("seg")
    upto = lambda c, end: F.coalesce(F.bit_xor(c).over(w.rowsBetween(W.Window.unboundedPreceding, end)), F.lit(0).cast("long"))
    rows = rows.withColumns({"a": half(1), "b": half(16)}).withColumns({"r1": upto("a", -1), "r2": upto("b", -1), "e1": upto("a", 0), "e2": upto("b", 0), "last": F.lead("seg").over(w).isNull()})
    return rows.select("conv_id", "seg", F.unhex("hex").alias("seq"), "chars", "r1", "r2", "e1", "e2", "last")


def ending_digests(segs: DataFrame) -> DataFrame:
    """`(seg, e1, e2, ends)`: sha256 of the ascending, comma-joined ids that end with a prefix. Ids are joined where they lie, then one task for each prefix streams the joined texts in order, as a digest must be."""
    rows = segs.where("last").select("seg", "e1", "e2", "conv_id")
    keys = ["seg", "e1", "e2"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in keys]
            new = np.zeros(batch.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            ids, out = batch.column("conv_id").to_pylist(), []
            edges = [0, *np.flatnonzero(new).tolist(), len(ids)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                out += [(a, ",".join(map(str, ids[a : min(a + IDS, hi)]))) for a in range(lo, hi, IDS)]
            at = np.array([a for a, _ in out], np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in cols), pa.array([ids[a] for a, _ in out], pa.int64()), pa.array([t for _, t in out])], [*keys, "first", "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*keys, "ids")), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield from _batches([done], ["int", "long", "long", "string"], [*keys, "ends"])
        if now is not None:
            yield from _batches([[(*now, h.hexdigest())]], ["int", "long", "long", "string"], [*keys, "ends"])

    by = [*keys, "conv_id"]
    pieces = rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(joined, "seg int, e1 bigint, e2 bigint, first bigint, ids string")
    return cut(pieces.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digested, "seg int, e1 bigint, e2 bigint, ends string"))


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batches(lots: list[list[tuple]], kinds: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    for rows in lots:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def common(a: bytes, b: bytes) -> int:
    """Tokens that both begin with."""
    n, d = min(len(a), len(b)), 0
    while d < n and a[d : d + TOKEN] == b[d : d + TOKEN]:
        d += TOKEN
    return d // TOKEN


class Forest:
    """The compressed tries of a partition's distinct, sorted sequences. Nodes 0 to k - 1 are the sequences' own; `left` and `right` are how many tokens the first and the last share with the neighbours beyond, -1 for none."""

    def __init__(self, tree: list, seqs: list[bytes], n: list[int], least: list[int], left: int, right: int):
        k = len(seqs)
        self.depth, self.n, self.least = [len(s) // TOKEN for s in seqs], list(n), list(least)
        self.first, self.last, self.up, self.children = list(range(k)), list(range(k)), [-1] * k, [0] * k
        self.left, self.right, self.k = left, right, k
        shared = [(common(seqs[i - 1], seqs[i]), i) for i in range(1, k) if tree[i - 1] == tree[i]]
        set_of, top = list(range(k)), list(range(k))

        def find(x: int) -> int:
            while set_of[x] != x:
                set_of[x] = x = set_of[set_of[x]]
            return x

        for d, i in sorted(shared, key=lambda e: (-e[0], e[1])):
            a, b = find(i - 1), find(i)
            x, y = top[a], top[b]
            if self.depth[x] > d:  # the merge makes a branching node
                z = len(self.depth)
                for col, v in ((self.depth, d), (self.n, self.n[x]), (self.least, self.least[x]), (self.first, self.first[x]), (self.last, self.last[x]), (self.up, -1), (self.children, 0)):
                    col.append(v)
                self._below(x, z)
                x = z
            self._below(y, x)
            self.n[x] += self.n[y]
            self.least[x] = min(self.least[x], self.least[y])
            self.last[x] = self.last[y]
            set_of[b] = a
            top[a] = x

    def _below(self, x: int, z: int) -> None:
        """x's chain of nodes begins under z; its first one is a new child unless it goes on from the partition before."""
        self.up[x] = z
        self.children[z] += not self.goes_on(x, self.depth[z] + 1)

    def goes_on(self, x: int, d: int) -> bool:
        return self.first[x] == 0 and d <= self.left

    def open(self, x: int, d: int) -> bool:
        return self.goes_on(x, d) or (self.last[x] == self.k - 1 and d <= self.right)

    def above(self, x: int) -> int:
        """Depth of the compressed node above, -1 over the top."""
        return self.depth[self.up[x]] if self.up[x] >= 0 else -1

    def sums(self, chars: list[np.ndarray], below: list[int], leaves: list[int], saved: list[int]) -> tuple[list[int], list[int], list[int]]:
        """For each node: leaves of its subtree, members times code points over it, and code points of its new nodes.

        `chars` are running sums of code points; `below` counts what a sequence's last node has below its segment, `leaves`
        and `saved` sum that up.
        """
        m = len(self.depth)
        leaf, many, once = [0] * m, [0] * m, [0] * m
        for x in sorted(range(m), key=lambda x: -self.depth[x]):  # what is below comes first
            d, c = self.depth[x], chars[self.first[x]]
            if x < self.k:
                extended = self.children[x] or (x == self.k - 1 and self.right == d)
                leaf[x] += leaves[x] if below[x] else int(not extended)
                many[x] += saved[x]
            own = int(c[d] - c[d - 1]) if d else 0
            many[x] += self.n[x] * own
            once[x] += own * (not self.goes_on(x, d))
            z = self.up[x]
            if z >= 0:
                above = self.depth[z]
                leaf[z] += leaf[x]
                many[z] += many[x] + self.n[x] * int(c[d - 1] - c[above])
                once[z] += once[x] + self.new_chars(x, c, above, d - 1)
        return leaf, many, once

    def new_chars(self, x: int, c: np.ndarray, lo: int, hi: int) -> int:
        """Code points of x's chain at depths over `lo` up to `hi`, without nodes that go on from the partition before."""
        lo = max(lo, min(self.left, hi)) if self.first[x] == 0 else lo
        return int(c[hi] - c[lo]) if hi > lo else 0


_NODE = [("seg", "int"), ("r1", "long"), ("r2", "long"), ("d", "int"), ("n", "long"), ("conv_id", "long"), ("children", "long"), ("leaves", "long"), ("many", "long"), ("once", "long"), ("chars", "long"), ("more", "boolean"), ("ends", "string"), ("key", "string"), ("pkey", "string"), ("parent", "long")]


def nodes_of(part: pa.Table) -> Iterator[tuple]:
    """Node rows of one partition, which has its own rows (kind 0), sorted, and its neighbours' nearest (kind -1 and 1)."""
    kind = part.column("kind").to_pylist()
    tree = list(zip(*(part.column(c).to_pylist() for c in _AT), strict=True))
    seqs = part.column("seq").to_pylist()
    a, b = kind[0] == -1, kind[-1] == 1
    left = common(seqs[0], seqs[1]) if a and tree[0] == tree[1] else -1
    right = common(seqs[-1], seqs[-2]) if b and tree[-1] == tree[-2] else -1
    own = slice(int(a), len(kind) - int(b))
    part, tree, seqs = part.slice(own.start, own.stop - own.start), tree[own], seqs[own]
    n, least, below, leaves, saved, root, ends, more = (part.column(c).to_pylist() for c in ("n", "conv_id", "below", "leaves", "saved", "root", "ends", "more"))
    chars = [np.concatenate([[0], np.cumsum(np.asarray(c, np.int64))]) for c in part.column("chars").to_pylist()]
    f = Forest(tree, seqs, n, least, left, right)
    leaf, many, once = f.sums(chars, below, leaves, saved)
    key = lambda r, d: "{}:{}:{}:{}:".format(*tree[r], d) + hashlib.md5(seqs[r][: TOKEN * d], usedforsecurity=False).hexdigest()
    for x in range(len(f.depth)):
        r, deep, above = f.first[x], f.depth[x], f.above(x)
        c, seg = chars[r], tree[r][0]
        for d in range(above + 1, deep + 1):
            whole = d == deep
            kids = f.children[x] + (below[x] if x < f.k else 0) if whole else int(not f.goes_on(x, d + 1))
            is_open, pkey, parent = f.open(x, d), None, None
            if d == 1 and seg:
                parent = root[r]
            elif d:
                up = x if d - 1 > above else f.up[x]
                pkey, parent = (key(r, d - 1), None) if f.open(up, d - 1) else (None, f.least[up])
            yield (
                *tree[r], d, f.n[x], f.least[x], kids, leaf[x], many[x] + (0 if whole else f.n[x] * int(c[deep - 1] - c[max(d - 1, 0)])), once[x] + (0 if whole else f.new_chars(x, c, max(d - 1, 0), deep - 1)), int(c[d] - c[d - 1]) if d else 0,
                bool(whole and x < f.k and more[x]), ends[x] if whole and x < f.k else None, key(r, d) if is_open else None, pkey, parent,
            )


def trie_nodes(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Node rows, named as `_NODE`, of distinct sequences `(seg, r1, r2, seq, chars, n, conv_id, below, leaves, saved, root, ends, more)`."""
    ready(rows.sparkSession)
    by = [*_AT, "seq"]
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("b")).first()
    parts = parts or max(rows.sparkSession.sparkContext.defaultParallelism, -(-size["n"] // ROWS), -(-size["b"] // BYTES))
    sorted_ = cut(rows.repartitionByRange(parts, *by).withColumn("part", F.spark_partition_id()))
    # one row for each part: its first and last sequence, and those of the parts beside it
    ends = sorted_.groupBy("part").agg(F.min(F.struct(*by)).alias("first"), F.max(F.struct(*by)).alias("last"))
    w = W.Window.orderBy("part")
    beside = ends.select("part", F.array(F.struct(F.lit(-1).alias("kind"), F.lag("last").over(w).alias("x")), F.struct(F.lit(1).alias("kind"), F.lead("first").over(w).alias("x"))).alias("b"))
    ghosts = beside.select("part", F.explode("b").alias("b")).where("b.x is not null").select("part", "b.kind", *(F.col(f"b.x.{c}").alias(c) for c in by))
    every = sorted_.withColumn("kind", F.lit(0)).unionByName(ghosts, allowMissingColumns=True).withColumn("part", F.col("part").cast("long"))
    names, kinds = [c for c, _ in _NODE], [k for _, k in _NODE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tx.sorted_groups(batches, ["part"]):
            held = []
            for row in nodes_of(part):
                held.append(row)
                if len(held) == 1 << 15:
                    yield from _batches([held], kinds, names)
                    held = []
            yield from _batches([held], kinds, names)

    dealt = every.repartition(F.col("part")).sortWithinPartitions("part", *by)
    found = cut(dealt.mapInArrow(run, ", ".join(f"{c} {k}" for c, k in _NODE)))
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "many", "once")]
    same = [F.max(c).alias(c) for c in ("seg", "r1", "r2", "d", "chars", "more", "ends", "pkey", "parent")]
    merged = cut(found.where("key is not null").groupBy("key").agg(*sums, F.min("conv_id").alias("conv_id"), *same))
    whole = found.where("key is null").unionByName(merged.select(names))
    above = merged.select(F.col("key").alias("pkey"), F.col("conv_id").alias("up"))
    return whole.join(above, "pkey", "left").withColumn("parent", F.coalesce("parent", "up")).drop("up", "key", "pkey")


def _distinct(segs: DataFrame) -> DataFrame:
    """Sequences of segments, each once, with the least conversation, the number of all, and sums of what they have below."""
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    return segs.groupBy(*_AT, "e1", "e2").agg(F.any_value("seq").alias("seq"), F.any_value("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.bool_or(~F.col("last")).alias("more"), *sums)


def conversation_trie(conversations: DataFrame, mix: int = 6, block: int = 100, segment: int | None = None, parts: int | None = None) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations `(conv_id, turn, role, text)`.

    Each conversation c is rebuilt from the first h turns of conversation c - c % `block` and its own turns after its first
    h; h is crc32 of its id's digits mod `mix`. Returns per node: `conv_id` (its least member), `depth`, `parent_conv_id`,
    `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`.

    Null roles and texts are empty; null turns come first; turns of one number are ordered by their content's md5, so
    repeated rows are turns each. Rows without a conv_id belong to no conversation. An empty table has no node, not even
    the root. Other columns are not read, whatever their names. Turns of one conversation, copies of one and members of a
    node may be most of all rows: turns are numbered by ranges, copies are counted before they are sorted, and a node over
    many partitions is merged from sums. Only the digest of ids that end at one node is made by one task, from joined
    texts of `IDS` ids.
    """
    ready(conversations.sparkSession)
    size = segment or SEGMENT
    segs = cut(segments(rebuilt_turns(conversations, mix, block), size))
    zero = {c: F.lit(0).cast("long") for c in ("leaves", "saved")}
    # segments below others first: what each conversation brings to the segments above
    flat = cut(_distinct(segs.where("seg > 0").withColumns(zero)).withColumns({"below": F.col("more").cast("long"), "root": F.lit(None).cast("long"), "ends": F.lit(None).cast("string")}))
    deep = cut(trie_nodes(flat, parts))
    share = deep.where("d > 0").groupBy("conv_id", "seg").agg(F.sum((F.col("n") - 1) * F.col("chars")).alias("saved"), F.count_if((F.col("children") == 0) & ~F.col("more")).alias("leaves"))
    w = W.Window.partitionBy("conv_id").orderBy("seg").rowsBetween(1, W.Window.unboundedFollowing)
    long_ = segs.where("seg > 0 or not last").select("conv_id", "seg").join(share, ["conv_id", "seg"], "left")
    brought = cut(long_.select("conv_id", "seg", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in zero)))
    some = _distinct(segs.join(brought, ["conv_id", "seg"], "left").withColumns({c: F.coalesce(c, z) for c, z in zero.items()}))
    some = cut(some)
    roots = cut(deep.where("d = 0").select((F.col("seg") - 1).alias("seg"), F.col("r1").alias("e1"), F.col("r2").alias("e2"), F.col("children").alias("below")))
    tops = cut(some.where("more").select((F.col("seg") + 1).alias("seg"), F.col("e1").alias("r1"), F.col("e2").alias("r2"), F.col("conv_id").alias("root")))
    rows = some.join(roots, ["seg", "e1", "e2"], "left").join(tops, _AT, "left").join(ending_digests(segs), ["seg", "e1", "e2"], "left").drop("e1", "e2")
    nodes = trie_nodes(cut(rows.withColumn("below", F.coalesce("below", F.lit(0)).cast("long"))), parts)
    return nodes.where("d > 0 or seg = 0").select(
        "conv_id",
        (F.col("seg").cast("long") * size + F.col("d")).alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("many") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )
