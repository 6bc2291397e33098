"""Suffix-array dedup: find every byte covered by a string of a given length that starts anywhere else too.

Each place where such a string could start belongs to the anchor of its window: the least hash of an `ANCHOR`-byte string
in it. Equal windows have equal anchors, so places are gathered by anchor into stretches, and only stretches whose anchor
occurs again can hold repeats. Stretches that are equal as a whole enter once, with their count. The others are dealt to
shards by anchor. A shard sorts all suffixes of its stretches (Larsson-Sadakane refinement: ranks double the length they
tell apart, and only groups not yet told apart are sorted on), takes common prefixes of neighbours in the manner of
Kasai's algorithm (a prefix shrinks by at most one from one text place to the next, so only the places where it does not
follow from the one before are compared), and marks windows that share their whole length with a neighbour. An anchor
with more stretches than a shard holds is first taken apart: windows in which the anchor stands at about the same place
share all bytes but a few at both ends, so those bytes deal them to shards of their own, and parts that are equal as a
whole enter once again. What is still more than a shard holds goes to several shards; each sends its sorted window hashes
by range, and those are merged by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm import text as tx
from assetloom.session import cut, ready

#: Bytes of an anchor, bytes of stretches that one shard sorts, and parts by place of anchor of a larger anchor's stretches.
ANCHOR, SHARD, CLASSES = 48, 1 << 20, 8
#: Keys with the most rows that are met by broadcast; any number gives the same.
HOT = 4096
_M = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_M), -1, 1 << 64))
_LOW = np.uint64(28)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _M), ("down", _INVERSE)):
            steps = np.full(n + n // 4, base, np.uint64)
            steps[:1] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def _rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling."""
    have, width, out, done = tx._RANDOM[data], 1, None, 0
    while True:
        if k & width:
            shifted = have if out is None else have[done : done + len(data) - (done + width) + 1]
            out = shifted if out is None else out[: len(shifted)] * _up(width) + shifted
            done += width
        if done == k:
            return tx.mix(out)
        have = have[:-width] * _up(width) + have[width:]
        width *= 2


def _up(n: int) -> np.ndarray:
    return np.array([pow(int(_M), n, 1 << 64)], np.uint64)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive entries."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(grid, 1).ravel()
    return np.minimum(ahead[:n], behind[w - 1 : w - 1 + n])


def stretches(data: np.ndarray, at: np.ndarray, length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Stretches as (text, first place in it, places, anchor's distance from the first place, anchor hash, hash of all
    bytes of the windows that start there), and repeats found on the way as (text, first place, places).

    Where neighbouring stretches have equal anchors, as in text of a short period, windows that occur several times among
    them are such repeats, and only the first of each stays: text of one repeated byte is one stretch of one place.
    """
    n, none = len(data), np.zeros(0, np.int64)
    size = at[1:] - at[:-1]
    doc = np.repeat(np.arange(len(size)), size)
    places = np.flatnonzero(np.arange(n) + length <= at[1:][doc]) if n >= length else none
    if not len(places):
        return (none,) * 6, (none,) * 3
    h = _rolling(data, ANCHOR)
    mask = (np.uint64(1) << _LOW) - np.uint64(1)
    key = (h & ~mask) | (mask - (np.arange(len(h), dtype=np.uint64) & mask))
    least = _least(key, length - ANCHOR + 1)[places]
    sums = _sums(data)

    def runs(places: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
        new = np.ones(len(places), bool)
        new[1:] = (least[1:] != least[:-1]) | (places[1:] != places[:-1] + 1)
        start = np.flatnonzero(new)
        first = places[start]
        back = (mask - (least[start] & mask)).astype(np.int64)
        return first, np.diff(np.append(start, len(places))), first + ((back - first) & int(mask))

    first, count, anchor = runs(places, least)
    chained = (h[anchor][1:] == h[anchor][:-1]) & (first[1:] == first[:-1] + count[:-1])
    local = (none,) * 3
    if chained.any():
        chain = np.cumsum(np.concatenate([[True], ~chained]))
        inside = np.repeat(np.concatenate([chained, [False]]) | np.concatenate([[False], chained]), count)
        own, p = np.repeat(chain, count)[inside], places[inside]
        w = _spans(sums, p, p + length)
        order = np.lexsort((p, w, own))
        new = np.ones(len(p), bool)
        new[1:] = (w[order][1:] != w[order][:-1]) | (own[order][1:] != own[order][:-1])
        often = np.empty(len(p), bool)
        often[order] = np.repeat(np.diff(np.append(np.flatnonzero(new), len(p))) > 1, np.diff(np.append(np.flatnonzero(new), len(p))))
        kept = np.ones(len(places), bool)
        kept[np.flatnonzero(inside)[order[~new]]] = False
        again = p[often]
        edge = np.flatnonzero(np.concatenate([[True], again[1:] != again[:-1] + 1])) if len(again) else none
        local = (doc[again[edge]], again[edge] - at[doc[again[edge]]], np.diff(np.append(edge, len(again))))
        first, count, anchor = runs(places[kept], least[kept])
    whole = tx.mix(_spans(sums, first, first + count - 1 + length) + tx.mix(count.astype(np.uint64)))
    return (doc[first], first - at[doc[first]], count, anchor - first, h[anchor].view(np.int64), whole.view(np.int64)), local


def sub_stretches(data: np.ndarray, first: np.ndarray, count: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches taken apart by where the anchor stands in the window: (stretch, first place, places, key, hash of all bytes).

    Windows whose anchor stands in the same `CLASSES`-th part of the possible places share, besides the anchor, all
    bytes but a few at both ends; the key is a hash of those. Equal windows have equal keys.
    """
    sums = _sums(data)
    wide = -(-(length - ANCHOR + 1) // CLASSES)
    out = []
    for c in range(CLASSES):
        near, far = c * wide, min((c + 1) * wide - 1, length - ANCHOR)  # distances of the anchor from a window's start
        low, high = np.maximum(off - count + 1, near), np.minimum(off, far)
        k = np.flatnonzero(low <= high)
        a, n = first[k] + off[k], high[k] - low[k] + 1
        start = a - high[k]
        key = tx.mix(_spans(sums, a - near, a - far + length) + np.uint64(c + 1))
        whole = tx.mix(_spans(sums, start, start + n - 1 + length) + tx.mix(n.astype(np.uint64)))
        out.append((k, start, n, key.view(np.int64), whole.view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sums(data: np.ndarray) -> np.ndarray:
    """Running sums from which `_spans` takes hashes."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx._RANDOM[data] * _powers(len(data) + 1)[0][: len(data)])])


def _spans(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span."""
    return tx.mix((sums[hi] - sums[lo]) * _powers(len(sums))[1][lo] + (hi - lo).astype(np.uint64))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes. Symbols are 0 to 256; the shorter of two suffixes that agree comes first."""
    n = len(symbols)
    packed, padded = np.zeros(n, np.int64), np.concatenate([symbols + 1, np.zeros(8, np.int64)])
    for i in range(7):
        packed = packed << 9 | padded[i : i + n]
    order = np.argsort(packed, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    edge = np.flatnonzero(np.concatenate([[True], packed[order][1:] != packed[order][:-1]]))
    rank[order] = np.repeat(edge, np.diff(np.append(edge, n)))
    h = 7
    while True:
        size = np.diff(np.append(edge, n))
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            break
        slot = np.flatnonzero(open_)  # groups of more than one place, in their slots
        place = order[slot]
        major, minor = rank[place], rank[np.minimum(place + h, n)]
        inner = np.argsort(major * (n + 1) + minor + 1, kind="stable")
        order[slot] = place = place[inner]
        major, minor = major[inner], minor[inner]
        first = np.concatenate([[True], (major[1:] != major[:-1]) | (minor[1:] != minor[:-1])])
        rank[place] = np.repeat(slot[first], np.diff(np.append(np.flatnonzero(first), len(slot))))
        edge = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
        h *= 2
    return order


def common_prefixes(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each slot but the first, how many symbols its suffix shares with that of the slot before."""
    n = len(symbols)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    led = np.ones(n, bool)  # places whose prefix does not follow from the place before
    led[1:] = (before[1:] <= 0) | (symbols[:-1] != symbols[np.maximum(before[1:] - 1, 0)])
    a = np.flatnonzero(led & (before >= 0))
    b, same = before[a], np.zeros(len(a), np.int64)
    padded = np.concatenate([symbols, np.full(16, 511, np.int64)])
    packed = padded[: n + 8].copy()
    for k in range(1, 7):
        packed = packed * 512 + padded[k : k + n + 8]
    going = np.arange(len(a))
    while len(going):
        x, y = a[going] + same[going], b[going] + same[going]
        equal = packed[x] == packed[y]
        rest = going[~equal]
        for _ in range(6):
            step = padded[a[rest] + same[rest]] == padded[b[rest] + same[rest]]
            rest = rest[step]
            same[rest] += 1
        going = going[equal]
        same[going] += 7
    reach = i.copy()
    reach[a] += same
    return (reach[np.maximum.accumulate(np.where(led, i, 0))] - i)[order[1:]]


def shard_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a shard as (piece, offset, group of equal windows, size of the group)."""
    size = np.array([len(p) for p in pieces])
    first = np.cumsum(size + 1) - size - 1
    symbols = np.zeros(int((size + 1).sum()), np.int64)
    inside = np.ones(len(symbols), bool)
    inside[first + size] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    order = suffix_array(symbols)
    prefix = common_prefixes(symbols, order)
    own = np.repeat(np.arange(len(pieces)), size + 1)
    fits = (np.arange(len(symbols)) + length <= (first + size)[own])[order]
    group = np.concatenate([[0], np.cumsum(prefix < length)])[fits]
    place = order[fits]
    _, group, count = np.unique(group, return_inverse=True, return_counts=True)
    return own[place], place - first[own[place]], group, count[group]


class Keyed(NamedTuple):
    """Docs with `h`, a hash of the text: (doc_id, h) tells rows with different texts apart, whatever ids repeat or are null."""

    docs: DataFrame
    kind: str

    def texts_of(self, stretches: DataFrame, cols: list[str]) -> DataFrame:
        """Texts of the rows that `stretches` name, each with its list `s` of structs of `cols`."""
        lists = cut(stretches.groupBy("doc_id", "h").agg(F.collect_set(F.struct(*cols)).alias("s"))).withColumnsRenamed({"doc_id": "id_", "h": "h_"})
        # rows that are equal in id and text share one list; one of them gives the text
        return self.docs.join(lists, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_"))).select("doc_id", "h", "text", "s")


def _listed(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.StructArray, np.ndarray, np.ndarray]]:
    """(rows, row of each stretch, stretches, bytes, first place of each in them) of the blocks of texts with lists; a stretch's own bytes are all there."""
    lists = batch.column("s")
    for lo, hi, data, at in tx.text_blocks(batch):
        part = lists.slice(lo, hi - lo)
        own, flat = np.repeat(np.arange(hi - lo), part.value_lengths().to_numpy()), part.flatten()
        start = flat.field("start").to_numpy().astype(np.int64)
        if len(data) <= 2 * tx.BLOCK:
            yield batch.slice(lo, hi - lo), own, flat, data, start + at[own]
            continue
        for s in range(0, len(data), tx.BLOCK):  # one long text, in slices
            k = np.flatnonzero((start >= s) & (start < s + tx.BLOCK))
            if len(k):
                begin = max(0, s - length)
                yield batch.slice(lo, 1), own[k], flat.take(pa.array(k)), data[begin : s + tx.BLOCK + 3 * length], start[k] - begin


def _shards(rows: DataFrame, kind: str, length: int, shard_bytes: int) -> DataFrame:
    """Sort each shard. Rows out: spans `(doc_id, h, lo, hi)` of a text; and for groups of several shards, of each shard and range of hashes one row with the sorted window hashes `w` and where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for g in tx.sorted_groups(batches, ["key", "part"]):
            bytes_ = g.column("piece").nbytes
            if g.num_rows == 1 and g.column("parts")[0].as_py() == 1:
                continue  # nothing to compare with
            if held and size + bytes_ > shard_bytes:
                yield from sort(pa.concat_tables(held))
                held, size = [], 0
            held.append(g)
            size += bytes_
        if held:
            yield from sort(pa.concat_tables(held))

    def sort(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        pieces = t.column("piece").to_pylist()
        own, offset, group, count = shard_windows(pieces, length)
        single, parts, start, key = (t.column(c).to_numpy() for c in ("single", "parts", "start", "key"))
        ids, h = t.column("doc_id").combine_chunks(), t.column("h").to_numpy()
        repeated = (count > 1) & single[own]
        order = np.lexsort((offset[repeated], own[repeated]))
        o, p = own[repeated][order], offset[repeated][order]
        new, end = np.ones(len(o), bool), np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
        end[:-1] = new[1:]
        which = o[new]
        yield _rows(ids.take(pa.array(which)), h[which], start[which] + p[new], start[which] + p[end] + length)
        out = np.flatnonzero((parts > 1)[own])
        if len(out):
            out = out[np.unique(group[out], return_index=True)[1]]
            first = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
            w = _rolling(np.frombuffer(b"".join(pieces), np.uint8), length)[first[own[out]] + offset[out]]
            order = np.argsort(w, kind="stable")
            out, w = out[order], w[order]
            bucket = ((w >> np.uint64(32)) * parts[own[out]].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            deal = np.lexsort((w, bucket, key[own[out]]))
            out, w, bucket = out[deal], w[deal], bucket[deal]
            k = key[own[out]]
            edges = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (bucket[1:] != bucket[:-1])]))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(out)], strict=True):
                who, at = np.unique(own[out[a:b]], return_inverse=True)
                place = start[own[out[a:b]]] + offset[out[a:b]]
                more = [k[a], bucket[a], w[a:b].tobytes(), at.astype("<u4").tobytes(), place.astype("<u4").tobytes(), single[own[out[a:b]]].tobytes(), ids.take(pa.array(who)), h[who]]
                yield _rows(pa.nulls(1, ids.type), [None], [None], [None], more)

    names = ["key", "bucket", "w", "at", "place", "single", "ids", "hs"]

    def _rows(ids: pa.Array, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, more: list | None = None) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(ids.type), pa.list_(pa.int64())]
        rest = [pa.nulls(len(ids), t) if more is None else pa.array([x.to_pylist() if isinstance(x, pa.Array) else x], t) for t, x in zip(kinds, more or kinds, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.array(h, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), *rest], ["doc_id", "h", "lo", "hi", *names])

    dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
    return dealt.mapInArrow(run, f"doc_id {kind}, h long, lo long, hi long, key long, bucket long, w binary, at binary, place binary, single binary, ids array<{kind}>, hs array<long>")


def merged(sorted_: list[np.ndarray]) -> list[np.ndarray]:
    """For sorted arrays of distinct numbers: which entries another array holds too. Each array is found in those merged before it by binary search."""
    met = [np.zeros(len(x), bool) for x in sorted_]
    if not sorted_:
        return met
    all_, array, index = sorted_[0], np.zeros(len(sorted_[0]), np.int64), np.arange(len(sorted_[0]))
    for i, x in enumerate(sorted_[1:], 1):
        at = np.searchsorted(all_, x)
        here = np.flatnonzero(at < len(all_))
        here = here[all_[at[here]] == x[here]]
        met[i][here] = True
        for j in np.unique(array[at[here]]):
            met[j][index[at[here]][array[at[here]] == j]] = True
        new = np.ones(len(x), bool)
        new[here] = False  # what is there already stands for both
        all_ = np.insert(all_, at[new], x[new])
        array, index = np.insert(array, at[new], i), np.insert(index, at[new], np.flatnonzero(new))
    return met


def _merge(found: DataFrame, kind: str, length: int) -> DataFrame:
    """Spans of windows that more than one shard of their group holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in tx.sorted_groups(batches, ["key", "bucket"]):
            rows = g.select(["w", "at", "place", "single", "ids", "hs"]).to_pylist()
            for r, met in zip(rows, merged([np.frombuffer(r["w"], np.uint64) for r in rows]), strict=True):
                k = np.flatnonzero(met & np.frombuffer(r["single"], bool))
                at, lo = np.frombuffer(r["at"], "<u4")[k], np.frombuffer(r["place"], "<u4")[k].astype(np.int64)
                ids = pa.array([r["ids"][i] for i in at], g.schema.field("ids").type.value_type)
                yield pa.RecordBatch.from_arrays([ids, pa.array([r["hs"][i] for i in at], pa.int64()), pa.array(lo), pa.array(lo + length)], ["doc_id", "h", "lo", "hi"])

    return found.repartition("key", "bucket").sortWithinPartitions("key", "bucket").mapInArrow(run, f"doc_id {kind}, h long, lo long, hi long")


def _known(rows: DataFrame, same: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose `keys` occur more than once. The `HOT` keys with the most rows are met by a broadcast of that size, so that their rows stay where they are."""
    copied = same.where("copies > 1")
    hot = cut(copied.orderBy(F.desc("copies"), *keys).limit(HOT).select(keys))
    return rows.join(F.broadcast(hot), keys, "left_semi").unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(copied.select(keys), keys, "left_semi"))


def repeated_spans(docs: DataFrame, length: int = 200, shard_bytes: int = SHARD) -> DataFrame:
    """`(doc_id, h, lo, hi)`: byte spans, perhaps overlapping, that together cover every repeated string of `length` bytes. `docs` has doc_id, h, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = Keyed(docs, kind)
    span = ["doc_id", "h", F.col("start").cast("long").alias("lo"), (F.col("start") + F.col("places") - 1 + length).cast("long").alias("hi")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, base, data, at in tx.text_slices(batch, length - 1):
                (doc, start, count, off, anchor, whole), (l_doc, l_start, l_count) = stretches(data, at, length)
                row = np.concatenate([own[doc], own[l_doc]])
                nulls = pa.nulls(len(l_doc), pa.int64())
                ints = [np.concatenate(x).astype(np.int32) for x in ((start + base[doc], l_start + base[l_doc]), (count, l_count), (off, np.zeros(len(l_doc), np.int64)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in ("doc_id", "h")), *map(pa.array, ints), *(pa.concat_arrays([pa.array(x), nulls]) for x in (anchor, whole))], ["doc_id", "h", "start", "places", "off", "anchor", "whole"])

    scanned = cut(docs.mapInArrow(scan, f"doc_id {kind}, h long, start int, places int, off int, anchor long, whole long"))
    rows = scanned.where("anchor is not null")
    # what is joined by anchor is cut first: a join whose sides both come straight from an exchange can split a hot anchor
    again = cut(rows.groupBy("anchor").count().where("count > 1").select("anchor"))
    rows = cut(rows.join(again, "anchor", "left_semi"))
    first = [F.first(c).alias(c) for c in ("doc_id", "h", "start", "places", "off")]
    same = cut(rows.groupBy("anchor", "whole").agg(F.count("*").alias("copies"), *first))
    spans = scanned.where("anchor is null").select(*span).unionByName(_known(rows, same, ["anchor", "whole"]).select(*span))

    def unclear(of: DataFrame, key: str, single: Column) -> DataFrame:
        return cut(of.groupBy(key).agg(F.count("*").alias("kinds"), F.count_if(single).alias("singles"), F.sum(F.col("places") + length).alias("bytes")).where("kinds > 1 and singles > 0"))

    one = F.col("copies") == 1
    open_ = unclear(same, "anchor", one)
    task = lambda key, parts, single: (F.col(key).alias("key"), F.pmod(F.xxhash64("whole"), parts).alias("part"), parts.alias("parts"), single.alias("single"), "start", "places")
    tasks = same.join(open_.where(F.col("bytes") <= shard_bytes).select("anchor"), "anchor").select("doc_id", "h", *task("anchor", F.lit(1).cast("long"), one))
    spread = open_.where(F.col("bytes") > shard_bytes).select("anchor")
    if spread.limit(1).count():
        sub = _split(keyed, same.join(spread, "anchor").withColumn("single", one), length)
        same2 = cut(sub.groupBy("key", "whole").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("doc_id", "h", "start", "places", "single"))))
        spans = spans.unionByName(_known(sub.where("single"), same2, ["key", "whole"]).select(*span))
        alone = one & F.col("single")
        open2 = unclear(same2, "key", alone)
        parts = F.ceil(F.col("bytes") / shard_bytes).cast("long")
        tasks = tasks.unionByName(same2.join(open2.select("key", "bytes"), "key").select("doc_id", "h", *task("key", parts, alone)))
    names = ["key", "part", "parts", "single", "start", "places"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, own, flat, data, start in _listed(batch, length):
                end, whole = start + flat.field("places").to_numpy() - 1 + length, data.tobytes()
                for k in range(0, len(own), 5000):
                    n = min(5000, len(own) - k)
                    pieces = [whole[a:b] for a, b in zip(start[k : k + n], end[k : k + n], strict=True)]
                    yield pa.RecordBatch.from_arrays([*(texts.column(c).take(pa.array(own[k : k + n])) for c in ("doc_id", "h")), *(flat.slice(k, n).field(c) for c in names), pa.array(pieces, pa.binary())], ["doc_id", "h", *names, "piece"])

    texts = keyed.texts_of(tasks, names)
    found = cut(_shards(texts.mapInArrow(fetch, f"doc_id {kind}, h long, key long, part long, parts long, single boolean, start int, places int, piece binary"), kind, length, shard_bytes))
    return spans.unionByName(found.where("w is null").select("doc_id", "h", "lo", "hi")).unionByName(_merge(found.where("w is not null"), kind, length))


def _split(keyed: Keyed, spread: DataFrame, length: int) -> DataFrame:
    """Stretches of anchors too large for a shard, taken apart by `sub_stretches`: `(doc_id, h, single, start, places, key, whole)`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, own, flat, data, first in _listed(batch, length):
                count, off = (flat.field(c).to_numpy().astype(np.int64) for c in ("places", "off"))
                k, start, n, key, whole = sub_stretches(data, first, count, off, length)
                base = flat.field("start").to_numpy().astype(np.int64) - first
                cols = [*(texts.column(c).take(pa.array(own[k])) for c in ("doc_id", "h")), flat.field("single").take(pa.array(k)), pa.array((start + base[k]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(key), pa.array(whole)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "single", "start", "places", "key", "whole"])

    texts = keyed.texts_of(spread, ["start", "places", "off", "single"])
    return cut(texts.mapInArrow(run, f"doc_id {keyed.kind}, h long, single boolean, start int, places int, key long, whole long"))


def repeated_bytes(docs: DataFrame, length: int = 200, id: str = "doc_id", text: str = "text", with_text: bool = False, shard_bytes: int = SHARD) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that starts anywhere else too, in the same text or another.

    Per row: `doc_id`, `n_bytes`, `n_removed`, `n_spans` (maximal removed runs), `kept_sha256` (of the bytes that stay), and
    `spans`, a list of (lo, hi); with `with_text` also `kept`, the bytes that stay.

    Matches never cross texts; overlaps count; strings are judged on the input. Null texts count as empty, and texts
    shorter than `length` lose nothing. Every row is a text of its own, also where ids repeat or are null: rows are told
    apart by id and a hash of the text, and rows equal in both are copies of each other. Long texts are searched in
    slices. Other columns are not read; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a set: rows equal in id and text bring the same spans; cut, so that a row that is there very often can be split from its key
    spans = cut(repeated_spans(docs, length, shard_bytes).groupBy("doc_id", "h").agg(F.collect_set(F.struct("lo", "hi")).alias("s"))).withColumnsRenamed({"doc_id": "id_", "h": "h_"})

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("s"), batch.num_rows
            data, at = tx.raw(batch.column("text"))
            own = np.repeat(np.arange(n), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
            flat = lists.flatten()
            shift = at[own] + own  # texts do not touch
            lo, hi = (flat.field(c).to_numpy() + shift for c in ("lo", "hi"))
            order = np.argsort(lo, kind="stable")
            lo, reach, own = lo[order], np.maximum.accumulate(hi[order]), own[order]
            new = np.ones(len(lo), bool)
            new[1:] = lo[1:] > reach[:-1]
            last = np.append(np.flatnonzero(new)[1:], len(lo)) - 1 if len(lo) else np.zeros(0, np.int64)
            own = own[new]
            lo, hi = lo[new] - own, reach[last] - own  # places in all bytes of the batch
            edges = np.searchsorted(own, np.arange(n + 1))
            digests, kept = [], []
            for i in range(n):
                begin, parts = at[i], []
                for a, b in zip(lo[edges[i] : edges[i + 1]], hi[edges[i] : edges[i + 1]], strict=True):
                    parts.append(data[begin:a])
                    begin = b
                parts.append(data[begin : at[i + 1]])
                digest = hashlib.sha256()
                for x in parts:
                    digest.update(x)
                digests.append(digest.hexdigest())
                if with_text:
                    kept.append(b"".join(x.tobytes() for x in parts))
            runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(lo - at[own]), pa.array(hi - at[own])], ["lo", "hi"]))
            removed = np.bincount(own, hi - lo, n).astype(np.int64)
            cols = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed), pa.array(np.diff(edges)), pa.array(digests, pa.string()), runs, *([pa.array(kept, pa.binary())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: len(cols)])

    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left").select("doc_id", "text", "s")
    return joined.mapInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo: long, hi: long>>" + ", kept binary" * with_text)
