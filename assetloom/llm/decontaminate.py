"""Benchmark decontamination: Wu-Manber search of many word patterns in whole documents.

Patterns are the 13-word windows of all items. Text and patterns are compared as sequences of word hashes; a block is
two words. The shift table tells, for the block at the end of a text window, how far the window may move. At shift 0 the
hash of that block names a bucket of patterns; those of the bucket whose first block has the hash of the window's first
block are candidates, and a comparison of all words, byte by byte, confirms an occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm import text as tx
from assetloom.session import cut, ready

_BITS = 20
#: Words that one cursor walks through; many cursors step at once.
_STRIDE = 128


class Vocabulary:
    """Distinct words of the items: bytes in a row, where each starts, their hashes."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        self.hashes = tx.run_hashes(self.data, self.at[:-1], self.at[1:])

    def equal(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Whether each run of `data` is that word."""
        size = end - start
        same = size == self.at[word + 1] - self.at[word]
        k = np.flatnonzero(same)
        if len(k):
            first = np.cumsum(size[k]) - size[k]
            place = np.arange(int(size[k].sum())) - np.repeat(first, size[k])
            bytes_ = data[place + np.repeat(start[k], size[k])] == self.data[place + np.repeat(self.at[word[k]], size[k])]
            same[k] = np.logical_and.reduceat(bytes_, first)
        return same


class Patterns:
    """Shift table and buckets of the distinct patterns of one length in words, and which items hold each."""

    def __init__(self, m: int, words: np.ndarray, item: np.ndarray, vocabulary: Vocabulary):
        """`words` has a row of word numbers for each window, `item` the item it is from."""
        self.m, self.block, self.vocabulary = m, min(2, m), vocabulary
        self.words, own = np.unique(words, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([own.ravel(), item]), axis=1)
        self.items, self.edge = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.words) + 1))
        hashes = vocabulary.hashes[self.words]
        self.shift = np.full(1 << _BITS, m - self.block + 1, np.int16)
        for i in range(m - self.block + 1):
            np.minimum.at(self.shift, self._key(hashes[:, i : i + self.block]), m - self.block - i)
        bucket = self._bucket(self._mixed(hashes[:, m - self.block :]), self._mixed(hashes[:, : self.block]))
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]

    @staticmethod
    def _mixed(block: np.ndarray) -> np.ndarray:
        return tx.mix(block[..., 0] if block.shape[-1] == 1 else block[..., 0] * np.uint64(0x9E3779B97F4A7C15) + block[..., 1])

    @classmethod
    def _key(cls, block: np.ndarray) -> np.ndarray:
        return (cls._mixed(block) >> np.uint64(64 - _BITS)).astype(np.int64)

    @staticmethod
    def _bucket(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The bucket in the upper bits, the first block's hash in the lower ones."""
        return (last >> np.uint64(64 - _BITS) << np.uint64(64 - _BITS)) | (first >> np.uint64(_BITS))

    def occurrences(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of each occurrence: cursors walk over the last words `first` to `last` (without) of windows by the shift table."""
        m, b, none = self.m, self.block, np.zeros(0, np.int64)
        if len(h) < m or not len(self.words):
            return none, none
        mixed = self._mixed(np.stack([h[i : len(h) - b + 1 + i] for i in range(b)], -1))
        key = (mixed >> np.uint64(64 - _BITS)).astype(np.int64)
        alive = first < last
        at, stop, stops = first[alive], last[alive], []
        while len(at):  # `at` is a window's last word
            move = self.shift[key[at - b + 1]]
            stops.append(at[move == 0])
            at = at + np.maximum(move, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        window = np.sort(np.concatenate(stops)) - m + 1 if stops else none
        wanted = self._bucket(mixed[window + m - b], mixed[window])
        lo, hi = np.searchsorted(self.bucket, wanted, "left"), np.searchsorted(self.bucket, wanted, "right")
        n = hi - lo
        window, place = np.repeat(window, n), np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pattern = self.order[place]
        for i in range(m):  # words by hash, then by bytes
            keep = h[window + i] == self.vocabulary.hashes[self.words[pattern, i]]
            window, pattern = window[keep], pattern[keep]
        pairs, own = np.unique(np.stack([(window[:, None] + np.arange(m)).ravel(), self.words[pattern].ravel()]), axis=1, return_inverse=True)
        sure = self.vocabulary.equal(data, start[pairs[0]], end[pairs[0]], pairs[1])[own.ravel()].reshape(-1, m).all(1)
        return window[sure], pattern[sure]


class Search:
    """Patterns of all lengths: full windows, and whole items that are shorter than a window."""

    def __init__(self, rows: list[tuple[str, str]], width: int):
        self.names = sorted({item for item, _ in rows})
        number = {item: i for i, item in enumerate(self.names)}
        known: dict[bytes, int] = {}
        windows: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in rows:
            data = tx.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
            start, end, _ = tx.words(data, np.array([0, len(data)]), tx.ALNUM)
            low = data.tobytes()
            w = np.array([known.setdefault(low[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.int32)
            if m := min(width, len(w)):
                windows.setdefault(m, []).append((number[item], np.lib.stride_tricks.sliding_window_view(w, m)))
        vocabulary = Vocabulary(list(known))
        self.sets = [Patterns(m, np.concatenate([w for _, w in found]), np.repeat([i for i, _ in found], [len(w) for _, w in found]), vocabulary) for m, found in sorted(windows.items())]

    def run(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text; (text, word of it) of the words inside an occurrence; (text, item) of the items that occur."""
        n = len(at) - 1
        h, start, end, doc = tx.word_hashes(data, at, tx.ALNUM)
        edge = np.searchsorted(doc, np.arange(n + 1))
        low, hit, met = tx.LOWER[data], np.zeros(len(h) + 1, np.int64), [np.zeros((2, 0), np.int64)]
        for p in self.sets:
            base, stop = edge[:-1] + p.m - 1, edge[1:]
            runs = np.maximum(0, -(-(stop - base) // _STRIDE))
            own = np.repeat(np.arange(n), runs)
            first = base[own] + (np.arange(len(own)) - np.repeat(np.cumsum(runs) - runs, runs)) * _STRIDE
            window, pattern = p.occurrences(low, h, start, end, first, np.minimum(first + _STRIDE, stop[own]))
            np.add.at(hit, window, 1)
            np.add.at(hit, window + p.m, -1)
            pairs = np.unique(np.stack([doc[window], pattern]), axis=1)
            count = p.edge[pairs[1] + 1] - p.edge[pairs[1]]
            place = np.repeat(p.edge[pairs[1]] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            met.append(np.stack([np.repeat(pairs[0], count), p.items[place]]))
        inside = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        met = np.unique(np.concatenate(met, axis=1), axis=1)
        return np.diff(edge), doc[inside], inside - edge[doc[inside]], met[0], met[1]


def _list(own: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(n + 1)), pa.int32()), values)


def contamination(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 13, share: int = 20, chars_at_once: int = 1 << 23) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_words`, `n_hit`, `items` (sorted ids as text), `n_items`, `contaminated`.

    Words are maximal runs of ASCII letters and digits and all bytes from 0x80, lower-cased A-Z. A window is `width`
    consecutive words of an item, or all words of a shorter one. A word is hit if any occurrence of a window covers
    it; a document is contaminated if `n_hit > 0` and `share * n_hit >= n_words`.

    The driver and each task hold items of about `chars_at_once` characters (and the largest item); a larger benchmark
    is searched in several passes, whose hit words are united, so no bound is put on its size. Null and empty texts have
    no words and are never contaminated; items without words match nothing; item ids may repeat and count once. Null item
    ids match nothing. Repeated documents are each judged. Other columns are not read; an empty table gives an empty
    result, an empty benchmark no hits.
    """
    spark = docs.sparkSession
    ready(spark)
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("t")).where("item is not null and t is not null").distinct()
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    passes = max(1, -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // chars_at_once))
    if passes > 1:
        return _judged(_in_passes(rows, items, passes, width), share)
    search = spark.sparkContext.broadcast(Search([(r["item"], r["t"]) for r in items.collect()], width))  # bounded by `chars_at_once`

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(search.value.names, pa.string())
        for batch in batches:
            for lo, hi, data, at in tx.text_blocks(batch):
                n, doc, _, own, item = search.value.run(data, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(np.bincount(doc, minlength=hi - lo), pa.int64()), _list(own, names.take(pa.array(item)), hi - lo)], ["doc_id", "n_words", "n_hit", "items"])

    return _judged(rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>"), share)


def _judged(found: DataFrame, share: int) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "items", F.size("items").cast("long").alias("n_items"), ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"))


def _in_passes(rows: DataFrame, items: DataFrame, passes: int, width: int) -> DataFrame:
    """The same over a benchmark too large for one pass: items are dealt by hash; later passes return only rows with hits."""
    spark = rows.sparkSession
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = cut(items.withColumn("part", F.pmod(F.xxhash64("item", "t"), F.lit(passes)).cast("int")))
    found = None
    for k in range(passes):
        search = spark.sparkContext.broadcast(Search([(r["item"], r["t"]) for r in dealt.where(F.col("part") == k).collect()], width))

        def run(batches: Iterator[pa.RecordBatch], search=search, every: bool = not k) -> Iterator[pa.RecordBatch]:
            names = pa.array(search.value.names, pa.string())
            for batch in batches:
                for lo, hi, data, at in tx.text_blocks(batch):
                    n, doc, word, own, item = search.value.run(data, at)
                    out = pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("row", "doc_id")), pa.array(n, pa.int64()), _list(doc, pa.array(word, pa.int64()), hi - lo), _list(own, names.take(pa.array(item)), hi - lo)], ["row", "doc_id", "n_words", "words", "items"])
                    yield out if every else out.take(pa.array(np.unique(doc)))

        part = cut(rows.mapInArrow(run, f"row long, doc_id {kind}, n_words long, words array<long>, items array<string>"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("words")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
