"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Sizes are whole numbers up to the capacity, so documents and gaps are kept range-sorted as runs of equal size: at most
`capacity` runs of each, whatever the input. A round sweeps over the sorted runs: each gap takes its successor from below,
the largest document that fits and that no better-fitting gap has taken; gaps that compete for the same documents are
served in rank order. Matched gaps shrink by the document and the next round begins. What a round decides is a range of
ranks on both sides; ranks of documents come from one distributed range count over all pieces.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from assetloom.llm import text as tx
from assetloom.session import cut, ready

assert array("I").itemsize == 4 and sys.byteorder == "little"

#: Words whose ids a Python worker keeps; words met later are encoded each time.
CACHE = 250_000
_TOKENIZERS: dict = {}
#: Lower-case words that the vocabulary's normaliser leaves alone and its pre-tokenizer takes whole: a-z, and precomposed Latin letters from U+00E0.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\xa0-\xb6\xb8-\xbf])+").fullmatch
_TAIL = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + rest.index(b)) for b in range(256)]


def slices(text: bytes, most: int = 4 << 20) -> Iterator[slice]:
    """Parts of about `most` bytes that end at a blank or line feed, where there is one: words are split out of one part at a time."""
    lo = 0
    while len(text) - lo > most:
        ends = [k for k in (text.find(b" ", lo + most), text.find(b"\n", lo + most)) if k >= 0]
        hi = min(ends) if ends else len(text)
        yield slice(lo, hi)
        lo = hi
    yield slice(lo, len(text))


class Encoder(dict):
    """Ids of words as little-endian 32-bit numbers, filled as words come up: tokens of this kind of vocabulary never span white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))

    def __missing__(self, word: bytes) -> bytes:
        """A word that ends in ASCII marks after a letter is its stem's ids and the marks' ids; a plain word goes to the merge table at once, any other through the whole tokenizer."""
        stem = word.rstrip(_TAIL)
        if _PLAIN(word):
            got = array("I", [t.id for t in self.merge(word.decode("latin-1").translate(self.letters))]).tobytes()
        elif len(stem) < len(word) and stem and 0x61 <= stem[-1] <= 0x7A and b"<|" not in word:
            got = self[stem] + self[word[len(stem) :]]
        else:
            got = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        if len(self) < CACHE:
            self[word] = got
        return got

    def ids(self, text: bytes) -> bytes:
        """A text's ids. A-Z are lower-cased first, as the vocabulary's own rule does, unless the text may hold a special token."""
        special, out = b"<|" in text, []
        for k in slices(text):
            out.append(b"".join(map(self.__getitem__, (text[k] if special else text[k].lower()).split())))
        return b"".join(out)


def encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """`(row, doc_id, piece, start, length, ids_crc32)` of every document's ids and the end id, cut only where longer than `capacity`."""
    ready(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tail, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc = encoder(tokenizer)
        for batch in batches:
            for lo, hi, data, at in tx.text_blocks(batch):
                whole = data.tobytes()
                out: list[tuple] = []
                for k in range(hi - lo):
                    ids = enc.ids(whole[at[k] : at[k + 1]]) + tail
                    for p, s in enumerate(range(0, len(ids), width)):
                        part = ids[s : s + width]
                        out.append((k + lo, p, s // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                own, piece, start, length, crc, kept = zip(*out, strict=True)
                cols = [batch.column("doc_id").take(pa.array(own)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.binary())] if with_ids else cols, [*names, "ids"] if with_ids else names)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


class Gaps:
    """Open gaps by size; each size holds ranges of sequence numbers."""

    def __init__(self, capacity: int):
        self.by = [deque() for _ in range(capacity + 1)]
        self.count = np.zeros(capacity + 1, np.int64)

    def add(self, size: int, first: int, n: int) -> None:
        self.by[size].append((first, n))
        self.count[size] += n

    def take(self, size: int, n: int) -> Iterator[tuple[int, int]]:
        self.count[size] -= n
        while n:
            first, have = self.by[size].popleft()
            now = min(n, have)
            if now < have:
                self.by[size].appendleft((first + now, have - now))
            yield first, now
            n -= now


def rounds(counts: np.ndarray, capacity: int) -> pd.DataFrame:
    """Rows (length, first, n, sequence, place): documents of that length and of ranks first to first + n - 1 go to sequences from `sequence` on, at `place`.

    New sequences are opened with the largest documents left, as many as the tokens left need at least.
    """
    left, next_rank, out = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64), []
    gaps, opened, sizes = Gaps(capacity), 0, np.arange(capacity + 1)

    def put(size: int, n: int, first: int, place: int) -> None:
        out.append((size, int(next_rank[size]), n, first, place))
        next_rank[size] += n
        left[size] -= n
        if capacity > place + size:
            gaps.add(capacity - place - size, first, n)

    while left.any():
        need = max(1, -(-int((left * sizes).sum()) // capacity))
        for size in range(capacity, 0, -1):
            n = int(min(need, left[size]))
            if n:
                put(size, n, opened, 0)
                opened, need = opened + n, need - n
            if not need:
                break
        while left.any():
            # the sweep, upwards: documents wait on a stack; each gap takes from its top, the largest that fit
            waiting: list[list[int]] = []
            matched: list[tuple[int, int, int]] = []
            for size in np.flatnonzero(left + gaps.count):
                if left[size]:
                    waiting.append([int(size), int(left[size])])
                free = int(gaps.count[size])
                while free and waiting:
                    n = min(free, waiting[-1][1])
                    matched.append((int(size), waiting[-1][0], n))
                    free -= n
                    waiting[-1][1] -= n
                    if not waiting[-1][1]:
                        waiting.pop()
            if not matched:
                break
            taken = [(gap, doc, list(gaps.take(gap, n))) for gap, doc, n in matched]
            for gap, doc, ranges in taken:
                for first, n in ranges:
                    put(doc, n, first, capacity - gap)
    return pd.DataFrame(out, columns=["length", "first", "n", "sequence", "place"])


def pack(cut_pieces: DataFrame, capacity: int = 4096, at_once: int = 1000) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces of at most `capacity` tokens.

    Ranks within a length are counted over parts of about `at_once` pieces, as many as the length's count asks for, so
    one very common length is no single task. Only the histogram of lengths passes the driver, and the plan made of it;
    the capacity bounds both, whatever the input, so the plan is broadcast.
    """
    spark = cut_pieces.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r["length"]] = r["n"]
    plan = spark.createDataFrame(rounds(counts, capacity), "length long, first long, n long, sequence long, place long")
    parts = spark.createDataFrame([(k, int(-(-counts[k] // at_once))) for k in np.flatnonzero(counts).tolist()], "length long, salts long")
    steps = F.broadcast(plan.groupBy("length").agg(F.collect_list(F.struct("first", "n", "sequence", "place")).alias("steps")))
    p = cut_pieces.join(F.broadcast(parts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts")).drop("salts")
    per = p.groupBy("length", "salt").agg(F.count("*").alias("n"))
    so_far = W.Window.partitionBy("length").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = per.select("length", "salt", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"))
    w = W.Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = p.withColumn("rank", F.row_number().over(w)).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("base"))
    own = F.filter("steps", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["first"] + s["n"]))[0]
    placed = ranked.join(steps, "length").withColumn("own", own)
    return placed.withColumn("sequence_id", F.col("own.sequence") + F.col("rank") - F.col("own.first")).withColumn("offset", F.col("own.place")).drop("salt", "rank", "base", "steps", "own")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: `doc_id, piece, start, length, ids_crc32, sequence_id, offset`.

    Null and empty texts are one piece that holds the end id alone. Texts longer than the capacity are cut into full
    pieces and a rest. Repeated rows are packed each; a null id is packed too. An empty table gives an empty result.
    Sequences have no gaps before their last token. Other columns are not read.
    """
    return pack(cut(pieces(docs, tokenizer, capacity, end_id, id, text)), capacity)
