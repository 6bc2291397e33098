"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of about `FRAME` bytes that end between code points, with the number of
units (code points) before each frame. A place in the text is then found by the cumulative counts: only the frames that
hold a cut are decompressed to select there, and everything else is streamed frame by frame. The rearranged text is made
as frames of the same kind, and the original is rebuilt from those.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.llm import text as tx
from assetloom.session import cut, ready

#: Bytes of a frame before compression, and of frames that one output batch holds.
FRAME, BATCH = 1 << 16, 1 << 23
#: What marks the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
LEVEL = 3


def _heads(data: np.ndarray) -> np.ndarray:
    """Whether each byte begins a code point."""
    return (data & 0xC0) != 0x80


class FrameWriter:
    """Makes frames from pieces of UTF-8 that may end inside a code point."""

    def __init__(self, size: int):
        self.size, self.held, self.starts, self.frames, self.n = size, bytearray(), [], [], 0
        self._zip = zstandard.ZstdCompressor(level=LEVEL)

    def write(self, piece: bytes) -> None:
        for at in range(0, len(piece), self.size):
            self.held += piece[at : at + self.size]
            while len(self.held) > self.size:
                end = self.size
                while end > 1 and self.held[end] & 0xC0 == 0x80:
                    end -= 1
                self._frame(end)

    def _frame(self, end: int) -> None:
        raw = bytes(self.held[:end])
        del self.held[:end]
        self.starts.append(self.n)
        self.frames.append(self._zip.compress(raw))
        self.n += int(np.count_nonzero(_heads(np.frombuffer(raw, np.uint8))))

    def close(self) -> tuple[list[int], list[bytes], int]:
        """Units before each frame, the frames, and all units."""
        if self.held:
            self._frame(len(self.held))
        return self.starts, self.frames, self.n


class FrameReader:
    """Places and ranges of a text in frames. One decompressed frame is held at a time."""

    def __init__(self, starts: list[int], frames: list[bytes], n: int):
        self.starts, self.frames, self.n = np.asarray(starts, np.int64), frames, n
        self._zip, self._at, self._raw, self.opened = zstandard.ZstdDecompressor(), -1, b"", 0

    def frame(self, i: int) -> bytes:
        if i != self._at:
            self._at, self._raw = i, self._zip.decompress(self.frames[i])
            self.opened += 1
        return self._raw

    def place(self, unit: int) -> tuple[int, int]:
        """(frame, byte in it) where a unit begins; the end of the text for the number of all units."""
        if unit >= self.n:
            return len(self.frames), 0
        i = int(np.searchsorted(self.starts, unit, "right")) - 1
        if unit == self.starts[i]:
            return i, 0
        heads = np.flatnonzero(_heads(np.frombuffer(self.frame(i), np.uint8)))
        return i, int(heads[unit - self.starts[i]])

    def stream(self, lo: tuple[int, int], hi: tuple[int, int]) -> Iterator[bytes]:
        """The bytes between two places, a frame at a time."""
        for i in range(lo[0], min(hi[0] + 1, len(self.frames))):
            a, b = (lo[1] if i == lo[0] else 0), (hi[1] if i == hi[0] else None)
            if b is None or b > a:
                yield self.frame(i)[a:b]

    def find(self, mark: bytes, start: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Where the first `mark` from `start` on begins and ends; it may lie across frames."""
        tail, places = b"", []  # the last bytes seen and where each is
        for i in range(start[0], len(self.frames)):
            a = start[1] if i == start[0] else 0
            part = self.frame(i)[a:]
            k = (tail + part).find(mark)
            if k >= 0:
                at = lambda j, i=i, a=a, tail=tail, places=places: places[j] if j < len(tail) else (i, a + j - len(tail))
                return at(k), at(k + len(mark))
            keep = len(mark) - 1
            places = [*places, *((i, a + j) for j in range(max(0, len(part) - keep), len(part)))][-keep:]
            tail = (tail + part)[-keep:]
        raise ValueError("the text has no such mark")


def order(form: str) -> tuple[str, str, str]:
    """The parts in the order of a form's output: prefix, suffix, middle for psm; suffix, prefix, middle for spm."""
    return ("prefix", "suffix", "middle") if form == "psm" else ("suffix", "prefix", "middle")


_MARK = dict(zip(("prefix", "suffix", "middle"), (m.encode() for m in MARKS), strict=True))


def rearranged(text: FrameReader, form: str, lo: int, hi: int) -> Iterator[bytes]:
    """The output of a text cut before units `lo` and `hi`, in pieces."""
    begin, end = (0, 0), (len(text.frames), 0)
    if form == "plain":
        yield from text.stream(begin, end)
        return
    a, b = text.place(lo), text.place(hi)
    ranges = {"prefix": (begin, a), "middle": (a, b), "suffix": (b, end)}
    for part in order(form):
        yield _MARK[part]
        yield from text.stream(*ranges[part])


def rebuilt(output: FrameReader, form: str) -> Iterator[bytes]:
    """The original text, in pieces, from the output and its form alone. A text without marks in it gives an output whose marks are unambiguous."""
    end = (len(output.frames), 0)
    if form == "plain":
        yield from output.stream((0, 0), end)
        return
    ranges, at, last = {}, (0, 0), None
    for part in order(form):
        begins, ends = output.find(_MARK[part], at)
        if last:
            ranges[last] = (at, begins)
        at, last = ends, part
    ranges[last] = (at, end)
    for part in ("prefix", "middle", "suffix"):
        yield from output.stream(*ranges[part])


def _digested(pieces: Iterable[bytes], writer: FrameWriter | None = None) -> str:
    h = hashlib.sha256()
    for p in pieces:
        h.update(p)
        if writer:
            writer.write(p)
    return h.hexdigest()


def frame_store(docs: DataFrame, id: str = "doc_id", text: str = "text", also: tuple[str, ...] = (), frame: int | None = None) -> DataFrame:
    """`(doc_id, *also, n, starts, frames)`: each text as frames, with the units before each and the number of all.

    A text's frames stay in its row, as its digest needs them in order; no row is moved. Null counts as empty: no frames.
    Rows that repeat are stored each; other columns are not read, whatever their names; an empty table stays empty.
    """
    ready(docs.sparkSession)
    size = frame or FRAME
    rows = docs.select(F.col(id).alias("doc_id"), *(F.col(c) for c in also), F.col(text).alias("t__"))
    kept = ["doc_id", *also]
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    names = [*kept, "n", "starts", "frames"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = tx.raw(batch.column("t__"))
            lo, made, held = 0, [], 0
            for i in range(batch.num_rows):
                w = FrameWriter(size)
                for a in range(int(at[i]), int(at[i + 1]), size):
                    w.write(data[a : min(a + size, int(at[i + 1]))].tobytes())
                made.append(w.close())
                held += sum(map(len, made[-1][1]))
                if held >= BATCH or i + 1 == batch.num_rows:
                    cols = [batch.column(c).slice(lo, len(made)) for c in kept]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([m[2] for m in made], pa.int64()), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.binary()))], names)
                    lo, made, held = i + 1, [], 0

    return rows.mapInArrow(run, f"{kinds}, n bigint, starts array<bigint>, frames array<binary>")


def select_units(store: DataFrame, lo: Column, hi: Column, name: str = "selected") -> DataFrame:
    """`(doc_id, name)`: units `lo` to `hi` (not included) of each stored text. Only frames that hold some of them are decompressed. Bounds outside the text count as its ends; a null bound selects nothing: null."""
    ready(store.sparkSession)
    rows = store.select("doc_id", "n", "starts", "frames", lo.cast("long").alias("lo__"), hi.cast("long").alias("hi__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = (batch.column(c).to_pylist() for c in ("n", "lo__", "hi__"))
            for i in range(batch.num_rows):
                part = None
                if a[i] is not None and b[i] is not None:
                    r = FrameReader(batch.column("starts")[i].as_py(), batch.column("frames")[i].as_py(), n[i])
                    x, y = (min(max(v, 0), n[i]) for v in (a[i], b[i]))
                    part = b"".join(r.stream(r.place(x), r.place(y))).decode() if x < y else ""
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([part], pa.string())], ["doc_id", name])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, `{name}` string")


def decisions(store: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """Add `form`, `lo`, `hi` by the sha256 of `seed:` and the id: cuts from its first two 8-digit groups, the form from the next two. A null id has no digits."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = lambda k: F.conv(F.substring("h__", 8 * k - 7, 8), 16, 10).cast("long")
    a, b = part(1) % (F.col("n") + 1), part(2) % (F.col("n") + 1)
    form = F.when((F.col("n") == 0) | F.col("marked") | (part(3) % 100 >= plain_from), "plain").when(part(4) % 100 < spm_below, "spm").otherwise("psm")
    return store.withColumn("h__", h).withColumns({"form": form, "lo": F.least(a, b), "hi": F.greatest(a, b)}).drop("h__")


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", seed: str = "1", frame: int | None = None, output: bool = False) -> DataFrame:
    """Each document's text rearranged for filling in its middle.

    Returns per row: `doc_id`, `n` (code points), `form` (plain, psm, spm), `prefix_chars`, `middle_chars` (null if plain),
    `output_sha256`, `restored_sha256` (of the text rebuilt from output and form), and with `output` also `output_n`,
    `output_starts`, `output_frames`: the output itself as frames.

    Texts that are empty or hold a mark stay plain. Null counts as empty. Rows are taken each by itself, so repeated rows
    give the same twice, and rows that share an id are cut at the same hashes. A null id is hashed as no digits. Other
    columns are not read, whatever their names; an empty table gives an empty result. A text of any length is read and
    written a frame at a time; only its compressed frames are held.
    """
    ready(docs.sparkSession)
    has = lambda m: F.contains(F.coalesce(F.col(text), F.lit("")), F.lit(m))
    marked = has(MARKS[0]) | has(MARKS[1]) | has(MARKS[2])
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"), marked.alias("marked"))
    store = decisions(cut(frame_store(rows, also=("marked",), frame=frame)), seed)
    size = frame or FRAME
    kind = store.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", *(["output_n", "output_starts", "output_frames"] if output else [])]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, frames, starts = batch.column("doc_id"), batch.column("frames"), batch.column("starts")
            n, form, lo, hi = (batch.column(c).to_pylist() for c in ("n", "form", "lo", "hi"))
            first, made, held = 0, [], 0
            for i in range(batch.num_rows):
                w = FrameWriter(size)
                sent = _digested(rearranged(FrameReader(starts[i].as_py(), frames[i].as_py(), n[i]), form[i], lo[i], hi[i]), w)
                at, blobs, units = w.close()
                back = _digested(rebuilt(FrameReader(at, blobs, units), form[i]))
                plain = form[i] == "plain"
                made.append((n[i], form[i], None if plain else lo[i], None if plain else hi[i] - lo[i], sent, back, *((units, at, blobs) if output else ())))
                held += sum(map(len, blobs)) if output else 0
                if held >= BATCH or i + 1 == batch.num_rows:
                    cols = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=False)]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(made)), *cols], names)
                    first, made, held = i + 1, [], 0

    more = ", output_n bigint, output_starts array<bigint>, output_frames array<binary>" if output else ""
    asked = store.select("doc_id", "n", "form", "lo", "hi", "starts", "frames")
    return asked.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string{more}")
