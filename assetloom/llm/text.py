"""Numpy kernels over whole batches of UTF-8 texts: bytes, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a kernel works on at once, and whose word hashes are made at once. One longer text comes in slices, or, where
#: its words are numbered, whole: then with about 20 bytes of memory for each of its bytes.
BLOCK, HASHED = 1 << 19, 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, after A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_M = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each starts (one more entry than texts). Null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def blocks(at: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about `most` bytes together, one text at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def text_blocks(batch: pa.RecordBatch, text: str = "text", most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, starts) of the blocks of a batch."""
    data, at = raw(batch.column(text))
    for lo, hi in blocks(at, most):
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]


def text_slices(batch: pa.RecordBatch, overlap: int, text: str = "text", most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, first places in them, bytes, starts) of the blocks of a batch. A text longer than two blocks comes alone, in slices that share `overlap` bytes."""
    data, at = raw(batch.column(text))
    most = most or BLOCK
    for lo, hi in blocks(at, most):
        size = at[hi] - at[lo]
        if size <= 2 * most:
            yield np.arange(lo, hi), np.zeros(hi - lo, np.int64), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            continue
        for s in range(0, max(size - overlap, 1), most):
            e = min(size, s + most + overlap)
            yield np.array([lo]), np.array([s]), data[at[lo] + s : at[lo] + e], np.array([0, e - s])


def words(data: np.ndarray, at: np.ndarray, inside_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of `inside_of` bytes; runs end with their text."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = inside_of[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < n]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, of about `HASHED` bytes at a time."""
    size = end - start
    out, upto, lo = np.zeros(len(size), np.uint64), np.cumsum(size), 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - size[lo] + HASHED, "right")))
        out[lo:hi] = _polynomials(data, start[lo:hi], size[lo:hi])
        lo = hi
    return mix(out + size.astype(np.uint64) * _M)


def _polynomials(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    if len(size) == 1 and size[0] > HASHED:  # one very long run, in parts
        total, power, step = np.zeros(1, np.uint64), np.ones(1, np.uint64), np.array([pow(int(_M), HASHED, 1 << 64)], np.uint64)
        for s in range(0, int(size[0]), HASHED):
            part = _RANDOM[data[start[0] + s : start[0] + min(s + HASHED, size[0])]]
            total += power * (part * np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(part) - 1, _M, np.uint64)]))).sum()
            power *= step
        return total
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(size.max()) - 1, _M, np.uint64)]))
    return np.add.reduceat(_RANDOM[data[place + np.repeat(start, size)]] * powers[place], first)


def word_hashes(data: np.ndarray, at: np.ndarray, inside_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, text number) of each word of texts whose A-Z are lower-cased here."""
    data = LOWER[data]
    start, end, doc = words(data, at, inside_of)
    return run_hashes(data, start, end), start, end, doc


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive entries; texts are not told apart here."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, powers = np.zeros(n, np.uint64), np.multiply.accumulate(np.full(k, _M, np.uint64))
    for i in range(k):
        out += hashes[i : i + n] * powers[i : i + 1]
    return mix(out + np.uint64(k))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by its long `keys`, one at a time."""
    held: list[pa.Table] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        new = np.zeros(t.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), t.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(c[lo] for c in cols)
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            last = key
            held.append(t.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)
