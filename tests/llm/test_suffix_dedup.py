"""Suffix-array dedup where ids repeat, text is periodic or very long, and one anchor has thousands of stretches."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm import suffix_dedup, text

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length=200):
    places = {}
    for k, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            places.setdefault(b[p : p + length], []).append((k, p))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for k, p in at:
                gone[k].update(range(p, p + length))
    out = []
    for (i, t), g in zip(rows, gone):
        b = (t or "").encode()
        out.append((i, len(b), len(g), sum(p - 1 not in g for p in g), hashlib.sha256(bytes(c for p, c in enumerate(b) if p not in g)).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("h", "id_", "h_", "s", "key", "anchor", "start")})
    return sorted((tuple(r[c] for c in COLUMNS) for r in suffix_dedup.repeated_bytes(df, **more).collect()), key=repr)


def noise(rng, n, letters="abcdef "):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.mark.parametrize("shard", [1 << 20, 500])
def test_repeated_and_null_ids_of_different_texts(spark, shard):
    rng = random.Random(1)
    t = noise(rng, 600)
    rows = [(1, "short"), (1, t), (2, t[50:550]), (None, t[100:350]), (None, "zz"), (None, None), (3, ""), (7, t[:100] * 4), (7, t[:100] * 4), (7, noise(rng, 400)), (8, "x" * 1000), (9, "y" * 300 + "x" * 250), (10, "ab" * 300), (10, "é" * 150)]
    rows += [(20 + i, noise(rng, 40) + t[i * 7 : i * 7 + 260] + noise(rng, 40)) for i in range(30)]
    assert found(spark, rows, shard_bytes=shard) == brute(rows)


@pytest.mark.parametrize("shard", [1 << 20, 60_000, 5000])
def test_an_anchor_in_thousands_of_stretches(spark, shard):
    """5000 different texts share 100 bytes in their middle; some parts of them come again elsewhere."""
    rng = random.Random(2)
    mid = noise(rng, 100, "ABCDEFGH")
    rows = [(i, noise(rng, 110, "abcd") + mid + noise(rng, 110, "efgh")) for i in range(5000)]
    rows += [(10_000 + i, rows[i][1][rng.randrange(60) :][: rng.randrange(210, 260)]) for i in range(200)]
    assert found(spark, rows, shard_bytes=shard) == brute(rows)


def test_very_long_texts(spark):
    """A megabyte of one byte, of a short period, and 3 MB of noise that repeats a passage far apart: searched in slices."""
    rng = np.random.default_rng(3)
    deep = bytes(rng.integers(97, 123, 3_000_000, dtype=np.uint8)).decode()
    assert len(deep) > 2 * text.BLOCK
    at = text.BLOCK
    texts = ["z" * 1_200_000, "0123456789" * 120_000 + "tail", deep[: 2 * at - 100] + deep[5000:5400] + deep[2 * at - 100 :], "q" * 150 + deep[at - 150 : at + 150]]
    got = {r[0]: r[1:4] for r in found(spark, list(enumerate(texts)))}
    assert got[0] == (1_200_000, 1_200_000, 1)
    assert got[1] == (1_200_004, 1_200_000, 1)
    assert got[2] == (3_000_400, 400 + 400 + 300, 3)
    assert got[3] == (450, 300, 1)


def test_stretches_of_one_byte_are_few():
    data = np.full(100_000, 97, np.uint8)
    kept, local = suffix_dedup.stretches(data, np.array([0, 60_000, 100_000]), 200)
    assert kept[2].tolist() == [1, 1] and local[2].tolist() == [59_801, 39_801]


def test_every_window_is_in_one_stretch_and_sub_stretch():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 101, 5000, dtype=np.uint8)
    at = np.array([0, 100, 2000, 5000])
    (doc, start, count, off, anchor, whole), local = suffix_dedup.stretches(data, at, 200)
    assert not len(local[0])
    first = start + at[doc]
    every = sorted(p for a, n in zip(first, count) for p in range(a, a + n))
    assert every == [p for a, b in ((0, 100), (100, 2000), (2000, 5000)) for p in range(a, b - 199)]
    k, start, n, key, whole = suffix_dedup.sub_stretches(data, first, count, off, 200)
    assert sorted(p for a, m in zip(start, n) for p in range(a, a + m)) == every


def test_merging_by_binary_search():
    rng = np.random.default_rng(5)
    parts = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (80, 0, 150, 40, 90)]
    all_, count = np.unique(np.concatenate(parts), return_counts=True)
    often = set(all_[count > 1].tolist())
    assert [m.tolist() for m in suffix_dedup.merged(parts)] == [[x in often for x in p.tolist()] for p in parts]
    assert suffix_dedup.merged([]) == []
