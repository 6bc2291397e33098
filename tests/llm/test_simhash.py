"""SimHash classes against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assetloom.llm import simhash
from assetloom.llm.simhash import hamming_components, linked, simhash_dedup, vantage_shards

DOCS = "doc_id long, text string"


def plain_print(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def plain_components(points, radius):
    """The least of each fingerprint's component, by all pairs."""
    points = sorted(points)
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in points}


def plain_classes(rows, radius=2):
    fp = [plain_print(t) for _, t in rows]
    comp = plain_components(set(fp), radius)
    least = {}
    for (i, _), f in zip(rows, fp, strict=True):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    return sorted(((i, f"{f:016x}", least.get(comp[f])) for (i, _), f in zip(rows, fp, strict=True)), key=repr)


def corpus(seed, n=220):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)] + ["The", "AND", "Öl", "x-y,"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 30, 200, 400]))) for _ in range(n // 2)]
    while len(texts) < n:
        t = rng.choice(texts).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        texts.append(rng.choice([" ", "  ", "\n"]).join(t))
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [None, 12])
def test_classes_equal_brute_force(spark, size):
    rows = corpus(3)
    got = simhash_dedup(spark.createDataFrame(rows, DOCS), size=size).collect()
    want = plain_classes(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})  # links, not only equal fingerprints


def test_odd_rows(spark):
    """Nulls in any column, texts without words, repeated rows and ids, ids that are null, clashing columns; an empty table."""
    far = "some words of another text that nothing else in here is near to at all"
    rows = [(5, None), (4, ""), (9, " \t\n"), (1, "A  b\tc"), (2, "a b c"), (3, "a b"), (3, "a b"), (3, far), (None, far), (None, "alone by itself in here"), (None, None), (7, "\x00\x01"), (8, "é Ü")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("fp", "shard", "least", "component", "v", "m", "n", "d", "t__")})
    got = sorted(map(tuple, simhash_dedup(df).collect()), key=repr)
    assert got == plain_classes(rows)
    by = {(i, f): c for i, f, c in got}
    assert by[(5, "0" * 16)] == by[(None, "0" * 16)] == 4 and {c for i, f, c in got if i is None} == {4, 3, None}
    assert simhash_dedup(df.where("false")).collect() == []


def clustered(seed, n, around, flips):
    rng = random.Random(seed)
    points = {rng.getrandbits(64) for _ in range(n)}
    for c in [rng.getrandbits(64) for _ in range(around)]:
        for _ in range(n // max(around, 1)):
            x = c
            for b in rng.sample(range(64), rng.randrange(flips + 1)):
                x ^= 1 << b
            points.add(x)
    return points


@pytest.mark.parametrize(("around", "flips", "radius"), [(0, 0, 2), (3, 4, 2), (1, 9, 2), (20, 3, 3), (1, 2, 2), (1, 3, 2), (1, 3, 1), (2, 6, 1)])
def test_linked_equals_all_pairs(monkeypatch, around, flips, radius):
    monkeypatch.setattr(simhash, "LEAF", 8)
    points = clustered(around + flips, 500, around, flips)
    x = np.array(sorted(points), np.uint64)
    first = linked(x, radius)
    named = {}
    for p, r in zip(x.tolist(), first.tolist(), strict=True):
        named[p] = named.setdefault(("r", r), p)  # in order: the first of a component is its least
    assert {p: named[p] for p in points} == plain_components(points, radius)


def test_midpoints_in_several_passes():
    points = clustered(9, 300, 2, 4)
    x = np.array(sorted(points), np.uint64)
    some = np.repeat(np.arange(len(x)), 1)
    a, b = np.arange(len(x)), np.arange(len(x))
    simhash._by_midpoints(a, some, x, 2)
    many = np.concatenate([x, np.unique(np.random.default_rng(1).integers(1, 1 << 63, 140_000).astype(np.uint64))])
    b = np.arange(len(many))
    simhash._by_midpoints(b, np.arange(len(many)), many, 2)  # 65 keys each: three passes
    assert np.array_equal(simhash._find(a, some), simhash._find(b, np.arange(len(many)))[: len(x)])


@pytest.mark.parametrize(("around", "flips", "sample"), [(0, 0, 1 << 17), (2, 5, 64)])
def test_shards_hold_every_close_pair_together(spark, monkeypatch, around, flips, sample):
    """By the driver's tree alone, and by rounds over what a small sample leaves too large."""
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    points = sorted(clustered(7, 400, around, flips))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    rows = vantage_shards(fps, 2, 40).collect()
    shards, together = {}, set()
    for r in rows:
        shards.setdefault(r["shard"], []).append(r["fp"] % (1 << 64))
    assert len(rows) == len(set(rows)) and len(shards) > 8 and len(rows) < 10 * len(points)
    if not around:
        assert max(map(len, shards.values())) <= 40
    for s in shards.values():
        together |= {(a, b) for a in s for b in s if a < b and (a ^ b).bit_count() <= 2}
    assert together == {(a, b) for i, a in enumerate(points) for b in points[i + 1 :] if (a ^ b).bit_count() <= 2}
    got = {r["fp"] % (1 << 64): r["component"] for r in hamming_components(fps, 2, 40).collect()}
    want = {}
    for p, c in plain_components(points, 2).items():
        want.setdefault(c, []).append(p)
    parts = {}
    for p, c in got.items():
        parts.setdefault(c, []).append(p)
    assert sorted(sorted(v) for v in parts.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_dense_groups_take_few_comparisons(monkeypatch):
    """Near copies in a ball: twice the points, about twice the distances, not four times."""
    seen = [0]
    real = np.bitwise_count

    def counted(x):
        seen[0] += x.size
        return real(x)

    monkeypatch.setattr(np, "bitwise_count", counted)
    work = []
    for n in (4000, 8000, 16000):
        rng = np.random.default_rng(5)
        bits = np.uint64(1) << rng.integers(0, 64, (n, 3)).astype(np.uint64)
        x = np.unique(np.uint64(0x5A5A5A5A5A5A5A5A) ^ bits[:, 0] ^ bits[:, 1] ^ bits[:, 2])
        seen[0] = 0
        assert len(np.unique(linked(x, 2))) == 1
        work.append(seen[0] / len(x))
    assert work[2] < 1.6 * work[0] and work[2] < 500, work


def test_very_long_texts(spark):
    df = spark.sql("select 1L as doc_id, repeat(array_join(transform(sequence(0, 9999), x -> concat('w', x)), ' ') || ' ', 1100) as text union all select 2L, concat(repeat('x', 16000000), ' tail') union all select id, concat('short text ', id) from range(4, 9)")
    out = {r["doc_id"]: r for r in simhash_dedup(df).collect()}
    assert set(out) == {1, 2, 4, 5, 6, 7, 8}
    assert out[2]["fingerprint"] == f"{plain_print('x' * 16_000_000 + ' tail'):016x}"


def test_slices_of_a_text_give_the_same_hashes(monkeypatch):
    text = " ".join(f"Wörd{i}" for i in range(3000)).encode()
    whole = np.concatenate(list(simhash.shingle_hashes(text)))
    monkeypatch.setattr(simhash, "SLICE", 50)
    assert np.array_equal(whole, np.concatenate(list(simhash.shingle_hashes(text)))) and len(whole) == 2998
