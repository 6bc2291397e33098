"""The conversation trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from assetloom.llm import conversation_trie as ct

CONV = "conv_id long, turn long, role string, text string"


def plain_nodes(rows, mix=6, block=100):
    """Every prefix of every rebuilt conversation in one dictionary."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % mix
        seqs[c] = tuple(own.get(c - c % block, [])[:h] + turns[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(seqs[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items()), key=repr)


def talks(seed, n=120, long=12):
    rng = random.Random(seed)
    opening = [("user", "hello"), ("user", "Hello "), ("system", "be brief"), (None, None)]
    rows = []
    for c in rng.sample(range(400), n):
        turns = [rng.choice(opening)] + [(rng.choice(["user", "assistant"]), rng.choice("abcé")) for _ in range(rng.randrange(rng.choice([2, 4, long])))]
        rows += [(c, t * 3, *x) for t, x in enumerate(turns)]
    copy = [(t, "user", f"copied {t}") for t in range(7)]
    for c in (401, 402, 403, 450, 700, 999):
        rows += [(c, *x) for x in copy]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **more):
    df = rows if not isinstance(rows, list) else spark.createDataFrame(rows, CONV)
    return sorted(map(tuple, ct.conversation_trie(df, **more).collect()), key=repr)


@pytest.mark.parametrize(("segment", "parts"), [(None, None), (None, 13), (2, 3), (3, 1), (1, 7)])
def test_nodes_equal_a_plain_dictionary(spark, segment, parts):
    """Whole sequences and cut ones; one partition and many, so that nodes go on over borders."""
    rows = talks(5)
    assert run(spark, rows, segment=segment, parts=parts) == plain_nodes(rows)


def test_odd_rows(spark):
    """Nulls in any column, repeated rows, ties of a turn, no conversation, conversations left without turns, clashing columns; then an empty table."""
    rows = [(None, 1, "user", "no conversation"), (5, None, "b", "x"), (5, None, "a", "x"), (5, 1, None, None), (5, 1, "", ""), (5, 1, "user", "t"), (5, 1, "user", "t"), (-7, 1, "user", "t"), (-7, 2, "user", "long " * 50_000), (100, 0, "user", ""), (101, 0, "é", "ü")]
    rows += [(c, 0, "user", "one turn") for c in (205, 206, 207, 208, 209)]  # their base is absent: most lose their only turn
    df = spark.createDataFrame(rows, CONV).withColumns({c: F.lit("clash") for c in ("pos", "tok", "chars", "seg", "seq", "r1", "n", "d", "key", "part", "kind", "h", "base")})
    want = plain_nodes([(c, t, r, x) for c, t, r, x in rows])
    want_root = next(r for r in want if r[1] == 0)
    assert run(spark, df) == want and want_root[2] is None and want_root[7] != hashlib.sha256().hexdigest()
    assert run(spark, df, segment=1, parts=4) == want
    assert run(spark, df.where("false")) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


def test_one_conversation_with_most_turns(spark):
    """A long conversation and a copy of it that leaves it late, in segments over partitions; then the forest's sums without segments."""
    turns = [("user", f"t{i % 17} {i // 40}") for i in range(900)]
    rows = [(c, t, *x) for c in (300, 601) for t, x in enumerate(turns)] + [(601, 900, "user", "later")] + [(c, 0, "user", "short") for c in range(20)]
    want = plain_nodes(rows)
    assert run(spark, rows, segment=64, parts=6) == want == run(spark, rows)


def test_a_common_first_turn_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(ct, "IDS", 7)
    rows = [(c, t, "user", "hi" if t == 0 else f"{c % 50 if c % 3 else 'same'} {t}") for c in range(600) for t in range(3)]
    assert run(spark, rows, parts=9) == plain_nodes(rows)


def test_forest_of_neighbours():
    """Merges in descending depth give the branching nodes, whatever the order of equal depths."""
    tok = lambda s: b"".join(c.encode() * ct.TOKEN for c in s)
    seqs = sorted(map(tok, ["", "a", "ab", "abc", "abd", "abde", "b", "bcd", "bce"]))
    f = ct.Forest([0] * len(seqs), seqs, [1] * len(seqs), list(range(len(seqs))), -1, -1)
    named = {(f.depth[x], f.first[x], f.last[x]): (f.n[x], f.children[x]) for x in range(len(f.depth))}
    assert named[0, 0, 8] == (9, 2) and named[2, 2, 5] == (4, 2) and named[1, 6, 8] == (3, 1) and named[2, 7, 8] == (2, 2)
    assert len(f.depth) == 10  # one node that is no sequence's own: bc
    assert ct.common(tok("abc"), tok("abd")) == 2 and ct.common(tok("ab"), tok("abd")) == 2 and ct.common(b"", tok("a")) == 0
