"""The training-data operators against brute-force versions, and their odd cases."""

import bisect
import functools
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from assetloom.llm import line_dedup, ngram_join, packing, queries, suffix_dedup, toxicity, url_filters
from assetloom.llm.decontaminate import contamination
from assetloom.llm.exact_dedup import exact_dedup
from assetloom.llm.license_scan import TEMPLATES, align, scan_licenses
from assetloom.llm.quality import score_quality
from assetloom.session import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and odd texts, ties, repeated texts, a very long text, and columns with clashing names.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A  b\tc"), (6, "a b c"), (7, "the MIT  License"), (8, "é Ü … ﬁ"), (9, "x" * 70_000),
    (10, "word " * 30_000), (11, "a b c"), (12, "\x00\x01 b"), (13, "Licensed under the Apache License, Version 2.0."), (14, "a b c d e f g h i j k l m n o p q"),
    (15, "a b c d e f g h i j k l m n o p q r"), (None, "a b c"), (None, None),
]
CLASH = ["token", "k1", "node", "size", "keep_id", "score", "anchor", "count", "n", "row", "salt", "rank", "items", "s", "t", "y"]


def docs_of(spark, rows, clash=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("clash") for c in CLASH})
    return df


def collect(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def small_corpus(seed=3, n=160):
    """Random texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["The", "AND", "ö", "x-y,"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 20, 60, 150]))) for _ in range(n // 2)]
    passage = " ".join(rng.choice(vocab) for _ in range(70))
    while len(texts) < n:
        t = rng.choice(texts).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            t[rng.randrange(len(t))] = rng.choice(vocab)
        if rng.random() < 0.3:
            at = rng.randrange(len(t) + 1)
            t[at:at] = passage.split()
        texts.append(("  " if rng.random() < 0.3 else " ").join(t))
    return list(enumerate(texts))


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return sorted(((i, len(sets[i]), find(i)) for i in ids), key=repr)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 100)])
def test_jaccard_components_equal_brute_force(spark, k, percent):
    rows = small_corpus()
    got = ngram_join.jaccard_components(docs_of(spark, rows), words=k, percent=percent)
    assert collect(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, k, percent)


def test_jaccard_components_in_blocks(spark, monkeypatch):
    """Groups larger than a task's share are dealt out and still lose no link."""
    monkeypatch.setattr(ngram_join, "GROUP_SETS", 4)
    rows = small_corpus(seed=8)
    got = ngram_join.jaccard_components(docs_of(spark, rows), words=3, percent=80)
    assert collect(got, "doc_id", "n_shingles", "component_id") == brute_components(rows, 3, 80)


def test_jaccard_components_of_repeated_ids(spark):
    """Rows of one id are one document: it has the links of all its texts, empty ones among them."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3 + x for x in ("one", "two", "three"))
    far = "other words that nobody else has in this table of texts at all"
    rows = [(5, a), (5, ""), (5, None), (7, b), (7, far), (3, f"{far} x"), (9, c), (9, "  "), (11, far + " y"), (12, ""), (12, "")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs_of(spark, rows), words=3, percent=60).where("n_shingles > 0").collect()}
    assert got == {5: 3, 7: 3, 3: 3, 9: 3, 11: 3}


def test_signature_tree_rules_out_no_link():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(120)]
    sets += [np.unique(np.concatenate([s[: len(s) - int(rng.integers(0, 9))], rng.integers(0, 1 << 63, int(rng.integers(0, 5))).astype(np.uint64)])) for s in sets]
    size = np.array([len(s) for s in sets])
    maps = ngram_join.folded(ngram_join.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])))
    seen = {(int(i), int(j)) for x, y in ngram_join.SignatureTree(maps, size).pairs(80) for i, j in zip(x, y)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 180 * len(np.intersect1d(sets[i], sets[j])) >= 80 * (len(sets[i]) + len(sets[j]))}
    assert want <= seen
    assert len(seen) < len(sets) ** 2 / 8


def brute_removed(rows, length):
    places = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            places.setdefault(b[p : p + length], []).append((i, p))
    gone = {i: set() for i, _ in rows}
    for at in places.values():
        if len(at) > 1:
            for i, p in at:
                gone[i].update(range(p, p + length))
    out = []
    for i, t in rows:
        b, g = (t or "").encode(), gone[i]
        out.append((i, len(b), len(g), sum(p - 1 not in g for p in g), hashlib.sha256(bytes(c for p, c in enumerate(b) if p not in g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1 << 20, 2000])
def test_repeated_bytes_equal_brute_force(spark, shard):
    """Also with shards so small that anchors are spread and merged."""
    rng = random.Random(4)
    base = "".join(rng.choice("abcé \n") for _ in range(1500))
    rows = [(i, t) for i, t in small_corpus(seed=5, n=80)]
    for i in range(60):
        a = rng.randrange(1200)
        rows.append((1000 + i, "".join(rng.choice("abc ") for _ in range(rng.randrange(150))) + base[a : a + rng.randrange(400)] + "".join(rng.choice("xyz ") for _ in range(rng.randrange(90)))))
    rows += [(2000, "ab" * 300), (2001, "a" * 199), (2002, "q" * 201), (2003, None), (2004, "")]
    rows += [(3000 + i, f"{i} " + base[:230] + f" {i * 7}") for i in range(40)]
    got = suffix_dedup.repeated_bytes(docs_of(spark, rows), shard_bytes=shard)
    assert collect(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows, 200)


def test_suffix_array_and_prefixes():
    rng = random.Random(2)
    for _ in range(60):
        s = np.array([rng.randint(0, 2) for _ in range(rng.randint(1, 120))], np.int64)
        t = s.tolist()
        order = suffix_dedup.suffix_array(s)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        for k, got in enumerate(suffix_dedup.common_prefixes(s, order), 1):
            a, b = t[order[k] :], t[order[k - 1] :]
            assert got == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_packing_is_whole_and_tight(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    rows = [r for r in ODD if r[0] is not None] + [(100 + i, t) for i, t in small_corpus(n=60)] + [(999, "zig zag " * 6000), (998, "don't <|endoftext|> X.")]
    out = packing.pack_documents(docs_of(spark, rows), path).collect()
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((i, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(w[3] for w in want) // 4096) + 1


def test_packing_rounds_place_each_rank_once():
    rng = np.random.default_rng(0)
    counts = np.zeros(101, np.int64)
    counts[1:] = rng.integers(0, 50, 100)
    plan = packing.rounds(counts, 100)
    for size in range(1, 101):
        ranks = [r for f, n in plan[plan["length"] == size][["first", "n"]].to_numpy() for r in range(f, f + n)]
        assert sorted(ranks) == list(range(counts[size]))
    total = (counts * np.arange(101)).sum()
    assert plan["sequence"].max() + 1 <= 1.1 * total / 100 + 2  # sequential best-fit decreasing needs 1390 here


def sequential_best_fit(sizes, capacity):
    """Sequences that plain best-fit decreasing opens: each document to the fullest sequence that it fits in."""
    room = []
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(room, size)
        left = (room.pop(at) if at < len(room) else capacity) - size
        bisect.insort(room, left)
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_packing_rounds_need_no_more_than_sequential_best_fit(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([20, 100, 500]))
    sizes = np.clip(rng.lognormal(np.log(capacity / 6), 1.0, 3000).astype(int), 1, capacity)
    counts = np.bincount(sizes, minlength=capacity + 1)
    plan = packing.rounds(counts, capacity)
    assert plan["n"].sum() == len(sizes)
    assert plan["sequence"].add(plan["n"]).max() <= sequential_best_fit(sizes.tolist(), capacity) * 1.002 + 1


def test_packing_of_one_common_length_in_parts(spark):
    """Ranks over several parts of one length: every piece gets a place of its own."""
    rows = [(i % 50, 0, 0, 7, i) for i in range(3000)] + [(i, 0, 0, 5 + i % 3, i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(df, 100, at_once=100).collect()
    assert len(out) == len(rows) and len({(r["sequence_id"], r["offset"]) for r in out}) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 100


def test_contamination_equals_brute_force(spark):
    rows = small_corpus(seed=11, n=80)
    items = [(f"i{k}", " ".join(t.split()[3:30])) for k, (_, t) in enumerate(rows[:8])] + [("short", "w1 w2"), ("none", "..."), ("null", None), ("i0", "w5")]
    bench = spark.createDataFrame(items, "item_id string, text string")

    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    want = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            b = words(text)
            m = min(13, len(b))
            for j in range(len(b) - m + 1 if m else 0):
                for p in range(len(w) - m + 1):
                    if w[p : p + m] == b[j : j + m]:
                        hit.update(range(p, p + m))
                        found.add(item)
        want.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    for at_once in (1 << 23, 200):
        got = contamination(docs_of(spark, rows), bench, chars_at_once=at_once)
        assert collect(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(want, key=repr)


def test_exact_dedup_equals_brute_force(spark):
    rows = [r for r in ODD if r[0] is not None]
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    want = [(i, min(j for j in norm if norm[j] == x), sum(y == x for y in norm.values()), hashlib.sha256(x.encode()).hexdigest()) for i, x in norm.items()]
    assert collect(exact_dedup(docs_of(spark, rows), digest=True), "doc_id", "keep_id", "group_size", "text_sha256") == sorted(want, key=repr)


def test_patience_alignment():
    assert align([1, 2, 3, 4], [9, 1, 2, 8, 4]) == [(0, 1), (1, 2), (3, 4)]
    assert align([1, 1, 2, 1, 3], [1, 1, 2, 1, 3]) == [(i, i) for i in range(5)]
    assert align([], [1]) == []


@functools.cache
def recursive_patience(a, b):
    """Least and most words that patience alignment by plain recursion may align: equal ends are taken, then any longest rising run of the words unique in both, then the gaps."""
    if not a or not b:
        return 0, 0
    for x, y in ((a[0] == b[0], (a[1:], b[1:])), (a[-1] == b[-1], (a[:-1], b[:-1]))):
        if x:
            lo, hi = recursive_patience(*y)
            return lo + 1, hi + 1
    anchors = [(-1, -1), *((i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1), (len(a), len(b))]
    best = [(0, 0, 0)]  # run length, least and most aligned before this anchor, it included
    for k, (i, j) in enumerate(anchors[1:], 1):
        longest = max(best[m][0] for m in range(k) if anchors[m][1] < j)
        ways = [(best[m], recursive_patience(a[anchors[m][0] + 1 : i], b[anchors[m][1] + 1 : j]) if longest or k < len(anchors) - 1 else (0, 0)) for m in range(k) if anchors[m][1] < j and best[m][0] == longest]
        best.append((longest + 1, min(x[1] + g[0] for x, g in ways) + 1, max(x[2] + g[1] for x, g in ways) + 1))
    return (best[-1][1] - 1, best[-1][2] - 1) if best[-1][0] > 1 else (0, 0)


def test_alignment_equals_a_recursive_one():
    rng = random.Random(14)
    some = 0
    for _ in range(150):
        a = [rng.randrange(30) for _ in range(rng.randrange(1, 30))]
        b = [w if rng.random() < 0.85 else rng.randrange(30) for w in a if rng.random() < 0.9]
        at = rng.randrange(len(b) + 1)
        b[at:at] = [rng.randrange(40) for _ in range(rng.randrange(6))]
        got = align(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        lo, hi = recursive_patience(tuple(a), tuple(b))
        assert lo <= len(got) <= hi
        some += lo == hi and lo > 3
    assert some > 50


def test_whole_license_texts_are_told_apart(spark):
    """Each template inside other text: its own licence comes first, and none that is but a part of it is listed. With a tenth of its words changed it is found, and comes first if it is a whole text (of a notice, the words that tell it apart may be gone)."""
    rng = random.Random(15)
    rows, want = [], []
    for name, t in [(n, max(ts, key=len)) for n, ts in sorted(TEMPLATES.items())]:
        w = t.split()
        for k in rng.sample(range(len(w)), len(w) // 10):
            w[k] = f"changed{k}"
        rows.append((len(rows), f"before {'x ' * 30} {' '.join(w)} after {'y ' * 30}"))
        want.append(name)
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in scan_licenses(docs_of(spark, rows)).collect()}
    assert all(n in got[i] for i, n in enumerate(want))
    assert all(got[i][0] == n for i, n in enumerate(want) if len(max(TEMPLATES[n], key=len).split()) > 60)
    exact = [(i, f"before {max(ts, key=len)} after") for i, (_, ts) in enumerate(sorted(TEMPLATES.items()))]
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in scan_licenses(docs_of(spark, exact)).collect()}
    assert [got[i][0] for i in range(len(exact))] == want
    assert got[want.index("BSD-3-Clause")] == ["BSD-3-Clause"] and got[want.index("AGPL-3.0")] == ["AGPL-3.0"] and got[want.index("CC-BY-NC-SA-4.0")] == ["CC-BY-NC-SA-4.0"]


def test_license_scan_finds_templates(spark):
    long_tail = "alpha beta gamma " * 5000
    rows = [(1, f"{long_tail}\nReleased under the MIT License.\n{long_tail}"), (2, "MIT is under the sea; released, a license."), (3, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."), (4, "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"), (5, None)]
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in scan_licenses(docs_of(spark, rows)).collect()}
    assert got[1] == ["MIT"] and "CC-BY-NC-4.0" in got[3] and got[4][0] == "GPL-3.0" and got[5] == []
    assert "MIT" not in got[2]


@pytest.mark.parametrize("between", ["", "and", "* \n"])
@pytest.mark.parametrize("copies", [1, 2, 5])
def test_license_scan_finds_repeated_notices_inside_text(spark, between, copies):
    known = [(n, t) for n, ts in sorted(TEMPLATES.items()) for t in ts]
    rows = [(i, f"some text x {f' {between} '.join([f'{t}.'] * copies)} y and more text") for i, (_, t) in enumerate(known)]
    got = {r["doc_id"]: {x["license"]: x["coverage"] for x in r["licenses"]} for r in scan_licenses(docs_of(spark, rows)).collect()}
    assert [got[i].get(n) for i, (n, _) in enumerate(known)] == [1.0] * len(known)


def test_line_dedup_is_relative_to_the_host(spark):
    pages = [(i, f"http://a.org/{i}", f"<nav>Menu</nav><p>text {i}</p><style>p{{}}</style>") for i in range(8)] + [(100, "http://b.org/", "<p>Menu</p>"), (101, None, None), (102, "odd", "<p>Menu")]
    out = {r["page_id"]: r for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[3]["text"] == "text 3" and out[3]["n_dropped"] == 1
    assert out[100]["text"] == "Menu" and out[102]["text"] == "Menu" and out[101]["n_lines"] == 0
    assert len(out) == len(pages)


def test_line_dedup_cleans_small_hosts(spark):
    pages = [(i, f"http://small.org/{i}", f"<nav>Menu</nav><p>text {i}</p>") for i in range(3)] + [(9, "http://one.org/", "<nav>Menu</nav><p>text</p>")]
    out = {r["page_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out == {0: "text 0", 1: "text 1", 2: "text 2", 9: "Menu\ntext"}


def test_line_dedup_keeps_rows_apart_where_ids_repeat_or_are_null(spark):
    """Against a plain count; ids are null, or the same on two hosts, and pages come again."""
    rng = random.Random(9)
    pages = []
    for i in range(60):
        host = rng.choice(["a.org", "b.org", "c.org", ""])
        lines = ["Menu"] * (host == "a.org" or rng.random() < 0.05) + [rng.choice(["x", "y", f"text {i}"]) for _ in range(rng.randrange(4))] + ["end " * 2000] * (i % 20 == 0)
        pages.append((rng.choice([None, None, 1, 2, i]), f"http://{host}/{i}" if host else None, "".join(f"<p>{x}</p>" for x in lines)))
    pages += pages[:5]
    lines_of = [[x.strip() for x in re.findall("<p>(.*?)</p>", h)] for _, _, h in pages]
    host_of = [u.split("/")[2] if u else "" for _, u, _ in pages]
    want = []
    for (i, _, _), own, host in zip(pages, lines_of, host_of):
        same = [set(x) for x, h in zip(lines_of, host_of) if h == host]
        n = {x: sum(x in s for s in same) for x in own}
        kept = [x for x in own if n[x] < 2 or n[x] <= 0.1 * len(same)]
        want.append((i, host, len(own), len(own) - len(kept), "\n".join(kept)))
    df = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, own string, host string")
    assert collect(line_dedup.drop_boilerplate(df), "page_id", "host", "n_lines", "n_dropped", "text") == sorted(want, key=repr)
    two = [(None, f"http://a.org/{i}", f"<p>Menu</p><p>{i}</p>") for i in range(6)] + [(None, "http://b.org/", "<p>Menu</p>"), (3, "http://a.org/3", "<p>Menu</p>"), (3, "http://c.org/", "<p>Menu</p>")]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(two, "page_id long, url string, html string"))
    assert {r["host"]: r["text"] for r in got.where("host <> 'a.org'").collect()} == {"b.org": "Menu", "c.org": "Menu"}


def test_url_entries_hold_for_a_time(spark):
    entries = spark.sql("select * from values ('domain','example.org',date'2024-02-01','add'), ('domain','example.org',date'2024-03-01','remove'), ('host','x.net',date'2024-01-01','add'), ('prefix','y.net/ads',date'2024-01-01','add'), (null,'z',date'2024-01-01','add') t(kind,pattern,at,action)")
    caps = spark.sql("select * from values ('http://a.example.org/p', date'2024-01-31'), ('http://a.example.org/p', date'2024-02-01'), ('http://a.example.org/p', date'2024-03-01'), ('https://X.net:80/', date'2024-06-01'), ('http://y.net/ads/1?q', date'2024-06-01'), ('http://y.net/adsense', date'2024-06-01'), (null, date'2024-06-01'), ('http://x.net/', null) t(url,fetched_at)")
    got = {(r["url"], str(r["at"])): r["blocked"] for r in url_filters.filter_urls(caps, entries).collect()}
    assert [got[k] for k in (("http://a.example.org/p", "2024-01-31"), ("http://a.example.org/p", "2024-02-01"), ("http://a.example.org/p", "2024-03-01"), ("https://X.net:80/", "2024-06-01"), ("http://y.net/ads/1?q", "2024-06-01"), ("http://y.net/adsense", "2024-06-01"), (None, "2024-06-01"), ("http://x.net/", "None"))] == [False, True, False, True, True, False, False, False]


def test_url_prefixes_of_any_depth_and_case(spark):
    entries = spark.sql("select * from values ('prefix','D.org/a/b/c/d',date'2024-01-01','add'), ('prefix','Y.net/Ads',date'2024-01-01','add') t(kind,pattern,at,action)")
    caps = spark.sql("select *, date'2024-06-01' as fetched_at from values ('http://d.org/a/b/c/d/e/f'), ('http://d.org/a/b/c/d'), ('http://d.org/a/b/c'), ('http://Y.net/Ads/1'), ('http://y.net/ads/1'), ('http://y.net/') t(url)")
    got = {r["url"]: r["blocked"] for r in url_filters.filter_urls(caps, entries).collect()}
    assert {u for u, b in got.items() if b} == {"http://d.org/a/b/c/d/e/f", "http://d.org/a/b/c/d", "http://Y.net/Ads/1"}
    assert len(got) == 6


def test_a_pattern_with_most_dates_and_captures(spark):
    """2000 switches of one pattern, ties among them, and 3000 captures of it: the last switch at or before each fetch."""
    rng = random.Random(44)
    rows = [("domain", "hot.org", rng.randrange(4000), rng.choice(["add", "remove"])) for _ in range(2000)] + [("host", f"h{i}.net", i, "add") for i in range(30)]
    caps = [(f"http://{'www.hot.org' if i % 4 else f'h{i % 40}.net'}/{i % 3}", None if i % 50 == 0 else rng.randrange(-5, 4100)) for i in range(4000)]
    got = url_filters.filter_urls(spark.createDataFrame(caps, "url string, fetched_at int").repartition(8), spark.createDataFrame(rows, "kind string, pattern string, at int, action string").repartition(8)).collect()
    last = {}
    for kind, pattern, at, action in rows:
        d = last.setdefault((kind, pattern), {})
        d[at] = d.get(at, True) and action == "add"
    dates = {k: sorted(d) for k, d in last.items()}

    def holds(k, at):
        i = bisect.bisect_right(dates.get(k, []), at) if at is not None else 0
        return i > 0 and last[k][dates[k][i - 1]]

    want = {}
    for url, at in caps:
        host = url.split("/")[2]
        active = sorted(f"{k}:{p}" for k, p in (("host", host), ("domain", "hot.org" if "hot" in host else host)) if holds((k, p), at))
        want[url, at] = (bool(active), len(active), active[0] if active else None)
    assert {(r["url"], r["at"]): (r["blocked"], r["n_active"], r["first_pattern"]) for r in got} == want and len(got) == len(want)


def test_statistics_equal_plain_counts():
    """The sixteen statistics of quality by loops over words and bytes."""
    from assetloom.llm import quality

    rng = random.Random(14)
    texts = ["", " \n", "a", "One two, two two. THREE!\nfour? é #5 {x}", "x" * 300, "ab ab ab ab\n\n1 2 3 ..."] + [" ".join(rng.choice(["Foo", "bar,", "12", "x!", "é.", "Foo"]) for _ in range(rng.randrange(1, 60))) for _ in range(20)]
    marks = set(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    odd = marks - set(b".,;:'\"-()?")
    logit = lambda part, whole: np.log((part + 0.5) / (max(whole - part, 0) + 0.5 + 0.01 * whole))
    want = []
    for t in texts:
        b = t.encode()
        w = re.findall(rb"[^\x20\x09-\x0D]+", b.lower())
        n, size, pairs = len(w), len(b), list(zip(w, w[1:]))
        letters, upper, digits = sum(x >= 128 or chr(x).isalpha() for x in b), sum(65 <= x <= 90 for x in b), sum(48 <= x <= 57 for x in b)
        m, o = sum(x in marks for x in b), sum(x in odd for x in b)
        cells = [sum(x >> 2 == c for x in b) / size for c in range(64)] if size else []
        want.append([
            np.log1p(size), np.log1p(n), np.log1p(sum(map(len, w)) / max(n, 1)), logit(len(set(w)), n), logit(len(set(pairs)), len(pairs)), logit(upper, letters), logit(digits, size), logit(m, size), logit(o, size),
            logit(sum(x[-1] in odd for x in w), n), np.log1p(n / (b.count(b"\n") + 1)), logit(sum(len(x) <= 3 for x in w), n), logit(sum(x[-1] in b".!?" for x in w), n), logit(size - letters - digits - m, size), np.log1p(max(map(len, w), default=0)), -sum(p * np.log(p) for p in cells if p),
        ])
    raw = [t.encode() for t in texts]
    together = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    alone = np.concatenate([quality.statistics(np.frombuffer(b, np.uint8), np.array([0, len(b)])) for b in raw])
    assert np.allclose(together, want) and np.allclose(alone, want)


def test_quality_scores_equal_a_plain_quadratic_discriminant(spark):
    """Means, shrunk covariances, inverse and determinant by numpy over the same statistics."""
    from assetloom.llm import quality

    rng = random.Random(12)
    texts = [(i, " ".join(rng.choice(["Foo", "bar,", "12", "x!", "word", "é."]) if i % 2 else rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    labels = [(i, i % 2, 0) for i in range(120)]
    got = {r["doc_id"]: r["score"] for r in score_quality(docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    x = np.concatenate([quality.statistics(*(lambda b: (np.frombuffer(b, np.uint8), np.array([0, len(b)])))(t.encode())) for _, t in texts])
    learn = np.array([i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5])
    middle, scale = x[learn].mean(0), np.maximum(x[learn].std(0), 1e-6)
    z = np.clip((x - middle) / scale, -8, 8)
    own = [z[learn[learn % 2 == y]] for y in (0, 1)]
    covs = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) * c for o, c in zip(own, covs)) / len(learn)
    side = []
    for o, c in zip(own, covs):
        c = (1 - 1e-3) * (0.9 * c + 0.1 * pooled) + 1e-3 * np.eye(len(c))
        d = z - o.mean(0)
        side.append(np.log(len(o) / len(learn)) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    want = 1 / (1 + np.exp(-np.clip(side[1] - side[0], -40, 40)))
    assert np.allclose([got[i] for i, _ in texts], want, atol=1e-6)


def test_toxicity_scores_equal_a_plain_version(spark):
    """Sets of n-grams by slices of bytes, counts by loops, a dense matrix for the regression."""
    rng = random.Random(13)
    words = ["plain", "words", "here", "and", "there", "again"]
    texts = [(i, " ".join([*(rng.choice(words) for _ in range(rng.randrange(3, 12))), *(["vile"] if i % 3 == 0 else [])])) for i in range(90)] + [(500, None), (501, "abc")]
    labels = [(i, 0, int(i % 3 == 0)) for i in range(80)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs_of(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), keep=60).collect()}

    def grams(t):
        b, out = (t or "").lower().encode(), set()
        for n in toxicity.SIZES:
            for p in range(len(b) - n + 1):
                v = int.from_bytes(b[p : p + n], "little")
                h = ((v ^ (v >> 17)) * int(toxicity._MULTIPLIER) + n - 1) % (1 << 64)
                out.add(h * int(toxicity._MULTIPLIER) % (1 << 64) >> (64 - toxicity.BITS))
        return out

    learn = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    sets, y = {i: grams(t) for i, t in texts}, {i: v for i, _, v in labels}
    n = [sum(y[i] == k for i in learn) for k in (0, 1)]
    rated = []
    for f in set().union(*(sets[i] for i in learn)):
        c = [sum(f in sets[i] for i in learn if y[i] == k) for k in (0, 1)]
        p = [min((c[k] + 1) / (n[k] + 2), 0.999) for k in (0, 1)]
        ratio = np.log((c[1] + 1) / (n[1] + 2) / ((c[0] + 1) / (n[0] + 2))) - np.log((1 - p[1]) / (1 - p[0]))
        if sum(c) >= 4 and ratio:
            rated.append((-abs(ratio) / np.sqrt(1 / (c[1] + 1) + 1 / (c[0] + 1)), f, float(np.clip(ratio, -6, 6))))
    chosen = sorted(sorted(rated)[:60], key=lambda r: r[1])
    dense = lambda ids: np.array([[r * (f in sets[i]) for _, f, r in chosen] for i in ids])
    x, t = dense(learn), np.array([y[i] for i in learn])
    prior = max(n[1] / len(learn), 0.25)
    weight = np.where(t == 1, prior / n[1], (1 - prior) / n[0])
    w, b, gw, gb = np.zeros(len(chosen)), np.log(prior / (1 - prior)), np.full(len(chosen), 1e-8), 1e-8
    for _ in range(200):
        e = (1 / (1 + np.exp(-(x @ w + b))) - t) * weight
        g = x.T @ e + 1e-3 * w
        gw, gb = gw + g**2, gb + e.sum() ** 2
        w, b = w - 0.1 * g / np.sqrt(gw), b - 0.1 * e.sum() / np.sqrt(gb)
    want = 1 / (1 + np.exp(-(dense([i for i, _ in texts]) @ w + b)))
    assert np.allclose([got[i] for i, _ in texts], want, atol=1e-6)


def _held_out_accuracy(spark, sf, scored, label):
    labels = table(spark, sf, "labels")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(r["predicted"] == r[label] for r in rows) / len(rows)


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    assert _held_out_accuracy(spark, sf, score_quality(docs, labels), "quality") >= 0.95


def test_toxicity_catches_held_out_rows_and_leaves_others(spark):
    """One in eight is toxic, so what flags nothing, or everything, fails."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    rows = toxicity.score_toxicity(table(spark, sf, "documents"), labels).where("held_out").join(labels, "doc_id").select("predicted", "toxic").collect()
    caught = [r["predicted"] for r in rows if r["toxic"] == 1]
    flagged = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert len(caught) > 80 and len(flagged) > 600
    assert sum(caught) >= 0.9 * len(caught) and sum(flagged) <= 0.01 * len(flagged), (sum(caught), len(caught), sum(flagged), len(flagged))


def test_fold_rule(spark):
    from assetloom.llm.labelled import held_out
    from pyspark.sql import functions as F

    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


OPERATORS = {
    "license": lambda d, lab, b: scan_licenses(d),
    "quality": lambda d, lab, b: score_quality(d, lab),
    "jaccard": lambda d, lab, b: ngram_join.jaccard_components(d),
    "packing": lambda d, lab, b: packing.pack_documents(d, queries.tokenizer_path()),
    "toxicity": lambda d, lab, b: toxicity.score_toxicity(d, lab),
    "suffix": lambda d, lab, b: suffix_dedup.repeated_bytes(d),
    "exact": lambda d, lab, b: exact_dedup(d, digest=True),
    "contamination": lambda d, lab, b: contamination(d, b),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_and_empty_tables(spark, name):
    """Nulls in any column, odd texts, repeated rows, clashing columns; then empty tables all around."""
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (5, None, None), (14, 1, 0), (14, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (None, "x"), (2, None)], "item_id long, text string")
    rows = [*ODD, ODD[3]]
    out = OPERATORS[name](docs_of(spark, rows, clash=True), labels, bench).collect()
    assert {r["doc_id"] for r in out} == {i for i, _ in rows}
    assert len(out) >= len(rows)
    none = docs_of(spark, []).where("false")
    assert OPERATORS[name](none, labels.where("false"), bench.where("false")).collect() == []
    assert len(OPERATORS[name](docs_of(spark, [(1, "a b c d e f g"), (2, None)]), labels.where("false"), bench.where("false")).collect()) == 2


def test_url_filters_of_odd_captures(spark):
    """Empty tables, repeated captures, clashing columns: distinct captures once each, blocked by what holds."""
    entries = spark.sql("select * from values ('domain','example.org',date'2024-02-01','add'), ('domain','example.org',date'2024-02-01','add'), ('host','h',null,'add'), ('host','h',date'2024-01-01',null) t(kind,pattern,at,action)")
    caps = spark.sql("select *, 'c' as kind, 'c' as pattern, 'c' as spans, 'c' as holds, 'c' as depth, 'c' as url_, 'c' as key from values ('http://example.org/', date'2024-06-01'), ('http://example.org/', date'2024-06-01'), ('http://h/', date'2024-06-01'), ('', date'2024-06-01'), (null, null), (null, null) t(url,fetched_at)")
    got = url_filters.filter_urls(caps, entries)
    assert collect(got, "url", "blocked", "n_active", "first_pattern") == sorted([("http://example.org/", True, 1, "domain:example.org"), ("http://h/", False, 0, None), ("", False, 0, None), (None, False, 0, None)], key=repr)
    assert url_filters.filter_urls(caps.where("false"), entries).collect() == []
    assert {r["blocked"] for r in url_filters.filter_urls(caps, entries.where("false")).collect()} == {False}


@pytest.mark.parametrize("name", OPERATORS)
def test_very_long_texts(spark, name):
    """64 MB of words, and of one word of 16 MB, beside short texts."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (6, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19")], "item_id long, text string")
    df = spark.sql("select 1L as doc_id, repeat(array_join(transform(sequence(0, 9999), x -> concat('w', x)), ' ') || ' ', 1100) as text union all select 2L, concat(repeat('x', 16000000), ' tail') union all select 3L, 'w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 w18 w19' union all select id, concat('short text ', id) from range(4, 9)")
    assert df.selectExpr("max(length(text))").first()[0] > 64_000_000
    out = {r["doc_id"]: r for r in OPERATORS[name](df, labels, bench).drop("spans").collect()}
    assert set(out) == set(range(1, 9))
    if name == "contamination":
        assert (out[1]["n_words"], out[1]["n_hit"]) == (11_000_000, 1100 * 13) and out[3]["contaminated"]
    if name == "exact":
        assert all(r["kept"] and r["group_size"] == 1 for r in out.values())
    if name == "jaccard":
        assert out[1]["n_shingles"] == 10_000 and out[2]["n_shingles"] == 1
    if name == "suffix":
        assert out[1]["n_removed"] == out[1]["n_bytes"] and out[2]["n_removed"] == 16_000_000


def test_odd_pages_and_captures(spark):
    pages = spark.createDataFrame([(None, None, None, "c"), (1, "http://h/", "<p>x</p>", "c"), (1, "http://h/", "<p>x</p>", "c")], "page_id long, url string, html string, key string")
    assert len(line_dedup.drop_boilerplate(pages).collect()) == 3
    assert line_dedup.drop_boilerplate(pages.where("false")).collect() == []


def plain_hits(text, items, width=13):
    """(words, hit words) by comparing every window with every place."""
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    known = {}
    for b in items:
        b = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (b or "").encode().lower())
        m = min(width, len(b))
        known.setdefault(m, set()).update(tuple(b[j : j + m]) for j in range(len(b) - m + 1 if m else 0))
    hit = {p + k for m, ws in known.items() if m for p in range(len(w) - m + 1) if tuple(w[p : p + m]) in ws for k in range(m)}
    return len(w), len(hit)


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Each stage against a plain reading of its own input; toxicity against the labels it may not learn from."""
    docs = table(spark, SF, "documents")
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            scored = {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
            assert after == {i for i in before if scored[i] == 0}
            marked, clean = [i for i in before if toxic.get(i) == 1], [i for i in before if toxic.get(i) == 0]
            assert sum(i not in after for i in marked) >= 0.8 * len(marked) > 0 and sum(i in after for i in clean) >= 0.98 * len(clean)
        if name == "exact_dedup":
            norm = {}
            for i in sorted(before):
                norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", before[i] or ""), i)
            assert after == set(norm.values())
        if name == "ngram_jaccard":
            assert after == {c for _, _, c in brute_components(sorted(before.items()), 5, 80)}
        if name == "decontamination":
            hits = {i: plain_hits(t, items) for i, t in before.items()}
            assert after == {i for i, (n, h) in hits.items() if not (h and 20 * h >= n)} and len(after) < len(before)
        if name == "packing":
            assert after == set(before)


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, nulls in any column, repeated rows, an extra column: every row is decided on by itself."""
    bench = " ".join(f"bench{k}" for k in range(20))
    copy = " ".join(f"word{k}" for k in range(60))
    rows = [(None, bench), (None, copy), (None, copy), (4, bench), (4, "clean text of its own"), (5, copy), (6, f"{copy} more"), (7, "twice the same"), (7, "twice the same"), (8, None), (9, ""), (None, None)]
    for name, data, kind in (("labels", [(10, 1, 0)], "doc_id long, quality int, toxic int"), ("benchmark", [("b", bench)], "item_id string, text string")):
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).withColumn("row", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df=docs: collect(stages[name](spark, df, str(tmp_path)), "doc_id", "text")
    assert stages["toxicity"](spark, docs, str(tmp_path)).columns == docs.columns and run("toxicity") == sorted(rows, key=repr)
    assert run("exact_dedup") == sorted([(4, bench), (4, "clean text of its own"), (5, copy), (6, f"{copy} more"), (7, "twice the same"), (8, None)], key=repr)
    assert run("ngram_jaccard") == sorted([r for r in rows if r not in ((None, bench), (None, copy), (6, f"{copy} more"), (7, "twice the same"))] + [(7, "twice the same")], key=repr)
    assert run("decontamination") == sorted([r for r in rows if r[1] != bench], key=repr)
    assert stages["packing"](spark, docs, str(tmp_path)).count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    show = lambda v: str(v)
    assert sorted(tuple(show(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(show(v) for v in r) for r in want.select(*cols).fetchall())
