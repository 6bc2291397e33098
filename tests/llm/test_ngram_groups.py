"""Sets that have a passage in common, but no partner, neither meet nor travel from task to task."""

import random

import pytest

from assetloom.llm import ngram_join


def words(rng, n):
    return [f"{rng.getrandbits(32):06x}" for _ in range(n)]


def corpus(rng, n, size, passage):
    """Texts that share a passage and nothing else; the last three are near copies of the first three."""
    texts = []
    for _ in range(n - 3):
        t = words(rng, size)
        at = rng.randrange(size)
        texts.append(t[:at] + passage + t[at:])
    texts += [t[:-1] + ["else"] for t in texts[:3]]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def components(texts, k, percent):
    """Each id's least one, by all pairs."""
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (t.split() for _, t in texts)]
    up = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    return {texts[i][0]: texts[x][0] for i, x in enumerate(up)}


@pytest.mark.parametrize("limit", [("GROUP_SETS", 16), ("GROUP_TOKENS", 300)])
def test_large_groups_are_pruned_before_their_tokens_travel(spark, monkeypatch, limit):
    texts = corpus(random.Random(5), 200, 30, words(random.Random(6), 14))
    monkeypatch.setattr(ngram_join, *limit)
    monkeypatch.setattr(ngram_join, "COMMON", 0)  # else they do not meet at all
    groups, sent = ngram_join._groups, []
    monkeypatch.setattr(ngram_join, "_groups", lambda docs, tasks, *a: sent.append(tasks.count()) or groups(docs, tasks, *a))
    got = ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), words=5, percent=80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(texts, 5, 80)
    # a set travels for each of its few groups, and not for each block of the others
    assert sent[0] < 10 * len(texts) and sum(sent[1:]) < len(texts), sent


def test_a_passage_spread_thinly_is_no_meeting_place(spark, monkeypatch):
    texts = corpus(random.Random(7), 12, 160_000, words(random.Random(8), 60))  # 1.1 MB each: not two in one block
    monkeypatch.setattr(ngram_join, "COMMON_FROM", 8)
    refined, met = ngram_join._refined, []
    monkeypatch.setattr(ngram_join, "_refined", lambda members, *a: met.extend(r["node"] for r in members.select("node").distinct().collect()) or refined(members, *a))
    got = ngram_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), words=5, percent=80)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: i if i < 9 else i - 9 for i in range(12)}
    assert sorted(met) == [0, 1, 2, 9, 10, 11]


def test_bitmaps_of_different_parts_only():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 2**62, 200).astype(np.uint64)) for _ in range(30)]
    sets += [np.sort(np.concatenate([s[:-3], rng.integers(0, 2**62, 3).astype(np.uint64)])) for s in sets[:4]]
    size = np.array([len(s) for s in sets])
    maps = ngram_join.bitmaps(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]))
    part = np.arange(len(sets))
    part[30:32] = part[:2]  # these two are joined already
    found = ngram_join.may_link_parts(maps, size, part, 80)
    assert set(np.flatnonzero(found)) >= {2, 3, 32, 33} and not found[[0, 1, 30, 31]].any()
