"""Long licences: the terms as templates, against patience alignment of whole documents."""

import random

import numpy as np
import pytest

from assetloom.llm import license_scan as ls
from assetloom.llm.license_texts import FOLDER, known_texts, whole_texts

DOCS = "doc_id long, text string"


def named(spark, rows):
    df = ls.scan_licenses(spark.createDataFrame(rows, DOCS))
    return {r["doc_id"]: [(x["license"], x["coverage"]) for x in r["licenses"]] for r in df.collect()}


def changed(text, share, seed):
    rng, w = random.Random(seed), text.split()
    for k in rng.sample(range(len(w)), int(len(w) * share)):
        w[k] = f"changed{k}"
    return " ".join(w)


def test_published_files_are_told_apart(spark):
    """Each file with its preamble and appendix, between other text: its own licence alone, whole. Close ones (the two of 2.x, those of version 3) do not take its place."""
    want = sorted(p.stem for p in FOLDER.glob("*.txt"))
    rows = [(i, f"before {'x ' * 900} {(FOLDER / f'{n}.txt').read_text()} after {'y ' * 90}") for i, n in enumerate(want)]
    rows.append((len(want), f"{'x ' * 90} {whole_texts()['AGPL-3.0'][0]} {'y ' * 900}"))
    got = named(spark, rows)
    assert [got[i] for i in range(len(rows))] == [[(n, 1.0)] for n in [*want, "AGPL-3.0"]]


def test_altered_terms_come_first(spark):
    known = sorted(whole_texts().items())
    got = named(spark, [(i, f"{'x ' * 700} {changed(t, 0.1, i)} {'y ' * 50}") for i, (_, (t,)) in enumerate(known)])
    assert [got[i][0][0] for i in range(len(known))] == [n for n, _ in known]
    assert all(got[i][0][1] >= 0.89 for i in range(len(known)))
    assert all(ls.long_match(ls._words(t), np.array(ls._words(changed(t, 0.25, i)), np.uint64))[0] < 0.8 for i, (_, (t,)) in enumerate(known))


@pytest.mark.parametrize("copies", [2, 5])
def test_copies_side_by_side_do_not_hide_each_other(spark, copies):
    known = sorted(whole_texts().items())
    rows = [(i, " ".join(changed(t, 0.05 * (k != copies // 2), k) for k in range(copies))) for i, (_, (t,)) in enumerate(known)]
    got = named(spark, rows)
    assert [dict(got[i]).get(n) for i, (n, _) in enumerate(known)] == [1.0] * len(known)


def test_windows_find_what_the_whole_document_has():
    """One altered copy anywhere in a document: no less than by patience alignment of the whole document."""
    rng, terms = random.Random(4), [ls._words(t) for (t,) in whole_texts().values()]
    for k in range(40):
        t = terms[k % len(terms)]
        m, copy = len(t), list(t)
        for i in rng.sample(range(m), rng.randrange(m // 6)):
            copy[i] = rng.randrange(1 << 60)
        extra = rng.choice([0, m // 10, m * 4 // 5])  # other words between
        for i in sorted(rng.sample(range(m), extra), reverse=True):
            copy.insert(i, rng.randrange(1 << 60))
        around = [rng.randrange(1 << 60) for _ in range(rng.choice([0, m // 3, 4 * m]))]
        at = rng.randrange(len(around) + 1)
        words = np.array(around[:at] + copy + around[at:], np.uint64)
        share, first, last = ls.long_match(t, words)
        assert share >= min(len(ls.align(t, words.tolist())) / m, 1.0) - 1e-12
        assert at <= first <= last < at + len(copy)


def test_odd_rows(spark):
    got = named(spark, [(None, None), (1, ""), (2, "the of to a " * 60_000), (3, whole_texts()["MPL-2.0"][0] * 3), (3, "x"), (None, "Licensed under the Apache License, Version 2.0")])
    assert got[1] == got[2] == [] and got[None] == [("Apache-2.0", 1.0)]
    assert [len(t) for _, t in sorted(known_texts().items())] and "GPL-3.0" in known_texts()
    assert ls.long_match(ls._words(whole_texts()["GPL-2.0"][0]), np.zeros(0, np.uint64)) == (0.0, -1, -1)
