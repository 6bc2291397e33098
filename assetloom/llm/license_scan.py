"""License scans: patience alignment of licence templates with whole documents."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.llm import text as tx
from assetloom.llm.license_texts import TEMPLATES as TEMPLATES
from assetloom.llm.license_texts import known_texts
from assetloom.session import ready

#: Templates of as many words are aligned in windows that slide over the document.
LONG = 500


def _words(text: str) -> list[int]:
    data = np.frombuffer(text.encode(), np.uint8)
    return tx.word_hashes(data, np.array([0, len(data)]), tx.ALNUM)[0].tolist()


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Patience alignment: pairs (i, j) with a[i] == b[j], rising in both.

    Anchors are the words that occur once in both; the longest run of anchors that rises in both stays, and the gaps
    between them, where other words may have become unique, are aligned in the same way. Equal words at the edges of a
    gap are taken first.
    """
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        seen: dict[int, list[int]] = {}
        for k in range(i, i_end):
            seen.setdefault(a[k], [0, 0, k, 0])[0] += 1
        for k in range(j, j_end):
            if a_word := seen.get(b[k]):
                a_word[1] += 1
                a_word[3] = k
        unique = sorted((x[2], x[3]) for x in seen.values() if x[0] == x[1] == 1)
        tops: list[int] = []  # patience piles: the last word of the best run of each length
        held, before = [], []
        for k, (_, y) in enumerate(unique):
            at = bisect_left(tops, y)
            tops[at:] = [*([y]), *tops[at + 1 :]]
            held[at:] = [k, *held[at + 1 :]]
            before.append(held[at - 1] if at else -1)
        chain, k = [], held[-1] if held else -1
        while k >= 0:
            chain.append(unique[k])
            k = before[k]
        if not chain:
            continue
        for x, y in [*chain[::-1], (i_end, j_end)]:
            if x < i_end:
                out.append((x, y))
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
    return sorted(out)


def best_match(template: list[int], words: np.ndarray, least: float = 0.8, slack: int = 2) -> tuple[float, int, int]:
    """(share of the template's words that align, first and last word of the match) over the whole document.

    Documents are aligned in windows of `1 + 2 * slack` template lengths around each place of the template words that
    are rarest in the document. Where copies stand so close that a window holds several, no word is unique in it; so
    the place is also taken as an anchor itself, and each side is aligned only as far as one copy's share of that word
    reaches, and as far as one copy's length with spare words or none. A licence that occurs twice then does not hide
    its own anchors. A match of `least` lacks at most `(1 - least)` of the template's words, so with one word more than that some window lies on it. Words
    farther than `slack / 2` template lengths from the middle of a match do not count.
    """
    m, best = len(template), (0.0, -1, -1)
    places = {w: np.flatnonzero(words == w) for w in dict.fromkeys(template)}
    for w in sorted(places, key=lambda w: len(places[w]))[: int((1 - least) * m + 1e-9) + 1]:
        own, stands = [r for r, x in enumerate(template) if x == w], places[w].tolist()
        for i, at in enumerate(stands):
            lo, hi = max(0, at - slack * m), at + slack * m + 1
            tries = [[j + lo for _, j in align(template, words[lo:hi].tolist())]]
            for k, r in enumerate(own):
                start = max(lo, stands[i - k - 1] + 1 if i > k else 0)
                after = i + len(own) - k
                end = min(hi, stands[after] if after < len(stands) else hi)
                for spare in (slack * m, m // 8 + 1, 0):
                    begin, stop = max(start, at - r - spare), min(end, at + m - r + spare)
                    left = [j + begin for _, j in align(template[:r], words[begin:at].tolist())]
                    tries.append([*left, at, *(j + at + 1 for _, j in align(template[r + 1 :], words[at + 1 : stop].tolist()))])
            for near in filter(None, tries):
                mid = near[len(near) // 2]
                near = [j for j in near if abs(j - mid) <= slack * m // 2 + 1]
                best = max(best, (len(near) / m, near[0], near[-1]), key=lambda x: x[0])
        if best[0] == 1:
            break
    return best


def long_match(template: list[int], words: np.ndarray, least: float = 0.8) -> tuple[float, int, int]:
    """The same for templates of `LONG` words and more, in windows of one and a half template lengths, a quarter apart.

    A match that is at most a quarter longer than the template lies in such a window as a whole. Beside it there are at
    most parts of other copies that make half a length together, so half of the copy's own rare words stay unique: anchors
    are there even where copies stand side by side, and in the gaps between anchors the rest becomes unique. Windows of
    three lengths, one apart, take matches with more other words between. Only windows that
    hold `least` of the template's words, counted with repeats, are aligned; they rule out no match.
    """
    m, best = len(template), (0.0, -1, -1)
    kinds, need = np.unique(np.array(template, np.uint64), return_counts=True)
    place = np.minimum(np.searchsorted(kinds, words), len(kinds) - 1)
    place = np.where(kinds[place] == words, place, len(kinds))
    for size, step in ((m + m // 2, m // 4), (3 * m, m)):
        for lo in range(0, max(len(words) - size + step, 1), step):
            have = np.bincount(place[lo : lo + size], minlength=len(kinds) + 1)[:-1]
            if np.minimum(have, need).sum() < max(least, best[0]) * m:
                continue
            near = [j + lo for _, j in align(template, words[lo : lo + size].tolist())]
            best = max(best, (len(near) / m, near[0], near[-1]) if near else best, key=lambda x: x[0])
            if best[0] == 1:
                return best
    return best


def listed(found: dict[str, list[tuple[int, tuple[float, int, int]]]]) -> list[dict]:
    """Rows of the licences of a text, each by its best match; `found` has (template words, match) of all that match.

    A licence of which all matches lie inside a match of another one (those of long templates by nine tenths), of which more
    words align, or as many that are all of its words, is left out.
    """
    def aligned(x: tuple) -> int:
        return round(x[0] * x[1][0])

    def inside(x: tuple, y: tuple) -> bool:
        most = 9 if x[0] >= LONG else 10  # a stray word at an edge of a long match does not count
        return 10 * (min(x[1][2], y[1][2]) - max(x[1][1], y[1][1]) + 1) >= most * (x[1][2] - x[1][1] + 1)

    def part(x: tuple, name: str) -> bool:
        return any((aligned(y), y[1][0] == 1) > (aligned(x), x[1][0] == 1) and inside(x, y) for other, ys in found.items() if other != name for y in ys)

    best = {k: (max(xs, key=lambda x: (x[1][0], x[0]))[1], max(map(aligned, xs))) for k, xs in found.items() if not all(part(x, k) for x in xs)}
    order = sorted(best, key=lambda k: (-round(best[k][0][0], 6), -best[k][1], k))
    return [{"license": k, "coverage": round(best[k][0][0], 6), "first_word": best[k][0][1], "last_word": best[k][0][2]} for k in order]


def scan_licenses(docs: DataFrame, id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, least: float = 0.8) -> DataFrame:
    """Per row of `docs`: `doc_id`, `licenses`, a list of (license, coverage, first_word, last_word) by falling coverage, then
    words that align, then name.

    A licence is found if `least` of the words of one of its templates align; templates are short texts and notices, and
    the terms of long licences, unless others are given. A template is aligned only with documents
    that hold enough of its words at all, counted with repeats, which rules out no match. A licence whose matches lie
    inside a match of another one, as `listed` says, is part of that licence's text and is not listed.

    Null and empty texts, and texts without words, have no licence; a licence with several matching templates is listed
    once with its best; a longer template wins a tie. Repeated rows and null ids are each scanned. Other columns are
    not read; an empty table gives an empty result, and without templates no licence is found.
    """
    ready(docs.sparkSession)
    every = [(name, _words(t)) for name, ts in sorted((templates or known_texts()).items()) for t in ts]
    known, long = [(name, t) for name, t in every if 0 < len(t) < LONG], [(name, t) for name, t in every if len(t) >= LONG]
    vocabulary = np.unique(np.array([w for _, t in known for w in t], np.uint64))
    needs = np.zeros((len(known), len(vocabulary)), np.int64)
    for k, (_, t) in enumerate(known):
        np.add.at(needs[k], np.searchsorted(vocabulary, np.array(t, np.uint64)), 1)
    # few documents have as many words as a long template; its words are counted in those only
    long_words = np.unique(np.array([w for _, t in long for w in t], np.uint64))
    long_needs = [np.unique(np.searchsorted(long_words, np.array(t, np.uint64)), return_counts=True) for _, t in long]
    shortest = least * min((len(t) for _, t in long), default=0)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    item = pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in tx.text_blocks(batch):
                n = hi - lo
                h, _, _, doc = tx.word_hashes(data, at, tx.ALNUM)
                place = np.minimum(np.searchsorted(vocabulary, h), max(len(vocabulary) - 1, 0))
                hit = vocabulary[place] == h if len(vocabulary) else np.zeros(len(h), bool)
                have = np.bincount(doc[hit] * len(vocabulary) + place[hit], minlength=n * len(vocabulary)).reshape(n, -1)
                edge = np.searchsorted(doc, np.arange(n + 1))
                out: list[dict[str, list]] = [{} for _ in range(n)]
                for k, (name, t) in enumerate(known):
                    for d in np.flatnonzero(np.minimum(have, needs[k]).sum(1) >= least * len(t)):
                        got = best_match(t, h[edge[d] : edge[d + 1]], least)
                        if got[0] >= least:
                            out[d].setdefault(name, []).append((len(t), got))
                for d in np.flatnonzero(np.diff(edge) >= shortest) if long else ():
                    own = h[edge[d] : edge[d + 1]]
                    where = np.searchsorted(long_words, own)
                    ours = np.bincount(where[long_words[np.minimum(where, len(long_words) - 1)] == own], minlength=len(long_words))
                    for (name, t), (kinds, need) in zip(long, long_needs, strict=True):
                        if np.minimum(ours[kinds], need).sum() >= least * len(t) and (got := long_match(t, own, least))[0] >= least:
                            out[d].setdefault(name, []).append((len(t), got))
                found = [listed(x) for x in out]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(found, pa.list_(item))], ["doc_id", "licenses"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, licenses array<struct<license: string, coverage: double, first_word: bigint, last_word: bigint>>")
