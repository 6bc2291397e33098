"""Fill-in-middle against plain string work, and frames against plain slicing."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from assetloom.llm.fill_middle import FrameReader, FrameWriter, fill_in_middle, frame_store, rearranged, rebuilt, select_units

DOCS = "doc_id long, text string"
TEXTS = [None, "", "a", "é", "plain words here", "ünïcödé \U0001f600 text … " * 9, "has <P> inside", "<S>", "x<M>", "ends with <", "<P", "S>M>", "\x00\x01", "abc" * 50_000, "héé\U0001f600" * 20_000, " \n\t "]


def plain(i, t):
    """The contract's rule by plain string work."""
    t, sha = t or "", lambda s: hashlib.sha256(s.encode()).hexdigest()
    n, h = len(t), sha(f"1:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, sha(t), sha(t))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{t[:lo]}<S>{t[hi:]}<M>{t[lo:hi]}" if form == "psm" else f"<S>{t[hi:]}<P>{t[:lo]}<M>{t[lo:hi]}"
    return (i, n, form, lo, hi - lo, sha(out), sha(t))


@pytest.mark.parametrize("frame", [None, 7])
def test_equals_plain_string_work(spark, frame):
    """All forms, nulls in any column, repeated rows and ids, marks, long texts, clashing columns; then an empty table."""
    texts = TEXTS if frame is None else [t for t in TEXTS if len(t or "") < 1000]
    rows = [(i, t) for i in range(12) for t in texts] + [(None, "no id"), (None, None), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("n", "form", "frames", "starts", "marked", "lo", "h__", "t__")})
    got = sorted(map(tuple, fill_in_middle(df, frame=frame).collect()), key=repr)
    want = sorted((plain(i, t) for i, t in rows), key=repr)
    assert got == want and {"plain", "psm", "spm"} == {r[2] for r in got}
    assert fill_in_middle(df.where("false")).collect() == []


def test_output_frames_hold_the_output(spark):
    rows = [(i, "wörter \U0001f600 " * 40) for i in range(30)]
    out = fill_in_middle(spark.createDataFrame(rows, DOCS), frame=64, output=True).collect()
    for r in out:
        assert len(r["output_frames"]) > 5
        o = FrameReader(r["output_starts"], r["output_frames"], r["output_n"])
        whole = b"".join(o.stream((0, 0), (len(o.frames), 0)))
        assert hashlib.sha256(whole).hexdigest() == r["output_sha256"] and len(whole.decode()) == r["output_n"]


def test_selection_opens_only_frames_with_a_cut(spark):
    text = "".join(chr(0x100 + i % 500) for i in range(5000))
    w = FrameWriter(100)
    w.write(text.encode())
    starts, frames, n = w.close()
    r = FrameReader(starts, frames, n)
    assert n == 5000 and len(frames) == 100 and starts == list(range(0, 5000, 50))
    r.place(50), r.place(4950), r.place(5000)
    assert r.opened == 0  # places between frames need none
    assert b"".join(r.stream(r.place(1020), r.place(1090))).decode() == text[1020:1090] and r.opened == 4
    df = frame_store(spark.createDataFrame([(1, text), (2, "short"), (3, None)], DOCS), frame=100)
    got = {x["doc_id"]: x["selected"] for x in select_units(df, F.lit(3), F.lit(1234)).collect()}
    assert got == {1: text[3:1234], 2: "rt", 3: ""}
    assert {x["selected"] for x in select_units(df, F.lit(None), F.lit(9)).collect()} == {None}


def test_round_trips_of_texts_like_marks():
    rng = random.Random(4)
    for _ in range(400):
        t = "".join(rng.choice("<PSM>é\U0001f600") for _ in range(rng.randrange(1, 40)))
        if any(m in t for m in ("<P>", "<S>", "<M>")):
            continue
        lo, hi = sorted(rng.randrange(len(t) + 1) for _ in range(2))
        for form in ("psm", "spm", "plain"):
            w, size = FrameWriter(5), FrameWriter(5)
            size.write(t.encode())
            for piece in rearranged(FrameReader(*size.close()), form, lo, hi):
                w.write(piece)
            assert b"".join(rebuilt(FrameReader(*w.close()), form)).decode() == t


def test_very_long_texts(spark):
    df = spark.sql("select 4L as doc_id, repeat('wörter ', 9000000) as text union all select 5L, repeat('x', 16000000) union all select id, concat('short ', id) from range(6, 9)")
    out = {r["doc_id"]: r for r in fill_in_middle(df).collect()}
    assert set(out) == {4, 5, 6, 7, 8} and out[4]["n"] == 63_000_000
    assert out[4]["restored_sha256"] == hashlib.sha256("wörter ".encode() * 9_000_000).hexdigest()
