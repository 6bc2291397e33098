"""Core operators against brute force, their unit cases, and streaming forms against batch ones."""

import hashlib
import random
import re
import struct
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.functions import exprs as X
from assetloom.operators import decisions, features, incremental, similarity, views
from assetloom.operators.components import changed_edges, connected_components, update_components
from assetloom.operators.places import placed, ranged
from assetloom.session import cut
from assetloom.sources import files


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(60)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for a, b in edges if a != b for n in (a, b)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


@pytest.mark.parametrize("threshold", [4, 8, 12])
def test_hamming_pairs_equal_brute_force(spark, threshold):
    rng = random.Random(threshold)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(60)]
    while len(fps) < 150:
        x = rng.choice(fps)
        for _ in range(rng.randrange(14)):
            x ^= 1 << rng.randrange(63)
        fps.append(x)
    rows = [(f"p{i:04}", fp) for i, fp in enumerate(fps)] + [("none", None)]
    rep = {}
    for p, fp in rows[:-1]:
        rep.setdefault(fp, p)
    want = {(a, b, bin((x ^ y) & ((1 << 64) - 1)).count("1")) for x, a in rep.items() for y, b in rep.items() if a < b and bin((x ^ y) & ((1 << 64) - 1)).count("1") < threshold}
    want |= {(rep[fp], p, 0) for p, fp in rows[:-1] if rep[fp] != p}
    got = similarity.hamming_pairs(spark.createDataFrame(rows, "path string, fp long"), "path", threshold).collect()
    assert sorted((r["src"], r["dst"], r["dist"]) for r in got) == sorted(want)


def test_components_by_rounds_and_by_one_task(spark):
    rng = random.Random(12)
    edges = spark.createDataFrame([(f"n{rng.randrange(90):03}", f"n{rng.randrange(90):03}") for _ in range(70)] + [("a", None), ("b", "b")], "src string, dst string")
    assert sorted(connected_components(edges).collect()) == sorted(connected_components(edges, small=0).collect()) != []


def test_components_after_a_change(spark):
    """Random inserts and deletes: the same as a full run, over few edges."""
    rng = random.Random(31)
    edges = {(a, b) for a, b in ((rng.randrange(300), rng.randrange(300)) for _ in range(230)) if a != b} | {(500 + i, 501 + i) for i in range(40)}
    frame = lambda e: spark.createDataFrame(sorted(e), "src long, dst long")
    stored = connected_components(frame(edges))
    for added, removed in (({(1, 700), (700, 701), (3, 520)}, {510, 7}), ({(0, 299)}, set()), (set(), {501, 20, 40}), (set(), set()), ({(9, 510), (600, 601)}, {510})):
        gone = spark.createDataFrame([(n,) for n in removed], "node long")
        extra = frame(added) if added else frame(edges).where("false")
        want = connected_components(frame({e for e in edges | added if not removed & set(e)}))
        got = update_components(stored, frame(edges), extra, gone)
        assert sorted(got.collect()) == sorted(want.collect()), (added, removed)
    todo, _ = changed_edges(stored, frame(edges), frame({(1, 700)}), spark.createDataFrame([(510,)], "node long"))
    assert todo.count() <= 42 < len(edges)  # the chain that lost a node, and the new edge


@pytest.mark.parametrize(("threshold", "few", "calm"), [(4, 0, 4), (12, 0, 4), (12, 0, 0), (12, 1 << 14, 4)])
def test_hamming_links_connect_what_pairs_connect(spark, monkeypatch, threshold, few, calm):
    monkeypatch.setattr(similarity, "FEW", few)
    monkeypatch.setattr(similarity, "CALM", calm)
    rng = random.Random(threshold + 1)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(40)]
    while len(fps) < 160:  # chains: each copy is made from any earlier one
        x = rng.choice(fps)
        for _ in range(rng.randrange(14)):
            x ^= 1 << rng.randrange(63)
        fps.append(x)
    dense = fps[0]
    fps += [dense ^ 1 << i ^ 1 << j for i in range(24) for j in range(i, 24)] + fps[:20]
    rows = spark.createDataFrame([(f"p{i:04}", fp) for i, fp in enumerate(fps)] + [("none", None)], "path string, fp long")
    links = similarity.hamming_links(rows, "path", threshold).collect()
    pairs = similarity.hamming_pairs(rows, "path", threshold).collect()
    named = lambda edges: {(r["node"], r["component"]) for r in connected_components(spark.createDataFrame([(r["src"], r["dst"]) for r in edges], "src string, dst string")).collect()}
    assert named(links) == named(pairs)
    assert len(set(links)) == len(links)
    assert len(links) * 4 < len(pairs), (len(links), len(pairs))
    empty = similarity.hamming_links(spark.createDataFrame([("a", None)], "path string, fp long"), "path", threshold)
    assert empty.collect() == []


@pytest.mark.parametrize("flips", [3, 7])
def test_dense_clusters_take_comparisons_in_proportion(spark, flips):
    """Near copies around one centre, tight and loose: what meets grows with their number, not with its square."""
    met = []
    for n in (1500, 3000):
        rng = random.Random(flips)
        fps = {0x5A5A5A5A5A5A5A5A}
        while len(fps) < n:
            x = 0x5A5A5A5A5A5A5A5A
            for b in rng.sample(range(63), rng.randrange(flips + 1)):
                x ^= 1 << b
            fps.add(x)
        df = spark.createDataFrame([(x,) for x in fps], "fp long")
        picked = similarity._picked(df, 12)
        ends = picked.select("fp", F.explode(F.array("lead", "reach")).alias("to")).where("fp <> to")
        rows = picked.join(connected_components(ends, "fp", "to"), F.col("fp") == F.col("node"), "left").select("fp", "lead", F.coalesce("component", "fp").alias("part"))
        met.append(similarity._meetings(rows, 12)[0].count())
        assert rows.select("part").distinct().count() < 0.1 * n
    assert met[1] <= 2.3 * max(met[0], 1500), met


def test_stitched_sessions_equal_one_window(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(60_000)) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, t long")
    one = sorted((r["id"], r["session"]) for r in similarity.sessions(df, F.col("t"), 150, ["id"]).where("session is not null").collect())
    two = sorted((r["id"], r["session"]) for r in similarity.stitched_sessions(df, F.col("t"), 150, ["id"], 1000).where("session is not null").collect())
    assert one == two and len(one) == 300


@pytest.fixture
def hot(spark):
    """2000 rows of which one key has 40 %, a null key among the others; times repeat, some are null."""
    rng = random.Random(9)
    rows = [(i, "hot" if i % 5 < 2 else rng.choice([f"k{j}" for j in range(40)] + [None]), rng.randrange(9000) if i % 97 else None) for i in range(2000)]
    return spark.createDataFrame(rows, "id long, key string, t long").repartition(4)


def test_places_of_a_hot_key_are_dealt_to_many_tasks(spark, hot):
    by, order = ["key"], [F.desc_nulls_last("t"), F.col("id")]
    plain = {}
    for r in sorted(hot.collect(), key=lambda r: (r["t"] is None, -(r["t"] or 0), r["id"])):
        plain.setdefault(r["key"], []).append(r["id"])
    got = placed(hot, by, order, parts=16)
    assert {(r["id"], r["place"]) for r in got.collect()} == {(i, n) for ids in plain.values() for n, i in enumerate(ids)} and got.count() == 2000
    sizes = sorted(r["count"] for r in ranged(hot, by, order, 16).groupBy("part__").count().collect())
    assert len(sizes) >= 12 and sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes
    empty = hot.where("false")
    assert placed(empty, by, order).collect() == [] and placed(empty, [], order).collect() == []


def test_sessions_of_a_hot_key_equal_a_plain_scan(spark, hot):
    for by in (["key"], []):
        got = similarity.sessions(hot.repartition(16), F.col("t"), 7, ["id"], by).collect()
        want, last = {}, {}
        for r in sorted((r for r in hot.collect() if r["t"] is not None), key=lambda r: (r["t"], r["id"])):
            k = r["key"] if by else None
            t, n = last.get(k, (None, 0))
            n += t is not None and r["t"] - t >= 7
            last[k] = (r["t"], n)
            want[r["id"]] = n
        assert {r["id"]: r["session"] for r in got if r["session"] is not None} == want and len(got) == 2000


@pytest.mark.parametrize(("rows", "groups"), [
    ([("a", 0.0, 0), ("b", 1000.0, -1), ("c", 5000.0, 0x5555555555555555)], [["a", "b"], ["c"]]),
    ([("a", 0.0, 0), ("b", 1500.0, -1)], [["a"], ["b"]]),
    ([("a", 0.0, 0), ("b", 9e5, 0x3000000000000000), ("c", 9e6, -1)], [["a", "b"], ["c"]]),
    ([("a", 0.0, 0), ("b", 1000.0, 0x3000000000000000), ("c", 5e5, 0x7000000000000000)], [["a", "b", "c"]]),
    ([("a", None, None), ("b", None, None)], [["a"], ["b"]]),
])
def test_groups(spark, rows, groups):
    out = similarity.group_items(spark.createDataFrame(rows, "path string, ts double, fp long"), F.col("ts"), 1500.0).collect()
    by = {}
    for r in out:
        by.setdefault(r["group_id"], []).append(r["path"])
    assert [sorted(by[k]) for k in sorted(by)] == groups


def test_reasons_and_normalisers(spark):
    c = Config()
    df = spark.sql("select 20d b, 0.9d o, 0d u, true closed, true face, cast(null as double) q")
    r = df.select(X.waste_reasons(F.col("b"), F.col("o"), F.col("u"), F.lit(True), F.col("closed"), F.col("face"), c).alias("r"), X.norm_quality(F.col("q")).alias("q"), X.norm_blur(F.lit(500.0)).alias("b"), X.hamming(F.lit(0).cast("long"), F.lit(None).cast("long")).alias("h"), X.hex_fingerprint(F.lit("3000000000000000")).alias("x")).first()
    assert r["r"] == ["blurred", "exposure", "duplicate", "eyes_closed"] and r["q"] == 0.5 and r["b"] == 1.0 and r["h"] == 255 and r["x"] == 0x3000000000000000


def test_upsert_updates_supplied_columns_only(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "path string, blur_score double, scene string")
    new = spark.createDataFrame([("b", 5.0, 2), ("b", 4.0, 1), ("c", 9.0, 1)], "path string, blur_score double, seq int")
    assert sorted(map(tuple, incremental.upsert(old, new, seq="seq").collect())) == [("a", 1.0, "x"), ("b", 5.0, "y"), ("c", 9.0, None)]
    with pytest.raises(Exception, match="row without a key"):
        incremental.upsert(old, spark.createDataFrame([(None, 1.0)], "path string, blur_score double")).collect()


def test_undo_cancels_a_decision(spark):
    log = spark.createDataFrame([(1, "a", "star", "3"), (2, "a", "pick", "X"), (3, "a", "undo", "2")], "seq long, path string, kind string, value string")
    assert decisions.fold(decisions.without_undone(log)).first()["star"] == 3
    assert decisions.fold(log).first()["star"] == 0
    odd = log.unionByName(spark.createDataFrame([(4, "a", "undo", "none"), (5, "a", "undo", None), (6, "b", "star", "many")], log.schema))
    assert {r["path"]: r["star"] for r in decisions.fold(decisions.without_undone(odd)).collect()} == {"a": 3, "b": None}


def _png(path, rows):
    h, w = len(rows), len(rows[0])
    raw = b"".join(b"\0" + bytes(v for p in r for v in (p, p, p)) for r in rows)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_images_and_scan(spark, tmp_path):
    rng = random.Random(1)
    _png(tmp_path / "flat.png", [[128] * 64] * 64)
    _png(tmp_path / "white.png", [[255] * 64] * 64)
    _png(tmp_path / "noise.PNG", [[rng.randrange(256) for _ in range(256)] for _ in range(256)])
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / ".hidden.png").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    names = {r["path"].rsplit("/", 1)[1] for r in files.scan_collection(spark, str(tmp_path)).collect()}
    assert names == {"flat.png", "white.png", "noise.PNG", "broken.png"}
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.image_features(spark, str(tmp_path)).collect()}
    assert got["flat.png"]["blur_score"] < 60 < got["noise.PNG"]["blur_score"] and got["white.png"]["over_ratio"] > 0.5
    assert not got["broken.png"]["ok"] and got["broken.png"]["fp"] is None


def test_ingest_stream_resumes_and_merges(spark, tmp_path):
    from assetloom.streaming.flows import compact, ingest

    src, deltas, snap = str(tmp_path / "in"), f"file://{tmp_path}/deltas", files.Snapshots(spark, f"file://{tmp_path}/snap")
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, x double").write.parquet(src)
    seen = spark.sparkContext.accumulator(0)

    def features(batch):
        def count(rows):
            for r in rows:
                seen.add(len(r))
                yield r

        return batch.mapInPandas(count, batch.schema).withColumn("y", F.col("x") * 2)

    run = lambda: ingest(spark, src, "path string, x double", features, deltas, str(tmp_path / "cp")).awaitTermination()
    run()
    assert compact(spark, deltas, snap) == 1 and seen.value == 2
    run()
    assert compact(spark, deltas, snap) is None and snap.version()[0] == 1
    spark.createDataFrame([("b", 5.0)], "path string, x double").write.mode("append").parquet(src)
    run()
    assert seen.value == 3  # a batch reads its own rows only
    assert compact(spark, deltas, snap) == 2
    assert sorted(map(tuple, snap.read().collect())) == [("a", 1.0, 2.0), ("b", 5.0, 10.0)]
    assert sorted(snap.read(back=1).select("x").toPandas()["x"])[0] == 1.0


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    """The same batch number is written again, as after a failure between writing and committing."""
    from assetloom.streaming.flows import compact, ingest

    src, deltas, snap = str(tmp_path / "in"), f"file://{tmp_path}/deltas", files.Snapshots(spark, f"file://{tmp_path}/snap")
    spark.createDataFrame([("a", 1.0)], "path string, x double").write.parquet(src)
    for checkpoint in ("one", "two"):
        ingest(spark, src, "path string, x double", lambda b: b, deltas, str(tmp_path / checkpoint)).awaitTermination()
    assert spark.read.parquet(deltas).count() == 1 and compact(spark, deltas, snap) == 1
    assert compact(spark, deltas, snap) is None and snap.read().count() == 1


def test_copy_plan_never_overwrites(spark):
    out = views.copy_plan(spark.createDataFrame([("/a/x.jpg", "x.jpg"), ("/b/x.jpg", "x.jpg"), ("/c/y", "y")], "path string, fname string")).collect()
    assert len({r["dst"] for r in out}) == 3
    out = views.copy_plan(spark.createDataFrame([("/a/x.jpg", "x.jpg"), ("/b/x.jpg", "x.jpg"), ("/c/x_2.jpg", "x_2.jpg"), ("/d/x_2.jpg", "x_2.jpg"), ("/e/x_2_2.jpg", "x_2_2.jpg"), ("/f/a.b.c", "a.b.c"), ("/g/a.b.c", "a.b.c")], "path string, fname string")).collect()
    assert len({r["dst"] for r in out}) == 7 and {r["src"]: r["dst"] for r in out}["/c/x_2.jpg"] == "photos/x_2.jpg"


def test_search_heeds_no_case_and_missing_fields(spark):
    df = spark.createDataFrame([("p", "IMG_001.JPG", None), ("q", "img-002.jpg", 1.0), ("r", "x%y.png", None)], "path string, fname string, quality double")
    find = lambda t: sorted(r["path"] for r in df.where(views.item_filter({"search": t})).collect())
    assert find("img") == ["p", "q"] and find("JPG") == ["p", "q"] and find("g_0") == ["p", "q"] and find("%y") == ["r"] and find("\\") == []
    assert sorted(r["path"] for r in views.missing(df, "quality").collect()) == ["p", "r"]
    assert views.missing(df, "no_such_field").collect() == [] and views.missing(df, "aesthetic").collect() == []


def test_known_columns_and_empty_updates(spark):
    df = spark.createDataFrame([("a", "f", 1)], "path string, fname string, other int")
    assert incremental.known_columns(df).columns == ["path", "fname"] and incremental.known_columns(df, ("other",)).columns == df.columns
    assert incremental.upsert(df, df.select("path"), insert=False).collect() == df.collect()
    more = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert sorted(map(tuple, incremental.upsert(df, more).collect())) == [("a", "f", 1), ("b", None, None)]


def test_simhash_equals_a_plain_one(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "bb", "ç", "d-d", "E"]) + str(rng.randrange(30)) for _ in range(rng.choice([1, 2, 7, 300])))) for i in range(60)] + [(99, ""), (98, None)]
    want = {}
    for i, t in rows:
        if t:
            hs = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in set(t.split())]
            v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
            want[i] = v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame(rows, "id long, t string")
    got = similarity.simhash(df, "id", F.filter(F.split("t", " "), lambda x: x != ""), ("t",)).collect()
    assert {r["id"]: r["fp"] for r in got} == want | {98: None, 99: None} and {(r["id"], r["t"]) for r in got} == set(rows)
    edges = np.array([0, 3, 3, 5])
    assert similarity.word_bits(pa.array(["x", "y", "z", "x", "y"]), edges, at_once=2).tolist() == similarity.word_bits(pa.array(["x", "y", "z", "x", "y"]), edges).tolist()


def test_words_of_whole_texts_equal_plain_ones(spark):
    """Words, distinct words, white space and fingerprint of texts with all kinds of white space, many distinct words or one that comes often; in slices of any size."""
    rng = random.Random(5)
    kinds = ["a", "B", "é", "İ", "\t", "\n", "\x0b", "\f", "\r", " ", "  ", "\x1c", "\x85", "\xa0", "9"]
    texts = ["".join(rng.choices(kinds, k=rng.randrange(120))) for _ in range(80)] + ["", " ", None, "a " * 70_000, " ".join(map(str, range(1300)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def plain(t):
        own = [w for w in re.split("[ \t\n\x0b\f\r]+", t or "") if w]
        hs = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in set(own)]
        v = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        return len(own), len(hs), len(re.findall("[ \t\n\x0b\f\r]", t or "")), (v - (1 << 64) if v >> 63 else v) if hs else None

    for at_once in (1, 500, 1 << 22):
        got = similarity.text_simhash(rows, "id", F.col("text"), ("text",), at_once).collect()
        assert {r["id"]: tuple(r)[2:] for r in got} == {i: plain(t) for i, t in enumerate(texts)} and {(r["id"], r["text"]) for r in got} == set(enumerate(texts))


def test_one_pass_over_the_text_equals_columns(spark, tmp_path):
    """Items with fingerprints have the metrics that items without them have, and the fingerprints of their words."""
    from assetloom import queries

    texts = [None, "", " \t", "Straße ÉÉ  x9\x0b!!\r\nx9 ", "日本 語, a-b\x1cB", "..."] + [f"{i} words of {i * 7} 'x' {'y ' * i}" for i in range(20)]
    spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.text_metrics_and_fp(queries.documents(spark, str(tmp_path)))
    plain = queries.text_metrics(spark, str(tmp_path))
    assert sorted(made.select(plain.columns).collect()) == sorted(plain.collect())
    fps = similarity.simhash(spark.read.parquet(f"{tmp_path}/documents.parquet"), "doc_id", queries.words(F.col("text")))
    assert sorted(made.select("doc_id", F.coalesce("fp", F.lit(0))).collect()) == sorted(fps.select("doc_id", F.coalesce("fp", F.lit(0))).collect())


def test_what_a_run_has_stored_reads_the_text_once(spark, monkeypatch):
    from assetloom import queries, session

    opened, sf = [], "/root/testdata/sf0.001"
    monkeypatch.setattr(queries, "table", lambda s, d, name: opened.append(name) or session.table(s, d, name))
    session.clear_shared(spark)
    stored = queries.stored_items(spark, sf)
    assert opened.count("documents") == 1 and stored.count() == spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 5 <> 0").count()
    session.clear_shared(spark)


def test_judging_by_top_members_equals_whole_ranks(spark):
    """A group with most of all rows, ties, and groups without clean members."""
    from assetloom.operators import verdict
    from pyspark.sql import window as W

    rng = random.Random(4)
    rows = [(f"p{i:03}", rng.choice([0, 0, 0, 0, 1, 2, 3 + i]), rng.choice([0.0, 20.0, 100.0, 150.0, 151.0]), rng.choice(["portrait", "other"]), rng.random(), rng.getrandbits(60)) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, group_id long, blur_score double, scene string, scene_conf double, fp long").withColumns({"over_ratio": F.lit(0.0), "under_ratio": F.lit(0.0), "aesthetic": F.lit(50.0), "quality": F.lit(None).cast("double"), "is_face": F.lit(False), "ear": F.lit(None).cast("double"), "eye_close_prob": F.lit(None).cast("double")})
    scored = verdict.score_items(df, Config())
    out = {r["path"]: r for r in verdict.judge(scored, Config()).collect()}
    ranks = {r["path"]: r for r in verdict.rank_in_group(scored).withColumn("n", F.count_if(~F.col("hard_waste")).over(W.Window.partitionBy("group_id"))).collect()}
    for p, r in out.items():
        rank = ranks[p]["rank"]
        assert r["rank"] == (rank if rank and rank <= 5 else None)
        assert r["is_best"] == (not r["is_uncertain"] and rank == 1)
        assert r["candidate_rank"] == (rank if r["is_uncertain"] and rank and rank <= min(5, ranks[p]["n"]) else 0)


def test_a_large_grid_and_many_classes_take_linear_time(spark):
    df = spark.range(20).select(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: (i * 37 % 101).cast("double")).alias("g"), F.transform(F.sequence(F.lit(1), F.lit(256)), lambda i: F.sqrt(i.cast("double"))).alias("l"))
    began = time.time()
    r = df.select(X.variance(F.col("g")).alias("v"), X.softmax(F.col("l")).alias("p")).collect()[-1]
    assert time.time() - began < 15  # each value was once visited for each other one: minutes
    x = np.arange(4096) * 37 % 101
    e = np.exp(np.sqrt(np.arange(1, 257)) - 16)
    assert np.isclose(r["v"], x.var()) and np.allclose(r["p"], e / e.sum())


def test_failing_scorers_leave_nulls(spark):
    from assetloom.operators import features

    def scorer(pdf):
        if len(pdf) > 1 and (pdf["x"] == 3).any():
            raise ValueError("batch")
        if (pdf["x"] == 3).any():
            raise ValueError("row")
        return pdf["x"] * 2.0

    got = {r["x"]: r["s"] for r in features.score_batches(spark.range(6).select(F.col("id").alias("x")).coalesce(1), scorer, "s").collect()}
    assert got == {0: 0.0, 1: 2.0, 2: 4.0, 3: None, 4: 8.0, 5: 10.0}


def test_kept_frames_are_forgotten_with_their_tables(spark):
    from assetloom import queries, session

    sf = "/root/testdata/sf0.001"
    queries.queries()["waste_set"](spark, sf).count()
    session.clear_shared(spark)
    assert queries.queries()["waste_set"](spark, sf).count() > 0


def test_group_members_are_those_of_all_groups(spark):
    import __spark_entry__ as e

    sf = "/root/testdata/sf0.001"
    got = [(r["group_id"], r["path"]) for r in e.queries()["group_members"](spark, sf).collect()]
    assert max(g for g, _ in got) >= 50
    assert sorted(got) == sorted((r["group_id"], r["path"]) for r in e.queries()["group_ids"](spark, sf).collect())


def test_a_model_is_loaded_once_in_each_worker(spark, tmp_path):
    """Twelve tasks in two jobs on four cores: no worker loads twice; a failing batch is scored row by row by the same model."""
    def load():
        import os
        import uuid

        (tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}").touch()
        return 10.0

    def score(pdf, model):
        if len(pdf) > 1 and (pdf["id"] == 3).any() or (pdf["id"] == 5).all():
            raise ValueError
        return pdf["id"] * model

    for _ in range(2):
        got = {r["id"]: r["v"] for r in features.score_batches(spark.range(0, 60, 1, 6), score, "v", load, "ten-1").collect()}
        assert got == {i: None if i == 5 else 10.0 * i for i in range(60)}
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert loads and len(loads) == len(set(loads))
    with pytest.raises(ValueError, match="name the model"):
        features.score_batches(spark.range(1), score, "v", load)


def test_no_row_is_made_of_fingerprints_that_are_far(spark):
    """Random fingerprints: what leaves the tasks that compare are close ones only, not all that share a band's value."""
    rng = random.Random(77)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(2500)]
    fps += [x ^ 5 << 20 for x in fps[:40]]
    rows = spark.createDataFrame([(x, x, x) for x in fps], "fp long, lead long, part long")
    near = {(x, y) for x in fps[:40] for y in (x ^ 5 << 20,)} | {(x ^ 5 << 20, x) for x in fps[:40]}
    met = similarity._meetings(rows, 12)[0]
    got = [(r["lead"], r["fp"]) for r in met.collect()]
    assert near <= set(got) and len(got) < 1000


@pytest.mark.parametrize(("leads", "queries"), [(1 << 17, 1 << 20), (16, 64)])
def test_pairs_of_deals_and_grids(spark, monkeypatch, leads, queries):
    """Deals of one task and of many: each close pair once, whichever of its bands are close; a hot band's value too."""
    monkeypatch.setattr(similarity, "LEADS", leads)
    monkeypatch.setattr(similarity, "QUERIES", queries)
    rng = random.Random(78)
    fps = {rng.getrandbits(64) - (1 << 63) for _ in range(300)} | {-1, 0, (1 << 63) - 1, -(1 << 63)}
    fps |= {(rng.getrandbits(47) << 16 | 0xABCD) for _ in range(200)}
    for x in list(fps)[:150]:
        for _ in range(rng.randrange(13)):
            x ^= 1 << rng.randrange(63)
        fps.add(x)
    fps = sorted(fps)
    rows = spark.createDataFrame([(f"p{i:04}", x) for i, x in enumerate(fps)], "path string, fp long")
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = sorted((f"p{i:04}", f"p{j:04}", far(fps[i], fps[j])) for i in range(len(fps)) for j in range(i + 1, len(fps)) if far(fps[i], fps[j]) < 12)
    assert sorted(tuple(r) for r in similarity.hamming_pairs(rows, "path", 12).collect()) == want


def test_fingerprints_that_no_pick_is_close_to_are_linked(spark, monkeypatch):
    """Few picks and many fingerprints of each band's value: those far from all picks keep their links."""
    monkeypatch.setattr(similarity, "FEW", 0)
    monkeypatch.setattr(similarity, "PICKS", 1)
    rng = random.Random(79)
    values = [0x0000, 0x00FF, 0xFF00, 0xFFFF, 0x0F0F, 0xF0F0]
    fps = {sum(v << 16 * k for k, v in enumerate(rng.choices(values, k=4))) for _ in range(150)}
    fps = sorted(x - (1 << 63) for x in fps | {x ^ 0x10001 for x in fps})
    rows = spark.createDataFrame([(f"p{i:04}", x) for i, x in enumerate(fps)], "path string, fp long")
    named = lambda edges: sorted(connected_components(edges).collect())
    want = named(similarity.hamming_pairs(rows, "path", 4))
    assert similarity._picked(rows.select("fp"), 4).count() == len(fps) == len(want)
    assert named(similarity.hamming_links(rows, "path", 4)) == want


def test_fingerprints_travel_as_arrays(spark, monkeypatch):
    """A batch sends a deal one row, however many of its fingerprints go there; of a pair's two ways one is compared."""
    sent = []
    dealt = similarity._dealt

    def watched(*args):
        sent.append(cut(dealt(*args)))
        return sent[-1]

    monkeypatch.setattr(similarity, "_dealt", watched)
    rng = random.Random(80)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(4000)]
    rows = spark.createDataFrame([(f"p{i:04}", x) for i, x in enumerate(fps)], "path string, fp long").coalesce(1)
    similarity.hamming_pairs(rows, "path", 12).collect()
    queries, leads = sent
    n = [df.agg(F.sum(F.size(c))).first()[0] for df, c in ((queries, "fp"), (leads, "lead"))]
    assert n[1] == 4 * 4000 and 3.5 * n[1] < n[0] < 4.5 * n[1]  # 7 of 8 deals are close to one; half of these, and its own
    assert queries.count() <= 2 * 32 and leads.count() <= 2 * 32


def test_picks_are_met_by_arrays(spark):
    """What a fingerprint meets is as by a plain search of all picks, and no row is made for each value near its bands."""
    rng = random.Random(81)
    fps = [rng.getrandbits(64) - (1 << 63) for _ in range(300)] + [-1, 0, -(1 << 63)]
    fps += [x ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) ^ 7 * k << 40 for x in fps for k in range(3)]
    df = spark.createDataFrame([(x,) for x in set(fps)], "fp long")
    picked = similarity._picked(df, 12)
    assert "Join" not in picked._jdf.queryExecution().toString()
    hashed = {r["fp"]: tuple(r)[1:] for r in df.select("fp", F.xxhash64(F.lit(-1), "fp"), *(F.xxhash64(F.lit(j), "fp") for j in range(similarity.PICKS))).collect()}
    band = lambda x, b: x >> 16 * b & 0xFFFF
    holds = {}
    for x in hashed:
        for b in range(4):
            holds.setdefault((b, band(x, b)), []).append(x)
    picks = {(at, min(xs, key=lambda x: hashed[x][1 + j])) for at, xs in holds.items() for j in range(similarity.PICKS)}
    for r in picked.collect():
        x = r["fp"]
        near = sorted((hashed[p][0], p, ((x ^ p) & (1 << 64) - 1).bit_count()) for p in {p for (b, v), p in picks if (v ^ band(x, b)).bit_count() <= 2})
        for name, most in (("lead", 5), ("reach", 11)):
            assert r[name] == next((p for _, p, d in near if d <= most), x)


def test_pairs_make_each_fingerprint_once(spark):
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(f"p{i:03}", i // 2 << 8) for i in range(200)], "path string, fp long").mapInArrow(make, "path string, fp long")
    assert similarity.hamming_pairs(rows, "path", 1).where("dist = 0").count() == 100
    assert made.value == 200
