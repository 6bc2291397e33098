"""Whole runs over a collection: what is made anew, what stays, what a published version says."""

import pytest
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.operators import incremental
from assetloom.operators.progress import Phases, shares
from assetloom.plans import collection
from assetloom.sources.files import Snapshots
from assetloom.streaming.ledger import Ledger

SIG, ROOT = incremental.model_signature(q="musiq", aes="clip", eye="none"), "/photos"


def files_of(spark, n=8, touched=()):
    """n files; every third shares its fingerprint with the one before."""
    rows = [(f"{ROOT}/{i}.jpg", 1_700_000_000 + i + (1000 if i in touched else 0)) for i in range(n)]
    return spark.createDataFrame(rows, "path string, s long").select("path", F.timestamp_seconds("s").alias("mtime"))


class Stages:
    """Stand-ins for extraction and scoring that count the rows they see."""

    def __init__(self, spark):
        self.made, self.scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(self, rows, counter):
        def run(batches):
            for b in batches:
                counter.add(len(b))
                yield b

        return rows.mapInPandas(run, rows.schema)

    def features(self, rows):
        i = F.regexp_extract("path", r"(\d+)\.jpg", 1).cast("long")
        r = self.counted(rows.select("path"), self.made)
        return r.select("path", F.concat(i, F.lit(".jpg")).alias("fname"), F.timestamp_seconds(1_700_000_000 + i * 3600).alias("ts"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.when(i == 5, 20.0).otherwise(150.0 + i).alias("blur_score"), F.lit(0.0).alias("over_ratio"), F.lit(0.0).alias("under_ratio"), F.lit(False).alias("is_face"), ((i - F.pmod(i, F.lit(3))) * 0x123456789ABC).alias("fp"))

    def scores(self, rows):
        r = self.counted(rows.select("path"), self.scored)
        return r.select("path", F.lit(60.0).alias("aesthetic"), F.lit("landscape").alias("scene"), F.lit(0.9).alias("scene_conf"))

    def counts(self):
        out = self.made.value, self.scored.value
        self.made.value = self.scored.value = 0
        return out


@pytest.fixture
def run(spark, tmp_path):
    stages, target = Stages(spark), Snapshots(spark, f"file://{tmp_path}/items")

    def go(scanned, signature=SIG, root=ROOT, whole=False, **more):
        """A whole run, or its refreshing step alone, published in the same form."""
        if whole:
            out = collection.run_collection(target, scanned, stages.features, stages.scores, Config(), signature, root, **more)
        else:
            out = collection.refreshed(scanned, collection.published(target), stages.features, stages.scores, signature, root)
            target.publish(out.withColumns({"scene_auto": F.col("scene"), "scene_conf_auto": F.col("scene_conf")}), model_signature=signature, source_root=root)
        return {r["path"].rsplit("/", 1)[1]: r for r in out.collect()}, stages.counts()

    go.target = target
    return go


def patched(run, spark, path, **values):
    """Publish the current version with some values of one row changed."""
    df = run.target.read()
    run.target.publish(df.withColumns({k: F.when(F.col("path") == path, F.lit(v)).otherwise(F.col(k)).cast(dict(df.dtypes)[k]) for k, v in values.items()}))


def test_second_run_makes_nothing_anew(spark, run):
    first, made = run(files_of(spark), whole=True)
    assert made == (8, 8) and first["5.jpg"]["waste_reasons"] == "blurred,duplicate" and first["0.jpg"]["comp_score"] > 50
    assert first["0.jpg"]["group_id"] == first["2.jpg"]["group_id"] != first["3.jpg"]["group_id"]
    second, made = run(files_of(spark), whole=True)
    assert made == (0, 0)
    assert {k: r["group_id"] for k, r in second.items()} == {k: r["group_id"] for k, r in first.items()}
    assert {k: r["is_best"] for k, r in second.items()} == {k: r["is_best"] for k, r in first.items()}


def test_only_changed_new_and_lacking_files_are_extracted(spark, run):
    run(files_of(spark))
    out, made = run(files_of(spark, 9, touched={2, 3}))
    assert made == (3, 3) and len(out) == 9
    out, made = run(files_of(spark, 4, touched={2, 3}))
    assert made == (0, 0) and len(out) == 4  # what is no longer there is gone
    patched(run, spark, f"{ROOT}/1.jpg", blur_score=None, fp=None)
    out, made = run(files_of(spark, 4, touched={2, 3}))
    assert made == (1, 1) and out["1.jpg"]["blur_score"] == 151.0


def test_lacking_scores_are_made_without_features(spark, run):
    run(files_of(spark))
    patched(run, spark, f"{ROOT}/1.jpg", aesthetic=None, scene_auto=None)
    out, made = run(files_of(spark))
    assert made == (0, 1) and out["1.jpg"]["aesthetic"] == 60.0 and out["1.jpg"]["scene"] == "landscape"


def test_a_scene_set_by_hand_survives(spark, run):
    run(files_of(spark))
    patched(run, spark, f"{ROOT}/1.jpg", scene_manual="portrait")
    out, made = run(files_of(spark, touched={1}), whole=True)
    assert made == (1, 1) and (out["1.jpg"]["scene"], out["1.jpg"]["scene_manual"], out["1.jpg"]["scene_auto"]) == ("portrait", "portrait", "landscape")


@pytest.mark.parametrize("change", [{"signature": incremental.model_signature(q="dbcnn", aes="clip", eye="none")}, {"root": "/elsewhere"}])
def test_other_models_or_another_source_make_everything_anew(spark, run, change):
    run(files_of(spark))
    _, made = run(files_of(spark), **change)
    assert made == (8, 8)


def test_a_version_without_a_signature_counts_for_nothing(spark, run):
    run(files_of(spark))
    run.target.publish(run.target.read(), model_signature=None)
    assert run(files_of(spark))[1] == (8, 8)


def test_an_empty_collection(spark, run):
    assert run(files_of(spark, 0), whole=True) == ({}, (0, 0))
    assert run(files_of(spark, 2))[1] == (2, 2)


def test_unreadable_files_stay_and_are_tried_again(spark, run):
    stages = Stages(spark)
    some = lambda rows: stages.features(rows.where("path not like '%/3.jpg'"))
    made = collection.refreshed(files_of(spark), None, some, stages.scores, SIG, ROOT)
    run.target.publish(made.withColumns({"scene_auto": F.col("scene"), "scene_conf_auto": F.col("scene_conf")}), model_signature=SIG, source_root=ROOT)
    out = {r["path"]: r for r in made.collect()}
    assert len(out) == 8 and out[f"{ROOT}/3.jpg"]["fp"] is None
    assert run(files_of(spark))[1][0] == 1


class Dies(Exception):
    pass


def dying(stage, after):
    """A stage that fails from its batch number `after` on."""
    calls = [0]

    def run(rows):
        calls[0] += 1
        if calls[0] > after:
            raise Dies(f"batch {calls[0]}")
        return stage(rows)

    return run


def test_a_run_that_dies_goes_on_where_it_was(spark, tmp_path):
    """Killed after two of five batches of features, then after one of scores: later runs make the rest only, and publish what a whole run does."""
    stages, target, scanned = Stages(spark), Snapshots(spark, f"file://{tmp_path}/items"), files_of(spark, 10)
    go = lambda f, s, at=scanned: collection.run_collection(target, at, f, s, Config(), SIG, ROOT, batch_rows=2)
    with pytest.raises(Exception, match="batch 3"):
        go(dying(stages.features, 2), stages.scores)
    first, scored = stages.counts()
    assert 0 < first < 10 and not scored and target.read() is None
    with pytest.raises(Exception, match="batch 2"):
        go(stages.features, dying(stages.scores, 1))
    rest, scored = stages.counts()
    assert rest == 10 - first and 0 < scored < 10
    # a file that changed since then is made anew, what was finished for the others stays
    got = go(stages.features, stages.scores, files_of(spark, 10, touched={4})).orderBy("path").collect()
    made = stages.counts()
    assert made[0] == 1 and made[1] in (10 - scored, 11 - scored)  # 4.jpg may be among those that were scored
    whole = Snapshots(spark, f"file://{tmp_path}/whole")
    want = collection.run_collection(whole, files_of(spark, 10, touched={4}), stages.features, stages.scores, Config(), SIG, ROOT).orderBy("path").collect()
    assert got == want and stages.counts() == (10, 10)
    go(stages.features, stages.scores, files_of(spark, 10, touched={4}))
    assert stages.counts() == (0, 0)


def test_batches_of_a_run_read_their_own_rows_only(spark, monkeypatch):
    """No batch opens a table: what features and scores need comes with the rows of the scan."""
    from assetloom import queries

    def closed(*args, **named):
        with monkeypatch.context() as m:
            m.setattr(queries, "table", lambda *_: pytest.fail("a batch reads a whole table"))
            return whole(*args, batch_rows=90, **named)

    whole, sf = collection.run_collection, "/root/testdata/sf0.001"
    monkeypatch.setattr(collection, "run_collection", closed)
    got = sorted(map(tuple, queries.queries()["rerun_unchanged"](spark, sf).collect()))
    items = queries.full_items(spark, sf).select("fp", "aesthetic", "scene_conf").collect()
    lacking = [sum(r["fp"] is None for r in items), sum(None in tuple(r) for r in items)]
    assert got == [(1, len(items), len(items), len(items)), (2, *lacking, len(items))]


def test_carried_columns_reach_the_scores(spark, tmp_path):
    """Scores may read columns of the scan, in batches or at once; the items do not have them."""
    stages, scanned = Stages(spark), files_of(spark).withColumn("told", F.lit(0.25))
    scores = lambda rows: stages.scores(rows).join(rows.select("path", "told"), "path").withColumn("scene_conf", F.col("told")).drop("told")
    for ledger in (None, Ledger(spark, f"file://{tmp_path}/l", SIG, ROOT, batch_rows=3)):
        out = collection.refreshed(scanned, None, stages.features, scores, SIG, ROOT, ledger, carried=("told",))
        assert "told" not in out.columns and {r["scene_conf"] for r in out.collect()} == {0.25} and out.count() == 8


def test_unfinished_work_of_other_models_does_not_count(spark, tmp_path):
    stages, target = Stages(spark), Snapshots(spark, f"file://{tmp_path}/items")
    with pytest.raises(Exception, match="batch 2"):
        collection.run_collection(target, files_of(spark, 4), dying(stages.features, 1), stages.scores, Config(), SIG, ROOT, batch_rows=2)
    stages.counts()
    collection.run_collection(target, files_of(spark, 4), stages.features, stages.scores, Config(), "aes=other", ROOT, batch_rows=2)
    assert stages.counts() == (4, 4)


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    """Scores come as a queue: a failing batch leaves earlier ones in place, a replay replaces what it wrote."""
    ledger = Ledger(spark, f"file://{tmp_path}/l", SIG, ROOT, batch_rows=3)
    rows = spark.createDataFrame([(f"{i}", None, None if i % 4 else 1.0, None, 0.5) for i in range(9)], "path string, mtime timestamp, aesthetic double, scene string, scene_conf double")
    stages = Stages(spark)
    with pytest.raises(Exception, match="batch 3"):
        collection.second_stage(rows, dying(stages.scores, 2), ledger)
    scored = stages.counts()[1]
    assert 0 < scored < 9
    done = ledger.done("scores", f"path string, mtime timestamp, {collection.typed(*collection.SCORES)}")
    assert done.count() == scored
    out = {r["path"]: r for r in collection.second_stage(rows, stages.scores, ledger).collect()}
    assert stages.counts() == (0, 9 - scored) and len(out) == 9
    assert out["4"]["aesthetic"] == 1.0 and out["5"]["aesthetic"] == 60.0 and {r["scene"] for r in out.values()} == {"landscape"} and out["0"]["scene_conf"] == 0.5


def test_phases_of_a_run(spark, tmp_path):
    told = []
    watch = Phases(spark, lambda name, n: told.append((name, n)))
    collection.run_collection(Snapshots(spark, f"file://{tmp_path}/items"), files_of(spark), Stages(spark).features, Stages(spark).scores, Config(), SIG, ROOT, batch_rows=4, watch=watch)
    rows = {r["phase"]: r for r in watch.table().collect()}
    assert list(rows) == ["plan", "features", "scores", "group", "score", "publish"] and {r["rows"] for r in rows.values()} == {8}
    assert sum(n for name, n in told if name == "features") == 8 and [name for name, _ in told].count("features") == 2 and told[-1] == ("publish", 8)
    assert abs(sum(r["seconds"] for r in rows.values()) - sum(e["seconds"] for e in watch.ended)) < 1e-6 and abs(sum(r["share"] for r in rows.values()) - 100) < 1e-6
    assert Phases(spark).table().collect() == []
    seen = Phases(spark)
    seen.run("x", spark.range(7), lambda df: df.collect(), top=F.max("id"))
    assert seen.ended[0]["rows"] == 7 and seen.ended[0]["also"] == {"top": "6"}
    assert [r["share"] for r in shares(spark.sql("select * from values (0.0), (0.0) t(v)"), "v").collect()] == [None, None]


def test_signature_and_source_rules(spark):
    assert SIG == incremental.model_signature(eye="none", aes="clip", q="musiq") == "aes=clip|eye=none|q=musiq"
    prior = spark.createDataFrame([("a", SIG, ROOT), ("b", None, ROOT), ("c", SIG, None), ("d", SIG, "/x"), ("e", "old", ROOT)], "path string, model_signature string, source_root string")
    assert sorted(r["path"] for r in incremental.usable_prior(prior, SIG, ROOT).collect()) == ["a", "c"]
    assert incremental.usable_prior(prior.select("path"), SIG).collect() == [] and incremental.usable_prior(prior.select("path"), None, ROOT).count() == 5


def test_snapshots_keep_meta_and_few_versions(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/s")
    assert s.read() is None and s.version() is None and s.meta("x") is None
    for i in range(4):
        assert s.publish(spark.range(i + 1), **({"x": str(i)} if i < 2 else {"y": "z"})) == i + 1
    assert s.meta("x") == "1" and s.meta("y") == "z" and s.read().count() == 4 and s.read(back=2).count() == 2
    s.keep(2)
    assert s.read(back=1).count() == 3 and s.read(back=2) is None and s.publish(spark.range(9)) == 5
    s.clear()
    assert s.read() is None and s.publish(spark.range(1)) == 1
