"""What is kept between runs: postings of names, and rollups that take back what changed."""

import random

import pytest
from pyspark.sql import functions as F

from assetloom.operators import rollups, search, views


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    rng = random.Random(21)
    names = ["".join(rng.choice("abAB_%é.1\\") for _ in range(rng.randrange(12))) for _ in range(300)] + ["IMG_0001.JPG", "img_0002.jpg", "ÉTÉ.png", None, ""]
    items = spark.createDataFrame([(f"/p/{i}", n) for i, n in enumerate(names)], "path string, fname string").cache()
    folder = f"file://{tmp_path_factory.mktemp('postings')}/p"
    search.write_postings(items, folder)
    return items, folder


@pytest.mark.parametrize("text", ["img_000", "a_b", "ab%b1", "été", "A.1", "ab", "_", "", "%%%", "aba", "\\ab", "no such name", "b1a%.a_"])
def test_search_equals_the_filter(spark, named, text):
    items, folder = named
    got = sorted(r["path"] for r in search.search(items, folder, text).collect())
    assert got == sorted(r["path"] for r in items.where(views.item_filter({"search": text})).collect())


def test_a_search_reads_few_files(spark, named):
    _, folder = named
    whole = len(spark.read.parquet(folder).inputFiles())
    found = search.candidates(spark, folder, "img_000")
    assert search.candidates(spark, folder, "ab_c") is None and found.count() == 2
    read = {r["f"] for r in spark.read.parquet(folder).where(F.col("part").isin([r["p"] for r in spark.range(1).select(F.explode(F.transform(search.trigrams(F.lit("img")), search._part)).alias("p")).collect()])).select(F.input_file_name().alias("f")).distinct().collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [part#" in plan and len(read) <= 4 < whole


def test_rollups_take_back_what_changed(spark):
    """Random changes, arrivals and departures, nulls among keys' groups and values: as if counted anew."""
    rng = random.Random(22)
    row = lambda i: (i, rng.choice(["a", "b", None]), rng.choice([1, 2, None]))
    old = [row(i) for i in range(200)]
    new = [row(i) if i % 10 == 3 else r for i, r in enumerate(old) if i % 7] + [row(300 + i) for i in range(9)] + [(999, "new", 5)]
    kind, sums = "id long, g string, v int", {"v": F.col("v"), "twos": (F.col("v") == 2).cast("int")}
    a, b = spark.createDataFrame(old, kind), spark.createDataFrame(new, kind)
    change = rollups.changes(a, b, "id", ["g", "v"])
    got = rollups.changed_rollup(rollups.rollup(a, ["g"], sums), change, ["g"], sums)
    want = rollups.rollup(b, ["g"], sums)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    touched = spark.createDataFrame([(i,) for i in range(1000) if i % 10 == 3 or i % 7 == 0 or i >= 300], "id long")
    assert sorted(map(tuple, rollups.changes(a, b, "id", ["g", "v"], touched).collect()), key=repr) == sorted(map(tuple, change.collect()), key=repr)
    assert rollups.changes(a, a, "id", ["g", "v"]).collect() == []
    gone = rollups.changes(a, a.where("false"), "id", ["g", "v"])
    assert rollups.changed_rollup(rollups.rollup(a, ["g"], sums), gone, ["g"], sums).collect() == []
