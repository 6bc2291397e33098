"""What jobs leave on disk: shuffle files of cut tables, and tables that nothing reads any more."""

from pyspark.sql import functions as F

from assetloom.llm.ngram_join import jaccard_components
from assetloom.operators.components import connected_components
from assetloom.session import CUTS, NO_SHUFFLES_LEFT, cut


def _blocks(spark):
    """Shuffle blocks' status is known for so many shuffles."""
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()


def test_a_cut_leaves_no_shuffle(spark):
    before, setting = _blocks(spark), spark.conf.get(NO_SHUFFLES_LEFT, None)
    df = cut(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert df.count() == 7 and sum(r["count"] for r in df.collect()) == 1000
    assert _blocks(spark) <= before + 1  # the count's own, and not those of the cut
    assert spark.conf.get(NO_SHUFFLES_LEFT, None) == setting


def test_a_join_of_sets_keeps_only_what_its_result_reads(spark):
    rows = [(i, " ".join(f"w{i // 2}x{j}" for j in range(30)) + (" end" if i % 2 else "")) for i in range(60)]
    mark = len(CUTS)
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=80)
    assert len(CUTS) - mark == 3  # scanned texts, sets, components
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == {i: i - i % 2 for i, _ in rows}


def test_rounds_of_components_do_not_pile_up(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    mark = len(CUTS)
    out = connected_components(edges, small=0)
    assert len(CUTS) - mark == 1
    assert out.count() == 201 and {r["component"] for r in out.collect()} == {0}
