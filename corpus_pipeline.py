"""Documents to training sequences: each stage works on all that the one before kept, and its decisions take effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm.decontaminate import contamination
from assetloom.llm.exact_dedup import exact_dedup
from assetloom.llm.ngram_join import jaccard_components
from assetloom.llm.packing import pack_documents
from assetloom.llm.queries import tokenizer_path
from assetloom.llm.toxicity import score_toxicity
from assetloom.session import CUTS, cut, drop_cuts, table


def _kept(docs: DataFrame, rejected: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Documents but those that `rejected(docs, key)` names in a column `key`.

    The key is `doc_id` where all ids differ. Where an id is null or comes again, rows are numbered first, in the order of
    ids with nulls last, and written, so that every row is decided on by itself.
    """
    odd = docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.join(rejected(docs, "doc_id").select(F.col("key").alias("doc_id")), "doc_id", "left_anti").select(docs.columns)
    order = F.asc_nulls_last("doc_id")
    rows = cut(docs.repartitionByRange(order).sortWithinPartitions(order).withColumn("row__", F.monotonically_increasing_id()))
    return rows.join(rejected(rows, "row__").select(F.col("key").alias("row__")), "row__", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go.

    Null and empty texts have the score of a text without n-grams. Repeated rows and rows with a null id are scored each.
    An empty table stays empty. Other columns are kept as they are.
    """
    labels = table(spark, sf_dir, "labels")
    return _kept(docs, lambda rows, key: score_toxicity(rows, labels, row=None if key == "doc_id" else key).where("predicted = 1").select(F.col(key).alias("key")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays; of rows with one id, or none but nulls, one.

    Null counts as empty, and empty texts equal each other. An empty table stays empty. Other columns are kept as they are.
    """
    return _kept(docs, lambda rows, key: exact_dedup(rows, id=key).where("not kept").select(F.col("doc_id").alias("key")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate texts (five-word shingles, Jaccard 0.8 or more, linked through others too) the smallest id stays.

    Texts that are null or have no words are linked with nothing and stay. Rows that repeat an id are documents each. An
    empty table stays empty. Other columns are kept as they are.
    """
    return _kept(docs, lambda rows, key: jaccard_components(rows, words=5, percent=80, id=key).where("component_id <> doc_id").select(F.col("doc_id").alias("key")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, by the contract's rule, go.

    Null and empty texts stay. Repeated rows and rows with a null id are judged each. An empty table stays empty, and with
    an empty benchmark all stay. Other columns are kept as they are.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return _kept(docs, lambda rows, key: contamination(rows, benchmark, id=key).where("contaminated").select(F.col("doc_id").alias("key")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens. Null and empty texts are one piece of the end id; repeated rows and null ids are packed each; an empty table gives no sequence."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("decontamination", decontamination), ("packing", packing)]

#: The toxicity classifier and the byte-pair ids are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again. The tables that a stage needed are removed once its result is written."""
    docs, used = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        before = len(CUTS)
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
            drop_cuts(spark, [*used, *CUTS[before:-1]])
            used = CUTS[-1:]
    return docs
