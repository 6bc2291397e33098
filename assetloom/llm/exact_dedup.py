"""Exact dedup by progressive refinement: length, then a hash of the head, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetloom.session import cut

#: Runs of ASCII white space count as one space.
SPACE = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", head_chars: int = 256, digest: bool = False) -> DataFrame:
    """Which row of equal texts stays.

    Returns per input row: `doc_id`, `keep_id` (smallest id of the rows with an equal text), `group_size`, `kept`,
    and with `digest` also `text_sha256` of the normalised text.

    Lengths are counted first; rows whose length occurs once are settled. The rest compare a hash of the first
    `head_chars` characters; only rows that still share length and head have their whole text hashed. Each grouping
    is a partial aggregate, so a text that fills a third of the table is one key with one row from each task.

    Null texts count as empty; empty texts equal each other. Rows that repeat an id each count in `group_size` and
    share its `kept`. A null id never wins over an id; where all ids of a group are null, its rows stay. Other
    columns are not read, whatever their names; an empty table gives an empty result.
    """
    whole = F.sha2(F.encode("t", "UTF-8"), 256)
    rows = docs.select(F.col(id).alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ").alias("t"))
    rows = rows.select("doc_id", "t", F.length("t").alias("size"), F.xxhash64(F.substring("t", 1, head_chars)).alias("head"))
    # counts are cut before they are joined back, so that Spark may split a hot key's rows in the join
    brief = cut(rows.select("size", "head"))
    sizes = cut(brief.groupBy("size").count().where("count > 1"))
    open_ = cut(brief.join(sizes, "size", "left_semi").groupBy("size", "head").count().where("count > 1").select("size", "head", F.lit(True).alias("open")))

    # where every text's hash is asked for, only hashes travel; else the text does, and only what is open is hashed
    sent = rows.withColumn("text_sha256", whole).drop("t") if digest else rows
    full = F.when(F.col("open"), F.col("text_sha256") if digest else whole).alias("full")
    hashed = cut(sent.join(open_, ["size", "head"], "left").select("doc_id", "size", full, *(["text_sha256"] if digest else [])))
    groups = cut(hashed.where("full is not null").groupBy("size", "full").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"))
    return hashed.join(groups, ["size", "full"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("keep_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept"),
        *(["text_sha256"] if digest else []),
    )
