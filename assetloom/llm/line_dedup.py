"""Line dedup by site-relative frequency: lines that a large share of a host's pages repeat are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetloom.session import cut

#: Fixed patterns, for Java and RE2 alike: what is not content, tags that end a line, other tags, a URL's host.
HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BREAK = r"(?i)</?(?:p|div|li|ul|ol|br|h[1-6]|nav|article|footer|header|section|table|tr|td|th|title|body|head|html|main|aside)(?:\s[^>]*)?/?>"
TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def html_lines(html: Column) -> Column:
    """Non-empty trimmed lines of a page, in order."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, ""), BREAK, "\n"), TAG, "")
    return F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", most: float = 0.1, lines: Column | None = None) -> DataFrame:
    """Per page: `page_id`, `host`, `n_lines`, `n_dropped`, `text` (the lines that stay, joined by line feeds).

    A line is dropped from a host's pages if the pages that hold it are more than `most` of the host's pages and it
    repeats at all: what one page alone holds is no boilerplate, however few pages the host has. A page counts a line
    once. `lines` may give the lines of plain text instead of HTML.

    Lines are counted by an md5 of the line, partially in each task, so one host or line with a third of all rows
    moves one row from each task. Only a page's boilerplate hashes travel to the page; pages are told apart by id, host
    and a hash of their lines. Null pages have no lines; null or odd URLs share the host ''. Every row counts as a page of
    its own and is cleaned by its own host, also where ids repeat or are null. Other columns are not read; an empty table
    gives an empty result.
    """
    rows = pages.select(F.col(id).alias("page_id"), host_of(F.col(url)).alias("host"), (html_lines(F.col(html)) if lines is None else lines).alias("lines"))
    rows = rows.withColumn("own", F.xxhash64("lines"))
    keyed = cut(rows.select("page_id", "host", "own", F.transform(F.array_distinct("lines"), lambda x: F.unhex(F.md5(x))).alias("keys")))
    totals = cut(keyed.groupBy("host").agg(F.count("*").alias("pages")))
    each = keyed.select("page_id", "host", "own", F.explode("keys").alias("key"))
    counts = each.groupBy("host", "key").agg(F.count("*").alias("n")).where("n > 1")
    common = cut(counts.join(totals, "host").where(F.col("n") > most * F.col("pages")).select("host", "key"))
    # a set: rows that are equal in all three bring the same keys; cut, so that a key with many rows can be split from its rows
    marked = cut(each.join(common, ["host", "key"]).groupBy("page_id", "host", "own").agg(F.collect_set("key").alias("drop"))).withColumnsRenamed({"page_id": "marked_id", "host": "marked_host", "own": "marked_own"})
    kept = F.filter("lines", lambda x: ~F.coalesce(F.array_contains("drop", F.unhex(F.md5(x))), F.lit(False)))
    met = F.col("page_id").eqNullSafe(F.col("marked_id")) & (F.col("host") == F.col("marked_host")) & (F.col("own") == F.col("marked_own"))
    joined = rows.join(marked, met, "left").withColumn("kept", kept)
    return joined.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
