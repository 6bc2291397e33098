"""URL filters by a temporal list: dated entries become validity intervals, from one switch of a pattern to its next, and an as-of join finds the one that each capture was fetched in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from assetloom.llm.line_dedup import host_of
from assetloom.operators.places import carry, ranged
from assetloom.session import cut

PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)"


def url_keys(url: Column, depth: Column | None = None) -> Column:
    """What an entry can name: `host` the host, `domain` it or a parent domain, `prefix` the host and first path segments.

    `depth`, where given, is the most segments that any entry has; longer prefixes could meet none and are left out.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    segments = F.filter(F.split(F.coalesce(F.regexp_extract(url, PATH, 1), F.lit("")), "/"), lambda x: x != "")
    prefixes = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(segments), F.lit(1))), lambda i: (i <= F.size(segments)) & (F.lit(True) if depth is None else i <= depth)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("pattern")))
    keys = F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"))), domains, prefixes)
    return F.when(host != "", keys).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))


def switches(entries: DataFrame) -> DataFrame:
    """`(kind, pattern, t, on)`: what holds for a pattern from each of its dates on, until its next one.

    `entries` has kind, pattern, at, action ('add' or 'remove'); of entries with one time the 'remove' wins. Entries
    with nulls are void; an 'add' of what is listed, or a 'remove' of what is not, changes nothing. The case of a
    pattern's host does not count, that of its path does.
    """
    host = F.substring_index("pattern", "/", 1)
    pattern = F.concat(F.lower(host), F.expr("substring(pattern, length(substring_index(pattern, '/', 1)) + 1)"))
    e = entries.select("kind", pattern.alias("pattern"), F.col("at").alias("t"), (F.col("action") == "add").alias("on")).where("kind is not null and pattern is not null and t is not null and on is not null")
    return e.groupBy("kind", "pattern", "t").agg(F.min("on").alias("on"))


def as_of(keys: DataFrame, listed: DataFrame) -> DataFrame:
    """`keys(url, at, kind, pattern)` with `on`, the last switch of the pattern at or before that time; null before the first.

    Both are dealt together by ranges of pattern and time, so a pattern with most of all captures, or of all dates, is many
    tasks; each part gets the last switch of the parts before it that have the same pattern.
    """
    both = keys.withColumns({"t": F.col("at"), "seen": F.lit(1)}).unionByName(listed.withColumn("seen", F.lit(0)), allowMissingColumns=True)
    by = ["kind", "pattern"]
    rows = ranged(both, by, [F.col("t"), F.col("seen")])
    last = lambda w: F.last("on", ignorenulls=True).over(w)
    local = last(W.Window.partitionBy("part__", *by).orderBy("t", "seen").rowsBetween(W.Window.unboundedPreceding, 0))
    ends = rows.groupBy("part__", *by).agg(F.max_by("on", F.when(F.col("on").isNotNull(), F.struct("t", "seen"))).alias("on"))
    before = ends.select("part__", *by, last(W.Window.partitionBy(*by).orderBy("part__").rowsBetween(W.Window.unboundedPreceding, -1)).alias("before")).where("before is not null")
    return carry(rows.withColumn("local", local).where("seen = 1"), by, before).select("url", "at", *by, F.coalesce("local", "before").alias("on"))


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """Distinct `(url, at)` of the captures with `blocked`, `n_active` (patterns that hold) and `first_pattern` (least of them).

    Every capture is judged at its own fetch time: an entry holds from its date to before the date it was removed. Only
    keys of captures that some entry names are looked up (`as_of`). Callers join the verdicts back by URL and time. A
    capture yields the prefixes of its path down to the deepest that is listed.

    Null, empty or odd URLs match nothing; a null time is before every entry. Repeated captures share one verdict. Other
    columns are not read; with no entries nothing is blocked, without captures the result is empty.
    """
    c = captures.select(F.col(url).alias("url"), F.col(at).alias("at")).distinct()
    listed = cut(switches(entries))
    names = cut(listed.select("kind", "pattern").distinct())
    deepest = names.where("kind = 'prefix'").agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("depth"))  # one row
    keys = c.crossJoin(F.broadcast(deepest)).select("url", "at", F.explode(url_keys(F.col("url"), F.col("depth"))).alias("key")).select("url", "at", "key.kind", "key.pattern")
    held = as_of(keys.join(names, ["kind", "pattern"], "left_semi"), listed).where("on")
    found = held.groupBy("url", "at").agg(F.count("*").alias("n"), F.min(F.concat_ws(":", "kind", "pattern")).alias("first_pattern")).withColumnsRenamed({"url": "url_", "at": "at_"})
    out = c.join(found, F.col("url").eqNullSafe(F.col("url_")) & F.col("at").eqNullSafe(F.col("at_")), "left")
    return out.select("url", "at", F.col("n").isNotNull().alias("blocked"), F.coalesce("n", F.lit(0)).alias("n_active"), "first_pattern")
