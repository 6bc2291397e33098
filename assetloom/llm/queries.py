"""The operators' queries over the shared tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.llm import line_dedup, url_filters
from assetloom.llm.conversation_trie import conversation_trie
from assetloom.llm.decontaminate import contamination
from assetloom.llm.exact_dedup import exact_dedup
from assetloom.llm.fill_middle import fill_in_middle
from assetloom.llm.license_scan import scan_licenses
from assetloom.llm.line_dedup import drop_boilerplate
from assetloom.llm.ngram_join import jaccard_components
from assetloom.llm.packing import pack_documents
from assetloom.llm.quality import score_quality
from assetloom.llm.simhash import simhash_dedup
from assetloom.llm.suffix_dedup import repeated_bytes
from assetloom.llm.toxicity import score_toxicity
from assetloom.llm.url_filters import filter_urls
from assetloom.session import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    best = F.try_element_at("licenses", F.lit(1))
    names = F.array_join(F.array_sort(F.transform("licenses", lambda x: x["license"])), ",")
    return found.select("doc_id", best["license"].alias("license"), best["coverage"].alias("coverage"), best["first_word"].alias("first_word"), best["last_word"].alias("last_word"), names.alias("all_licenses"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP3_SQL = f"""
WITH p AS (SELECT page_id, lower(coalesce(regexp_extract(url, {_q(line_dedup.HOST)}, 1), '')) AS host,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), {_q(line_dedup.HIDDEN)}, '', 'g'), {_q(line_dedup.BREAK)}, chr(10), 'g'), {_q(line_dedup.TAG)}, '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM pages),
l AS (SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM p),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM l GROUP BY host, line) JOIN t USING (host) WHERE n > 1 AND n > 0.1 * pages),
d AS (SELECT l.page_id, list(l.line) AS gone FROM l JOIN c ON l.host = c.host AND l.line = c.line GROUP BY l.page_id),
k AS (SELECT p.page_id, p.host, p.lines, list_filter(p.lines, lambda x: NOT coalesce(list_contains(d.gone, x), false)) AS kept FROM p LEFT JOIN d USING (page_id))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""


def dated_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list made from the pages' own hosts, parent domains and path prefixes: all registrable domains (the hot ones too) and some of the others are added, removed and added again."""
    named = table(spark, sf_dir, "pages").select(F.explode(url_filters.url_keys(F.col("url"))).alias("k")).select("k.kind", "k.pattern").distinct()
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "kind", "pattern")), 1, 4), 16, 10).cast("int")
    labels = F.size(F.split("pattern", r"\."))
    listed = named.withColumn("h", h).where(((F.col("h") % 5 == 0) & (labels >= 3)) | ((F.col("kind") == "domain") & (labels == 2)))
    steps = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(d).alias("after")) for a, d in (("add", 0), ("remove", 60), ("add", 120))))
    s = listed.select("kind", "pattern", "h", F.explode(steps).alias("s"))
    return s.select("kind", "pattern", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("h") % 200 + F.col("s.after"))).alias("at"), F.col("s.action").alias("action"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a fetch time within one year."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.withColumn("fetched_at", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("page_id") * 37 % 365).cast("int")))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = captures(spark, sf_dir)
    v = filter_urls(c, dated_list(spark, sf_dir)).withColumnsRenamed({"url": "v_url", "at": "v_at"})
    out = c.join(v, F.col("url").eqNullSafe(F.col("v_url")) & F.col("fetched_at").eqNullSafe(F.col("v_at")), "left")
    return out.select("page_id", "url", "fetched_at", "blocked", "n_active", "first_pattern")


OP4_SQL = f"""
WITH u AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days((page_id * 37 % 365)::INT) AS fetched_at,
  lower(coalesce(regexp_extract(url, {_q(line_dedup.HOST)}, 1), '')) AS host,
  list_filter(string_split(coalesce(regexp_extract(url, {_q(url_filters.PATH)}, 1), ''), '/'), lambda x: x <> '') AS seg FROM pages),
k AS (SELECT page_id, url, fetched_at, 'host' AS kind, host AS pattern FROM u WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_at, 'domain', array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') FROM u, unnest(range(1, len(string_split(host, '.')) + 1)) r(i) WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_at, 'prefix', host || '/' || array_to_string(list_slice(seg, 1, i), '/') FROM u, unnest(range(1, len(seg) + 1)) r(i) WHERE host <> ''),
n AS (SELECT DISTINCT kind, pattern, ('0x' || substr(md5(kind || ':' || pattern), 1, 4))::INT AS h FROM k),
e AS (SELECT kind, lower(split_part(pattern, '/', 1)) || substr(pattern, length(split_part(pattern, '/', 1)) + 1) AS pattern, TIMESTAMP '2024-01-01' + to_days(h % 200 + a) AS at, act FROM n, (VALUES ('add', 0), ('remove', 60), ('add', 120)) s(act, a) WHERE (h % 5 = 0 AND len(string_split(pattern, '.')) >= 3) OR (kind = 'domain' AND len(string_split(pattern, '.')) = 2)),
m AS (SELECT k.page_id, k.url, k.fetched_at, k.kind, k.pattern, e.act FROM k ASOF LEFT JOIN e ON k.kind = e.kind AND k.pattern = e.pattern AND k.fetched_at >= e.at)
SELECT u.page_id, u.url, u.fetched_at, coalesce(bool_or(m.act = 'add'), false) AS blocked, count(*) FILTER (m.act = 'add')::BIGINT AS n_active, min(m.kind || ':' || m.pattern) FILTER (m.act = 'add') AS first_pattern
FROM u LEFT JOIN m ON u.page_id = m.page_id GROUP BY u.page_id, u.url, u.fetched_at
"""


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("spans")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest=True)


OP9_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(0), ' ', 'g'), '[^\x01-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(0), ' ', 'g'), '[^\x01-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) r(i) WHERE len(w) > 0),
x AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s FROM d, (SELECT DISTINCT m FROM p) q, unnest(range(1, greatest(0, len(w) - m + 1) + 1)) r(i)),
h AS (SELECT x.doc_id, x.i, x.m, p.item FROM x JOIN p ON x.m = p.m AND x.s = p.s),
c AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM h), unnest(range(i, i + m)) r(j) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
p AS (SELECT doc_id, t, n, [('0x' || substr(h, 8 * k - 7, 8))::BIGINT FOR k IN [1, 2, 3, 4]] AS x FROM d),
f AS (SELECT doc_id, t, n, least(x[1] % (n + 1), x[2] % (n + 1)) AS lo, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM p),
o AS (SELECT doc_id, n, form, lo, hi, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substr(t, 1, lo) || '<S>' || substr(t, hi + 1) || '<M>' || substr(t, lo + 1, hi - lo) ELSE '<S>' || substr(t, hi + 1) || '<P>' || substr(t, 1, lo) || '<M>' || substr(t, lo + 1, hi - lo) END AS out FROM f),
b AS (SELECT *, string_split(out, '<M>') AS m FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END::BIGINT AS middle_chars, sha256(out) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN out WHEN 'psm' THEN string_split(substr(m[1], 4), '<S>')[1] || m[2] || string_split(substr(m[1], 4), '<S>')[2] ELSE string_split(substr(m[1], 4), '<P>')[2] || m[2] || string_split(substr(m[1], 4), '<P>')[1] END) AS restored_sha256 FROM b
"""


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: Each node's own share of saved tokens and leaves goes to its least member; a node's sums are then its members' shares from its depth on.
OP12_SQL = """
WITH t AS (SELECT conv_id, tok, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tok) AS pos FROM (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS tok, length(coalesce(text, ''))::BIGINT AS chars FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.pos, tok, chars FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h UNION ALL SELECT c.conv_id, 1, t.pos, tok, chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
d AS (SELECT conv_id, row_number() OVER w AS depth, chars, md5(string_agg(tok, '') OVER w) AS node, md5(coalesce(string_agg(tok, '') OVER (PARTITION BY conv_id ORDER BY part, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS up, lead(pos) OVER (PARTITION BY conv_id ORDER BY part, pos) IS NULL AS last FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, md5(''), NULL, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (SELECT depth, node, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*)::BIGINT AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM d GROUP BY depth, node),
k AS (SELECT n.*, coalesce(m.n_children, 0)::BIGINT AS n_children FROM n LEFT JOIN (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2) m USING (depth, node)),
s AS (SELECT d.depth, d.node, sum(CASE WHEN k.conv_id = d.conv_id THEN (k.n_convs - 1) * k.chars ELSE 0 END) OVER w AS saved, sum(CASE WHEN k.conv_id = d.conv_id AND k.n_children = 0 THEN 1 ELSE 0 END) OVER w AS leaves FROM d JOIN k USING (depth, node) WINDOW w AS (PARTITION BY d.conv_id ORDER BY d.depth DESC ROWS UNBOUNDED PRECEDING)),
g AS (SELECT depth, node, sum(saved)::BIGINT AS saved_tokens, sum(leaves)::BIGINT AS n_leaves FROM s GROUP BY depth, node)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, g.n_leaves, g.saved_tokens, k.ends_sha256 FROM k JOIN g USING (depth, node) LEFT JOIN n p ON p.depth = k.depth - 1 AND p.node = k.up
"""


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def queries() -> dict:
    from corpus_pipeline import run

    own = (op1_license_scan, op2_quality, op3_line_dedup, op4_url_filters, op5_ngram_jaccard, op6_best_fit_packing, op7_toxicity, op8_suffix_dedup, op9_exact_dedup, op10_decontamination, op11_fill_middle, op12_conversation_trie, op13_simhash_dedup)
    return {f.__name__: f for f in own} | {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op4_url_filters": OP4_SQL, "op9_exact_dedup": OP9_SQL, "op10_decontamination": OP10_SQL, "op11_fill_middle": OP11_SQL, "op12_conversation_trie": OP12_SQL}
