"""Queries of the core operators over the shared tables, and SQL that gives the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.config import Config
from assetloom.functions import exprs as X
from assetloom.operators import components, decisions, features, incremental, progress, rollups, search, similarity, verdict, views
from assetloom.plans import collection
from assetloom.plans import curate as plan
from assetloom.session import KEPT, cut, shared_dir, table
from assetloom.sources import files
from assetloom.streaming import flows

#: Events cover 30 days, so the test collection's bursts use a wider gap than a camera's.
CONFIG = Config(burst_gap_ms=5000.0)
_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = "", changed: dict[str, str] | None = None) -> Callable:
    """Register a query under its function's name; `uses` names the common tables that its SQL needs, `changed` has those that differ."""
    def add(f: Callable) -> Callable:
        _Q[f.__name__] = f
        if sql:
            tables = CTES | (changed or {})
            names = [n for n in tables if n in closure(uses.split())]
            _SQL[f.__name__] = ("WITH RECURSIVE " + ", ".join(f"{n} AS ({tables[n]})" for n in names) + " " if names else "") + sql
        return f

    return add


def words(text):
    return F.array_remove(F.split(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+"), "")


def documents(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """All documents, or those whose `doc_id` is in `only`."""
    docs = table(spark, d, "documents")
    return docs if only is None else docs.join(only, "doc_id", "left_semi")


def odd_share():
    """Share of characters that are neither letters nor white space, which are removed by runs."""
    t = F.coalesce("text", F.lit(""))
    return F.length(F.regexp_replace(t, r"[\p{L}\s]+", "")) / F.greatest(F.length(t), F.lit(1))


def text_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Words and shares of characters of each document, as columns of which only those that are used are made."""
    t, w = F.coalesce("text", F.lit("")), F.col("w")
    rows = documents(spark, d).select("doc_id", "source", words(F.col("text")).alias("w"), odd_share().alias("odd"), ((F.length(t) - F.length(F.regexp_replace(t, r"\s+", ""))) / F.greatest(F.length(t), F.lit(1))).alias("blank"))
    return rows.select("doc_id", "source", F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct"), "odd", "blank")


def text_metrics_and_fp(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The same with fingerprints, in one pass over the text of documents `(doc_id, source, text, *also)`."""
    rows = docs.select("doc_id", "source", "text", *also, odd_share().alias("odd"), F.greatest(F.length("text"), F.lit(1)).alias("size"))
    made = similarity.text_simhash(rows, "doc_id", F.lower("text"), ("source", "odd", "size", *also))
    return made.select("doc_id", "source", "n_words", "n_distinct", "odd", (F.col("n_blank") / F.col("size")).alias("blank"), "fp", *also)


#: What items take from events and labels.
TOLD = ("ts", "event_type", "value", "props", "quality", "toxic")


def told(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    """Documents with what events and labels tell of them."""
    e = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "props")
    lab = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    return docs.join(e, "doc_id", "left").join(lab, "doc_id", "left")


def scene_columns():
    """Scores of an item: the columns of `collection.SCORES`."""
    scene = F.when(F.col("event_type") == "purchase", "portrait").when(F.col("event_type") == "view", "landscape").otherwise("other")
    return [F.least(F.lit(100.0), "value").alias("aesthetic"), scene.alias("scene"), (F.regexp_extract("props", r"(\d+)", 1).cast("double") / 100.0).alias("scene_conf")]


def items(spark: SparkSession, d: str, also: tuple[str, ...] = (), doc: DataFrame | None = None) -> DataFrame:
    """Documents as items: times and scenes from events, quality from labels, metrics from the text (`doc`, where they are made already)."""
    return as_items(told(spark, d, text_metrics(spark, d) if doc is None else doc), also)


def as_items(rows: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Items of documents with their metrics and what was told of them."""
    c = CONFIG
    df = rows.withColumns({"ear": 0.10 + F.pmod("doc_id", F.lit(30)) / 100.0, "quality": (F.col("quality") * 100.0).cast("double")})
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))
    aesthetic, scene, scene_conf = scene_columns()
    return df.select(
        "doc_id", F.concat(F.lit("/"), "source", F.lit("/"), name).alias("path"), name.alias("fname"), "ts", (F.unix_micros("ts") / 1000.0).alias("ts_ms"), scene, scene_conf,
        F.coalesce(200.0 * F.col("n_distinct") / F.when(F.col("n_words") > 0, F.col("n_words")), F.lit(0.0)).alias("blur_score"), F.least(F.lit(1.0), 2.0 * F.col("odd")).alias("over_ratio"), F.least(F.lit(1.0), 2.7 * F.col("blank")).alias("under_ratio"),
        aesthetic, "quality", F.col("toxic").isNotNull().alias("is_face"), "ear",
        F.when((F.col("ear") >= c.ear_closed) & (F.col("ear") <= c.gate_high), F.pmod(F.col("doc_id") * 13, F.lit(100)) / 100.0).alias("eye_close_prob"), *also,
    )


def doc_path():
    """A document's path as an item."""
    return F.concat(F.lit("/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt")).alias("path")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(doc_path(), "text")
    return similarity.text_simhash(docs, "path", F.lower("text")).select("path", "n_distinct", "fp").where("fp is not null")


def full_items(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """Items with fingerprints, in one pass over the text; of all documents, or of those that `only` names."""
    return cut(items(spark, d, ("fp",), text_metrics_and_fp(documents(spark, d, only))))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """The curated collection; kept for the session, as many views read it. `session.clear_shared` forgets it."""
    key = ("judged", spark.sparkContext.applicationId, d)
    if key not in KEPT:
        KEPT[key] = cut(plan.curate(full_items(spark, d), CONFIG).withColumn("label", F.when(F.pmod("doc_id", F.lit(17)) == 0, "P").when(F.pmod("doc_id", F.lit(19)) == 0, "X")))
    return KEPT[key]


def prior(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """A stored state: four fifths of the items (`made`, where they are made already), some with other times, some without a fingerprint."""
    i = (items(spark, d) if made is None else made).where("doc_id % 5 <> 0")
    return i.select("doc_id", "path", F.when(F.col("doc_id") % 7 == 0, F.timestamp_micros(F.unix_micros("ts") + 60_000_000)).otherwise(F.col("ts")).alias("mtime"), "blur_score", F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("fp"), F.when(F.col("doc_id") % 13 != 0, F.col("aesthetic")).alias("aesthetic"), "scene")


CTES = {
    "items": r"""SELECT d.doc_id, '/' || d.source || '/' || lpad(d.doc_id::VARCHAR, 8, '0') || '.txt' AS path, lpad(d.doc_id::VARCHAR, 8, '0') || '.txt' AS fname, e.ts, epoch_us(e.ts) / 1000.0::DOUBLE AS ts_ms,
  CASE e.event_type WHEN 'purchase' THEN 'portrait' WHEN 'view' THEN 'landscape' ELSE 'other' END AS scene, regexp_extract(e.props, '(\d+)', 1)::DOUBLE / 100.0::DOUBLE AS scene_conf,
  coalesce(200.0::DOUBLE * len(list_distinct(w)) / nullif(len(w), 0), 0.0::DOUBLE) AS blur_score,
  least(1.0::DOUBLE, 2.0::DOUBLE * (length(regexp_replace(t, '[\p{L}\s]', '', 'g'))::DOUBLE / greatest(length(t), 1))) AS over_ratio,
  least(1.0::DOUBLE, 2.7::DOUBLE * ((length(t) - length(regexp_replace(t, '\s', '', 'g')))::DOUBLE / greatest(length(t), 1))) AS under_ratio,
  least(100.0::DOUBLE, e.value) AS aesthetic, l.quality * 100.0::DOUBLE AS quality, l.toxic IS NOT NULL AS is_face, 0.10::DOUBLE + (d.doc_id % 30) / 100.0::DOUBLE AS ear,
  CASE WHEN 0.10::DOUBLE + (d.doc_id % 30) / 100.0::DOUBLE BETWEEN 0.20::DOUBLE AND 0.33::DOUBLE THEN (d.doc_id * 13 % 100) / 100.0::DOUBLE END AS eye_close_prob, w
  FROM (SELECT *, coalesce(text, '') AS t, list_filter(string_split_regex(trim(lower(coalesce(text, ''))), '\s+'), lambda x: x <> '') AS w FROM documents) d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "word_bits": "SELECT path, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM (SELECT path, unnest(list_distinct(w)) AS w FROM items)",
    "fps": "SELECT path, " + " | ".join(f"CASE WHEN 2 * ones[{i + 1}] > n THEN {1 << i}::UBIGINT ELSE 0::UBIGINT END" for i in range(64)) + " AS fp FROM (SELECT path, count(*) AS n, [" + ", ".join(f"sum(((h >> {i}) & 1)::INT)" for i in range(64)) + "] AS ones FROM word_bits GROUP BY path)",
    "near": "SELECT a.path AS src, b.path AS dst, bit_count(xor(a.fp, b.fp))::INT AS dist FROM fps a JOIN fps b ON a.path < b.path AND bit_count(xor(a.fp, b.fp)) < 12",
    "bursts": "SELECT path, prev FROM (SELECT path, ts_ms, lag(path) OVER w AS prev, lag(ts_ms) OVER w AS pt FROM items WHERE ts_ms IS NOT NULL WINDOW w AS (ORDER BY ts_ms, path)) WHERE ts_ms - pt < 5000",
    "edges": "SELECT src AS a, dst AS b FROM near UNION SELECT dst, src FROM near UNION SELECT path, prev FROM bursts UNION SELECT prev, path FROM bursts",
    "reach": "SELECT path, path AS root FROM items UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.path",
    "grouped": "SELECT path, dense_rank() OVER (ORDER BY root) - 1 AS group_id FROM (SELECT path, min(root) AS root FROM reach GROUP BY path)",
    "gscene": "SELECT group_id, CASE WHEN bool_or(scene = 'portrait') THEN 'portrait' WHEN bool_or(scene = 'landscape') THEN 'landscape' ELSE 'other' END AS group_scene, avg(CASE WHEN scene_conf = 0 THEN 1.0::DOUBLE ELSE coalesce(scene_conf, 1.0::DOUBLE) END) AS group_conf FROM items JOIN grouped USING (path) GROUP BY group_id",
    "norms": """SELECT *, CASE WHEN quality IS NULL THEN bn ELSE 0.5::DOUBLE * bn + 0.5::DOUBLE * qn END AS blur_n FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, blur_score / 200.0::DOUBLE)) AS bn, CASE WHEN quality IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, quality / 100.0::DOUBLE)) END AS qn,
  1.0::DOUBLE - greatest(0.0::DOUBLE, least(1.0::DOUBLE, over_ratio + under_ratio)) AS expo_n, greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(aesthetic, 50.0::DOUBLE) / 100.0::DOUBLE)) AS aes_n,
  CASE WHEN is_face THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (ear - 0.10::DOUBLE) / (0.32::DOUBLE - 0.10::DOUBLE))) ELSE 0.5::DOUBLE END AS face_n, ear < 0.20::DOUBLE OR coalesce(eye_close_prob > 0.60::DOUBLE, false) AS closed FROM items)""",
    "weights": "SELECT * FROM (VALUES ('portrait', 0.25::DOUBLE, 0.20::DOUBLE, 0.25::DOUBLE, 0.30::DOUBLE), ('landscape', 0.35::DOUBLE, 0.30::DOUBLE, 0.35::DOUBLE, 0.0::DOUBLE), ('other', 0.30::DOUBLE, 0.20::DOUBLE, 0.30::DOUBLE, 0.20::DOUBLE)) t(scene, w0, w1, w2, w3)",
    "scored": """SELECT n.*, g.group_id, s.group_scene, s.group_conf, f.fp, 100.0::DOUBLE * (w0 * blur_n + w1 * expo_n + w2 * aes_n + w3 * face_n) AS comp_score, blur_score < 60 OR over_ratio > 0.5::DOUBLE OR under_ratio > 0.5::DOUBLE OR (closed AND is_face) AS hard_waste
  FROM norms n JOIN grouped g USING (path) JOIN gscene s USING (group_id) JOIN weights w ON w.scene = s.group_scene LEFT JOIN fps f USING (path)""",
    "ranked": "SELECT *, CASE WHEN NOT hard_waste THEN row_number() OVER (PARTITION BY group_id, hard_waste ORDER BY comp_score DESC, path) END AS rank FROM scored",
    "verd": """SELECT *, clean > 0 AND (coalesce(gap < 3, false) OR coalesce(abs(d0) < 0.05 AND abs(d1) < 0.05 AND abs(d2) < 0.05 AND greatest(d0, d1, d2) > 0 AND least(d0, d1, d2) < 0, false) OR group_conf < 0.6) AS is_uncertain FROM (SELECT group_id, any_value(group_scene) AS group_scene, any_value(group_conf) AS group_conf, count(*) AS size, count(rank) AS clean, max(path) FILTER (rank = 1) AS best_path, max(fp) FILTER (rank = 1) AS best_fp,
  max(comp_score) FILTER (rank = 1) - max(comp_score) FILTER (rank = 2) AS gap, max(blur_n) FILTER (rank = 1) - max(blur_n) FILTER (rank = 2) AS d0, max(aes_n) FILTER (rank = 1) - max(aes_n) FILTER (rank = 2) AS d1, max(face_n) FILTER (rank = 1) - max(face_n) FILTER (rank = 2) AS d2 FROM ranked GROUP BY group_id)""",
    "marked": """SELECT r.*, v.is_uncertain, v.best_path, NOT v.is_uncertain AND coalesce(r.path = v.best_path, false) AS is_best, v.is_uncertain AND coalesce(r.rank <= least(v.clean, 5), false) AS is_candidate,
  v.size > 1 AND v.best_path IS NOT NULL AND r.path <> v.best_path AS other, coalesce(bit_count(xor(r.fp, v.best_fp)), 255) <= 4 AS close FROM ranked r JOIN verd v USING (group_id)""",
    "judged": """SELECT *, coalesce(waste_reasons <> '', false) AS is_waste FROM (SELECT *, other AND NOT close AS is_similar_loser, CASE WHEN is_candidate THEN rank ELSE 0 END AS candidate_rank, CASE WHEN is_best THEN 5 ELSE 0 END AS star, CASE WHEN doc_id % 17 = 0 THEN 'P' WHEN doc_id % 19 = 0 THEN 'X' END AS label,
  nullif(concat_ws(',', CASE WHEN blur_score < 60 THEN 'blurred' END, CASE WHEN over_ratio > 0.5::DOUBLE OR under_ratio > 0.5::DOUBLE THEN 'exposure' END, CASE WHEN other AND close THEN 'duplicate' END, CASE WHEN closed AND is_face THEN 'eyes_closed' END), '') AS waste_reasons FROM marked)""",
    "groups": "SELECT group_id, count(*)::BIGINT AS size, coalesce(max(path) FILTER (is_best), max(path) FILTER (candidate_rank = 1)) AS best_path, bool_or(is_uncertain) AS is_uncertain, count(*) FILTER (is_candidate)::BIGINT AS n_candidates FROM judged GROUP BY group_id",
    "dims": """SELECT path, group_id, rank, comp_score, unnest(x, recursive := true) FROM (SELECT *, list_filter([
  {'dim': 'clarity', 'value': (floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, blur_score / 200.0::DOUBLE)) * 100.0::DOUBLE)::INT)::VARCHAR, 'level': CASE WHEN blur_score >= 120 THEN 'good' WHEN blur_score >= 60 THEN 'warn' ELSE 'bad' END},
  {'dim': 'exposure', 'value': coalesce(nullif(concat_ws(' ', CASE WHEN over_ratio * 100 > 1 THEN 'over ' || round(over_ratio * 100)::INT END, CASE WHEN under_ratio * 100 > 1 THEN 'under ' || round(under_ratio * 100)::INT END), ''), 'normal'), 'level': CASE WHEN over_ratio * 100 > 50 OR under_ratio * 100 > 50 THEN 'bad' WHEN over_ratio * 100 > 20 OR under_ratio * 100 > 20 THEN 'warn' ELSE 'good' END},
  {'dim': 'aesthetics', 'value': coalesce((round(aesthetic)::INT)::VARCHAR, '-'), 'level': CASE WHEN aesthetic IS NULL THEN 'muted' WHEN aesthetic >= 60 THEN 'good' WHEN aesthetic >= 40 THEN 'warn' ELSE 'bad' END},
  {'dim': 'face', 'value': CASE WHEN NOT is_face THEN 'none' WHEN closed THEN 'closed' ELSE 'open' END, 'level': CASE WHEN NOT is_face THEN 'muted' WHEN closed THEN 'bad' ELSE 'good' END},
  {'dim': 'scene', 'value': scene, 'level': 'muted'},
  {'dim': 'composite', 'value': (round(comp_score)::INT)::VARCHAR, 'level': CASE WHEN comp_score >= 70 THEN 'good' WHEN comp_score >= 50 THEN 'warn' ELSE 'bad' END},
  CASE WHEN is_similar_loser AND NOT is_waste THEN {'dim': 'similar', 'value': 'near-dup', 'level': 'warn'} END], lambda e: e IS NOT NULL) AS xs FROM judged), unnest(xs) AS u(x)""",
    "prior": "SELECT doc_id, path, CASE WHEN doc_id % 7 = 0 THEN ts + INTERVAL 60 SECOND ELSE ts END AS mtime, blur_score, CASE WHEN doc_id % 11 <> 0 THEN doc_id END AS fp, CASE WHEN doc_id % 13 <> 0 THEN aesthetic END AS aesthetic, scene FROM items WHERE doc_id % 5 <> 0",
    "log": "SELECT event_id AS seq, user_id::VARCHAR AS path, CASE event_type WHEN 'view' THEN 'star' WHEN 'click' THEN 'pick' WHEN 'purchase' THEN 'label' WHEN 'signup' THEN 'scene' ELSE 'undo' END AS kind, CASE event_type WHEN 'view' THEN (event_id % 6)::VARCHAR WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'P' ELSE 'X' END WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'P' END WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'portrait' ELSE 'other' END ELSE (event_id - event_id % 10)::VARCHAR END AS value FROM events",
    "vecs": "SELECT vec_id, label, embedding, list_transform(embedding, lambda x: x::DOUBLE) AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings",
}
_NEEDS = {"word_bits": "items", "fps": "word_bits", "near": "fps", "bursts": "items", "edges": "near bursts", "reach": "items edges", "grouped": "reach", "gscene": "items grouped", "norms": "items", "scored": "norms grouped gscene weights fps", "ranked": "scored", "verd": "ranked", "marked": "ranked verd", "judged": "marked", "groups": "judged", "dims": "judged", "prior": "items"}


def closure(names: list[str]) -> set[str]:
    out: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += _NEEDS.get(n, "").split()
    return out


def r6(c, name: str, n: int = 5):
    return F.round(c, n).alias(name)


def _signed(x: str) -> str:
    """SQL for an unsigned 64-bit number as the signed one of the same bits."""
    return f"CASE WHEN {x} >= 9223372036854775808::UBIGINT THEN ({x}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {x}::BIGINT END"


# scalar functions over items
@query("SELECT path, round(bn, 5) AS blur_n, round(qn, 5) AS quality_n, round(expo_n, 5) AS expo_n, round(aes_n, 5) AS aes_n, round(face_n, 5) AS face_n FROM norms", "norms")
def normalize(s, d):
    i, c = items(s, d), CONFIG
    return i.select("path", r6(X.norm_blur(F.col("blur_score")), "blur_n"), r6(X.norm_quality(F.col("quality")), "quality_n"), r6(X.norm_exposure(F.col("over_ratio"), F.col("under_ratio")), "expo_n"), r6(X.norm_aesthetic(F.col("aesthetic")), "aes_n"), r6(X.norm_face(F.col("is_face"), F.col("ear"), c), "face_n"))


@query("SELECT path, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (aesthetic - 1) / 9 * 100)), 5) AS ava, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (1 - aesthetic / 100) * 100)), 5) AS brisque, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, aesthetic)), 5) AS other FROM items", "items")
def score_range_norm(s, d):
    a, c = F.col("aesthetic"), CONFIG
    return items(s, d).select("path", r6(X.range_norm(a, "musiq-ava", c), "ava"), r6(X.range_norm(a, "brisque", c), "brisque"), r6(X.range_norm(a, "unknown", c), "other"))


@query("SELECT path, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, coalesce(quality, CASE WHEN doc_id % 2 = 0 THEN aesthetic END, (1 - aesthetic / 100) * 100))), 5) AS score, CASE WHEN quality IS NOT NULL THEN 'musiq' WHEN doc_id % 2 = 0 AND aesthetic IS NOT NULL THEN 'dbcnn' ELSE 'brisque' END AS scorer_used FROM items", "items")
def score_fallback(s, d):
    scores = {"musiq": F.col("quality"), "dbcnn": F.when(F.col("doc_id") % 2 == 0, F.col("aesthetic") / 100.0), "brisque": F.col("aesthetic")}
    v, n = X.score_fallback(scores, CONFIG)
    return items(s, d).select("path", r6(v, "score"), n.alias("scorer_used"))


@query("SELECT path, round(blur_n, 5) AS blur_n, round(100.0::DOUBLE * (w0 * blur_n + w1 * expo_n + w2 * aes_n + w3 * face_n), 5) AS comp_score FROM norms JOIN weights USING (scene)", "norms weights")
def composite_score(s, d):
    return verdict.score_items(items(s, d), CONFIG).select("path", r6(F.col("blur_n"), "blur_n"), r6(F.col("comp_score"), "comp_score"))


@query("SELECT path, nullif(concat_ws(',', CASE WHEN blur_score < 60 THEN 'blurred' END, CASE WHEN over_ratio > 0.5::DOUBLE OR under_ratio > 0.5::DOUBLE THEN 'exposure' END, CASE WHEN closed AND is_face THEN 'eyes_closed' END), '') AS reasons, blur_score < 60 OR over_ratio > 0.5::DOUBLE OR under_ratio > 0.5::DOUBLE OR (closed AND is_face) AS hard_waste FROM norms", "norms")
def waste_reasons(s, d):
    return verdict.score_items(items(s, d), CONFIG).select("path", X.reasons_text(F.col("hard_reasons")).alias("reasons"), "hard_waste")


@query("SELECT path, closed FROM norms", "norms")
def eyes_closed(s, d):
    return items(s, d).select("path", X.eyes_closed(F.col("ear"), F.col("eye_close_prob"), CONFIG).alias("closed"))


@query("SELECT path, CASE WHEN blur_score >= 150 THEN 'clear' WHEN blur_score < 60 THEN 'blurred' ELSE 'normal' END || CASE WHEN over_ratio > 0.5::DOUBLE THEN '+over' WHEN under_ratio > 0.5::DOUBLE THEN '+under' ELSE '' END AS sharpness FROM items", "items")
def sharpness_label(s, d):
    return items(s, d).select("path", X.sharpness_label(F.col("blur_score"), F.col("over_ratio"), F.col("under_ratio"), CONFIG).alias("sharpness"))


@query("SELECT path, fname, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, doc_id % 3 <> 0 AS has_exif FROM items", "items")
def capture_time(s, d):
    i = items(s, d).withColumn("sec", F.date_trunc("second", "ts"))
    tag = F.when(F.col("doc_id") % 3 == 1, F.date_format("sec", "yyyy:MM:dd HH:mm:ss"))
    tag2 = F.when(F.col("doc_id") % 3 == 2, F.concat(F.date_format("sec", "yyyy-MM-dd HH:mm:ss"), F.lit(".25")))
    return files.capture_times(i.drop("ts").withColumns({"t1": tag, "t2": tag2}), "t1", "t2", "sec").select("path", X.basename(F.col("path")).alias("fname"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "has_exif")


@query("SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events")
def parse_capture_time(s, d):
    raw = F.when(F.col("event_id") % 4 == 0, "bad").otherwise(F.date_format(F.col("ts").cast("timestamp"), " yyyy-MM-dd HH:mm:ss.SSS"))
    return table(s, d, "events").select("event_id", F.date_format(X.parse_capture_time(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT path, dim, value, level FROM dims", "dims")
def score_breakdown(s, d):
    return judged(s, d).select("path", F.explode(X.breakdown(CONFIG)).alias("d")).select("path", "d.*")


# similarity
@query("SELECT src, dst, dist FROM (SELECT a.r AS src, b.r AS dst, bit_count(xor(a.fp, b.fp))::INT AS dist FROM (SELECT fp, min(path) AS r FROM fps GROUP BY fp) a JOIN (SELECT fp, min(path) AS r FROM fps GROUP BY fp) b ON a.r < b.r) WHERE dist < 12 UNION ALL SELECT r, path, 0 FROM fps JOIN (SELECT fp, min(path) AS r FROM fps GROUP BY fp) USING (fp) WHERE path <> r", "fps")
def hamming_pairs(s, d):
    return similarity.hamming_pairs(fingerprints(s, d), "path", 12)


@query("SELECT rep, size FROM (SELECT min(path) AS rep, count(*)::BIGINT AS size FROM fps GROUP BY fp)", "fps")
def exact_duplicates(s, d):
    return similarity.exact_duplicates(fingerprints(s, d), "path").select("rep", "size")


@query(f"SELECT path, n::BIGINT AS n_words, {_signed('fp')} AS fp FROM fps JOIN (SELECT path, count(*) AS n FROM word_bits GROUP BY path) USING (path)", "fps")
def simhash(s, d):
    return fingerprints(s, d).select("path", F.col("n_distinct").cast("long").alias("n_words"), "fp")


@query("SELECT a.path AS src, b.path AS dst, coalesce(bit_count(xor(x.fp, y.fp)), 255)::INT AS dist FROM items a JOIN items b ON b.doc_id = a.doc_id + 1 LEFT JOIN fps x ON x.path = a.path LEFT JOIN fps y ON y.path = b.path", "fps")
def hamming_distance(s, d):
    i = full_items(s, d).select("doc_id", "path", "fp")
    after = i.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("dst"), F.col("fp").alias("fp2"))
    return i.join(after, "doc_id").select(F.col("path").alias("src"), "dst", X.hamming(F.col("fp"), F.col("fp2")).alias("dist"))


_BURST = "SELECT event_id, sum(new) OVER (ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) >= 60000000 THEN 1 ELSE 0 END AS new FROM events)"


@query(_BURST)
def burst_sessions(s, d):
    e = table(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return similarity.stitched_sessions(e.select("event_id", "us"), F.col("us"), 60_000_000, ["event_id"], 3_600_000_000).select("event_id", "session")


@query("SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 10800000000 THEN 1 ELSE 0 END AS new FROM events)")
def burst_sessions_by_user(s, d):
    e = table(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return similarity.sessions(e.select("event_id", "user_id", "us"), F.col("us"), 10_800_000_000, ["event_id"], ["user_id"]).select("event_id", "user_id", "session")


@query("SELECT path, min(root) AS component FROM reach GROUP BY path", "reach")
def connected_components(s, d):
    i = full_items(s, d)
    near = similarity.hamming_pairs(i, "path", 12).select("src", "dst")
    bursts = cut(similarity.stitched_sessions(i.where("ts_ms is not null").select("path", "ts_ms"), F.col("ts_ms"), CONFIG.burst_gap_ms, ["path"], 3_600_000.0))
    heads = bursts.groupBy("session").agg(F.min("path").alias("src"))
    parts = components.connected_components(near.unionByName(bursts.join(heads, "session").select("src", F.col("path").alias("dst"))))
    return i.select("path").join(parts, F.col("path") == F.col("node"), "left").select("path", F.coalesce("component", "path").alias("component"))


@query("SELECT path, group_id FROM grouped", "grouped")
def group_ids(s, d):
    return similarity.group_items(full_items(s, d), F.col("ts_ms"), CONFIG.burst_gap_ms).select("path", "group_id")


_PAIRS = "SELECT a.r AS src, b.r AS dst FROM (SELECT fp, min(path) AS r FROM fps GROUP BY fp) a JOIN (SELECT fp, min(path) AS r FROM fps GROUP BY fp) b ON a.r < b.r AND bit_count(xor(a.fp, b.fp)) < 12 UNION ALL SELECT r, path FROM fps JOIN (SELECT fp, min(path) AS r FROM fps GROUP BY fp) USING (fp) WHERE path <> r"
_NUMBER = "substr(split_part({}, '/', 3), 1, 8)::BIGINT"


@query("SELECT path AS node, min(root) AS component FROM reach GROUP BY path HAVING count(*) > 1", "reach", {"items": CTES["items"], "edges": f"SELECT src AS a, dst AS b FROM ({_PAIRS}) WHERE {_NUMBER.format('src')} % 97 <> 5 AND {_NUMBER.format('dst')} % 97 <> 5 UNION SELECT dst, src FROM ({_PAIRS}) WHERE {_NUMBER.format('src')} % 97 <> 5 AND {_NUMBER.format('dst')} % 97 <> 5"})
def components_after_change(s, d):
    """Labels of near-duplicates after a hundredth of the documents came and another hundredth went, from those before."""
    number = lambda c: F.regexp_extract(c, r"(\d+)\.txt$", 1).cast("long")
    edges = cut(similarity.hamming_pairs(fingerprints(s, d), "path", 12).select("src", "dst"))
    new = (number("src") % 100 == 7) | (number("dst") % 100 == 7)
    before, added = edges.where(~new), edges.where(new)
    gone = table(s, d, "documents").where("doc_id % 97 = 5").select(doc_path().alias("node"))
    return components.update_components(cut(components.connected_components(before)), before, added, gone)


# verdicts
@query("SELECT path, group_id, round(comp_score, 4) AS comp_score, is_best, is_uncertain, is_candidate, candidate_rank::INT AS candidate_rank, is_similar_loser, is_waste, waste_reasons, star FROM judged", "judged")
def curate(s, d):
    return judged(s, d).select("path", "group_id", r6(F.col("comp_score"), "comp_score", 4), "is_best", "is_uncertain", "is_candidate", "candidate_rank", "is_similar_loser", "is_waste", "waste_reasons", "star")


def _with(name: str, *changes: tuple[str, str]) -> str:
    """A common table with other constants."""
    sql = CTES[name]
    for old, new in changes:
        assert old in sql, (name, old)
        sql = sql.replace(old, new)
    return sql


_CUSTOM = {
    "near": _with("near", ("< 12", "< 8")), "bursts": _with("bursts", ("< 5000", "< 20000")), "verd": _with("verd", ("gap < 3", "gap < 1"), ("group_conf < 0.6", "group_conf < 0.3")),
    "gscene": "SELECT group_id, 'landscape' AS group_scene, 1.0::DOUBLE AS group_conf FROM grouped GROUP BY group_id", "weights": "SELECT 'landscape' AS scene, 0.4::DOUBLE AS w0, 0.2::DOUBLE AS w1, 0.2::DOUBLE AS w2, 0.2::DOUBLE AS w3",
}


@query("SELECT path, group_id, is_best, is_candidate, is_waste FROM judged", "judged", _CUSTOM)
def curate_custom(s, d):
    c = Config(burst_gap_ms=20_000.0, hash_threshold=8, score_gap=1.0, confidence_low=0.3, forced_scene="landscape", weights=(0.4, 0.2, 0.2, 0.2))
    return plan.curate(full_items(s, d), c).select("path", "group_id", "is_best", "is_candidate", "is_waste")


@query("SELECT group_id, group_scene, round(group_conf, 5) AS group_conf FROM gscene", "gscene")
def group_scene(s, d):
    return verdict.group_scene(judged(s, d)).select("group_id", "group_scene", r6(F.col("group_conf"), "group_conf"))


@query("SELECT path, group_id, rank FROM ranked", "ranked")
def rank_in_group(s, d):
    return verdict.rank_in_group(judged(s, d).drop("rank")).select("path", "group_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT group_id, best_path, is_uncertain, CASE WHEN is_uncertain THEN least(clean, 5) ELSE 0 END::INT AS n_candidates, round(gap, 4) AS gap FROM verd", "verd")
def verdict_groups(s, d):
    return verdict.verdicts(judged(s, d), CONFIG).select("group_id", "best_path", "is_uncertain", "n_candidates", r6(F.col("gap"), "gap", 4))


@query("SELECT path, other AND close AS is_dup, is_similar_loser FROM judged", "judged")
def dup_vs_best(s, d):
    return judged(s, d).select("path", "is_dup", "is_similar_loser")


@query("SELECT path, CASE WHEN is_best THEN 5 WHEN candidate_rank = 1 THEN 4 ELSE 0 END AS suggested FROM judged", "judged")
def suggested_stars(s, d):
    return verdict.suggested_stars(judged(s, d))


@query("SELECT path, CASE WHEN doc_id % 6 <> 0 THEN (doc_id % 6)::INT WHEN is_best THEN 5 ELSE 0 END AS star FROM judged", "judged")
def sticky_star(s, d):
    return judged(s, d).select("path", X.sticky_star(F.pmod("doc_id", F.lit(6)), F.col("is_best")).alias("star"))


@query("SELECT * FROM groups", "groups")
def group_table(s, d):
    return plan.groups_of(judged(s, d))


@query("SELECT path, group_id FROM judged WHERE is_best", "judged")
def best_frames(s, d):
    return judged(s, d).where("is_best").select("path", "group_id")


@query("SELECT group_id, candidate_rank::INT AS candidate_rank, path, CASE WHEN candidate_rank <= 4 THEN substr('ABCD', candidate_rank::INT, 1) ELSE '·' END AS tag FROM judged WHERE is_candidate", "judged")
def candidates(s, d):
    return judged(s, d).where("is_candidate").select("group_id", "candidate_rank", "path", X.candidate_tag(F.col("candidate_rank")).alias("tag")).orderBy("group_id", "candidate_rank")


@query("SELECT group_id, size FROM groups WHERE is_uncertain AND size >= 2", "groups")
def uncertain_groups(s, d):
    return plan.groups_of(judged(s, d)).where("is_uncertain and size >= 2").select("group_id", "size").orderBy("group_id")


@query("SELECT group_id, path, round(comp_score, 4) AS comp_score FROM judged", "judged")
def group_members(s, d):
    return judged(s, d).orderBy("group_id", F.desc("comp_score")).select("group_id", "path", r6(F.col("comp_score"), "comp_score", 4))


# views and rollups
@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (is_waste)::BIGINT AS waste, count(*) FILTER (star > 0)::BIGINT AS starred, count(*) FILTER (star = 5)::BIGINT AS star5, count(*) FILTER (is_best)::BIGINT AS best, count(*) FILTER (is_uncertain)::BIGINT AS uncertain_photos, count(*) FILTER (is_candidate)::BIGINT AS candidate_photos, (SELECT count(*) FROM groups WHERE is_uncertain)::BIGINT AS uncertain_groups, (SELECT count(*) FROM groups)::BIGINT AS groups, (SELECT string_agg(scene || '=' || n, ',' ORDER BY scene) FROM (SELECT scene, count(*) AS n FROM judged GROUP BY scene)) AS scenes FROM judged", "groups")
def collection_stats(s, d):
    out = views.collection_stats(judged(s, d), plan.groups_of(judged(s, d)))
    return out.withColumn("scenes", F.array_join(F.transform(F.map_entries("scenes"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query("SELECT scene, count(*)::BIGINT AS n FROM items GROUP BY scene", "items")
def scene_distribution(s, d):
    return judged(s, d).groupBy("scene").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT scene FROM items", "items")
def distinct_scenes(s, d):
    return judged(s, d).select(F.coalesce("scene", F.lit("other")).alias("scene")).distinct().orderBy("scene")


@query("SELECT (SELECT count(*) FROM groups)::BIGINT AS groups, (SELECT count(*) FROM groups WHERE is_uncertain)::BIGINT AS uncertain_groups, (SELECT count(*) FROM groups WHERE NOT is_uncertain AND best_path IS NOT NULL)::BIGINT AS best_groups, count(*)::BIGINT AS items, count(*) FILTER (is_waste)::BIGINT AS waste, count(*) FILTER (is_candidate)::BIGINT AS candidate_items FROM judged", "groups")
def run_summary(s, d):
    return plan.run_summary(judged(s, d))


@query("SELECT reason, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(waste_reasons, ',')) AS reason FROM judged) GROUP BY reason", "judged")
def reason_counts(s, d):
    return views.reason_counts(judged(s, d))


@query("SELECT group_id, count(*)::BIGINT AS members, max(fname) FILTER (is_best) AS best_name, count(*) FILTER (star >= 4 OR label = 'P')::BIGINT AS kept FROM judged GROUP BY group_id", "judged")
def group_context(s, d):
    return judged(s, d).groupBy("group_id").agg(F.count("*").alias("members"), F.max(F.when(F.col("is_best"), F.col("fname"))).alias("best_name"), F.count_if(X.keep(F.col("star"), F.col("label"), CONFIG)).alias("kept"))


@query("SELECT count(*)::BIGINT AS total, count(*) FILTER (star >= 4 OR label = 'P')::BIGINT AS selected, count(*) FILTER (is_waste)::BIGINT AS waste, count(DISTINCT group_id) FILTER (is_uncertain)::BIGINT AS undecided FROM judged", "judged")
def export_metrics(s, d):
    return judged(s, d).agg(F.count("*").alias("total"), F.count_if(X.keep(F.col("star"), F.col("label"), CONFIG)).alias("selected"), F.count_if("is_waste").alias("waste"), F.countDistinct(F.when(F.col("is_uncertain"), F.col("group_id"))).alias("undecided"))


@query("SELECT path, scene FROM judged WHERE scene = 'portrait' AND NOT is_waste AND fname ILIKE '%1_.TXT%'", "judged")
def filter_items(s, d):
    return judged(s, d).where(views.item_filter({"scene": "portrait", "is_waste": False, "search": "1_.TXT", "label": ""})).select("path", "scene")


@query("SELECT path, fname FROM items WHERE fname ILIKE '%012_.T%'", "items")
def search_items(s, d):
    """Names that hold a pattern, by postings written for all of them."""
    i = items(s, d).select("path", "fname")
    folder = f"{shared_dir(s)}/{s.sparkContext.applicationId}/postings-{uuid.uuid4().hex}"
    search.write_postings(i, folder)
    return search.search(i, folder, "012_.T")


@query("SELECT scene, count(*)::BIGINT AS n, count(*) FILTER (is_waste)::BIGINT AS waste, sum(star)::BIGINT AS stars FROM (SELECT CASE WHEN doc_id % 100 = 3 THEN 'food' ELSE scene END AS scene, is_waste, CASE WHEN doc_id % 100 = 4 THEN 5 ELSE star END AS star FROM judged WHERE doc_id % 100 <> 5) GROUP BY 1", "judged")
def rollup_after_change(s, d):
    """Counts by scene after a run that changed or removed three hundredths of the items, from those before and the change rows."""
    i, h = judged(s, d).select("doc_id", "path", "scene", "is_waste", "star"), F.col("doc_id") % 100
    now = i.where(h != 5).withColumns({"scene": F.when(h == 3, "food").otherwise(F.col("scene")), "star": F.when(h == 4, 5).otherwise(F.col("star"))})
    sums = {"waste": F.col("is_waste").cast("int"), "stars": F.col("star")}
    kept = cut(rollups.rollup(i, ["scene"], sums))
    change = rollups.changes(i, now, "path", ["scene", "is_waste", "star"], i.where(h.isin(3, 4, 5)))
    return rollups.changed_rollup(kept, change, ["scene"], sums)


@query("SELECT count(*)::BIGINT AS n FROM judged WHERE star >= 5 AND NOT is_uncertain", "judged")
def filtered_count(s, d):
    return judged(s, d).where(views.item_filter({"star_min": 5, "is_uncertain": False})).agg(F.count("*").alias("n"))


@query("SELECT path FROM items WHERE quality IS NULL", "items")
def missing_field(s, d):
    return views.missing(judged(s, d), "quality")


@query("SELECT path FROM items ORDER BY path LIMIT 25", "items")
def first_items(s, d):
    return items(s, d).select("path").orderBy("path").limit(25)


@query("SELECT path, fname, round(blur_score, 5) AS blur_score FROM items WHERE doc_id = 42", "items")
def point_lookup(s, d):
    return items(s, d).where("doc_id = 42").select("path", "fname", r6(F.col("blur_score"), "blur_score"))


@query("SELECT path, star, round(comp_score, 4) AS comp_score FROM judged WHERE NOT is_waste AND NOT is_similar_loser", "judged")
def leaderboard(s, d):
    return views.leaderboard(judged(s, d), CONFIG, hide_waste=True, hide_losers=True, sort="star_desc").select("path", "star", r6(F.col("comp_score"), "comp_score", 4))


@query("SELECT path, round(comp_score, 4) AS comp_score FROM judged", "judged")
def ordered_items(s, d):
    return judged(s, d).orderBy(F.desc("comp_score"), "path").select("path", r6(F.col("comp_score"), "comp_score", 4))


@query("SELECT path FROM judged WHERE star >= 4 OR label = 'P'", "judged")
def keep_set(s, d):
    return judged(s, d).where(X.keep(F.col("star"), F.col("label"), CONFIG)).select("path")


@query("SELECT path, waste_reasons FROM judged WHERE is_waste", "judged")
def waste_set(s, d):
    return judged(s, d).where("is_waste").select("path", "waste_reasons")


@query("SELECT path FROM judged WHERE is_similar_loser AND NOT is_waste", "judged")
def loser_set(s, d):
    return judged(s, d).where("is_similar_loser and not is_waste").select("path")


@query("SELECT path, CASE WHEN b = '' THEN '-' ELSE b END AS badge, f AS face_badge, CASE WHEN is_waste THEN 'waste' WHEN is_best THEN 'best' WHEN star >= 4 OR label = 'P' THEN 'keep' WHEN is_candidate THEN 'candidate' ELSE 'none' END AS status FROM (SELECT *, concat_ws(' ', CASE WHEN star > 0 THEN '*' || star END, label, CASE WHEN is_best THEN 'best' END, CASE WHEN is_candidate THEN 'candidate' END, CASE WHEN is_similar_loser AND NOT is_waste THEN 'near-dup' END, CASE WHEN is_waste THEN 'waste:' || waste_reasons END) AS b, concat_ws(' ', CASE WHEN is_face THEN CASE WHEN closed THEN 'closed' ELSE 'face' END END, CASE WHEN is_similar_loser AND NOT is_waste THEN 'near-dup' END) AS f FROM judged)", "judged")
def badge(s, d):
    return judged(s, d).select("path", X.badge().alias("badge"), X.face_badge(CONFIG).alias("face_badge"), X.status_class(CONFIG).alias("status"))


@query("SELECT fname, path, scene, round(scene_conf, 3) AS scene_conf, star, coalesce(label, '') AS label, coalesce(waste_reasons, '') AS waste_reasons, is_best::INT AS is_best, group_id, round(comp_score, 1) AS comp_score, round(blur_score, 1) AS blur_score, round(over_ratio, 3) AS over_ratio, round(under_ratio, 3) AS under_ratio, round(aesthetic, 1) AS aesthetic FROM (SELECT * REPLACE (CASE WHEN scene_conf = 0 THEN 1.0 ELSE scene_conf END AS scene_conf) FROM judged) WHERE star >= 4 OR label = 'P'", "judged")
def export_manifest(s, d):
    return views.export_manifest(judged(s, d), CONFIG)


@query("""WITH f AS (SELECT path, CASE WHEN doc_id % 50 = 7 THEN '006_2.txt' ELSE lpad((doc_id % 50)::VARCHAR, 3, '0') || '.txt' END AS f FROM items), k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY path) AS n FROM f), m AS (SELECT *, CASE WHEN n = 1 THEN f ELSE replace(f, '.txt', '') || '_' || n || '.txt' END AS name FROM k)
  SELECT path AS src, CASE WHEN n > 1 AND name IN (SELECT f FROM f) THEN 'photos-' || n || '/' || f ELSE 'photos/' || name END AS dst FROM m""".replace("WITH f", ", f", 1), "items")
def copy_plan(s, d):
    n = F.col("doc_id") % 50
    f = F.when(n == 7, "006_2.txt").otherwise(F.concat(F.lpad(n.cast("string"), 3, "0"), F.lit(".txt")))
    return views.copy_plan(items(s, d).withColumn("fname", f))


@query("SELECT a.path AS a_path, b.path AS b_path, round(a.comp_score - b.comp_score, 4) AS comp_diff, dim, a.value AS a_value, a.level AS a_level, b.value AS b_value, b.level AS b_level FROM dims a JOIN dims b USING (group_id, dim) WHERE a.rank = 1 AND b.rank = 2", "dims")
def pair_compare(s, d):
    return views.pair_levels(judged(s, d), CONFIG).drop("group_id").withColumn("comp_diff", F.round("comp_diff", 4))


@query("SELECT count(*) FILTER (quality = 1)::BIGINT AS n1, count(*) FILTER (quality = 0)::BIGINT AS n0, round((avg(n_chars) FILTER (quality = 1) - avg(n_chars) FILTER (quality = 0)) / sqrt(((count(*) FILTER (quality = 1) - 1) * var_samp(n_chars) FILTER (quality = 1) + (count(*) FILTER (quality = 0) - 1) * var_samp(n_chars) FILTER (quality = 0)) / (count(*) - 2)), 5) AS d FROM documents JOIN labels USING (doc_id)")
def cohens_d(s, d):
    return views.cohens_d(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), F.col("n_chars").cast("double"), "quality").select("n1", "n0", r6(F.col("d"), "d"))


# incremental
def signed_prior(spark: SparkSession, d: str, made: DataFrame | None = None) -> DataFrame:
    """The stored state with the models and the source that made each row: some rows name none, some another."""
    i = F.col("doc_id")
    return prior(spark, d, made).withColumns({"model_signature": F.when(i % 17 != 0, F.when(i % 23 == 0, "aes=0|q=0").otherwise(SIGNATURE)), "source_root": F.when(i % 19 == 0, "/other").when(i % 3 != 0, "/root")})


SIGNATURE = incremental.model_signature(q="1", aes="1")
_USABLE = "doc_id % 17 <> 0 AND doc_id % 23 <> 0 AND doc_id % 19 <> 0"


@query(f"SELECT i.path, n AS need_features, n OR p.aesthetic IS NULL OR p.scene IS NULL AS need_scores FROM (SELECT i.path, NOT (coalesce(abs(epoch_us(i.ts) - epoch_us(p.mtime)) <= 1, false) AND p.blur_score IS NOT NULL AND p.fp IS NOT NULL) AS n FROM items i LEFT JOIN (SELECT * FROM prior WHERE {_USABLE}) p USING (path)) i LEFT JOIN (SELECT * FROM prior WHERE {_USABLE}) p USING (path)", "prior")
def incremental_plan(s, d):
    return incremental.incremental_plan(items(s, d).withColumn("mtime", F.col("ts")), signed_prior(s, d), SIGNATURE, "/root")


_FRESH = f"NOT (doc_id % 5 <> 0 AND {_USABLE} AND doc_id % 7 <> 0 AND doc_id % 11 <> 0)"
_MERGED = f"""SELECT * REPLACE (CASE WHEN fresh THEN blur_score ELSE blur_score * 0.9::DOUBLE END AS blur_score, CASE WHEN fresh OR doc_id % 13 = 0 THEN aesthetic ELSE aesthetic * 0.5::DOUBLE END AS aesthetic) FROM (SELECT *, {_FRESH} AS fresh FROM ({CTES["items"]}))"""


def stored_items(spark: SparkSession, d: str) -> DataFrame:
    """What an earlier run has left: a table of the session, made once, whose values differ from fresh ones."""
    key = ("stored", spark.sparkContext.applicationId, d)
    if key not in KEPT:
        made = full_items(spark, d)  # the text is read once
        kept = signed_prior(spark, d, made).select("path", "mtime", "model_signature", "source_root", (F.col("blur_score") * 0.9).alias("blur_score"), (F.col("aesthetic") * 0.5).alias("aesthetic"), F.col("fp").isNotNull().alias("has_fp"))
        both = made.drop("blur_score", "aesthetic").join(kept, "path")
        KEPT[key] = cut(both.withColumn("fp", F.when(F.col("has_fp"), F.col("fp"))).drop("has_fp"))
    return KEPT[key]


@query("SELECT path, group_id, round(comp_score, 4) AS comp_score, is_best, is_candidate, is_waste, waste_reasons FROM judged", "judged", {"items": _MERGED})
def incremental_curate(s, d):
    """A later run over what an earlier one has stored: only documents that need it are read and fingerprinted. Stored values differ from fresh ones, so the result shows which were made anew."""
    numbered = F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("doc_id")
    made = lambda rows: full_items(s, d, rows.select(numbered))
    scored = lambda rows: items(s, d).select("path", *collection.SCORES).join(rows.select("path"), "path", "left_semi")
    scanned = table(s, d, "documents").select("doc_id", doc_path()).join(table(s, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("mtime")), "doc_id", "left")
    merged = collection.refreshed(scanned.select("path", "mtime"), stored_items(s, d), made, scored, SIGNATURE, "/root")
    out = plan.curate(merged.withColumn("ts_ms", F.unix_micros("ts") / 1000.0), CONFIG)
    return out.select("path", "group_id", r6(F.col("comp_score"), "comp_score", 4), "is_best", "is_candidate", "is_waste", "waste_reasons")


@query("SELECT path, coalesce(p.aesthetic, i.doc_id::DOUBLE) AS aesthetic, p.scene FROM prior p JOIN items i USING (path)", "prior")
def second_stage(s, d):
    """Scores for stored rows that lack them."""
    score = lambda rows: rows.select("path", F.col("doc_id").cast("double").alias("aesthetic"), F.lit("new").alias("scene"))
    return features.fill_scores(prior(s, d), score, ("aesthetic", "scene")).select("path", "aesthetic", "scene")


@query("SELECT path, coalesce(u.aesthetic, p.aesthetic) AS aesthetic, p.scene, p.fp FROM prior p FULL JOIN (SELECT path, doc_id::DOUBLE AS aesthetic FROM items WHERE doc_id % 10 < 3) u USING (path)", "prior")
def upsert_merge(s, d):
    i = items(s, d).where("doc_id % 10 < 3")
    new = i.select("path", F.col("doc_id").cast("double").alias("aesthetic"), F.lit(2).alias("seq")).unionByName(i.select("path", F.lit(-1.0).alias("aesthetic"), F.lit(1).alias("seq")))
    merged = incremental.upsert(prior(s, d).drop("doc_id"), new, seq="seq")
    return merged.select("path", "aesthetic", "scene", "fp")


@query("SELECT path, CASE WHEN doc_id % 10 < 3 THEN 'x' ELSE scene END AS scene FROM prior", "prior")
def keyed_update(s, d):
    new = items(s, d).where("doc_id % 10 < 3").select("path", F.lit("x").alias("scene"))
    return incremental.upsert(prior(s, d), new, insert=False).select("path", "scene")


@query("SELECT i.path, round(coalesce(CASE WHEN i.doc_id % 3 = 0 THEN i.aesthetic + 1 END, p.aesthetic, 50.0::DOUBLE), 5) AS aesthetic, coalesce(p.scene, 'other') AS scene FROM items i LEFT JOIN prior p USING (path)", "prior")
def overlay(s, d):
    i = items(s, d)
    fresh = i.where("doc_id % 3 = 0").select("path", (F.col("aesthetic") + 1).alias("aesthetic"), F.lit(None).cast("string").alias("scene"))
    return incremental.overlay(i, fresh, prior(s, d), {"aesthetic": F.lit(50.0), "scene": F.lit("other")}).select("path", r6(F.col("aesthetic"), "aesthetic"), "scene")


@query("SELECT path, CASE WHEN doc_id % 9 = 0 THEN 'landscape' WHEN doc_id % 4 = 0 THEN 'portrait' ELSE scene END AS scene, CASE WHEN doc_id % 9 = 0 OR doc_id % 4 = 0 OR scene_conf = 0 THEN 1.0::DOUBLE ELSE scene_conf END AS scene_conf FROM items", "items")
def scene_resolve(s, d):
    i = items(s, d).withColumn("scene_manual", F.when(F.col("doc_id") % 4 == 0, "portrait"))
    over = i.where("doc_id % 9 = 0").select("path", F.lit("landscape").alias("scene"))
    return incremental.scene_resolve(i, over).select("path", "scene", "scene_conf")


@query("SELECT path, 'portrait' AS scene FROM items WHERE doc_id % 4 = 0", "items")
def scene_overrides(s, d):
    i = items(s, d).withColumn("scene_manual", F.when(F.col("doc_id") % 4 == 0, "portrait"))
    return i.where("scene_manual is not null").select("path", F.col("scene_manual").alias("scene"))


@query("SELECT path, md5(path) AS key FROM items WHERE doc_id % 6 < 2", "items")
def stale_artifacts(s, d):
    i = items(s, d).withColumn("mtime", F.col("ts"))
    made = i.where("doc_id % 6 <> 0").select(F.md5("path").alias("key"), F.timestamp_micros(F.unix_micros("ts") + F.when(F.col("doc_id") % 6 == 1, -1_000_000).otherwise(5)).alias("artifact_mtime"))
    return incremental.stale_artifacts(i, made)


@query("SELECT path, NULL::DOUBLE AS quality, scene FROM prior", "prior")
def schema_evolve(s, d):
    old = prior(s, d).select("path", "scene")
    like = items(s, d).select("path", "scene", "quality")
    return incremental.evolve(incremental.evolve(old, like), like).select("path", "quality", "scene")


# decisions
def decision_log(s, d) -> DataFrame:
    e, t, i = table(s, d, "events"), F.col("event_type"), F.col("event_id")
    kind = F.when(t == "view", "star").when(t == "click", "pick").when(t == "purchase", "label").when(t == "signup", "scene").otherwise("undo")
    value = F.when(t == "view", (i % 6).cast("string")).when(t == "click", F.when(i % 2 == 0, "P").otherwise("X")).when(t == "purchase", F.when(i % 3 == 0, "").otherwise("P")).when(t == "signup", F.when(i % 2 == 0, "portrait").otherwise("other")).otherwise((i - i % 10).cast("string"))
    return e.select(i.alias("seq"), F.col("user_id").cast("string").alias("path"), kind.alias("kind"), value.alias("value"))


_FOLD = "SELECT path, max_by(CASE WHEN kind = 'star' THEN value WHEN value = 'P' THEN '5' ELSE '0' END, seq) FILTER (kind IN ('star', 'pick'))::INT AS star, max_by(value, seq) FILTER (kind IN ('label', 'pick')) AS label, max_by(value, seq) FILTER (kind = 'scene') AS scene_manual FROM {} WHERE kind <> 'undo' GROUP BY path"


@query(_FOLD.format("log"), "log")
def decision_state(s, d):
    return decisions.fold(decision_log(s, d))


@query(_FOLD.format("(SELECT * FROM log WHERE seq NOT IN (SELECT value::BIGINT FROM log WHERE kind = 'undo'))"), "log")
def decision_undo(s, d):
    return decisions.fold(decisions.without_undone(decision_log(s, d)))


@query("SELECT path, CASE WHEN doc_id % 6 = 0 THEN 0 ELSE 5 END AS star, CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'P' END AS label, CASE WHEN doc_id % 9 = 0 THEN 'landscape' END AS scene_manual FROM items WHERE doc_id % 3 = 0", "items")
def decision_rows(s, d):
    """Picks, later removals of some, and scenes set by hand, folded."""
    i = items(s, d).where("doc_id % 3 = 0")
    rows = decisions.numbered(decisions.picked(i).unionByName(decisions.scene_set(i.where("doc_id % 9 = 0"), "landscape")), 0)
    return decisions.fold(rows.unionByName(decisions.numbered(decisions.removed(i.where("doc_id % 6 = 0")), 1 << 60)))


@query("SELECT path, 'pick' AS kind, 'X' AS value FROM judged JOIN groups USING (group_id) WHERE groups.best_path IS NOT NULL AND path <> groups.best_path", "groups")
def keep_only_best(s, d):
    return decisions.keep_only_best(plan.groups_of(judged(s, d)), judged(s, d))


# streaming forms over whole tables
_GAPS = "SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 10800000000 THEN 1 ELSE 0 END AS new FROM events)"


@query(f"SELECT user_id, count(*)::BIGINT AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last FROM ({_GAPS}) GROUP BY user_id, session")
def online_bursts(s, d):
    """Session windows over the table as one batch; tests run them as a stream."""
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return flows.online_bursts(e, 10_800_000_000, "1 day", ["user_id"]).select("user_id", "n", show("first"), show("last"))


@query("SELECT n.path, s.stored, bit_count(xor(n.fp, s.fp))::INT AS dist FROM (SELECT f.path, f.fp FROM fps f JOIN items USING (path) WHERE doc_id % 2 = 0) n JOIN (SELECT min(path) AS stored, f.fp FROM fps f JOIN items USING (path) WHERE doc_id % 2 = 1 GROUP BY f.fp) s ON bit_count(xor(n.fp, s.fp)) < 12", "fps")
def near_stored(s, d):
    """Documents of even ids as a batch of new items, those of odd ids as what is stored."""
    i = full_items(s, d).select("doc_id", "path", "fp")
    return flows.near_stored(i.where("doc_id % 2 = 0"), cut(flows.band_index(i.where("doc_id % 2 = 1"))), 12)


@query("SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(text, '')) AS digest FROM documents")
def ingest_documents(s, d):
    """The table's files as a stream, some at a time, each batch's features written by its number; then merged into a version."""
    source, at = f"{d}/documents.parquet", f"{shared_dir(s)}/{s.sparkContext.applicationId}/ingest-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    made = lambda rows: rows.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("digest"))
    pattern = f"{d}/documents.parque[t]"  # a stream takes a folder or a pattern; the table may be one file
    flows.ingest(s, pattern, s.read.parquet(source).schema, made, f"{at}/batches", f"{at}/checkpoint").awaitTermination()
    target = files.Snapshots(s, f"{at}/versions")
    flows.compact(s, f"{at}/batches", target, "doc_id")
    return target.read()


@query("SELECT n.path, s.stored, bit_count(xor(n.fp, s.fp))::INT AS dist FROM (SELECT f.path, f.fp FROM fps f JOIN items USING (path) WHERE doc_id % 100 = 7) n JOIN (SELECT min(path) AS stored, f.fp FROM fps f JOIN items USING (path) WHERE doc_id % 100 <> 7 GROUP BY f.fp) s ON bit_count(xor(n.fp, s.fp)) < 12", "fps")
def near_stored_index(s, d):
    """A hundredth of the documents as a later run's new items, against a kept band index that earlier runs have added the others to, in two versions."""
    i = full_items(s, d).select("doc_id", "path", "fp")
    index = flows.BandIndex(s, f"{shared_dir(s)}/{s.sparkContext.applicationId}/bands-{uuid.uuid4().hex}", 16)
    for version in (1, 2):
        index.add(i.where(f"doc_id % 100 <> 7 and doc_id % 2 = {version - 1}"), version)
    return flows.near_stored(i.where("doc_id % 100 = 7"), index.read(), 12)


def streamed(rows: DataFrame, flow: Callable[[DataFrame], DataFrame], files: int = 4) -> DataFrame:
    """All that a flow sends of a table as a stream of some files, in two batches at least, with the `batch` that sent it. State is kept in RocksDB."""
    s = rows.sparkSession
    at = f"{shared_dir(s)}/{s.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    rows.repartition(files).write.parquet(f"{at}/in")
    flows.rocksdb_state(s)
    source = s.readStream.schema(rows.schema).option("maxFilesPerTrigger", files // 2).parquet(f"{at}/in")
    out = flow(source)
    save = lambda df, n: df.write.mode("overwrite").parquet(f"{at}/out/batch={n}")
    out.writeStream.foreachBatch(save).outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(f"{out._jdf.schema().toDDL()}, batch bigint").option("basePath", f"{at}/out").parquet(f"{at}/out")


def latest(sent: DataFrame, key: str) -> DataFrame:
    """The last that was sent of each key."""
    cols = [c for c in sent.columns if c not in (key, "batch")]
    return sent.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("x")).select(key, *(F.col("x")[c].alias(c) for c in cols))


@query(_FOLD.format("(SELECT * FROM log WHERE seq NOT IN (SELECT value::BIGINT FROM log WHERE kind = 'undo'))"), "log")
def decision_stream_undo(s, d):
    """Decisions and undos as a stream, in no order; paths of which nothing holds are left out."""
    log = decision_log(s, d)
    state = latest(streamed(log, flows.settled_decisions), "path")
    return state.join(decisions.without_undone(log).select("path").distinct(), "path", "left_semi")


@query("SELECT event_id AS id, user_id::VARCHAR AS key, epoch_us(min(ts) OVER (PARTITION BY user_id, session))::BIGINT AS session_start FROM (SELECT user_id, event_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 10800000000 THEN 1 ELSE 0 END AS new FROM events))")
def item_sessions(s, d):
    """Each event's burst, online, from files in no order of time; the last that was sent of each event."""
    e = table(s, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    sent = streamed(e, lambda rows: flows.item_sessions(rows, 10_800_000_000, "400 days", "user_id", "event_id"))
    return latest(sent, "id").select("id", "key", "session_start")


# whole runs
@query("SELECT path, fname, scene, round(blur_score, 5) AS blur_score, is_face FROM items", "items")
def known_columns(s, d):
    """What of the items a snapshot would take: only columns that it has."""
    i = items(s, d).withColumns({"blur_score": F.round("blur_score", 5), "unknown": F.lit(1)})
    return incremental.known_columns(i.select("unknown", "doc_id", "path", "fname", "scene", "blur_score", "is_face"))


@query("SELECT v AS version, count(*) FILTER (v = 2 OR doc_id % 2 = 0)::BIGINT AS rows, '/root' AS source_root, CASE v WHEN 1 THEN 'one' ELSE 'two' END AS model_signature FROM items, (VALUES (1), (2)) t(v) GROUP BY v", "items")
def snapshot_meta(s, d):
    """Two versions of the items and the values published with each; a cleared folder has none."""
    i = items(s, d).select("doc_id", "path")
    target, rows = files.Snapshots(s, f"{shared_dir(s)}/{s.sparkContext.applicationId}/meta-{uuid.uuid4().hex}"), []
    for signature, df in (("one", i.where("doc_id % 2 = 0")), ("two", i)):
        version = target.publish(df, model_signature=signature, **({"source_root": "/root"} if signature == "one" else {}))
        rows.append(target.read().agg(F.count("*").alias("rows")).select(F.lit(version).alias("version"), "rows", F.lit(target.meta("source_root")).alias("source_root"), F.lit(target.meta("model_signature")).alias("model_signature")))
    out = cut(rows[0].unionByName(rows[1]))
    target.clear()
    return out.where(F.lit(target.read() is None))


@query("SELECT run, count(*) FILTER (run = 1 OR len(w) = 0)::BIGINT AS extracted, count(*) FILTER (run = 1 OR len(w) = 0 OR aesthetic IS NULL OR scene_conf IS NULL)::BIGINT AS scored, count(*)::BIGINT AS published FROM items, (VALUES (1), (2)) t(run) GROUP BY run", "items")
def rerun_unchanged(s, d):
    """Two whole runs over the same documents: the second extracts and scores only what still lacks a value, such as texts without words."""
    # the scan brings each document's row, so a batch reads its own rows only, whatever the tables hold
    scanned = cut(told(s, d, table(s, d, "documents").select("doc_id", "source", "text", doc_path())).withColumn("mtime", F.col("ts")))
    made = lambda rows: as_items(text_metrics_and_fp(rows, TOLD), ("fp",))
    scored = lambda rows: rows.select("path", *scene_columns())
    target, out = files.Snapshots(s, f"{shared_dir(s)}/{s.sparkContext.applicationId}/runs-{uuid.uuid4().hex}"), []
    for run in (1, 2):
        watch = progress.Phases(s)
        collection.run_collection(target, scanned, made, scored, CONFIG, SIGNATURE, "/root", watch=watch, carried=("event_type", "value", "props"))
        of = lambda phase: F.coalesce(F.sum(F.when(F.col("phase") == phase, F.col("rows"))), F.lit(0)).alias({"features": "extracted", "scores": "scored", "publish": "published"}[phase])
        out.append(watch.table().agg(of("features"), of("scores"), of("publish")).select(F.lit(run).alias("run"), "extracted", "scored", "published"))
    return out[0].unionByName(out[1])


# progress
@query("SELECT event_type AS phase, count(*)::BIGINT AS rows, round(sum(value), 3) AS total, round(100 * sum(value) / (SELECT sum(value) FROM events), 5) AS share FROM events GROUP BY event_type")
def phase_shares(s, d):
    """Events as a log of phases, their values as seconds."""
    return progress.phase_shares(table(s, d, "events"), "event_type", "value").select("phase", "rows", r6(F.col("total"), "total", 3), r6(F.col("share"), "share"))


@query("SELECT phase, count(*)::BIGINT AS rows, CASE WHEN phase = 'judge' THEN count(*) FILTER (is_waste) END::BIGINT AS waste, 100.0::DOUBLE AS shares FROM judged, (VALUES ('group'), ('score'), ('judge')) p(phase) GROUP BY phase", "judged")
def run_progress(s, d):
    """Rows that each phase of a curation has told of; the phases' shares of its seconds sum up to 100."""
    watch = progress.Phases(s)
    watch.run("judge", plan.curate(full_items(s, d), CONFIG, watch=watch), waste=F.count_if("is_waste"))
    t = watch.table()
    return t.crossJoin(F.broadcast(t.agg(F.round(F.sum("share"), 6).alias("shares")))).select("phase", "rows", F.col("also")["waste"].cast("long").alias("waste"), "shares")  # one row


# grids, vectors, landmarks
@query()
def laplacian_var(s, d):
    m = features.grid_metrics(table(s, d, "embeddings"), "embedding", 8, 0.1, -0.1)
    return m.select("vec_id", r6(F.col("laplacian_var"), "laplacian_var"), r6(F.col("noise"), "noise", 7))


@query("SELECT vec_id, round(len(list_filter(v, lambda x: x >= 0.1::DOUBLE)) / 64.0::DOUBLE, 5) AS over_ratio, round(len(list_filter(v, lambda x: x < -0.1::DOUBLE)) / 64.0::DOUBLE, 5) AS under_ratio FROM vecs", "vecs")
def tail_ratio(s, d):
    m = features.grid_metrics(table(s, d, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), "embedding", 8, 0.1, -0.1)
    return m.select("vec_id", r6(F.col("over_ratio"), "over_ratio"), r6(F.col("under_ratio"), "under_ratio"))


@query(f"SELECT vec_id, {_signed('fp')} AS fp FROM (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN v[i + 1] > m THEN pow(2::HUGEINT, i)::HUGEINT ELSE 0::HUGEINT END))::UBIGINT AS fp FROM (SELECT vec_id, v, list_aggregate(v, 'median') AS m FROM vecs))", "vecs")
def grid_fingerprint(s, d):
    return table(s, d, "embeddings").select("vec_id", X.grid_bits(F.col("embedding")).alias("fp"))


_POINT = lambda a, b: f"sqrt(pow(v[{2 * a + 1}] - v[{2 * b + 1}], 2) + pow(v[{2 * a + 2}] - v[{2 * b + 2}], 2))"
_EYE = lambda o: f"(({_POINT(o + 2, o + 4)} + {_POINT(o + 3, o + 5)}) / (2.0::DOUBLE * {_POINT(o, o + 1)} + 1e-9::DOUBLE))"


@query(f"SELECT vec_id, round(least(({_EYE(0)} + {_EYE(6)}) / 2, ({_EYE(12)} + {_EYE(18)}) / 2), 5) AS ear FROM vecs", "vecs")
def min_ear(s, d):
    point = lambda i: F.struct(F.element_at("embedding", 2 * i + 1).cast("double").alias("x"), F.element_at("embedding", 2 * i + 2).cast("double").alias("y"))
    faces = F.array(*(F.array(*(point(i) for i in range(b, b + 12))) for b in (0, 12)))
    return features.min_ear(table(s, d, "embeddings"), faces, ((0, 1, 2, 3, 4, 5), (6, 7, 8, 9, 10, 11))).select("vec_id", r6(F.col("ear"), "ear"))


@query("SELECT vec_id, round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, (list_sum(list_transform(range(64), lambda i: v[i + 1] * (((i % 7) - 3) / 10.0::DOUBLE))) / n + 5) * 10)), 5) AS score FROM vecs", "vecs")
def linear_head_score(s, d):
    return table(s, d, "embeddings").select("vec_id", r6(X.linear_head_score(F.col("embedding"), [((i % 7) - 3) / 10.0 for i in range(64)], 5.0), "score"))


_PROTO = "p AS (SELECT label, list(c ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(range(64)) AS i, unnest(list_transform(v, lambda y: y / n)) AS x FROM vecs) GROUP BY label, i) GROUP BY label), l AS (SELECT vec_id, p.label, 20.0::DOUBLE * list_sum(list_transform(range(64), lambda i: v[i + 1] * c[i + 1])) / n AS z FROM vecs, p), e AS (SELECT vec_id, label, exp(z - max(z) OVER (PARTITION BY vec_id)) / sum(exp(z - max_z)) OVER (PARTITION BY vec_id) AS q FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS max_z FROM l))"


@query()
def zero_shot_class(s, d):
    v = table(s, d, "embeddings")
    return features.zero_shot(v, "embedding", features.prototypes(v, "embedding", "label"), 20.0, 0.6).select("vec_id", "class", r6(F.col("confidence"), "confidence", 4))


@query()
def prompt_score(s, d):
    v = table(s, d, "embeddings")
    p = features.prototypes(v, "embedding", "label")
    half = len(p) // 2
    return features.prompt_score(v, "embedding", [c for _, c in p[:half]], [c for _, c in p[half:]], 20.0).select("vec_id", r6(F.col("prompt_score"), "prompt_score", 4))


_SQL["zero_shot_class"] = f"WITH vecs AS ({CTES['vecs']}), {_PROTO} SELECT vec_id, CASE WHEN max(q) < 0.6 THEN -1 ELSE arg_max(label, q) END AS class, round(max(q), 4) AS confidence FROM e GROUP BY vec_id"
_SQL["prompt_score"] = f"WITH vecs AS ({CTES['vecs']}), {_PROTO} SELECT vec_id, round(100.0::DOUBLE * sum(q) FILTER (label IN (SELECT label FROM p ORDER BY label LIMIT (SELECT count(*) // 2 FROM p))), 4) AS prompt_score FROM e GROUP BY vec_id"
_SQL["laplacian_var"] = f"WITH vecs AS ({CTES['vecs']}), k AS (SELECT vec_id, list_transform(range(64), lambda i: v[abs(i // 8 - 1) * 8 + i % 8 + 1] + v[(7 - abs(7 - (i // 8 + 1))) * 8 + i % 8 + 1] + v[i // 8 * 8 + abs(i % 8 - 1) + 1] + v[i // 8 * 8 + 7 - abs(7 - (i % 8 + 1)) + 1] - 4 * v[i + 1]) AS l FROM vecs) SELECT vec_id, round(list_aggregate(l, 'var_pop'), 5) AS laplacian_var, round(list_avg(list_transform(l, lambda x: abs(x))) / 255, 7) AS noise FROM k"


@query("SELECT path, CASE WHEN ear BETWEEN 0.20::DOUBLE AND 0.33::DOUBLE THEN (doc_id * 13 % 100) / 100.0::DOUBLE END AS prob, closed FROM norms", "norms")
def cascade_score(s, d):
    i = items(s, d).select("doc_id", "path", "ear")
    return features.cascade(i, lambda pdf: pdf["doc_id"] * 13 % 100 / 100.0, CONFIG).select("path", "prob", "closed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
