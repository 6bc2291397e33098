"""Structured Streaming forms: resumable ingest, online bursts, decision state, near-duplicates of stored items."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from assetloom.functions.exprs import hamming
from assetloom.operators.incremental import upsert
from assetloom.operators.similarity import BROADCAST_ROWS, band_radius, bands
from assetloom.session import cut, ready
from assetloom.sources.files import Snapshots


def ingest(spark: SparkSession, source: str, schema: str | StructType, features: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, files: int = 16) -> StreamingQuery:
    """Feature extraction over new files of a folder, some files at a time, each batch written to a folder of its number.

    A batch costs what it holds, whatever is stored already. A stopped run goes on where its checkpoint is, and a batch
    that comes again replaces what it wrote before. `folder` and `checkpoint` belong together; `compact` merges the batches.
    """
    def add(batch: DataFrame, number: int) -> None:
        features(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compact(spark: SparkSession, folder: str, target: Snapshots, key: str = "path") -> int | None:
    """Merge the batches of `folder` that the snapshot does not have yet into its next version, later ones over earlier. Returns that version, None if there are none."""
    done = int(target.meta("batch") or -1)
    new = spark.read.option("basePath", folder).parquet(folder).where(F.col("batch") > done)
    last = new.agg(F.max("batch")).first()[0]
    if last is None:
        return None
    old = target.read()
    old = new.drop("batch").limit(0) if old is None else old
    return target.publish(upsert(old, new, key, seq="batch"), batch=str(last))


def online_bursts(events: DataFrame, gap_us: int, late: str, by: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """Bursts as session windows: neighbours less than the gap apart. A session window merges at exactly its gap, so it is one microsecond less."""
    w = F.session_window(ts, F.lit(f"{gap_us - 1} microseconds"))
    return events.withWatermark(ts, late).groupBy(*(by or []), w).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))


class ItemSessions(StatefulProcessor):
    """Keyed: the items of sessions that are still open; of one key, or of all keys (column `by`) that share a state. Sends each item with its session's first time, and again when a late item changes that."""

    def __init__(self, gap_us: int, id: str, us: str, by: str | None = None):
        self.gap, self.id, self.us, self.by = gap_us, id, us, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # 64-bit integers as bytes, by key and time; n: items of each key
        self.open = handle.getValueState("open", "keys array<string>, n binary, at binary, id binary, first binary")

    def _kept(self) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, and of each item that is kept its key's place, time, id and session's first time."""
        keys, *parts = self.open.get() if self.open.exists() else ([], b"", b"", b"", b"")
        n, at, ids, first = (np.frombuffer(x, np.int64) for x in parts)
        return list(keys), np.repeat(np.arange(len(keys)), n), at, ids, first

    def _ends(self, key: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last item of each session, and the milliseconds at which they close."""
        ends = np.flatnonzero(np.append((np.diff(key) != 0) | (np.diff(first) != 0), True)) if len(at) else np.zeros(0, np.int64)
        return ends, -(-(at[ends] + self.gap) // 1000)

    def _keep(self, keys: list, key: np.ndarray, at: np.ndarray, ids: np.ndarray, first: np.ndarray, watermark_ms: int, timer: int | None) -> None:
        """Keep what later items can still join, and wake up when the first of it is closed; `timer` is the one that is set."""
        ends, close = self._ends(key, at, first)
        open_ = close > watermark_ms
        wake = int(close[open_].min()) if open_.any() else None
        if timer != wake:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if wake is None:
            self.open.clear()
        else:
            alive = np.repeat(open_, np.diff(ends, prepend=-1))
            n = np.bincount(key[alive], minlength=len(keys))
            some = np.flatnonzero(n)
            self.open.update(([keys[i] for i in some], *(x.astype(np.int64).tobytes() for x in (n[some], at[alive], ids[alive], first[alive]))))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        keys, of, at, ids, told = self._kept()
        known = len(at)
        timer = int(self._ends(of, at, told)[1].min()) if known else None  # as set when this was kept
        new_keys = pdf[self.by].to_numpy(object) if self.by else np.full(len(pdf), key[0], object)
        place, distinct = pd.factorize(np.concatenate([np.array(keys, object), new_keys]), use_na_sentinel=False)
        of = np.concatenate([of, place[len(keys) :]])  # those that are known come first, in their order
        keys = [None if pd.isna(k) else str(k) for k in distinct]
        at, ids = np.concatenate([at, pdf[self.us].to_numpy(np.int64)]), np.concatenate([ids, pdf[self.id].to_numpy(np.int64)])
        told = np.concatenate([told, np.zeros(len(pdf), np.int64)])
        new = np.arange(len(at)) >= known
        order = np.lexsort((ids, at, of))
        of, at, ids, told, new = of[order], at[order], ids[order], told[order], new[order]
        starts = np.append(True, (np.diff(of) != 0) | (np.diff(at) >= self.gap))
        first = at[starts][np.cumsum(starts) - 1]
        send = new | (first != told)
        yield pd.DataFrame({"key": np.array(keys, object)[of[send]], "id": ids[send], "at": at[send], "session_start": first[send], "correction": ~new[send]})
        self._keep(keys, of, at, ids, first, timerValues.getCurrentWatermarkInMs(), timer)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            self._keep(*self._kept(), timerValues.getCurrentWatermarkInMs(), None)  # the one that was set is spent
        yield pd.DataFrame({"key": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "at": pd.Series(dtype="int64"), "session_start": pd.Series(dtype="int64"), "correction": pd.Series(dtype=bool)})


#: Keys are dealt to so many states by their hash: a call and an update serve all keys of one.
SHARED_STATES = 1024


def item_sessions(events: DataFrame, gap_us: int, late: str, by: str, id: str, ts: str = "ts", states: int = SHARED_STATES) -> DataFrame:
    """`(key, id, at, session_start, correction)` of a stream: each item as it comes, with the first time (microseconds) of
    its burst, whose neighbours are less than the gap apart; once more, as a correction, whenever a late item joins two
    bursts or begins one earlier. Each item's last row is what `sessions` gives for all. Items later than `late` are
    dropped, and a burst is forgotten when the watermark is past its gap. Append mode, with RocksDB (`rocksdb_state`).

    Keys share `states` states, each read and written as a whole by a batch that has items of any of its keys: more of
    them suit a stream of small batches over much open state. A checkpoint belongs to one number of states.
    """
    ready(events.sparkSession)
    rows = events.withWatermark(ts, late).where(F.col(ts).isNotNull()).select(F.col(by).cast("string").alias("key"), F.col(id).cast("long").alias("id"), F.col(ts), F.unix_micros(ts).alias("us"))
    shared = rows.withColumn("state", F.pmod(F.xxhash64("key"), F.lit(states)))
    return shared.groupBy("state").transformWithStateInPandas(ItemSessions(gap_us, "id", "us", "key"), "key string, id bigint, at bigint, session_start bigint, correction boolean", "append", "eventTime")


def decision_stream(log: DataFrame) -> DataFrame:
    """Latest `(path, star, label, scene_manual)` of a stream of decisions, in update mode; a lower seq never overwrites a
    higher one. It keeps only the latest of each field, so rows of kind `undo` are not heeded: `settled_decisions` heeds them."""
    fields = ("star", "label", "scene")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, values = (list(x) for x in state.get) if state.exists else ([-1, -1, -1], [None, None, None])
        for pdf in batches:
            last = pdf.sort_values("seq", kind="stable").drop_duplicates("field", keep="last").set_index("field")
            for i, f in enumerate(fields):
                if f in last.index and last.at[f, "seq"] >= seqs[i]:
                    seqs[i], values[i] = int(last.at[f, "seq"]), last.at[f, "value"]
        state.update((seqs, values))
        yield pd.DataFrame([(key[0], pd.to_numeric(values[0], errors="coerce"), values[1], values[2])], columns=["path", "star", "label", "scene_manual"]).astype({"star": "Int32"})

    pick = F.array(F.struct(F.lit("label").alias("field"), F.col("value").alias("value")), F.struct(F.lit("star").alias("field"), F.when(F.col("value") == "P", "5").otherwise("0").alias("value")))
    one = F.array(F.struct(F.col("kind").alias("field"), F.col("value").alias("value")))
    sets = log.where(F.col("kind").isin("pick", *fields)).select("seq", "path", F.explode(F.when(F.col("kind") == "pick", pick).otherwise(one)).alias("f")).select("seq", "path", "f.field", "f.value")
    return sets.groupBy("path").applyInPandasWithState(step, "path string, star int, label string, scene_manual string", "seqs array<bigint>, vals array<string>", "update", GroupStateTimeout.NoTimeout)


#: Decisions of so many numbers in a row, as a power of two, have one state: a call and an update serve them all.
RANGE_BITS = 12


class Settled(StatefulProcessor):
    """Keyed by a range of decisions' numbers: sends each decision once, and its cancellation once, in whatever order decision and undo come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "seq array<bigint>, decided array<boolean>, path array<string>, kind array<string>, value array<string>, undone array<boolean>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        known = {seq: (tuple(row) if decided else None, undone) for seq, decided, *row, undone in zip(*self.known.get(), strict=True)} if self.known.exists() else {}
        undos, out = pdf["kind"] == "undo", []
        for seq in pdf.loc[undos, "seq"].unique().tolist():
            row, undone = known.get(seq, (None, False))
            if row is not None and not undone:
                out.append((seq, *row, True))
            known[seq] = row, True
        decided = pdf.loc[~undos, ["seq", "path", "kind", "value"]].drop_duplicates("seq")
        for seq, *new in zip(*(decided[c].tolist() for c in decided.columns), strict=True):
            row, undone = known.get(seq, (None, False))
            if row is None:
                row = tuple(None if pd.isna(x) else x for x in new)
                known[seq] = row, undone
                if not undone:
                    out.append((seq, *row, False))
        none = (None, None, None)
        parts = list(zip(*((row or none) for row, _ in known.values()), strict=True))
        self.known.update((list(known), [row is not None for row, _ in known.values()], *map(list, parts), [undone for _, undone in known.values()]))
        yield pd.DataFrame(out, columns=["seq", "path", "kind", "value", "cancel"])


class LatestFields(StatefulProcessor):
    """Keyed by path: every decision that holds, and the latest value of each field when any comes or goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seq array<bigint>, kind array<string>, value array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = {seq: (kind, value) for seq, kind, value in zip(*self.held.get(), strict=True)} if self.held.exists() else {}
        for pdf in rows:
            each = list(zip(*(pdf[c].tolist() for c in ("seq", "kind", "value", "cancel")), strict=True))
            held.update((seq, (kind, None if pd.isna(value) else value)) for seq, kind, value, cancel in each if not cancel)
            for seq, _, _, cancel in each:
                if cancel:
                    held.pop(seq, None)
        self.held.update((list(held), [kind for kind, _ in held.values()], [value for _, value in held.values()]))
        last: dict[str, tuple] = {}
        for seq, (kind, value) in held.items():
            sets = {"label": value, "star": "5" if value == "P" else "0"} if kind == "pick" else {kind: value}
            for field, v in sets.items():
                last[field] = max(last.get(field, (-1, None)), (seq, v), key=lambda x: x[0])
        star, label, scene = (last.get(f, (0, None))[1] for f in ("star", "label", "scene"))
        try:
            star = int(star.strip()) if star is not None else None
        except ValueError:
            star = None
        yield pd.DataFrame({"path": [key[0]], "star": pd.array([star], "Int32"), "label": pd.Series([label], dtype=object), "scene_manual": pd.Series([scene], dtype=object)})


def settled_decisions(log: DataFrame) -> DataFrame:
    """`(path, star, label, scene_manual)` of a stream of decisions and undos `(seq, path, kind, value)`, in append mode: a
    path's state each time it changes, the last one counts, nulls where nothing holds any more.

    An undo names the number of a decision, maybe of another path and maybe one that is still to come. So both are keyed
    by that number first, `1 << RANGE_BITS` numbers in a row as one key, whose state is read and written as a whole; what
    it settles goes on by path, where all decisions that hold are kept, as an undo may reach back any time. Ends at what `fold(without_undone(log))` gives for the whole log. The session needs RocksDB as its state
    store (`rocksdb_state`).
    """
    undo = F.col("kind") == "undo"
    rows = log.where(F.col("kind").isin("undo", "pick", "star", "label", "scene"))
    keyed = rows.select(F.when(undo, F.col("value").try_cast("bigint")).otherwise(F.col("seq")).alias("seq"), "path", "kind", "value").where("seq is not null")
    ready(log.sparkSession)
    each = keyed.withColumn("range", F.shiftright("seq", RANGE_BITS)).groupBy("range").transformWithStateInPandas(Settled(), "seq bigint, path string, kind string, value string, cancel boolean", "append", "none")
    return each.groupBy("path").transformWithStateInPandas(LatestFields(), "path string, star int, label string, scene_manual string", "append", "none")


def rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB, on disk, as `settled_decisions` needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def band_index(stored: DataFrame) -> DataFrame:
    """Four rows `(stored, fp, at)` for each fingerprint of stored items `(path, fp)`, with the least path that has it. Write it once and add to it; `near_stored` reads it."""
    return bands(stored.where("fp is not null").groupBy("fp").agg(F.min("path").alias("stored")), 0, ["stored", "fp"])


class BandIndex:
    """The `band_index` of stored items, kept in a folder as a table bucketed by band value and added to by version.

    A search deals only the new items to the buckets; stored rows are read where they are, without an exchange. A version
    that is added twice, by a run that came again, is no harm: of a fingerprint's paths the least counts. Items that are
    stored no longer are left out by the caller, who knows which are there.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.name = "bands_" + hashlib.md5(self.folder.encode(), usedforsecurity=False).hexdigest()
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (stored STRING, fp BIGINT, at INT, version INT) USING parquet CLUSTERED BY (at) SORTED BY (at) INTO {buckets} BUCKETS LOCATION '{self.folder}'")

    def add(self, items: DataFrame, version: int) -> None:
        """Add the items `(path, fp)` of a version. Rows are dealt by bucket first, so each writes one file."""
        rows = band_index(items).select("stored", "fp", "at", F.lit(version).alias("version")).repartition(self.buckets, "at")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "at").sortBy("at").option("path", self.folder).saveAsTable(self.name)

    def read(self, upto: int | None = None) -> DataFrame:
        """Rows of all versions, or of those up to one."""
        rows = self.spark.table(self.name)
        return rows if upto is None else rows.where(F.col("version") <= upto)


def near_stored(batch: DataFrame, index: DataFrame, threshold: int = 12, most: int = BROADCAST_ROWS) -> DataFrame:
    """For `foreachBatch`: `(path, stored, dist)` of a new item `(path, fp)` and, for each close stored fingerprint of the
    `band_index`, the least stored path. Only the batch's fingerprints are widened; stored ones meet them as they are, not
    each other. Widened rows are sent to all tasks while they are counted as `most` at most, else dealt by band value, as a
    `BandIndex` is already."""
    new = cut(bands(batch.select("fp").where("fp is not null").distinct(), band_radius(threshold), ["fp"]).withColumnRenamed("fp", "new_fp"))
    few = new.count() <= most  # counted, as estimates do not see how often rows were exploded
    dist = hamming(F.col("new_fp"), F.col("fp"))
    met = index.join(new.hint("broadcast" if few else "merge"), "at").where(dist < threshold).select("new_fp", "fp", "stored", dist.alias("dist"))
    least = met.groupBy("new_fp", "fp").agg(F.min("stored").alias("stored"), F.first("dist").alias("dist")).drop("fp")  # once, in however many bands
    return batch.select("path", "fp").join(least, F.col("fp") == F.col("new_fp")).select("path", "stored", "dist")
