"""What a run's phases did: rows counted while they pass, seconds, and shares."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from assetloom.session import cut

#: Called with a phase's name and the rows it has done when it, or a batch of it, ends.
Told = Callable[[str, int], None]


class Phases:
    """Phases of a run in the order in which they end. Rows are counted by an observed metric of the job that writes the phase's result, so nothing is read a second time."""

    def __init__(self, spark: SparkSession, told: Told | None = None):
        self.spark, self.told, self.ended = spark, told, []

    def run(self, name: str, df: DataFrame, action: Callable[[DataFrame], object] = cut, **also: Column) -> object:
        """Run the action over the rows of `df`, which it must read once; its result is returned. `also` names more aggregates to observe."""
        seen, began = Observation(), time.monotonic()
        out = action(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in also.items())))
        values = seen.get
        self.add(name, time.monotonic() - began, values.get("rows") or 0, **{n: values.get(n) for n in also})
        return out

    def add(self, name: str, seconds: float, rows: int, **also: object) -> None:
        self.ended.append({"phase": name, "seconds": float(seconds), "rows": int(rows), "also": {k: str(v) for k, v in also.items()}})
        if self.told:
            self.told(name, rows)

    def table(self) -> DataFrame:
        """`(phase, rows, seconds, share, also)`: a row for each phase, batches of one summed up. As many rows as a run has phases."""
        every = self.spark.createDataFrame([(i, e["phase"], e["rows"], e["seconds"], e["also"]) for i, e in enumerate(self.ended)], "i int, phase string, rows bigint, seconds double, also map<string,string>")
        summed = every.groupBy("phase").agg(F.min("i").alias("i"), F.sum("rows").alias("rows"), F.sum("seconds").alias("seconds"), F.max_by("also", "i").alias("also"))
        return shares(summed, "seconds").orderBy("i").select("phase", "rows", "seconds", "share", "also")


def shares(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Add each row's part of the sum of `value`, in percent; null where the sum is 0 or the value is null."""
    total = df.agg(F.sum(value).alias("total__"))  # one row
    return df.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("total__") != 0, 100.0 * F.col(value) / F.col("total__"))).drop("total__")


def phase_shares(log: DataFrame, phase: str, value: str) -> DataFrame:
    """`(phase, rows, total, share)` of a log with a value (such as seconds) in each row: rows and sums by phase, and each sum's part of all, in percent."""
    sums = log.groupBy(F.col(phase).alias("phase")).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
    return shares(sums, "total")


class BatchProgress(StreamingQueryListener):
    """Tells of every batch that a streaming query ends: by `spark.streams.addListener(BatchProgress(phases))`. Only queries with a name are told of."""

    def __init__(self, phases: Phases, names: tuple[str, ...] | None = None):
        self.phases, self.names = phases, names

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if p.name and (self.names is None or p.name in self.names) and p.numInputRows:
            self.phases.add(p.name, p.durationMs.get("triggerExecution", 0) / 1000.0, p.numInputRows, batch=p.batchId)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass
