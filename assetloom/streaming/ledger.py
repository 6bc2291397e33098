"""Costly work in batches that are kept as they end, so that a run which dies loses one batch."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetloom.operators.progress import Phases


class Ledger:
    """Finished batches of stages below a folder, for one signature of models and one source; others' batches are not seen.

    `work` deals what is to do to files, and an available-now stream takes some at a time: a batch's result is written to a
    folder of the run's and the batch's number, so a batch that comes again replaces what it wrote. A later run reads what
    all runs have finished with `done`, and does the rest. `clear` removes everything once a version holds it.
    """

    def __init__(self, spark: SparkSession, root: str, signature: str | None = None, source: str | None = None, batch_rows: int = 100_000, watch: Phases | None = None):
        self.spark, self.batch_rows, self.watch = spark, batch_rows, watch
        self.root = f"{root.rstrip('/')}/{hashlib.md5(f'{signature}|{source}'.encode(), usedforsecurity=False).hexdigest()}"

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def done(self, stage: str, schema: str, key: str = "path") -> DataFrame:
        """Rows of all finished batches of a stage, the latest of each key; an empty frame of that schema if there are none."""
        folder = f"{self.root}/{stage}/done"
        if not self._there(folder):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, at bigint, run string, batch bigint").option("basePath", folder).parquet(folder)
        names = [c for c in rows.columns if c not in (key, "at", "run", "batch")]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("at", "run", "batch")).alias("x"))
        return last.select(key, *(F.col("x")[c].alias(c) for c in names))

    def work(self, stage: str, todo: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """Do `make` over the rows of `todo`, batch by batch, and keep each result. Returns the number of rows to do. If a batch fails, so does this; the batches before stay."""
        run, cores = uuid.uuid4().hex, self.spark.sparkContext.defaultParallelism
        at, place = f"{self.root}/{stage}/work/{run}", f"{self.root}/{stage}/done/run={run}"
        todo.write.parquet(f"{at}/rows")
        rows = self.spark.read.schema(todo.schema).parquet(f"{at}/rows")
        n = rows.count()
        if not n:
            return 0
        batches = -(-n // self.batch_rows)
        files = min(cores, -(-n // batches))
        rows.repartition(batches * files).write.parquet(f"{at}/todo")

        def end(batch: DataFrame, number: int) -> None:
            # named by the batch's number alone: a replay replaces it
            began = F.lit(time.time_ns())
            save = lambda df: df.withColumn("at", began).write.mode("overwrite").parquet(f"{place}/batch={number}")
            if self.watch:
                self.watch.run(stage, make(batch), save)
            else:
                save(make(batch))

        stream = self.spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", files).parquet(f"{at}/todo")
        stream.writeStream.foreachBatch(end).queryName(f"{stage}-{run}").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return n

    def clear(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
