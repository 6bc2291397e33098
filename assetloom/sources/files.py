"""File collections as tables, images, snapshots with a pointer."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from assetloom.config import PHOTO, RAW
from assetloom.session import ready


def scan_collection(spark: SparkSession, root: str, include_raw: bool = False, recursive: bool = True) -> DataFrame:
    """`(path, mtime, size)` of photo files below a root, without hidden files and folders, in no order (sort where it is shown); file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
    below = F.substring("path", F.length(F.regexp_extract("path", r"^(\w+:/*)", 1)) + 1, 1 << 30)
    kinds = "|".join(PHOTO + (RAW if include_raw else ()))
    return files.where(F.lower("path").rlike(rf"\.({kinds})$") & ~below.rlike(r"(^|/)\.[^/]+"))


def capture_times(df: DataFrame, first: str, second: str, mtime: str) -> DataFrame:
    """Add `ts` (first tag, second tag, file time, epoch) and `has_exif`."""
    from assetloom.functions.exprs import parse_capture_time

    tag = F.coalesce(parse_capture_time(F.col(first)), parse_capture_time(F.col(second)))
    return df.withColumns({"ts": F.coalesce(tag, mtime, F.timestamp_micros(F.lit(0))), "has_exif": tag.isNotNull()})


def _bilinear(g: np.ndarray, n: int) -> np.ndarray:
    def places(m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        lo = np.floor(x).astype(int)
        return lo, np.minimum(lo + 1, m - 1), x - lo

    (r0, r1, fr), (c0, c1, fc) = places(g.shape[0]), places(g.shape[1])
    rows = g[r0] * (1 - fr)[:, None] + g[r1] * fr[:, None]
    return rows[:, c0] * (1 - fc) + rows[:, c1] * fc


def _laplacian(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="reflect") if min(g.shape) > 1 else np.pad(g, 1, mode="edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def pixel_metrics(bgr: np.ndarray) -> tuple[float, float, float, float, int]:
    """Focus, over- and under-exposed shares, noise and a 64-bit perceptual hash of one image."""
    grey = bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299
    lap = _laplacian(_bilinear(grey, 512))
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ _bilinear(grey, 32) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low)
    fp = int(sum(1 << i for i in np.flatnonzero(bits)))
    return float(lap.var()), float((grey >= 245).mean()), float((grey < 10).mean()), float(np.abs(_laplacian(grey)).mean() / 255), fp - (1 << 64) if fp >= 1 << 63 else fp


def image_features(spark: SparkSession, root: str) -> DataFrame:
    """`(path, ok, width, height, blur_score, over_ratio, under_ratio, noise, fp)`: decode, metrics and hash in one pass. Files that do not decode stay, with `ok` false."""
    ready(spark)
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                ok = r.height > 0 and r.nChannels in (1, 3, 4)
                if ok:
                    a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels).astype(float)
                    out.append((r.origin, True, r.width, r.height, *pixel_metrics(a if r.nChannels > 1 else np.repeat(a, 3, 2))))
                else:
                    out.append((r.origin, False, None, None, None, None, None, None, None))
            yield pd.DataFrame(out, columns=["path", "ok", "width", "height", "blur_score", "over_ratio", "under_ratio", "noise", "fp"]).astype({"width": "Int32", "height": "Int32", "fp": "Int64"})

    return images.mapInPandas(run, "path string, ok boolean, width int, height int, blur_score double, over_ratio double, under_ratio double, noise double, fp bigint")


class Snapshots:
    """Versions of a table below a folder. A version is written whole, then a pointer row in a folder named by its number makes
    it current; a number that is there is never written again, so of two writers of one number the second fails. Writers
    that start in the same instant are not told apart on stores whose folders have no exclusive creation."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> tuple[JavaObject, JavaObject]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[Row]:
        """Pointer rows, latest first: few, as old versions are removed by `keep`."""
        path, fs = self._path("current")
        schema = "version long, folder string, meta map<string,string>"
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(str(path)).orderBy(F.desc("version")).collect() if fs.exists(path) else []

    def version(self) -> tuple[int, str] | None:
        rows = self._pointers()
        return (rows[0]["version"], rows[0]["folder"]) if rows else None

    def read(self, back: int = 0) -> DataFrame | None:
        """The current version, or the one `back` versions before."""
        rows = self._pointers()
        return self.spark.read.parquet(f"{self.root}/{rows[back]['folder']}") if len(rows) > back else None

    def meta(self, key: str) -> str | None:
        """A value published with the current version, such as source_root or model_signature."""
        rows = self._pointers()
        return (rows[0]["meta"] or {}).get(key) if rows else None

    def publish(self, df: DataFrame, **meta: str) -> int:
        """Write the next version, then its pointer. Values of `meta` are set; those of the version before stay otherwise."""
        rows = self._pointers()
        n, folder = (rows[0]["version"] + 1 if rows else 1), f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        meta = ((rows[0]["meta"] or {}) if rows else {}) | meta
        self.spark.createDataFrame([(n, folder, meta)], "version long, folder string, meta map<string,string>").coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/current/{n}")
        return n

    def keep(self, versions: int) -> None:
        """Remove all but the latest versions; readers of removed ones fail."""
        for r in self._pointers()[max(versions, 1) :]:
            for name in (f"current/{r['version']}", r["folder"]):
                path, fs = self._path(name)
                fs.delete(path, True)

    def clear(self) -> None:
        """Remove all versions."""
        path, fs = self._path("")
        fs.delete(path, True)
