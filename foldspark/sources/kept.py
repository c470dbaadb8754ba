"""Intermediate tables in the session's shared folder: they outlive a lost executor, cut lineage, and are wiped when nothing reads them any more."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a folder of our own, but only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="foldspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Kept:
    """Tables of one run. ``drop`` deletes one, ``wipe`` all; what is left goes with the session."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0
        atexit.register(self._end)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_path = path
        return out

    def drop(self, table: DataFrame) -> None:
        if path := getattr(table, "_kept_path", None):
            delete(self.spark, path)

    def wipe(self) -> None:
        if self.n:
            delete(self.spark, self.root)
            self.n = 0

    def _end(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self.wipe()
        except Exception:  # noqa: BLE001 - the session may be gone, and with it the way to the store
            pass
