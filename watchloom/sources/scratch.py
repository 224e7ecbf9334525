"""Written tables in the folder that the cluster shares, used to cut lineage.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and all of Spark runs in one process
(``local``, as in tests) a folder under ``/tmp/checkpoints`` is used; on a cluster a missing setting is an error, because
executors would write to their own disks. Every table is written by Spark's committed Parquet writer, so a lost executor costs a
task, never a table.
"""

from __future__ import annotations

import atexit
import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        return "file:///tmp/checkpoints"
    raise ValueError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")


class Store:
    """One folder of written tables; it goes when the driver ends, single tables go with ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/watchloom-{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._clean)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, rows: int = 0) -> DataFrame:
        """``rows``: at most so many rows a file (0: any number). Readers decode thousands of rows at once, so rows of many MB get files of their own."""
        df.write.option("maxRecordsPerFile", rows).mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def release(self) -> None:
        """Frees the shuffle files of finished steps: they go once the JVM has collected the plans that wrote them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass
