"""Intermediate tables in the cluster's shared folder.

A table written here cuts the lineage: what follows rereads it from shared storage, so a lost
executor costs a reread of its part and nothing before it. The folder is the one that the session
names in `spark.checkpoint.dir`; only a local session without that setting (tests) gets a folder below /tmp,
any other is refused.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_FALLBACK = "/tmp/checkpoints/crossgrain"
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets one where the session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder, and executors do not share a local one")
        found = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path of this application; all of them go when the driver ends."""
    app = f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(_remove, spark, app)
    return f"{app}/{label}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Writes `df` to the shared folder and rereads it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
