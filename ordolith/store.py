"""Tables in the folder that driver and executors share; they end lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where the session is local and names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ordolith-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/ordolith/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    at = fresh_path(df.sparkSession, what)
    df.write.parquet(at)
    back = df.sparkSession.read.schema(df.schema).parquet(at)
    back.stored_at = at
    return back


def drop_stored(*frames: DataFrame) -> None:
    """Delete the files of frames from ``stored`` that nothing reads any more."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)
