"""Cutting lineage where an operator iterates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, kind: str = "cut") -> str:
    """A new folder's name under spark.checkpoint.dir, which all executors share; only where that setting is missing on one
    machine does a temporary folder serve."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{tempfile.gettempdir()}/quillstream-checkpoints"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read again, in columns: its plan runs once, and what is read is pruned."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quillstream_path = path  # noqa: SLF001
    return out


def dropped(df: DataFrame) -> None:
    """Deletes what cut() wrote, once no frame that is still to run reads it."""
    path, spark = getattr(df, "_quillstream_path", None), df.sparkSession
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)  # noqa: SLF001
