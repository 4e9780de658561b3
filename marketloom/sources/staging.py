"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from marketloom.sources import files

_STAGED: set[str] = set()
_LOCK = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A session on one machine that names none (tests) gets a temporary one; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not taken; clear_staged() deletes what is written there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with _LOCK:
        _STAGED.add(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that repeated passes neither compute it again nor depend on single executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Deletes all that was staged; for use when results that read it are written or collected."""
    with _LOCK:
        paths = list(_STAGED)
        _STAGED.clear()
    for path in paths:
        files.delete(spark, path)
