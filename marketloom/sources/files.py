"""Small files beside tables: markers and manifests, by the file system of their path. Only names and short texts pass through the driver."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _at(spark, path)
    return system.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; nothing if it isn't there."""
    at, system = _at(spark, path)
    system.delete(at, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    at, system = _at(spark, folder)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def read_json(spark: SparkSession, path: str) -> dict:
    at, system = _at(spark, path)
    stream = system.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish_json(spark: SparkSession, path: str, content: dict) -> None:
    """Writes a file that appears whole or not at all. Raises FileExistsError if there is one: of two writers one wins.

    The text goes to a hidden file first, which is renamed without overwriting.
    """
    at, system = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{spark._jvm.java.util.UUID.randomUUID()}")
    stream = system.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    none = spark.sparkContext._gateway.new_array(rename, 1)
    none[0] = rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(system.makeQualified(draft), system.makeQualified(at), none)
    except Exception as e:
        system.delete(draft, False)
        if system.exists(at):
            raise FileExistsError(path) from e
        raise
