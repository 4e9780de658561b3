"""Versioned tables: every run writes all tables of a version beside the old ones, and publishing a manifest makes it the current one.

Layout below a folder: v=00000001/<table>/ has the rows, manifests/00000001.json names the tables with their rows and schemas. A version
without manifest is no version: readers never see it, and the next run takes another folder for it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from marketloom.sources import files


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, oldest first."""
    return [int(n.removesuffix(".json")) for n in files.names(spark, f"{folder}/manifests") if n[0] != "."]


def current(spark: SparkSession, folder: str) -> int:
    """The last complete version, 0 if there is none."""
    return max(versions(spark, folder), default=0)


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], after: int) -> int:
    """Writes all tables as the version that follows `after`, and makes it current. Returns its number.

    Tables may read the version before, since nothing is overwritten. If another writer has published the same version meanwhile, this one
    raises FileExistsError and nothing changes: start again from that version.
    """
    number, own = after + 1, uuid.uuid4().hex
    about = {}
    for name, df in tables.items():
        path = f"v={number:08d}-{own}/{name}"
        df.write.parquet(f"{folder}/{path}")
        rows = spark.read.schema(df.schema).parquet(f"{folder}/{path}").count()  # by the footers
        about[name] = {"path": path, "rows": rows, "schema": df.schema.jsonValue()}
    try:
        files.publish_json(spark, f"{folder}/manifests/{number:08d}.json", {"version": number, "tables": about})
    except FileExistsError:
        files.delete(spark, f"{folder}/v={number:08d}-{own}")
        raise
    return number


def table(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame | None:
    """A table of the given version, by default of the current one. None if no version is complete yet."""
    version = current(spark, folder) if version is None else version
    if not version:
        return None
    about = files.read_json(spark, f"{folder}/manifests/{version:08d}.json")["tables"][name]
    return spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{folder}/{about['path']}")


def prune(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Deletes all but the last `keep` complete versions, and what broken runs left for versions up to the current one. Returns the folders deleted."""
    kept = versions(spark, folder)[-keep:]
    paths = {t["path"].split("/")[0] for v in kept for t in files.read_json(spark, f"{folder}/manifests/{v:08d}.json")["tables"].values()}
    old = [n for n in files.names(spark, folder) if n.startswith("v=") and n not in paths and kept and int(n[2:10]) <= kept[-1]]
    for v in versions(spark, folder):
        if v not in kept:
            files.delete(spark, f"{folder}/manifests/{v:08d}.json")
    for n in old:
        files.delete(spark, f"{folder}/{n}")
    return old
