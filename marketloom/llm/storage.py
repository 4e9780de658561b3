"""Where intermediate tables go: the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from marketloom.sources import files
from marketloom.sources.staging import shared_folder


#: Bytes of an Arrow batch on its way to a task's Python; by rows alone, 10,000 texts are one batch, held on both sides at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: What this Python worker keeps from task to task, by operator and name.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make):
    """What make() gives, made once a Python worker and kept for its later tasks, until one of another operator lets it go."""
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Forgets what tasks of other operators left in this Python worker: workers serve all stages of a session, and each keeps its own."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()


#: Paths of the tables written in each open scratch() of this thread of work, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_scratches", default=())


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors, gives true sizes.

    Within scratch() the table is deleted at its end, unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _OPEN.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, what was written within and not kept. What leaves it must be a kept table."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own:
            files.delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH_BYTES (a longer row is a batch of its own), unless they are bounded by less.

    It stays so, since what a stage returns is computed after it has returned. Results don't depend on it.
    """
    spark.conf.set(_BATCH, str(min(BATCH_BYTES, _bytes(spark.conf.get(_BATCH)))))


def _bytes(text: str) -> int:
    number = text.strip().lower().rstrip("bkmgtp")
    unit = text.strip().lower()[len(number) :].rstrip("b") or "b"
    return int(number) << 10 * "bkmgtp".index(unit)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, made of `name`."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
