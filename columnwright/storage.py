"""Intermediate tables kept in the shared folder of the cluster."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, as the cluster names it.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="columnwright-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/columnwright/{name}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class Stored:
    """A table written once, so that lost executors never recompute what led to it."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        """Delete the files. Only for tables no later query reads."""
        delete(self.df.sparkSession, self.path)

    def keep(self) -> None:
        """Take the table out of the block it belongs to."""
        for made in _blocks.get():
            if self.path in made:
                made.remove(self.path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


# Paths written in each open block, the innermost last.
_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("blocks", default=())


@contextmanager
def scratch() -> Iterator[None]:
    """Delete what is stored inside this block at its end, also after an error.

    A ``lasting`` table belongs to the block around it, or stays if there is none.
    """
    made: list[str] = []
    token = _blocks.set((*_blocks.get(), made))
    try:
        yield
    finally:
        _blocks.reset(token)
        spark = SparkSession.getActiveSession()
        for path in made:
            delete(spark, path)


def store(df: DataFrame, name: str = "table", lasting: bool = False) -> Stored:
    """Write ``df`` as Parquet and read it back: short lineage, column pruning, real sizes."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    blocks = _blocks.get()[:-1] if lasting else _blocks.get()
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)
