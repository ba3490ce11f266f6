"""Intermediate tables in the folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="photarium-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` named; no frame may read it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what was written to scratch folders inside the block.

    Write the block's result to a path named outside it, since lazy frames made
    inside still read those folders. Blocks can be nested.
    """
    made: list[str] = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for path in made:
            discard(spark, path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows; more are joined in Spark's own way, none is dropped."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, or to ``path``, and read it back.

    This cuts the lineage: a lost executor costs at most a reread, and a frame
    used twice is computed once.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
