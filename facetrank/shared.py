"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dirs: dict[str, str] = {}
_block: ContextVar[str] = ContextVar("scratch block", default="")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode without the setting."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="facetrank-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/facetrank/{_block.get()}{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    place, files = _file_system(spark, path)
    return files.exists(place)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables written inside the block are removed at its end, after errors too.

    DataFrames made inside read them: store or collect what is wanted before the block ends. Blocks may be nested.
    """
    token = _block.set(f"{_block.get()}block-{uuid.uuid4().hex}/")
    folder = f"{shared_dir(spark).rstrip('/')}/facetrank/{_block.get()}"
    try:
        yield folder
    finally:
        _block.reset(token)
        place, files = _file_system(spark, folder)
        files.delete(place, True)


def by_shuffle(df: DataFrame) -> DataFrame:
    """`df` for a join in which both sides grow with the input: neither is sent whole through the driver.

    Spark estimates a stored table by its compressed files and an array as one element. Repeated values can make that a hundredth of what
    the rows take in memory, so a table far too large for it would be broadcast.
    """
    return df.hint("merge")


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs planned inside the block remove their shuffle files as they end.

    Spark keeps them until the driver happens to collect its garbage, so the steps of a long query add up on disk.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def write_once(df: DataFrame, label: str) -> DataFrame:
    """Store a result that several later steps read.

    It is computed once, its shuffle files go when it is stored, it survives the loss of executors, and gives the optimizer the
    size of its files, which are compressed: see `by_shuffle` for joins on it.
    """
    path = scratch_path(df.sparkSession, label)
    with released_shuffles(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
