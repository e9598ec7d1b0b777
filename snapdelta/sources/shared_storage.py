"""Where results that must outlive an executor are kept."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
# Has Spark delete the shuffle files of a query when it ends.
FREE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_opened: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints; an error if it names none."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if not named:
        raise ValueError(
            f"{CHECKPOINT_SETTING} is not set: name a folder that the driver and all executors share"
        )
    return named


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder in the shared folder that nobody has used yet."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for paths in _opened:
        paths.append(path)
    return path


def stored(df: DataFrame, free: bool = False, packed: bool = False) -> DataFrame:
    """The rows of ``df``, computed now and read back from the shared folder.

    A table rather than a checkpoint of rows, so that readers still prune columns. With
    ``free`` the shuffle files of the job that writes them are deleted when it ends, not
    when the driver next collects its garbage. With ``packed`` the table is smaller and takes
    more time to write.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stored")
    with settings(spark, {FREE_SETTING: "true"} if free else {}):
        df.write.parquet(path, compression="zstd" if packed else None)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more."""
    _delete(table.sparkSession, table.inputFiles()[0].rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings, changed until the block ends."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Deletes what was stored inside the block when it ends.

    Results that are to outlive the block must have been written elsewhere by then.
    """
    paths: list[str] = []
    _opened.append(paths)
    try:
        yield
    finally:
        _opened.remove(paths)
        for path in paths:
            _delete(spark, path)
