"""Small helpers for operators whose inner loop is Python over Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(id_column: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, as text, leaves this remainder; false for a null id."""
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def hash_share(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns' values only."""
    positive = F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 53) - 1))
    return positive.cast("double") / F.lit(float(1 << 53))


def slices_by_size(texts: list[str], budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about ``budget`` characters; a longer text is a range alone."""
    start = total = 0
    for i, text in enumerate(texts):
        if total and total + len(text) > budget:
            yield start, i
            start, total = i, 0
        total += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def bound_batches(spark: SparkSession) -> None:
    """Lets the session send tasks batches of about ``BATCH_BYTES``, not ten thousand rows at once.

    Spark holds a batch outside the heap twice, in Arrow and as the stream to Python, so
    ten thousand long texts take much of an executor's memory. A limit set before stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def small_batches(batch: pa.RecordBatch, budget: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``budget`` bytes, one row at least."""
    rows = max(1, int(batch.num_rows * budget / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def release() -> None:
    """Gives the memory of a finished task back; the Python worker lives on for others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: its free memory stays with the worker


def map_texts(
    df: DataFrame,
    text_col: str,
    keep: Iterable[str],
    make: Callable[[], Callable[[list[str]], dict[str, Any]]],
    fields: dict[str, pa.DataType],
    schema: str,
    release_after: bool = False,
) -> DataFrame:
    """Rows of ``keep`` beside what ``make()`` computes from the whole texts (null: empty).

    ``make`` runs once per task and returns a function from the texts of one Arrow batch
    (Spark bounds a batch by bytes) to columns named in ``fields``. ``schema`` is the
    schema of the new columns in Spark's words. With ``release_after`` a task gives its
    memory back when it ends, which pays where ``make`` remembers much; as it begins, it gives
    back what earlier tasks' broadcasts left.
    """
    kept = list(keep)
    plain = df.select(*[F.col(c) for c in kept], F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kept_schema = plain.select(*kept).schema
    out = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept_schema] + [schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = made = columns = None
        if release_after:
            release()
        for batch in (small for whole in batches for small in small_batches(whole)):
            work = work or make()
            made = work(batch.column(len(kept)).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [c if isinstance(c := made[f], pa.Array) else pa.array(c, kind) for f, kind in fields.items()]
            yield pa.RecordBatch.from_arrays(columns, names=kept + list(fields))
        if release_after:
            work = made = columns = None
            release()

    return plain.mapInArrow(run, out)
