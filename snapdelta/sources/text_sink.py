"""Reports as text files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.operators.report import Report, ranged
from snapdelta.sources.shared_storage import stored

# Fixed value: the form of the run stamp, year_month_day_hour_minute.
RUN_STAMP = "%Y_%m_%d_%H_%M"


def write_text(report: Report, path: str) -> None:
    """Write each report to its own folder below ``path``, replacing what is there.

    The files of a folder, read in name order, are the text of the report. A report
    that fits one range of keys is one file; a very long one is split.
    """
    ranged(report).select(*report.key, "text").write.mode("overwrite").partitionBy(
        *report.key
    ).option("lineSep", "\n").text(path)


def report_dir(base: str, run_at: datetime) -> str:
    """The folder of one run below ``base``."""
    return f"{base.rstrip('/')}/{run_at.strftime(RUN_STAMP)}"


def read_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The lines of written reports with their numbers: ``key, line_no, line``.

    ``key`` names the folders' columns and types, ``"snapshot_id INT"``. The order is that
    of the files' names, of the blocks of a file and of the lines of a block. Spark may
    read a long file as several blocks, so blocks are numbered apart and shifted by the
    lines before them; no report passes through a single task.
    """
    columns = [field.split()[0] for field in key.split(", ")]
    lines = stored(
        spark.read.schema(f"value STRING, {key}").option("lineSep", "\n").text(path).select(
            *columns, F.col("value").alias("line"),
            F.col("_metadata.file_name").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_place"),
        )
    )
    block = ["_file", "_block"]
    by = ", ".join(columns)
    offsets = (
        lines.groupBy(*columns, *block)
        .agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .selectExpr(
            *columns, *block, "_first",
            f"coalesce(sum(_n) over (partition by {by} order by _file, _block "
            "rows between unbounded preceding and 1 preceding), 0) as _before",
        )
    )
    return lines.join(offsets, [*columns, *block]).select(
        *columns, (F.col("_place") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line"
    )
