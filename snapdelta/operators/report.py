"""Text reports as rows.

A report is a relation of text rows with a sort key: ``numbered_lines`` turns it
into numbered lines, ``text_sink.write_text`` into files. A row may hold several
lines (an object's heading starts with the blank line that ends the previous
one), so rows with equal keys can be printed in any order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.operators.compare import PAIR, STATUSES
from snapdelta.operators.objects import CHILD_KEY, LISTING, object_counts
from snapdelta.sources.shared_storage import discard, stored

# The wording of the reports.
SCHEMA_TITLE = "=== Database Schema ==="
SCHEMA_NAME_LABEL = "Schema: "
TOTAL_LABEL = "Total objects: "
SECTION_TITLES = {
    "added": "=== Added Objects ===",
    "removed": "=== Removed Objects ===",
    "modified": "=== Modified Objects ===",
}
NOTHING = "(none)"
OLD_VERSION = "  --- Old version ---"
NEW_VERSION = "  --- New version ---"
INDENT = "  "


@dataclass(frozen=True)
class Report:
    """Text rows, the columns that name one report and the order within it."""

    rows: DataFrame
    key: list[str]
    order: list[str]


def _lines(*lines: str | Column) -> Column:
    parts = [F.lit(x) if isinstance(x, str) else x for x in lines]
    return F.concat_ws("\n", *parts)


def _labelled(indent: int, label: str, value: Column) -> Column:
    return F.concat(F.lit(" " * indent + label), value)


def _typed_name(indent: str, kind: str, name: str) -> Column:
    return F.concat(F.lit(f"{indent}["), F.col(kind), F.lit("] "), F.col(name))


def schema_rows(objects: DataFrame, children: DataFrame, snapshots: DataFrame) -> Report:
    """The text of each snapshot in ``snapshots``, sorted by unqualified name.

    ``snapshots`` has ``snapshot_id`` and, for a heading with a schema name,
    ``schema_name``; ``objects`` and ``children`` must hold no other snapshots.
    Only indexes and constraints look up their table, for its place among tables
    of one name; columns need no join.
    """
    order = ["part", "object_name", *LISTING, "is_child", "child_name", "child_rank",
             "ordinal_position"]
    schema_line = (
        F.concat(F.lit(SCHEMA_NAME_LABEL), F.col("schema_name"))
        if "schema_name" in snapshots.columns
        else F.lit(None).cast("string")
    )
    titles = snapshots.select("snapshot_id", schema_line.alias("_schema_line"))
    total = F.concat(F.lit(TOTAL_LABEL), F.col("n_objects").cast("string"))
    heads = (
        object_counts(objects, snapshots)
        .join(titles, "snapshot_id")
        .select(
            "snapshot_id",
            F.lit(0).alias("part"),
            # concat_ws leaves out a null schema line.
            _lines(SCHEMA_TITLE, F.col("_schema_line"), total).alias("text"),
        )
    )
    ends = snapshots.select("snapshot_id", F.lit(2).alias("part"), F.lit("").alias("text"))
    object_rows = objects.select(
        "snapshot_id", "object_name", *LISTING,
        F.lit(1).alias("part"),
        F.lit(False).alias("is_child"),
        _lines("", _typed_name("", "type", "object_name")).alias("text"),
    )

    is_table = F.col("type") == "TABLE"
    is_column = F.col("child_type") == "COLUMN"
    placed_columns = children.where(is_column).withColumn("table_rank", F.lit(0))
    others = children.where(~is_column).join(
        objects.where(is_table).select(*CHILD_KEY, "table_rank"), CHILD_KEY
    )
    child_rows = placed_columns.unionByName(others).select(
        "snapshot_id", "object_name", "table_rank", "schema_name", "copy_no",
        "child_name", "child_rank", "ordinal_position",
        F.lit(1).alias("part"),
        F.when(is_table, 0).otherwise(1).alias("kind_rank"),
        F.lit(True).alias("is_child"),
        _typed_name(INDENT, "child_type", "child_name").alias("text"),
    )
    rows = (
        object_rows.unionByName(child_rows, allowMissingColumns=True)
        .unionByName(heads, allowMissingColumns=True)
        .unionByName(ends, allowMissingColumns=True)
        .select("snapshot_id", *order, "text")
    )
    return Report(rows, ["snapshot_id"], order)


def diff_rows(diff: DataFrame, children: DataFrame, pairs: DataFrame) -> Report:
    """The text of each pair's differences; children keep their stored order.

    ``diff`` is used three times: pass stored rows.
    """
    order = ["status_rank", "part", "name", *LISTING, "version", "is_child", "child_rank",
             "ordinal_position", "child_name", "constraint_type"]
    status_rank = F.array_position(
        F.array(*[F.lit(s) for s in STATUSES]), F.col("status")
    )
    is_modified = F.col("status") == "modified"

    sections = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(status).alias("status"),
                    F.lit(title if i == 0 else f"\n{title}").alias("title"),
                )
                for i, (status, title) in enumerate(SECTION_TITLES.items())
            ]
        )
    )
    # One row per pair and section, whether or not the section has entries.
    heads = (
        diff.select(*PAIR, "status", F.lit(1).alias("n"), F.lit(None).cast("string").alias("title"))
        .unionByName(
            pairs.select(*PAIR, sections.alias("section")).select(
                *PAIR, "section.status", F.lit(0).alias("n"), "section.title"
            )
        )
        .groupBy(*PAIR, "status")
        .agg(F.sum("n").alias("n"), F.max("title").alias("title"))
        .select(
            *PAIR,
            status_rank.alias("status_rank"),
            F.lit(0).alias("part"),
            _lines(F.col("title"), F.when(F.col("n") == 0, NOTHING)).alias("text"),
        )
    )

    # The old and the new object of each row, as one relation.
    entries = (
        diff.select(
            *PAIR,
            "status",
            "name",
            status_rank.alias("status_rank"),
            F.explode(
                F.array(
                    F.struct(
                        F.lit(0).alias("version"),
                        F.col("source_id").alias("snapshot_id"),
                        F.col("old").alias("object"),
                    ),
                    F.struct(
                        F.lit(1).alias("version"),
                        F.col("target_id").alias("snapshot_id"),
                        F.col("new").alias("object"),
                    ),
                )
            ).alias("entry"),
        )
        .select(*PAIR, "status", "name", "status_rank", "entry.*")
        .where(F.col("object").isNotNull())
        .select(
            *PAIR, "status", "name", "status_rank", "version", "snapshot_id", "object.*",
            F.lit(1).alias("part"),
        )
        # A modified name has one old and one new object. They share the place of
        # their name, whatever they are.
        .withColumns(
            {
                f"listed_{f}": F.when(~is_modified, F.col(f))
                for f in LISTING
            }
        )
    )
    listing = [F.col(f"listed_{f}").alias(f) for f in LISTING]
    place = [*PAIR, "status_rank", "part", "name", "version"]

    has_children = F.col("n_columns") + F.col("n_indexes") + F.col("n_constraints") > 0
    details = _lines(
        F.when(
            F.col("version") == 0,
            F.concat(F.lit("Object: "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(")")),
        ),
        F.when(F.col("version") == 0, OLD_VERSION).otherwise(NEW_VERSION),
        _labelled(2, "type: ", F.col("type")),
        _labelled(2, "name: ", F.col("object_name")),
        F.when(has_children, "  children:"),
    )
    plain = F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.col("object_name"))
    object_rows = entries.select(
        *place, *listing,
        F.lit(False).alias("is_child"),
        F.when(is_modified, details).otherwise(plain).alias("text"),
    )

    child_details = _lines(
        _labelled(4, "type: ", F.col("child_type")),
        _labelled(4, "name: ", F.col("child_name")),
    )
    child_plain = F.concat(F.lit("  - "), F.col("child_type"), F.lit(": "), F.col("child_name"))
    child_rows = (
        entries.where(has_children)
        .select(*place, "status", *CHILD_KEY, *[f"listed_{f}" for f in LISTING])
        .join(
            children.select(
                *CHILD_KEY, "child_type", "child_name", "child_rank", "ordinal_position",
                "constraint_type",
            ),
            CHILD_KEY,
        )
        .select(
            *place, *listing,
            "child_rank", "ordinal_position", "child_name", "constraint_type",
            F.lit(True).alias("is_child"),
            F.when(is_modified, child_details).otherwise(child_plain).alias("text"),
        )
    )
    # A blank line ends each modified object.
    ends = diff.where(is_modified).select(
        *PAIR,
        "name",
        status_rank.alias("status_rank"),
        F.lit(1).alias("part"),
        F.lit(2).alias("version"),
        F.lit("").alias("text"),
    )
    rows = (
        object_rows.unionByName(child_rows, allowMissingColumns=True)
        .unionByName(heads, allowMissingColumns=True)
        .unionByName(ends, allowMissingColumns=True)
        .select(*PAIR, *order, "text")
    )
    return Report(rows, PAIR, order)


def ranged(report: Report) -> DataFrame:
    """The rows in report order: sorted partitions of consecutive key ranges.

    The ranges cut through a report, so a very long one is spread over tasks. Spark reads
    the rows twice, or parts of them three times, to find even ranges, so they are stored.
    """
    keys = [*report.key, *report.order]
    return stored(report.rows).repartitionByRange(*keys).sortWithinPartitions(*keys)


def placed_lines(report: Report, carried: Sequence[str] = ()) -> DataFrame:
    """Every line of every report, stored, with ``_place``, which grows along a range of
    consecutive rows, and the number ``_range`` of that range; ranges follow each other.

    ``carried`` columns of the rows stay beside their lines. ``_at`` counts the lines of a
    row, from 0. The stored rows are deleted as soon as their lines are stored.
    """
    keys = [*report.key, *report.order]
    rows = stored(report.rows, free=True, packed=True)
    lines = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *report.key, *carried, F.posexplode(F.split("text", "\n", -1)).alias("_at", "line")
    )
    lines = stored(with_places(lines), free=True, packed=True)
    discard(rows)
    return lines


def with_places(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"_place": F.monotonically_increasing_id(), "_range": F.spark_partition_id()})


def numbered(lines: DataFrame, key: list[str], whole: DataFrame | None = None) -> DataFrame:
    """Stored lines with places, numbered from 1 within each report; ``lines`` may be some
    of the ``whole``, and are numbered like them."""
    # One row per range and report that share lines.
    counts = stored(
        (lines if whole is None else whole).groupBy("_range", *key).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")), free=True
    )
    before = F.expr(
        f"coalesce(sum(_n) over (partition by {', '.join(key)} order by _range "
        "rows between unbounded preceding and 1 preceding), 0)"
    )
    offsets = counts.select("_range", *key, (F.lit(1) - F.col("_first") + before).alias("_shift"))
    return lines.join(offsets, ["_range", *key]).withColumn("line_no", F.col("_place") + F.col("_shift"))


def numbered_lines(report: Report, carried: Sequence[str] = ()) -> DataFrame:
    """Every line of every report with its number, from 1; ``carried`` columns stay beside it.

    The lines are range-partitioned, sorted and stored once. Each line then knows
    its place in its partition, and only the number of lines per partition and
    report is needed to shift it: no report passes through a single task.
    """
    return numbered(placed_lines(report, carried), report.key).select(*report.key, "line_no", "line", *carried)
