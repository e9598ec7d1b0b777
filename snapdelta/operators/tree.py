"""Two schema texts side by side, as ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.operators.compare import PAIR
from snapdelta.operators.report import Report, numbered, placed_lines, with_places
from snapdelta.sources.shared_storage import discard, settings, stored

_OBJECT = ["object_name", "kind_rank"]
_CHILD = ["child_name", "child_rank"]
# What tells the nodes of one snapshot apart, but for equal children of one object.
_NODE = [*_OBJECT, "object_no", "is_child", *_CHILD]
# If set, Spark deals rows anew by all keys though rows of some equal keys lie together.
_ALL_KEYS = "spark.sql.requireAllClusterKeysForDistribution"


def _numbered_nodes(lines: DataFrame) -> DataFrame:
    """The nodes of every snapshot with the numbers of their lines, made once, whatever the
    number of pairs.

    ``object_no`` counts the objects of one kind and name. Their lines follow each other, so
    they are counted within a range of lines, and no window holds all bearers of a name. Only
    the name that a range ends with may go on in the next: of such names, what earlier ranges
    counted is added.
    """
    # An object's heading has a blank line before it.
    starts = F.col("is_child").isNotNull() & (F.col("_at") == F.when(F.col("is_child"), 0).otherwise(1))
    nodes = lines.where(starts).withColumn("_is_object", (~F.col("is_child")).cast("int"))
    bearer = ["snapshot_id", *_OBJECT]
    ends = (
        nodes.groupBy("_range", "snapshot_id").agg(F.max(F.struct(*_OBJECT)).alias("_last"))
        .select("snapshot_id", "_last.*").distinct()
    )
    counts = stored(
        nodes.join(ends, bearer, "left_semi").groupBy("_range", *bearer).agg(F.sum("_is_object").alias("_n")), free=True
    )
    earlier = F.expr(
        f"sum(_n) over (partition by {', '.join(bearer)} order by _range rows between unbounded preceding and 1 preceding)"
    )
    inside = F.expr(f"sum(_is_object) over (partition by _range, {', '.join(bearer)} order by _place)")
    counted = (
        nodes.withColumn("_inside", inside)
        .join(counts.withColumn("_earlier", earlier).drop("_n"), ["_range", *bearer], "left")
        .withColumn("object_no", F.col("_inside") + F.coalesce("_earlier", F.lit(0)))
    )
    return numbered(counted, ["snapshot_id"], lines).select("snapshot_id", *_NODE, "line_no", "line")


def side_by_side(report: Report, sides: DataFrame) -> DataFrame:
    """``source_id, target_id, line_no, side, left_line, right_line, line``.

    ``report`` is that of the schema texts. Both sides of a pair list their nodes in one
    order, so a node's rank is its key. All snapshots' nodes are dealt once, to ranges of
    that key: there the equal ones of an object are numbered, the sides of a pair meet, and
    the lines of every pair are sorted. ``left_line`` and ``right_line`` are the numbers of
    the node's line in the texts of the source and the target, null where the node is missing.

    What is stored on the way is deleted as soon as the next step is stored.
    """
    lines = placed_lines(report, [*_OBJECT, "is_child", *_CHILD])
    nodes = stored(_numbered_nodes(lines), free=True, packed=True)
    discard(lines)
    child_no = F.expr(f"row_number() over (partition by snapshot_id, {', '.join(_NODE)} order by line_no)")
    is_old = F.col("is_old")
    # Nothing may deal the rows anew behind the ranges, so the pairs' few rows are broadcast.
    merged = (
        nodes.repartitionByRange(*_NODE)
        .withColumn("child_no", child_no)
        .join(F.broadcast(sides), "snapshot_id")
        .groupBy(*PAIR, *_NODE, "child_no", "line")
        .agg(
            F.max(F.when(is_old, F.col("line_no"))).alias("left_line"),
            F.max(F.when(~is_old, F.col("line_no"))).alias("right_line"),
        )
        .sortWithinPartitions(*PAIR, *_NODE, "child_no")
        .select(*PAIR, "left_line", "right_line", "line")
    )
    with settings(nodes.sparkSession, {_ALL_KEYS: "false"}):
        merged = stored(with_places(merged), free=True, packed=True)
    discard(nodes)
    side = (
        F.when(F.col("right_line").isNull(), "left_only")
        .when(F.col("left_line").isNull(), "right_only")
        .otherwise("both")
    )
    return numbered(merged, PAIR).select(*PAIR, "line_no", side.alias("side"), "left_line", "right_line", "line")
