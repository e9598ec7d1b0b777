"""Differences between the snapshots of a pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapdelta.operators.objects import CONTENT_FIELDS, LAST_WINS

PAIR = ["source_id", "target_id"]
# The three kinds of difference, in report order.
STATUSES = ("added", "removed", "modified")

_CONTENT_SEEDS = (11, 12)
_ENTRY = LAST_WINS + ["type", "n_columns", "n_indexes", "n_constraints", "fingerprint"]


def pair_sides(pairs: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Two rows per distinct pair: the snapshots on its old and on its new side.

    With ``snapshots``, the job fails on a pair that names an unknown one.
    """
    sides = (
        pairs.select(*PAIR)
        .distinct()
        .select(
            *PAIR,
            F.explode(
                F.array(
                    F.struct(
                        F.col("source_id").alias("snapshot_id"), F.lit(True).alias("is_old")
                    ),
                    F.struct(
                        F.col("target_id").alias("snapshot_id"), F.lit(False).alias("is_old")
                    ),
                )
            ).alias("side"),
        )
        .select(*PAIR, "side.*")
    )
    if snapshots is None:
        return sides
    known = snapshots.select(F.col("snapshot_id").alias("_known")).distinct()
    return sides.join(known, F.col("snapshot_id") == F.col("_known"), "left").select(
        *PAIR,
        F.coalesce("_known", F.raise_error(unknown_snapshot())).alias("snapshot_id"),
        "is_old",
    )


def unknown_snapshot(snapshot_id: str = "snapshot_id") -> Column:
    return F.concat(
        F.lit("pair names an unknown snapshot: "),
        F.coalesce(F.col(snapshot_id).cast("string"), F.lit("null")),
    )


def name_heads(objects: DataFrame) -> DataFrame:
    """One row per snapshot and name: how many objects bear it, and the one that holds it.

    ``content`` are two hashes of all that equality looks at. Several objects of one name
    are reduced before the shuffle.
    """
    fields = [F.col(f"entry.{f}") for f in CONTENT_FIELDS]
    # A hash passes over nulls, so where they stand is hashed as well.
    held = [*fields, *[F.isnull(f) for f in fields], F.col("entry.fingerprint")]
    return (
        objects.groupBy("snapshot_id", "name")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*_ENTRY)).alias("entry"))
        .select(
            "snapshot_id", "name", "n", "entry",
            *[
                F.xxhash64(F.lit(seed), *held).alias(f"content{i}")
                for i, seed in enumerate(_CONTENT_SEEDS)
            ],
        )
    )


def name_changes(heads: DataFrame, sides: DataFrame) -> DataFrame:
    """One row per pair and name that differs, with its ``status``, ``n_old`` and ``n_new``.

    ``heads`` are the rows of :func:`name_heads`, ``sides`` those of :func:`pair_sides`. A
    snapshot is reduced to its heads once, however many pairs name it; only a name, a
    count and two hashes are repeated per pair, and added up by hashing.
    """
    is_old = F.col("is_old")
    contents = ("content0", "content1")
    # A side has one row per name, so a sum stands for its value.
    differ = F.lit(False)
    for c in contents:
        differ = differ | (F.col(f"old_{c}") != F.col(f"new_{c}"))
    status = (
        F.when(F.col("n_old") == 0, "added")
        .when(F.col("n_new") == 0, "removed")
        .when(differ, "modified")
    )
    return (
        heads.select("snapshot_id", "name", "n", *contents)
        .join(sides, "snapshot_id")
        .groupBy(*PAIR, "name")
        .agg(
            F.sum(F.when(is_old, F.col("n")).otherwise(0)).alias("n_old"),
            F.sum(F.when(~is_old, F.col("n")).otherwise(0)).alias("n_new"),
            *[F.bit_xor(F.when(is_old, F.col(c))).alias(f"old_{c}") for c in contents],
            *[F.bit_xor(F.when(~is_old, F.col(c))).alias(f"new_{c}") for c in contents],
        )
        .withColumn("status", status)
        .where(F.col("status").isNotNull())
        .select(*PAIR, "name", "status", "n_old", "n_new")
    )


def summary(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of added, removed and modified objects per pair, zeros included."""
    n = (
        F.when(F.col("status") == "added", F.col("n_new"))
        .when(F.col("status") == "removed", F.col("n_old"))
        .otherwise(1)
    )
    zeros = pairs.select(
        *PAIR,
        F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias("status"),
        F.lit(0).cast("bigint").alias("n"),
    )
    return (
        changes.select(*PAIR, "status", n.alias("n"))
        .unionByName(zeros)
        .groupBy(*PAIR, "status")
        .agg(F.sum("n").alias("n"))
    )


def compare(objects: DataFrame, sides: DataFrame) -> DataFrame:
    """All differing objects: ``source_id, target_id, status, name, old, new``.

    Every object of an added or removed name is listed; of a modified name, the
    one that holds it on each side. ``objects`` is read several times: pass stored
    rows (see :mod:`snapdelta.plans.comparison`).
    """
    heads = name_heads(objects)
    changes = name_changes(heads, sides)

    def held(side: str, key: str) -> DataFrame:
        return heads.select(F.col("snapshot_id").alias(key), "name", F.col("entry").alias(side))

    modified = (
        changes.where(F.col("status") == "modified")
        .join(held("old", "source_id"), ["source_id", "name"])
        .join(held("new", "target_id"), ["target_id", "name"])
        .select(*PAIR, "status", "name", "old", "new")
    )
    is_added = F.col("status") == "added"
    one_sided = changes.where(F.col("status") != "modified").select(
        *PAIR,
        "status",
        "name",
        F.when(is_added, F.col("target_id")).otherwise(F.col("source_id")).alias("snapshot_id"),
    )
    entry = F.struct(*_ENTRY)
    listed = one_sided.join(objects, ["snapshot_id", "name"]).select(
        *PAIR,
        "status",
        "name",
        F.when(~is_added, entry).alias("old"),
        F.when(is_added, entry).alias("new"),
    )
    return listed.unionByName(modified)


def tree_diff(objects: DataFrame, children: DataFrame, sides: DataFrame) -> DataFrame:
    """Which ``[TYPE] name`` nodes stand on the left, on the right or on both sides.

    Nodes are told apart by kind and unqualified name alone. Equal nodes are
    counted: ``n`` of them have that ``side``. Null child fields (the object's own
    node) group as equal. Nodes are dealt once, by their names alone: so they are counted
    once per snapshot, and the counts repeated per pair and set side by side, where they lie.
    Most names are unique, so counts before the shuffle would fill memory and save nothing.
    The number of partitions is the session's, as merged ones would hold too many nodes.
    """
    node = ["object_name", "object_type", "child_type", "child_name"]
    no_text = F.lit(None).cast("string")
    nodes = objects.select(
        "snapshot_id", "object_name", F.col("type").alias("object_type"),
        no_text.alias("child_type"), no_text.alias("child_name"),
    ).unionByName(
        children.select(
            "snapshot_id", "object_name", F.col("type").alias("object_type"),
            "child_type", "child_name",
        )
    )
    left, right = F.col("n_left"), F.col("n_right")
    both = F.least(left, right)

    def counted(side: str, n: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), n.alias("n"))

    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        nodes.repartition(partitions, *node)
        .groupBy("snapshot_id", *node)
        .agg(F.count(F.lit(1)).alias("n"))
        .join(sides, "snapshot_id")
        .groupBy(*PAIR, *node)
        .agg(
            F.sum(F.when(F.col("is_old"), F.col("n")).otherwise(0)).alias("n_left"),
            F.sum(F.when(~F.col("is_old"), F.col("n")).otherwise(0)).alias("n_right"),
        )
        .select(
            *PAIR,
            *node,
            F.explode(
                F.array(
                    counted("both", both),
                    counted("left_only", left - both),
                    counted("right_only", right - both),
                )
            ).alias("counted"),
        )
        .select(*PAIR, *node, "counted.*")
        .where(F.col("n") > 0)
    )
