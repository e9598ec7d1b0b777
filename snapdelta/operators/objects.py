"""Schema objects and their children, as two flat relations.

``objects`` has one row per top-level object and ``children`` one row per
column, index or constraint. A table is never held as one nested value: one
table may own any share of the rows, and every step below works on single rows
or on partial aggregates of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.functions.expressions import (
    content_parts,
    expand_copies,
    qualified_name,
)
from snapdelta.operators import members
from snapdelta.operators.members import Scope
from snapdelta.sources.catalog import Catalog

# The order in which the kinds of objects are listed.
OBJECT_TYPES = ("TABLE", "VIEW", "FUNCTION", "PROCEDURE", "SEQUENCE")
# The order of the children of a table.
CHILD_TYPES = ("COLUMN", "INDEX", "CONSTRAINT")

OWNER = ["snapshot_id", "schema_name", "object_name"]
CHILD_KEY = ["snapshot_id", "type", "schema_name", "object_name", "copy_no"]

# What equality of two objects looks at, besides the fingerprint of the children.
CONTENT_FIELDS = [
    "type", "schema_name", "object_name", "return_type", "arguments", "language",
    "data_type", "start_value", "increment",
]
# Among objects of one name the one that is greatest by these fields wins.
LAST_WINS = [
    "kind_rank", "table_rank", "arguments", "language", "return_type", "schema_name",
    "object_name", "data_type", "start_value", "increment", "oid", "copy_no",
]
# Order of the objects of one name within a report.
LISTING = [
    "kind_rank", "table_rank", "schema_name", "arguments", "language", "return_type",
    "oid", "copy_no",
]
OBJECT_COLUMNS = [
    "snapshot_id", "kind_rank", "type", "schema_name", "object_name", "name",
    "table_rank", "copy_no", "oid", "return_type", "arguments", "language", "data_type",
    "start_value", "increment", "n_columns", "n_indexes", "n_constraints", "fingerprint",
]


def _table_children(catalog: Catalog, schema: Scope) -> DataFrame:
    """Children of tables. The columns of a view are in here too: the catalog
    lists them like those of a table, so a view with columns is also a table."""

    def child(df: DataFrame, kind: str, name: str, *rest: str) -> DataFrame:
        return df.select(
            "snapshot_id",
            "schema_name",
            F.col("table_name").alias("object_name"),
            F.lit(CHILD_TYPES.index(kind)).alias("child_rank"),
            F.lit(kind).alias("child_type"),
            F.col(name).alias("child_name"),
            *rest,
        )

    return (
        child(
            members.columns(catalog.columns, schema), "COLUMN", "column_name",
            "data_type", "is_nullable", "default_value", "ordinal_position",
        )
        .unionByName(
            child(
                members.indexes(catalog.indexes, schema), "INDEX", "index_name",
                "definition", "is_unique",
            ),
            allowMissingColumns=True,
        )
        .unionByName(
            child(
                members.constraints(
                    catalog.table_constraints, catalog.key_column_usage, schema
                ),
                "CONSTRAINT", "constraint_name", "constraint_type", "definition",
            ),
            allowMissingColumns=True,
        )
    )


def children(catalog: Catalog, schema: Scope = None) -> DataFrame:
    """One row per child of a table or a view.

    The stored order within an object is ``child_rank, ordinal_position,
    child_name, constraint_type``.
    """
    of_tables = _table_children(catalog, schema)
    view_copies = expand_copies(
        members.views(catalog.views, schema)
        .groupBy("snapshot_id", "schema_name", F.col("view_name").alias("object_name"))
        .agg(F.count(F.lit(1)).alias("_copies")),
        "_copies",
        "copy_no",
    )
    of_views = of_tables.where(F.col("child_type") == "COLUMN").join(view_copies, OWNER)
    return of_tables.withColumns(
        {"type": F.lit("TABLE"), "copy_no": F.lit(1).cast("bigint")}
    ).unionByName(of_views.withColumn("type", F.lit("VIEW")))


def _tables_and_views(catalog: Catalog, schema: Scope) -> DataFrame:
    """Tables and views from a single aggregation over their members.

    Children and views are stacked and grouped once, so nothing is joined. All
    aggregates are counts and sums: they shrink a large table before the shuffle.
    """
    content = content_parts(
        F.col("child_type"), F.col("child_name"), F.col("data_type"),
        F.col("is_nullable"), F.col("default_value"), F.col("default_value").isNull(),
        F.col("ordinal_position"), F.col("is_unique"), F.col("constraint_type"),
        F.col("definition"),
    )
    parts = [f"_part{i}" for i in range(len(content))]
    view_mark = -1
    table_kind, view_kind = OBJECT_TYPES.index("TABLE"), OBJECT_TYPES.index("VIEW")
    stacked = _table_children(catalog, schema).select(
        *OWNER, "child_rank", *[c.alias(p) for c, p in zip(content, parts)]
    ).unionByName(
        members.views(catalog.views, schema).select(
            "snapshot_id", "schema_name", F.col("view_name").alias("object_name"),
            F.lit(view_mark).alias("child_rank"),
            *[F.lit(0).cast("bigint").alias(p) for p in parts],
        )
    )

    def counted(rank: int) -> Column:
        return F.count_if(F.col("child_rank") == rank)

    is_column = F.col("child_rank") == CHILD_TYPES.index("COLUMN")
    grouped = stacked.groupBy(*OWNER).agg(
        counted(view_mark).alias("n_views"),
        *[
            counted(CHILD_TYPES.index(kind)).alias(count)
            for kind, count in zip(CHILD_TYPES, ("n_columns", "n_indexes", "n_constraints"))
        ],
        *[F.sum(p).alias(p) for p in parts],
        *[F.sum(F.when(is_column, F.col(p)).otherwise(0)).alias(f"{p}_columns") for p in parts],
    )

    # Each group may be a table, a view or both. The kind is a plain column, so an
    # aggregate that a plan does not use is left out together with what it reads.
    both = grouped.withColumn(
        "kind_rank", F.explode(F.array(F.lit(table_kind), F.lit(view_kind)))
    )
    is_table = F.col("kind_rank") == table_kind
    n_columns, n_indexes, n_constraints = (
        F.col("n_columns"), F.col("n_indexes"), F.col("n_constraints")
    )
    has_children = n_columns + n_indexes + n_constraints > 0
    # Tables are listed in the order they turn up: first those with columns, then
    # those known from their indexes only, then those known from constraints only.
    table_rank = (
        F.when(~is_table | (n_columns > 0), 0).when(n_indexes > 0, 1).otherwise(2)
    )
    listed = both.select(
        *OWNER,
        "kind_rank",
        F.when(is_table, "TABLE").otherwise("VIEW").alias("type"),
        table_rank.alias("table_rank"),
        F.when(is_table, F.when(has_children, 1).otherwise(0))
        .otherwise(F.col("n_views"))
        .cast("bigint")
        .alias("copies"),
        "n_columns",
        F.when(is_table, n_indexes).otherwise(0).alias("n_indexes"),
        F.when(is_table, n_constraints).otherwise(0).alias("n_constraints"),
        F.when(is_table, F.array(*parts))
        .otherwise(F.array(*[f"{p}_columns" for p in parts]))
        .alias("fingerprint"),
    ).where(F.col("copies") > 0)
    return expand_copies(listed, "copies", "copy_no")


def _routine_objects(catalog: Catalog, schema: Scope) -> DataFrame:
    return members.routines(
        catalog.proc, catalog.namespace, catalog.language, schema
    ).select(
        "snapshot_id", "oid", "type", "schema_name",
        F.col("routine_name").alias("object_name"),
        "return_type", "arguments", "language",
        F.when(F.col("type") == "FUNCTION", OBJECT_TYPES.index("FUNCTION"))
        .otherwise(OBJECT_TYPES.index("PROCEDURE"))
        .alias("kind_rank"),
    )


def _sequence_objects(catalog: Catalog, schema: Scope) -> DataFrame:
    return members.sequences(catalog.sequences, schema).select(
        "snapshot_id", "schema_name", F.col("sequence_name").alias("object_name"),
        "data_type", "start_value", "increment",
        F.lit("SEQUENCE").alias("type"),
        F.lit(OBJECT_TYPES.index("SEQUENCE")).alias("kind_rank"),
    )


def objects(catalog: Catalog, schema: Scope = None) -> DataFrame:
    """All top-level objects of all snapshots; repeats of a name are kept."""
    no_children = {
        "table_rank": F.lit(0), "copy_no": F.lit(1).cast("bigint"),
        **{n: F.lit(0).cast("bigint") for n in ("n_columns", "n_indexes", "n_constraints")},
    }
    leaves = _routine_objects(catalog, schema).unionByName(
        _sequence_objects(catalog, schema), allowMissingColumns=True
    )
    return (
        _tables_and_views(catalog, schema)
        .unionByName(leaves.withColumns(no_children), allowMissingColumns=True)
        .withColumn("name", qualified_name("schema_name", "object_name"))
        .select(*OBJECT_COLUMNS)
    )


def latest(objects: DataFrame) -> DataFrame:
    """One object per snapshot and name: of several, the last listed.

    Spark limits each group before the shuffle, so a name with very many
    overloads does not travel as a whole.
    """
    order = Window.partitionBy("snapshot_id", "name").orderBy(
        *[F.col(field).desc() for field in LAST_WINS]
    )
    return (
        objects.withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") == 1)
        .drop("_place")
    )


def object_counts(objects: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Objects per snapshot, zero for a snapshot without any."""
    zeros = snapshots.select("snapshot_id", F.lit(0).alias("n"))
    return (
        objects.select("snapshot_id", F.lit(1).alias("n"))
        .unionByName(zeros)
        .groupBy("snapshot_id")
        .agg(F.sum("n").alias("n_objects"))
    )
