"""Reading the catalog relations of one live PostgreSQL database through JDBC.

Each relation is one Spark JDBC read of a public catalog view; joins, filters and
grouping happen later, in Spark, for all databases at once. Land each database with
its own snapshot id and work on the landed files::

    land(read_database(spark, options, 7, "billing"), landing)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.sources.catalog import RELATIONS

# Where PostgreSQL keeps each relation.
CATALOG_VIEWS = {
    "columns": "information_schema.columns",
    "indexes": "pg_catalog.pg_indexes",
    "table_constraints": "information_schema.table_constraints",
    "key_column_usage": "information_schema.key_column_usage",
    "views": "information_schema.views",
    "namespace": "pg_catalog.pg_namespace",
    "language": "pg_catalog.pg_language",
    "sequences": "information_schema.sequences",
}
# The two texts of a routine exist only as results of server functions.
ROUTINES = (
    "select oid, proname, pronamespace, prolang, prokind, "
    "pg_get_function_result(oid) as return_type, "
    "pg_get_function_arguments(oid) as arguments from pg_catalog.pg_proc "
    "where prokind in ('f', 'p')"
)


def _fields(relation: str) -> list[tuple[str, str]]:
    """Names and types of a relation's columns after the snapshot id."""
    return [tuple(field.split()) for field in RELATIONS[relation].split(", ")][1:]


def database_reads() -> dict[str, dict[str, str]]:
    """The JDBC reader options of each relation. Columns that the relation does not
    have are not fetched."""
    reads = {
        relation: {
            "query": f"select {', '.join(name for name, _ in _fields(relation))} from {view}"
        }
        for relation, view in CATALOG_VIEWS.items()
    }
    reads["proc"] = {"query": ROUTINES}
    return reads


def read_database(
    spark: SparkSession,
    options: dict[str, str],
    snapshot_id: int,
    name: str,
    schema_name: str | None = None,
) -> dict[str, DataFrame]:
    """The relations of one database, with the fixed schemas.

    ``options`` are those of Spark's JDBC source: ``url``, ``user``, ``password``,
    ``driver``.
    """

    def relation(which: str, read: dict[str, str]) -> DataFrame:
        source = spark.read.format("jdbc").options(**options, **read).load()
        return source.select(
            F.lit(snapshot_id).alias("snapshot_id"),
            *[F.col(column).cast(kind).alias(column) for column, kind in _fields(which)],
        )

    known = spark.createDataFrame([(snapshot_id, name, schema_name)], RELATIONS["snapshots"])
    return {
        "snapshots": known,
        **{which: relation(which, read) for which, read in database_reads().items()},
    }
