"""The landed catalog relations and how to read them.

Every relation has one row per catalog entry and a ``snapshot_id`` that names
the database snapshot the entry belongs to.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and types of the relations' columns.
RELATIONS: dict[str, str] = {
    "snapshots": "snapshot_id INT, name STRING, schema_name STRING",
    "columns": (
        "snapshot_id INT, table_schema STRING, table_name STRING, column_name STRING, "
        "data_type STRING, is_nullable STRING, column_default STRING, ordinal_position INT"
    ),
    "indexes": (
        "snapshot_id INT, schemaname STRING, tablename STRING, indexname STRING, "
        "indexdef STRING"
    ),
    "table_constraints": (
        "snapshot_id INT, table_schema STRING, table_name STRING, constraint_name STRING, "
        "constraint_type STRING"
    ),
    "key_column_usage": (
        "snapshot_id INT, table_schema STRING, table_name STRING, constraint_name STRING, "
        "column_name STRING, ordinal_position INT"
    ),
    "views": "snapshot_id INT, table_schema STRING, table_name STRING",
    "proc": (
        "snapshot_id INT, oid BIGINT, proname STRING, pronamespace BIGINT, prolang BIGINT, "
        "prokind STRING, return_type STRING, arguments STRING"
    ),
    "namespace": "snapshot_id INT, oid BIGINT, nspname STRING",
    "language": "snapshot_id INT, oid BIGINT, lanname STRING",
    "sequences": (
        "snapshot_id INT, sequence_schema STRING, sequence_name STRING, data_type STRING, "
        "start_value STRING, increment STRING"
    ),
}


@dataclass(frozen=True)
class Catalog:
    """The relations of all snapshots; ``snapshots`` lists the known ones."""

    snapshots: DataFrame
    columns: DataFrame
    indexes: DataFrame
    table_constraints: DataFrame
    key_column_usage: DataFrame
    views: DataFrame
    proc: DataFrame
    namespace: DataFrame
    language: DataFrame
    sequences: DataFrame


def read_catalog(spark: SparkSession, path: str) -> Catalog:
    """Read ``<path>/<relation>`` as Parquet, with the fixed schemas."""
    return Catalog(
        **{
            name: spark.read.schema(schema).parquet(f"{path}/{name}")
            for name, schema in RELATIONS.items()
        }
    )


# What the entries of a landed relation are sorted by within a snapshot, so that the
# statistics of files and row groups tell which of them hold a schema or a table.
_LANDING_ORDER = {
    "columns": ["table_schema", "table_name", "ordinal_position"],
    "indexes": ["schemaname", "tablename", "indexname"],
    "table_constraints": ["table_schema", "table_name", "constraint_name"],
    "key_column_usage": ["table_schema", "table_name", "constraint_name"],
    "views": ["table_schema", "table_name"],
    "proc": ["pronamespace", "proname", "oid"],
    "namespace": ["oid"],
    "language": ["oid"],
    "sequences": ["sequence_schema", "sequence_name"],
}


def land(relations: Mapping[str, DataFrame], path: str) -> None:
    """Write relations of one or more snapshots below ``path``, for :func:`read_catalog`.

    Each relation is partitioned by snapshot and sorted within. A snapshot that is landed
    again replaces its entries and leaves those of other snapshots alone; one that has lost
    all entries of a relation loses its partition. The ranges of the sort cut through a
    large snapshot, so no task writes it alone. Columns beyond the fixed ones are left out.
    """
    snapshots = relations["snapshots"]
    for name, schema in RELATIONS.items():
        if name not in relations:
            continue
        df = relations[name].select(*[
            F.col(column).cast(kind).alias(column)
            for column, kind in (field.split() for field in schema.split(", "))
        ])
        order = ["snapshot_id", *_LANDING_ORDER.get(name, [])]
        writer = (
            df.repartitionByRange(*order).sortWithinPartitions(*order).write
            .partitionBy("snapshot_id").mode("overwrite").option("partitionOverwriteMode", "dynamic")
        )
        writer.parquet(f"{path}/{name}")
        emptied = snapshots.select("snapshot_id").join(df.select("snapshot_id"), "snapshot_id", "left_anti")
        _drop_partitions(emptied, f"{path}/{name}")


def _drop_partitions(snapshots: DataFrame, path: str) -> None:
    spark = snapshots.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in snapshots.distinct().toLocalIterator():
        files.delete(hadoop.Path(f"{path}/snapshot_id={row['snapshot_id']}"), True)


def catalog_of(spark: SparkSession, relations: dict[str, list[tuple]]) -> Catalog:
    """A catalog of literal rows; relations left out are empty."""
    return Catalog(
        **{
            name: spark.createDataFrame(relations.get(name, []), schema)
            for name, schema in RELATIONS.items()
        }
    )
