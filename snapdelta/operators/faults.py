"""Required fields without a value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.expressions import FUNCTION_KIND, PROCEDURE_KIND, Scope, in_scope, taking_part
from snapdelta.sources.catalog import Catalog

# The fields that every entry must have, and the column that names its schema.
REQUIRED = {
    "columns": ("table_schema", ["table_name", "column_name", "data_type", "is_nullable", "ordinal_position"]),
    "indexes": ("schemaname", ["tablename", "indexname", "indexdef"]),
    "table_constraints": ("table_schema", ["table_name", "constraint_name", "constraint_type"]),
    "views": ("table_schema", ["table_name"]),
    "sequences": ("sequence_schema", ["sequence_name", "data_type", "start_value", "increment"]),
}
REQUIRED_OF_ROUTINES = ["proname", "arguments", "lanname"]
REQUIRED_OF_FUNCTIONS = ["return_type"]


def catalog_faults(catalog: Catalog, scope: Scope = None) -> DataFrame:
    """``snapshot_id, relation, field, n_rows, n_missing`` for every required field.

    A result fails on a missing field only if it reads the field: a count of objects does
    not read types. This counts them all, in scope, in one pass per relation with partial
    sums; a relation without rows in a snapshot has no rows here.
    """

    def counted(df: DataFrame, relation: str, fields: list[str]) -> DataFrame:
        per_field = F.explode(
            F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("n_missing")) for f in fields])
        )
        return (
            df.groupBy("snapshot_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.isnull(f)).alias(f"_{f}") for f in fields])
            .select("snapshot_id", F.lit(relation).alias("relation"), "n_rows", per_field.alias("_fault"))
            .select("snapshot_id", "relation", "_fault.field", "n_rows", "_fault.n_missing")
        )

    namespaces = in_scope(catalog.namespace, "nspname", scope).select(
        "snapshot_id", F.col("oid").alias("pronamespace")
    )
    languages = taking_part(catalog.language, scope).select(
        "snapshot_id", F.col("oid").alias("prolang"), "lanname"
    )
    routines = (
        taking_part(catalog.proc, scope)
        .where(F.col("prokind").isin(FUNCTION_KIND, PROCEDURE_KIND))
        .join(namespaces, ["snapshot_id", "pronamespace"])
        .join(languages, ["snapshot_id", "prolang"])
    )
    functions = routines.where(F.col("prokind") == FUNCTION_KIND)
    found = [
        counted(in_scope(getattr(catalog, relation), schema, scope), relation, fields)
        for relation, (schema, fields) in REQUIRED.items()
    ]
    found += [
        counted(routines, "proc", REQUIRED_OF_ROUTINES),
        counted(functions, "proc", REQUIRED_OF_FUNCTIONS),
    ]
    return reduce(DataFrame.unionByName, found)
