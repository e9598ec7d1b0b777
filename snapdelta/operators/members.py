"""One mapped relation per kind of catalog entry.

``schema`` is everywhere the optional restriction described at
:func:`snapdelta.functions.expressions.in_scope`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.functions.expressions import (
    FUNCTION_KIND,
    KEYED_CONSTRAINTS,
    PROCEDURE_KIND,
    YES,
    Scope,
    constraint_definition,
    in_scope,
    mentions_unique,
    ordered_key_columns,
    required,
    taking_part,
)


def columns(cat_columns: DataFrame, schema: Scope = None) -> DataFrame:
    """Columns of tables and of views."""
    return in_scope(cat_columns, "table_schema", schema).select(
        "snapshot_id",
        F.col("table_schema").alias("schema_name"),
        required("table_name", "table_name").alias("table_name"),
        required("column_name", "column_name").alias("column_name"),
        required("data_type", "data_type").alias("data_type"),
        (required("is_nullable", "is_nullable") == YES).alias("is_nullable"),
        F.col("column_default").alias("default_value"),
        required("ordinal_position", "ordinal_position").alias("ordinal_position"),
    )


def indexes(cat_indexes: DataFrame, schema: Scope = None) -> DataFrame:
    definition = required("indexdef", "indexdef")
    return in_scope(cat_indexes, "schemaname", schema).select(
        "snapshot_id",
        F.col("schemaname").alias("schema_name"),
        required("tablename", "tablename").alias("table_name"),
        required("indexname", "indexname").alias("index_name"),
        definition.alias("definition"),
        mentions_unique(definition).alias("is_unique"),
    )


def constraints(
    table_constraints: DataFrame, key_column_usage: DataFrame, schema: Scope = None
) -> DataFrame:
    """Constraints with a definition that lists their key columns.

    Only constraints whose definition shows key columns are joined with them; the
    others, in most databases the many NOT NULL checks, are just made distinct.
    The join and the grouping share one shuffle: the grouping keys contain the
    join keys.
    """
    keys = ["snapshot_id", "table_schema", "table_name", "constraint_name"]
    listed = in_scope(table_constraints, "table_schema", schema).select(
        "snapshot_id",
        "table_schema",
        required("table_name", "table_name").alias("table_name"),
        required("constraint_name", "constraint_name").alias("constraint_name"),
        required("constraint_type", "constraint_type").alias("constraint_type"),
    )
    shows_keys = F.col("constraint_type").isin(*KEYED_CONSTRAINTS)
    key_columns = taking_part(key_column_usage, schema).select(
        *keys, "column_name", "ordinal_position"
    )
    keyed = (
        listed.where(shows_keys)
        .join(key_columns, keys, "left")
        .groupBy(*keys, "constraint_type")
        .agg(ordered_key_columns().alias("key_columns"))
    )
    others = (
        listed.where(~shows_keys)
        .distinct()
        .withColumn("key_columns", F.lit(None).cast("string"))
    )
    return keyed.unionByName(others).select(
        "snapshot_id",
        F.col("table_schema").alias("schema_name"),
        "table_name",
        "constraint_name",
        "constraint_type",
        constraint_definition(F.col("constraint_type"), F.col("key_columns")).alias(
            "definition"
        ),
    )


def views(cat_views: DataFrame, schema: Scope = None) -> DataFrame:
    return in_scope(cat_views, "table_schema", schema).select(
        "snapshot_id",
        F.col("table_schema").alias("schema_name"),
        required("table_name", "table_name").alias("view_name"),
    )


def view_columns(
    cat_columns: DataFrame, cat_views: DataFrame, schema: Scope = None
) -> DataFrame:
    """The columns whose table is a view."""
    keys = ["snapshot_id", "schema_name", "table_name"]
    wanted = views(cat_views, schema).withColumnRenamed("view_name", "table_name")
    return columns(cat_columns, schema).join(wanted, keys, "left_semi")


def routines(
    proc: DataFrame, namespace: DataFrame, language: DataFrame, schema: Scope = None
) -> DataFrame:
    """Functions and procedures in one pass; aggregates and the like are left out.

    A namespace or a language may own a large share of all routines. Both are
    joined without a hint: they are broadcast when Spark measures them as small,
    and otherwise the adaptive skew join splits the large keys.
    """
    namespaces = in_scope(namespace, "nspname", schema).select(
        "snapshot_id",
        F.col("oid").alias("pronamespace"),
        F.col("nspname").alias("schema_name"),
    )
    languages = taking_part(language, schema).select(
        "snapshot_id", F.col("oid").alias("prolang"), F.col("lanname").alias("language")
    )
    is_function = F.col("prokind") == FUNCTION_KIND
    return (
        taking_part(proc, schema)
        .where(F.col("prokind").isin(FUNCTION_KIND, PROCEDURE_KIND))
        .join(namespaces, ["snapshot_id", "pronamespace"])
        .join(languages, ["snapshot_id", "prolang"])
        .select(
            "snapshot_id",
            "oid",
            F.when(is_function, "FUNCTION").otherwise("PROCEDURE").alias("type"),
            "schema_name",
            required("proname", "proname").alias("routine_name"),
            F.when(is_function, required("return_type", "return_type")).alias(
                "return_type"
            ),
            required("arguments", "arguments").alias("arguments"),
            required("language", "lanname").alias("language"),
        )
    )


def functions(
    proc: DataFrame, namespace: DataFrame, language: DataFrame, schema: Scope = None
) -> DataFrame:
    only = proc.where(F.col("prokind") == FUNCTION_KIND)
    return routines(only, namespace, language, schema).select(
        "snapshot_id", "schema_name", F.col("routine_name").alias("function_name"),
        "return_type", "arguments", "language",
    )


def procedures(
    proc: DataFrame, namespace: DataFrame, language: DataFrame, schema: Scope = None
) -> DataFrame:
    only = proc.where(F.col("prokind") == PROCEDURE_KIND)
    return routines(only, namespace, language, schema).select(
        "snapshot_id", "schema_name", F.col("routine_name").alias("procedure_name"),
        "arguments", "language",
    )


def sequences(cat_sequences: DataFrame, schema: Scope = None) -> DataFrame:
    def whole(name: str):
        return required(F.col(name).cast("bigint"), name).alias(name)

    return in_scope(cat_sequences, "sequence_schema", schema).select(
        "snapshot_id",
        F.col("sequence_schema").alias("schema_name"),
        required("sequence_name", "sequence_name").alias("sequence_name"),
        required("data_type", "data_type").alias("data_type"),
        whole("start_value"),
        whole("increment"),
    )
