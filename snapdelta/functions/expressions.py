"""Column expressions shared by the operators. All run inside Spark's JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# They must equal what PostgreSQL and the report readers expect.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
YES = "YES"
UNIQUE_WORD = "UNIQUE"
FUNCTION_KIND = "f"
PROCEDURE_KIND = "p"
KEYED_CONSTRAINTS = ("PRIMARY KEY", "FOREIGN KEY", "UNIQUE")
KEY_COLUMN_SEPARATOR = ","
NAME_SEPARATOR = "."

# A 64-bit content hash is cut into three parts of 21 bits, so the sum of the
# parts over up to 2^42 rows still fits a BIGINT.
_HASH_SEEDS = (1, 2)
_PART_BITS = 21
_PARTS_PER_HASH = 3


def required(value: str | Column, field: str) -> Column:
    """The value itself; the job fails when it is null."""
    column = F.col(value) if isinstance(value, str) else value
    return F.coalesce(
        column, F.raise_error(F.lit(f"required catalog field is null: {field}"))
    )


def qualified_name(schema: str, name: str) -> Column:
    """``schema.name``; null when either part is null."""
    return F.concat(F.col(schema), F.lit(NAME_SEPARATOR), F.col(name))


def mentions_unique(definition: Column) -> Column:
    """True when the word occurs anywhere in the index definition, in any case."""
    return F.contains(F.upper(definition), F.lit(UNIQUE_WORD))


def constraint_definition(kind: Column, key_columns: Column) -> Column:
    """Short definition of a constraint; unknown kinds stand for themselves."""
    listed = F.coalesce(key_columns, F.lit(""))
    return (
        F.when(kind == "PRIMARY KEY", F.concat(F.lit("PRIMARY KEY ("), listed, F.lit(")")))
        .when(
            kind == "FOREIGN KEY",
            F.concat(F.lit("FOREIGN KEY ("), listed, F.lit(") REFERENCES ...")),
        )
        .when(kind == "UNIQUE", F.concat(F.lit("UNIQUE ("), listed, F.lit(")")))
        .when(kind == "CHECK", F.lit("CHECK (...)"))
        .otherwise(kind)
    )


def ordered_key_columns() -> Column:
    """Key column names as one text, in key order."""
    return F.expr(
        f"listagg(column_name, '{KEY_COLUMN_SEPARATOR}') "
        "within group (order by ordinal_position, column_name)"
    )


@dataclass(frozen=True)
class Wanted:
    """The snapshots and schemas of one run, resolved once and stored.

    ``rows`` has one row per known snapshot: ``snapshot_id, schema_name, taking_part``.
    Only snapshots with ``taking_part = 1`` are read. ``name`` is the schema of all of
    them, if it is one; else ``own_schemas`` says whether ``schema_name`` restricts them.
    """

    rows: DataFrame
    name: str | None = None
    own_schemas: bool = False


Scope = str | DataFrame | Wanted | None


def taking_part(df: DataFrame, scope: Scope) -> DataFrame:
    """The rows of the snapshots that take part; a filter on partitions where ``df`` was
    landed by snapshot."""
    if not isinstance(scope, Wanted):
        return df
    ids = scope.rows.where(F.col("taking_part") == 1).select("snapshot_id")
    return df.join(ids, "snapshot_id", "left_semi")


def in_scope(df: DataFrame, schema_column: str, scope: Scope = None) -> DataFrame:
    """Rows outside the system schemas and, if asked for, inside one schema.

    ``scope`` is a name for all snapshots, the resolved scope of a run, or a relation
    ``snapshot_id, schema_name`` of the wanted snapshots (null name = every schema).
    Repeated equal rows of it count once; two names for one snapshot fail the job.
    """
    kept = df.where(~F.col(schema_column).isin(*SYSTEM_SCHEMAS))
    if scope is None:
        return kept
    if isinstance(scope, str):
        return kept.where(F.col(schema_column) == scope)
    if isinstance(scope, Wanted):
        if scope.name is not None:
            kept = kept.where(F.col(schema_column) == scope.name)
        if not scope.own_schemas:
            return taking_part(kept, scope)
        wanted = scope.rows.where(F.col("taking_part") == 1).drop("taking_part")
    else:
        wanted = one_scope_each(scope)
    return (
        kept.join(wanted.withColumnRenamed("schema_name", "_wanted"), "snapshot_id")
        .where(F.col("_wanted").isNull() | (F.col("_wanted") == F.col(schema_column)))
        .drop("_wanted")
    )


def one_scope_each(scope: DataFrame) -> DataFrame:
    """``snapshot_id, schema_name`` with one row per snapshot; the job fails on two names."""
    names = F.collect_set(F.struct("schema_name"))
    several = F.concat(F.lit("several schemas are wanted of snapshot "), F.col("snapshot_id").cast("string"))
    return (
        scope.groupBy("snapshot_id").agg(names.alias("_names"))
        .select(
            "snapshot_id",
            F.when(F.size("_names") > 1, F.raise_error(several))
            .otherwise(F.element_at("_names", 1)["schema_name"])
            .alias("schema_name"),
        )
    )


def content_parts(*fields: Column) -> list[Column]:
    """Six small integers that stand for the content of one row.

    Sums of these parts over a group depend on the rows (with repeats) and not
    on their order. So a sum per object is a fixed-size fingerprint of its
    members that partial aggregation can build without collecting them.
    """
    parts = []
    mask = (1 << _PART_BITS) - 1
    for seed in _HASH_SEEDS:
        content = F.xxhash64(F.lit(seed), *fields)
        parts += [
            F.shiftrightunsigned(content, i * _PART_BITS).bitwiseAND(F.lit(mask))
            for i in range(_PARTS_PER_HASH)
        ]
    return parts


def expand_copies(df: DataFrame, copies: str, number: str) -> DataFrame:
    """One row per copy, numbered from 1.

    Goes by blocks, so that no array grows with the number of copies.
    """
    block = 1 << 16
    blocks = df.withColumn(
        "_block", F.explode(F.expr(f"sequence(0L, ({copies} - 1) div {block})"))
    )
    return blocks.withColumn(
        number,
        F.explode(
            F.expr(
                f"sequence(_block * {block} + 1, least({copies}, (_block + 1) * {block}))"
            )
        ),
    ).drop("_block", copies)
