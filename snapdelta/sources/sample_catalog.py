"""A catalog of one snapshot per region, derived from the star-schema test tables.

Customers become tables, orders their columns, indexes and constraints, parts
become routines and suppliers sequences. Each region key is one snapshot; snapshot
0 is the baseline that the others are compared with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.sources.catalog import Catalog

# The columns used of the test tables.
TABLES = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING",
    "customer": "c_custkey BIGINT",
    "supplier": "s_suppkey BIGINT",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT",
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING"
    ),
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT",
}

def _name(prefix: str, key: str) -> str:
    return f"concat('{prefix}', cast({key} as string))"


def _schema(key: str) -> str:
    return (
        f"case when {key} % 50 = 7 then 'pg_catalog' "
        f"when {key} % 50 = 8 then 'information_schema' "
        f"else concat('s', cast({key} % 5 as string)) end"
    )


def _drifted(key: str, modulus: int) -> str:
    return f"snapshot_id > 0 and ({key} + snapshot_id) % {modulus} = 0"


def _present(key: str, modulus: int) -> str:
    return f"({key} + snapshot_id) % {modulus} <> 0"


def catalog_from(spark: SparkSession, sf_dir: str) -> Catalog:
    def table(name: str) -> DataFrame:
        return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")

    region = table("region")
    # A subquery with one row; no join repeats the tables.
    snapshot_ids = region.agg(F.array_sort(F.collect_set("r_regionkey"))).scalar()

    def everywhere(df: DataFrame) -> DataFrame:
        return df.select("*", F.explode(snapshot_ids).alias("snapshot_id"))

    orders, part, supplier = table("orders"), table("part"), table("supplier")

    # A table is left out of a snapshot as a whole, so the position of a column is
    # the same in all snapshots and is numbered once.
    numbered = orders.selectExpr(
        "*",
        "row_number() over (partition by o_custkey order by o_orderkey) as ordinal_position",
    )
    columns = (
        everywhere(numbered)
        .where(_present("o_custkey", 11))
        .selectExpr(
            "snapshot_id",
            f"{_schema('o_custkey')} as table_schema",
            f"{_name('customer_', 'o_custkey')} as table_name",
            f"{_name('o_', 'o_orderkey')} as column_name",
            f"case when {_drifted('o_orderkey', 97)} then 'text' else o_orderpriority end "
            "as data_type",
            "case when o_orderstatus = 'O' then 'YES' else 'NO' end as is_nullable",
            "case when o_orderkey % 3 <> 0 then o_orderstatus end as column_default",
            "ordinal_position",
        )
    )

    order_indexes = (
        everywhere(orders.where("o_orderkey % 7 = 0"))
        .where(_present("o_custkey", 11))
        .selectExpr(
            "snapshot_id",
            f"{_schema('o_custkey')} as schemaname",
            f"{_name('customer_', 'o_custkey')} as tablename",
            f"{_name('ix_', 'o_orderkey')} as indexname",
            "concat(case when o_orderkey % 2 = 0 then 'CREATE UNIQUE INDEX ' "
            f"else 'CREATE INDEX ' end, {_name('ix_', 'o_orderkey')}) as indexdef",
        )
    )
    part_indexes = (
        everywhere(part.where("p_partkey % 10 = 0"))
        .where(_present("p_partkey", 13))
        .selectExpr(
            "snapshot_id",
            f"{_schema('p_partkey')} as schemaname",
            f"{_name('part_', 'p_partkey')} as tablename",
            f"{_name('pix_', 'p_partkey')} as indexname",
            "'CREATE INDEX pix' as indexdef",
        )
    )

    constraint_place = [
        "snapshot_id",
        f"{_schema('o_custkey')} as table_schema",
        f"{_name('customer_', 'o_custkey')} as table_name",
        f"{_name('k_', 'o_orderkey')} as constraint_name",
    ]
    constrained = orders.where("o_orderkey % 6 = 0")
    table_constraints = (
        everywhere(constrained)
        .where(_present("o_custkey", 11))
        .selectExpr(
            *constraint_place,
            "case o_orderkey % 5 when 0 then 'PRIMARY KEY' when 1 then 'FOREIGN KEY' "
            "when 2 then 'UNIQUE' when 3 then 'CHECK' else 'EXCLUDE' end as constraint_type",
        )
    )
    keyed = table("lineitem").join(
        constrained.where("o_orderkey % 5 < 3").withColumnRenamed("o_orderkey", "l_orderkey"),
        "l_orderkey",
    )
    key_column_usage = everywhere(keyed.withColumnRenamed("l_orderkey", "o_orderkey")).selectExpr(
        *constraint_place,
        f"{_name('c', 'l_partkey')} as column_name",
        "l_linenumber as ordinal_position",
    )

    customer_views = (
        everywhere(table("customer").where("c_custkey % 20 = 3"))
        .where(_present("c_custkey", 11))
        .selectExpr(
            "snapshot_id",
            f"{_schema('c_custkey')} as table_schema",
            f"{_name('customer_', 'c_custkey')} as table_name",
        )
    )
    supplier_views = everywhere(supplier.where("s_suppkey % 10 = 0")).selectExpr(
        "snapshot_id",
        "'s0' as table_schema",
        f"{_name('supplier_', 's_suppkey')} as table_name",
    )

    # A small file is one split of the scan, so one task would make all routines of all
    # snapshots. The number is named, as Spark would else merge the partitions by their
    # size, which they have before each row becomes many.
    spread_parts = part.repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    proc = (
        everywhere(spread_parts)
        .where(_present("p_partkey", 17))
        .selectExpr(
            "snapshot_id",
            "p_partkey as oid",
            f"{_name('fn_', '(p_partkey % 400)')} as proname",
            "p_partkey % 25 as pronamespace",
            "p_partkey % 5 as prolang",
            "case p_size % 4 when 2 then 'p' when 3 then 'a' else 'f' end as prokind",
            f"case when {_drifted('p_partkey', 31)} then 'void' else p_type end as return_type",
            "concat(p_brand, ' ', p_name) as arguments",
        )
    )
    return Catalog(
        snapshots=region.selectExpr(
            "r_regionkey as snapshot_id", "r_name as name",
            "cast(null as string) as schema_name",
        ),
        columns=columns,
        indexes=order_indexes.unionByName(part_indexes),
        table_constraints=table_constraints,
        key_column_usage=key_column_usage,
        views=customer_views.unionByName(supplier_views),
        proc=proc,
        namespace=everywhere(table("nation")).selectExpr(
            "snapshot_id",
            "cast(n_nationkey as bigint) as oid",
            "case when n_nationkey = 0 then 'pg_catalog' else n_name end as nspname",
        ),
        language=everywhere(region).selectExpr(
            "snapshot_id", "cast(r_regionkey as bigint) as oid", "r_name as lanname"
        ),
        sequences=everywhere(supplier)
        .where(_present("s_suppkey", 11))
        .selectExpr(
            "snapshot_id",
            "concat('s', cast(s_suppkey % 5 as string)) as sequence_schema",
            f"{_name('seq_', 's_suppkey')} as sequence_name",
            "'bigint' as data_type",
            "cast(s_suppkey as string) as start_value",
            f"case when {_drifted('s_suppkey', 9)} then '10' else '1' end as increment",
        ),
    )


def pairs_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline with each other snapshot."""
    region = spark.read.schema(TABLES["region"]).parquet(f"{sf_dir}/region.parquet")
    return region.where("r_regionkey > 0").selectExpr(
        "0 as source_id", "r_regionkey as target_id"
    )
