"""The JDBC reads as far as they can be checked without a database."""

from pyspark.sql import functions as F

from snapdelta.sources import jdbc
from snapdelta.sources.catalog import RELATIONS


class FakeReader:
    """Stands for ``spark.read``: answers each query with one row of server types."""

    SERVER_TYPES = {"oid": "bigint", "pronamespace": "bigint", "prolang": "bigint",
                    "ordinal_position": "int"}

    def __init__(self, spark, seen):
        self.spark, self.seen = spark, seen

    def format(self, source):
        assert source == "jdbc"
        return self

    def options(self, **options):
        self.seen.append(options)
        return self

    def load(self):
        listed = self.seen[-1]["query"].removeprefix("select ").split(" from ")[0]
        names = [part.split(" as ")[-1] for part in listed.split(", ")]
        return self.spark.range(1).select(
            *[F.lit("1").cast(self.SERVER_TYPES.get(n, "string")).alias(n) for n in names]
        )


class FakeSession:
    def __init__(self, spark):
        self.seen = []
        self.read = FakeReader(spark, self.seen)
        self.createDataFrame = spark.createDataFrame


def test_every_relation_is_read_with_its_schema(spark):
    session = FakeSession(spark)
    options = {"url": "jdbc:postgresql://host/db", "user": "reader"}
    found = jdbc.read_database(session, options, 7, "billing", "public")
    assert set(found) == set(RELATIONS)
    for relation, df in found.items():
        wanted = spark.createDataFrame([], RELATIONS[relation]).dtypes
        assert df.dtypes == wanted, relation
        assert df.first()["snapshot_id"] == 7
    assert all(seen["url"] == options["url"] for seen in session.seen)


def test_only_needed_columns_are_fetched():
    reads = jdbc.database_reads()
    assert reads["views"]["query"] == (
        "select table_schema, table_name from information_schema.views"
    )
    assert all("*" not in read["query"] for read in reads.values())
