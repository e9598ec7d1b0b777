"""Dropping rows by id without moving the rows that stay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOOM_BITS = 26
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _places(keys: np.ndarray) -> list[np.ndarray]:
    wide = keys.view(np.uint64)
    wide = wide ^ (wide >> np.uint64(32))
    return [((wide * np.uint64(f)) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64) for f in _FACTORS]


def bloom(keys: DataFrame) -> np.ndarray:
    """Words of a Bloom filter, 8 MB whatever the input, of a frame with one long column."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy()):
                np.bitwise_or.at(table, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], names=["word", "bits"])

    found = keys.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    table[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return table


def maybe_in(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are surely not in the filter."""
    found = np.ones(len(keys), bool)
    for at in _places(keys):
        found &= (table[at >> 6] >> (at & 63)) & 1 == 1
    return found


def maybe_column(spark: SparkSession, keys: DataFrame, column: Column) -> Column:
    """False where a long column surely holds no key; null values are not keys."""
    shared = spark.sparkContext.broadcast(bloom(keys))

    @F.pandas_udf("boolean")
    def maybe(values):
        return type(values)(maybe_in(shared.value, values.to_numpy(dtype=np.int64)))

    return maybe(column)


def one_of_each(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows that ``decided`` keeps or does not name, one per key.

    ``rows`` has ``_row``, a struct, and ``_key``; ``decided`` has ``_key, kept`` for the keys
    of which it decides. A filter of fixed size finds the rows that may have such a key; only
    those are shuffled and decided by a join. Of the rows of one decided key one stays, the
    same one whenever this is run; rows beyond ``decided`` stay, repeats included.
    """
    spark = rows.sparkSession
    maybe = maybe_column(spark, decided.select(F.xxhash64("_key")), F.xxhash64("_key"))
    flagged = rows.withColumn("_maybe", maybe)
    surely = flagged.where(~F.col("_maybe")).select("_row")
    decisions = decided.groupBy(F.col("_key").alias("_decided")).agg(F.max("kept").alias("_kept"))
    asked = flagged.where("_maybe").join(decisions, F.col("_key") == F.col("_decided"), "left")
    undecided = asked.where(F.col("_decided").isNull()).select("_row")
    # Any type has a text, also those that cannot be compared.
    order = F.xxhash64(F.to_json(F.struct("_row")))
    stay = asked.where("_kept").groupBy("_key").agg(F.min_by("_row", order).alias("_row"))
    return surely.unionByName(undecided).unionByName(stay.select("_row"))
