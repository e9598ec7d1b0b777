"""Approximate nearest neighbours by multi-index hashing.

Rotations learned on a bounded sample (iterative quantisation) turn each vector into a
binary code of one or more rotations, a bit per rotated axis. Codes are cut into
substrings of 16 bits and each substring is indexed. By the pigeonhole principle, a code
within Hamming radius r of a query agrees in at least one of m substrings within r // m
bits, so probing each substring that far finds every code within r; the found codes are
checked whole, and the vectors behind them are ranked by their exact distance. If fewer
than k codes lie within the radius, it grows until there are k.

The vectors are dealt into blocks of bounded size by the hash of their id, the queries,
a stated set, into blocks of their own, and each pair of blocks is one task; only the k
best of a pair leave it. So no group grows with the data, and a vector that occurs very
often is spread over all blocks.

Defined cases: vectors that are null, empty, zero, of another length than the most
frequent one, or that hold null or non-finite parts take no part, nor do null ids.
Repeated ids count as one: the copies of a row rank once each only if they differ. Ties
go to the smaller id. With fewer candidates than k, all are returned; an empty table
gives no rows. Columns but the named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
BLOCK_VECTORS, BLOCK_QUERIES = 8192, 1024
_ONES = np.array([bin(i).count("1") for i in range(1 << BITS)], np.uint8)
_BY_WEIGHT = [np.flatnonzero(_ONES == n).astype(np.uint16) for n in range(BITS + 1)]


@dataclass(frozen=True)
class Codes:
    """Mean and rotations; ``substrings`` words of 16 bits make a code."""

    mean: np.ndarray
    rotation: np.ndarray

    @property
    def substrings(self) -> int:
        return -(-self.rotation.shape[1] // BITS)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        bits = ((vectors - self.mean) @ self.rotation) > 0
        padded = np.zeros((len(bits), self.substrings * BITS), np.uint16)
        padded[:, : bits.shape[1]] = bits
        weights = (1 << np.arange(BITS)).astype(np.uint16)
        return (padded.reshape(len(bits), -1, BITS) * weights).sum(2, dtype=np.uint16)


def learn_codes(sample: np.ndarray, rotations: int = 2, rounds: int = 30, seed: int = 3) -> Codes:
    """Rotations that bring the sample close to the corners of a cube."""
    size = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(size)
    centred, random = sample - mean, np.random.default_rng(seed)
    found = []
    for _ in range(rotations):
        rotation = np.linalg.qr(random.normal(size=(size, size)))[0]
        for _ in range(rounds if len(sample) > size else 0):
            corners = np.where(centred @ rotation > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(centred.T @ corners)
            rotation = left @ right
        found.append(rotation)
    return Codes(mean, np.concatenate(found, 1))


class MultiIndex:
    """A block's codes, by substring: the values that occur and the rows of each."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.tables = []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, begins = np.unique(column[order], return_index=True)
            where = np.full(1 << BITS, -1, np.int32)
            where[values] = np.arange(len(values))
            self.tables.append((values, np.append(begins, len(order)), order, where))

    def probe(self, table: int, word: int, distance: int) -> np.ndarray:
        """Rows whose substring is exactly ``distance`` bits away from the word.

        All words at that distance are looked up, or all words that occur are compared,
        whichever are fewer; both find the same.
        """
        values, begins, order, where = self.tables[table]
        flips = _BY_WEIGHT[distance]
        if len(flips) < len(values):
            hit = where[flips ^ np.uint16(word)]
            hit = hit[hit >= 0]
        else:
            hit = np.flatnonzero(_ONES[values ^ np.uint16(word)] == distance)
        sizes = begins[hit + 1] - begins[hit]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return order[np.arange(total) + np.repeat(begins[hit] - (ends - sizes), sizes)]

    def search(self, code: np.ndarray, radius: int, least: int) -> np.ndarray:
        """All rows within the radius, or within the least radius that has ``least`` rows."""
        count, m = len(self.codes), len(self.tables)
        seen = np.zeros(count, bool)
        probed = -1
        while True:
            while probed < min(radius // m, BITS):
                probed += 1
                for table in range(m):
                    seen[self.probe(table, int(code[table]), probed)] = True
            rows = np.flatnonzero(seen)
            distances = _ONES[self.codes[rows] ^ code].sum(1, dtype=np.int32)
            near = rows[distances <= radius]
            if len(near) >= min(least, count) or radius >= m * BITS:
                return near
            radius += m


def _nearest(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, codes: Codes,
             radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    index, asked = MultiIndex(codes(vectors)), codes(queries)
    found: list[tuple[int, int, float]] = []
    for i, own in enumerate(query_ids.tolist()):
        rows = index.search(asked[i], radius, k + 1)
        rows = rows[ids[rows] != own]
        distance = np.sqrt(((vectors[rows] - queries[i]) ** 2).sum(1))
        best = np.lexsort((ids[rows], distance))[:k]
        found += [(own, int(ids[rows[b]]), float(distance[b])) for b in best]
    q, v, d = zip(*found) if found else ((), (), ())
    return np.array(q, np.int64), np.array(v, np.int64), np.array(d, np.float64)


def nearest(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 100,
    k: int = 10,
    radius: int | None = None,
    rotations: int = 2,
    sample_rows: int = 4096,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each row whose id ``every`` divides.

    ``score`` is the Euclidean distance in double precision. The rotations are fitted on
    the ``sample_rows`` rows of smallest hash; all rows are indexed. ``radius`` is in bits
    of the whole code of ``rotations`` times the dimension, by default seven sixteenths of it.
    """
    spark = df.sparkSession
    result = "query_id long, vec_id long, score double"
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(F.col("id").isNotNull() & sound)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, count = sizes[0]["d"], sizes[0]["n"]
    rows = rows.where(F.size("v") == dimension)
    radius = rotations * dimension * 7 // BITS if radius is None else radius
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(sample_rows).select("v").toArrow()
    codes = learn_codes(sample.column(0).combine_chunks().flatten().to_numpy().reshape(-1, dimension), rotations)
    shared = spark.sparkContext.broadcast((codes.mean, codes.rotation))
    asked = rows.where(F.col("id") % every == 0)
    blocks = -(-count // BLOCK_VECTORS)
    query_blocks = -(-max(asked.count(), 1) // BLOCK_QUERIES)

    def dealt(source: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return source.withColumn(own, F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(n)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left.column("id").to_numpy(), right.column("id").to_numpy()
        both = [t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dimension) for t in (left, right)]
        if len(ids) and len(own):
            q, v, d = _nearest(ids, both[0], own, both[1], Codes(*shared.value), radius, k)
        else:
            q, v, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return pa.table({"query_id": q, "vec_id": v, "score": d})

    data = dealt(rows, "block", blocks, "query_block", query_blocks).groupBy("block", "query_block")
    questions = dealt(asked, "query_block", query_blocks, "block", blocks).groupBy("block", "query_block")
    found = data.cogroup(questions).applyInArrow(search, result)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
