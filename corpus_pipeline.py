"""A training corpus from raw documents, stage by stage.

Each stage works on all rows its predecessor kept and, but for the last, returns the
columns of the documents. Rows without an id stay through the near-duplicate stage, as no
row can be named in their place; repeated whole rows count once there. The mixing stage
repeats rows that the mix takes twice and leaves out rows it does not take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapdelta.llm import bpe_codec, jaccard_join, language_id, row_filter, source_mix, toxicity
from snapdelta.llm.arrow_tasks import bound_batches, read_table
from snapdelta.llm.registry import make_importable
from snapdelta.sources.shared_storage import stored

# SQL has no trained models, no tokenizer and no hash that the mix uses.
ORACLE_SQL = None
# A text of so many characters holds n-grams enough to name its language.
LEAST_CHARACTERS = 40


def _prepare(spark: SparkSession) -> None:
    make_importable(spark)
    bound_batches(spark)


def _whole_rows(docs: DataFrame) -> DataFrame:
    """The row as one column, so that new columns cannot clash with its own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), fold=None)
    return toxicity.score(_whole_rows(docs), model, keep=["_row"]).where(F.col("score") < 0.3).select("_row.*")


def drop_without_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters, and those long enough to tell in which no n-gram
    of any learned language is found."""
    _prepare(spark)
    model = language_id.train(docs, fold=None)
    named = language_id.identify(_whole_rows(docs), model, keep=["_row"])
    spoken = (F.col("score") > 0) | (F.length(F.coalesce(F.col("_row.text"), F.lit(""))) < LEAST_CHARACTERS)
    return named.where((F.col("lang_pred") != language_id.UNKNOWN) & spoken).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of 0.8 or more on five words, the least stays."""
    _prepare(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    # Rows without an id come last; no part is null, so that keys can be joined.
    key = F.struct(
        F.col("doc_id").isNull().alias("missing"),
        F.coalesce(F.col("doc_id"), F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"),
        F.xxhash64(F.lit(1), text).alias("hash1"), F.xxhash64(F.lit(2), text).alias("hash2"),
    )
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), key.alias("_key"), text.alias("text"))
    joined = jaccard_join.similarity_join(keyed.select("_key", "text"), id_col="_key", width=5, percent=80)
    decided = stored(
        joined.where(F.col("n_links") > 0).select("_key", (F.col("_key") == F.col("component_id")).alias("kept"))
    )
    return row_filter.one_of_each(keyed, decided).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in its shards' order."""
    _prepare(spark)
    planned = source_mix.plan(docs)
    rows = source_mix.drawn(source_mix.mix(docs, planned))
    return rows.repartition("shard").sortWithinPartitions("shard", "order").select("row.*")


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _prepare(spark)
    return bpe_codec.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_without_language),
    ("near copies", drop_near_copies),
    ("mix", mix_sources),
    ("bpe", encode_and_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
