"""The pipeline keeps what it should, and each registered query equals its SQL."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from snapdelta.llm import arrow_tasks, bpe_codec, byte_bpe, language_id, registry, token_counts

SF_DIR = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    df = registry.queries()[name](spark, SF_DIR)
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(repr(row) for row in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def test_stages(spark):
    copy = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    rows = [(i, t, lang, "s", 1, "x") for i, (t, lang) in enumerate([
        (copy, "de"), (copy, "de"), (copy + " ende", "de"), ("12 34", "de"), (None, "de"), ("ganz anderer text", "de"),
    ])]
    rows.append((None, "text ohne nummer", "de", "s", 1, "x"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns
    lettered = corpus_pipeline.drop_without_language(spark, docs, SF_DIR)
    assert {r.doc_id for r in lettered.collect()} == {0, 1, 2, 5, None}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, lettered, SF_DIR).collect()} == {0, 5, None}
    assert corpus_pipeline.drop_near_copies(spark, lettered, SF_DIR).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF_DIR).collect() == []


def words(start, n=30):
    return " ".join(f"w{start}x{i}" for i in range(n))


def test_near_copies_with_clashing_ids_and_odd_columns(spark):
    """A text is judged for itself, whatever rows share its id; any column name and type passes."""
    texts = [
        (1, words(1), {"k": "a"}), (2, words(1), {"k": "b"}), (2, words(2), {}),  # a copy and a unique text under one id
        (3, words(3), None), (3, words(3) + " end", None), (3, words(3), {"k": "z"}),  # near copies under one id
        (None, words(4), None), (None, words(4), None), (4, words(4) + " end", None),  # a named copy goes before unnamed ones
        (None, words(5), None), (None, words(6), None), (7, None, None), (7, None, None), (8, "", None),
    ]
    docs = spark.createDataFrame(
        [(i, t, m, n, n) for n, (i, t, m) in enumerate(texts)],
        "doc_id long, text string, `a.b` map<string,string>, _maybe int, _row int",
    ).repartition(4)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF_DIR)
    assert out.columns == docs.columns
    rows = out.collect()
    found = sorted((str(r.doc_id), r.text or "") for r in rows)
    assert found == sorted([
        ("1", words(1)), ("2", words(2)), ("4", words(4) + " end"), ("None", words(5)), ("None", words(6)),
        ("7", ""), ("7", ""), ("8", ""), next(f for f in found if f[0] == "3"),
    ])
    assert sorted(r._maybe for r in out.collect()) == sorted(r._maybe for r in rows)


def test_unlearned_language_goes(spark):
    text = "der hund und die katze sehen das haus am see "
    rows = [(i, text * 2 + str(i), "de") for i in range(30)] + [(50, "это слово здесь написано на другом языке " * 3, "de")]
    rows += [(51, "слово", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = docs.where("doc_id < 50")
    from unittest import mock

    train = corpus_pipeline.language_id.train
    with mock.patch.object(corpus_pipeline.language_id, "train", lambda _, fold: train(learned, fold=fold)):
        kept = {r.doc_id for r in corpus_pipeline.drop_without_language(spark, docs, SF_DIR).collect()}
    assert kept == {*range(30), 51}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_stages_that_remember_much_give_their_memory_back(spark, monkeypatch):
    given_back = []

    def spied(of):
        def map_texts(*args, **named):
            given_back.append(named.get("release_after", False))
            return of(*args, **named)

        return map_texts

    for module in (bpe_codec, language_id):
        monkeypatch.setattr(module, "map_texts", spied(module.map_texts))
    docs = spark.createDataFrame([(1, "some words", "en")], "doc_id long, text string, lang string")
    bpe_codec.digests(docs)
    language_id.identify(docs, language_id.Model([], "und", np.zeros((1, 1), np.uint64), np.zeros(0)), ["doc_id"])
    assert given_back == [True, True]


def _batch_bytes(session, docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    return [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]


def test_stages_get_small_batches(spark):
    session = spark.newSession()
    docs = session.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    corpus_pipeline.encode_and_decode(session, docs, "")
    found = _batch_bytes(session, docs)
    assert sum(found) > 15_000_000 and max(found) < 1.2 * arrow_tasks.BATCH_BYTES


def test_a_limit_of_the_session_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000000")
    corpus_pipeline.encode_and_decode(session, session.createDataFrame([(1, "a")], "doc_id long, text string"), "")
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000000"


def test_tables_grow_with_the_longest_text():
    from tokenizers import Tokenizer

    path = byte_bpe.default_path()
    encoder = bpe_codec._Encoder(path)
    scanner = encoder.encode.scanner
    assert len(scanner.powers) == token_counts.FIRST_POWERS < token_counts.BLOCK_CHARS
    # Without a safe place the whole text is one unit.
    texts = ["a few words, ", "x\u00e9" * 200_000, "it's 12 more\n" * 30]
    library = Tokenizer.from_file(path)
    assert [x.tolist() for x in encoder.ids(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(scanner.powers) >= 400_000
    assert (scanner.powers * scanner.inverse == 1).all()
