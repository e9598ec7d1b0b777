"""The first ten operators on small hand-made tables, against brute force or exact round trips."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapdelta.llm import (
    bpe_codec, byte_bpe, chat_format, jaccard_join, language_id, source_mix, token_counts, topk_search, toxicity,
    vector_search, warc_store,
)
from snapdelta.llm.registry import make_importable

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ODD_TEXTS = [
    None, "", " \n\t", "a", "Don't we'll  \n\n x", "<|endoftext|> a<|endoftext|>", "é漢😀 ok　x ٣",
    "word " * 3000, "x" * 5000, "same text here", "same text here",
]


@pytest.fixture(scope="module")
def session(spark):
    make_importable(spark)
    return spark


def texts_table(spark, texts):
    """Documents with columns whose names the operators use themselves."""
    rows = [(i, t, "n_tokens", 0.5, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double, size int")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(byte_bpe.default_path())


def expected_ids(texts):
    return [e.ids for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def random_texts(n, seed=1):
    draw, letters = random.Random(seed), " '\n\tsrevlmdxA1é!.<ñ漢–😀　\xa0\x1c\x85"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(n)]


def test_token_counts_equal_the_library(session):
    texts = ODD_TEXTS + random_texts(300)
    got = token_counts.count_tokens(texts_table(session, texts), limit=1024).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(i) for i in expected_ids(texts)]
    assert [r.n_bytes for r in got] == [len((t or "").encode()) for t in texts]
    assert [r.over_limit for r in got] == [len(i) > 1024 for i in expected_ids(texts)]


def test_entry_states_equal_a_walk():
    table, _ = token_counts.compiled()
    classes = np.random.default_rng(0).integers(0, token_counts.N_CLASSES, (16, 9)).astype(np.uint8)
    state, walked = token_counts.FRESH, []
    for column in classes.T:
        walked.append(state)
        for c in column:
            state = table[int(c) * token_counts.N_STATES + state]
    assert token_counts.entry_states(classes, table).tolist() == walked


@pytest.mark.parametrize("bits", [2, 11])
def test_bpe_equals_the_library_however_texts_are_cut(bits, monkeypatch):
    monkeypatch.setattr(bpe_codec, "CUT_BITS", bits)
    texts = [t or "" for t in ODD_TEXTS] + random_texts(300)
    encoder = bpe_codec._Encoder(byte_bpe.default_path())
    assert [x.tolist() for x in encoder.ids(texts + texts)] == 2 * expected_ids(texts)


def test_bpe_round_trip(session):
    df = texts_table(session, ODD_TEXTS)
    decoded = bpe_codec.decode(bpe_codec.encode(df), keep=["doc_id"]).orderBy("doc_id").collect()
    assert [r.decoded for r in decoded] == [t or "" for t in ODD_TEXTS]
    for r, ids, text in zip(bpe_codec.digests(df).orderBy("doc_id").collect(), expected_ids(ODD_TEXTS), ODD_TEXTS):
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def components_of(texts, width, percent):
    sets = []
    for t in texts:
        words = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    label = list(range(len(texts)))
    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return [len(s) for s in sets], label, links


def near_copies(n, words, seed=3):
    draw, made = random.Random(seed), []
    for _ in range(n // 8):
        base = [draw.choice("abcdefghij") * draw.randint(1, 4) for _ in range(draw.choice(words))]
        for _ in range(8):
            copy = list(base)
            for _ in range(draw.randint(0, 1 + len(base) // 40)):
                copy[draw.randrange(len(copy))] = draw.choice("klmnop") * 3
            made.append(" ".join(copy))
    return made


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_similarity_join_equals_brute_force(session, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 3)  # large groups are split
    texts = ODD_TEXTS + near_copies(120, [6, 9, 30, 120, 150, 170, 400])
    sizes, label, links = components_of(texts, width, percent)
    got = jaccard_join.similarity_join(texts_table(session, texts), width=width, percent=percent).orderBy("doc_id").collect()
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == label
    assert [r.n_links for r in got] == links


@pytest.mark.parametrize("width, percent, words", [(4, 85, 9), (5, 80, 8), (2, 50, 2)])
def test_similarity_join_finds_supersets(session, width, percent, words):
    """The smaller set lies wholly in the larger one: 6 of 7, 4 of 5 and 1 of 2 shingles."""
    texts = []
    for i in range(60):  # words of more than 50 texts are frequent
        for common in (True, False):
            base = [("all" if common and k else f"own{i}{common}") + str(k) for k in range(words)]
            texts += [" ".join(base), " ".join([*base, "after"] if i % 2 else ["before", *base])]
    frequent = [f"all{k}" for k in range(words)]
    texts += [" ".join(frequent), " ".join([*frequent, "all0"])]
    sizes, label, links = components_of(texts, width, percent)
    assert links.count(0) == 0
    got = jaccard_join.similarity_join(texts_table(session, texts), width=width, percent=percent).orderBy("doc_id").collect()
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == label
    assert [r.n_links for r in got] == links


def test_similarity_join_of_nothing(session):
    assert jaccard_join.similarity_join(texts_table(session, [])).collect() == []


def test_disguised_words_are_restored_and_scored(session):
    draw = random.Random(5)
    plain = ["".join(draw.choice(["ba", "lo", "min", "ter", "so"]) for _ in range(3)) for _ in range(40)]
    rows, labels = [], []
    for i in range(400):
        words = [draw.choice(plain) for _ in range(30)]
        if bad := i % 4 == 0:
            words[draw.randrange(30)] = draw.choice(["moron", "stupid"])
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(bad), None if i % 50 == 1 else 1))
    held = [(1000, "balo m0r0n termin", "s"), (1001, "balo s t u p i d termin", "s"), (1002, "stuuuupid", "s"),
            (1003, "balo termin", "s"), (1004, None, "s"), (1005, "", "s"), (1006, "m0 r 2,50 1.5", "s")]
    docs = session.createDataFrame(rows + held, "doc_id long, text string, source string")
    labelled = session.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labelled, fold=None)
    score = {r.doc_id: r.score for r in toxicity.score(docs, model, keep=["doc_id"]).collect()}
    assert all(score[i] > 0.5 for i in (1000, 1001, 1002)) and all(score[i] < 0.3 for i in (1003, 1004, 1005, 1006))
    restored = {r.doc_id: r.restored.split() for r in toxicity.restore(docs, model, keep=["doc_id"]).collect()}
    assert restored[1001] == ["balo", "stupid", "termin"] and restored[1004] == []
    assert toxicity.score(docs.limit(0), model, keep=["doc_id"]).collect() == []
    none = toxicity.train(docs, labelled.where("toxic = 0"), fold=None)
    assert all(r.score < 0.3 for r in toxicity.score(docs, none, keep=["doc_id"]).collect())


def restorer():
    """Reads with the letters of a few words, as often as each would be in many texts."""
    text = "balo stupid termin moron sober idiot lomin ass terso fuck minba " * 200
    s = np.frombuffer(b"\0" + toxicity.folded(text), np.uint8).astype(np.int64)
    code = ((s[:-3] * 27 + s[1:-2]) * 27 + s[2:-1]) * 27 + s[3:]
    codes, counts = np.unique(code, return_counts=True)
    return toxicity.Restorer(toxicity.CharacterModel.of_counts(codes, counts).log_p)


@pytest.mark.parametrize("spaced", [False, True])
def test_readings_are_the_likeliest_of_all(spaced):
    """The search against every way through the lattice."""
    read, draw = restorer(), random.Random(8)
    spans = ["m0r0n", "a$$.", "stuupid!", "f**k", "1diiot", "sstuuupid", "b@l0,", "***", "é11o"]
    spans += ["".join(draw.choice("aabost1!*$.uid") for _ in range(draw.randint(1, 6))) for _ in range(60)]
    for span in spans:
        ways = []
        for way in itertools.product(*toxicity.lattice(span, spaced), [(" ", 0.0)]):
            score, state = sum(cost for _, cost in way), 0
            for c in "".join(meant for meant, _ in way):
                symbol = ord(c) - 96 if c != " " else 0
                if symbol or state % toxicity.SYMBOLS:
                    score += read.log_p[state * toxicity.SYMBOLS + symbol]
                    state = (state * toxicity.SYMBOLS + symbol) % toxicity.CONTEXTS
            ways.append((score, " ".join("".join(meant for meant, _ in way).split())))
        best = max(ways)[0]
        assert read.decode(span, spaced) in {text for score, text in ways if score > best - 1e-9}, span


def test_long_spans_are_read_whole():
    words = ["balo", "stupid", "termin", "moron", "sober", "idiot"] * 4
    assert restorer().restore(" ".join("".join(words)))[0].split() == words
    for pad in range(0, 70, 5):  # a word may stand anywhere
        assert "stupid" in restorer().restore("lomin" * (pad // 5) + "-stup1d-" + "minba" * 20)[0].split()
    # Work grows with the length, not its square.
    assert restorer().restore(" ".join("stupid" * 5000))[0].split() == ["stupid"] * 5000


@pytest.mark.parametrize("disguised, plain", [
    ("m0r0n", "moron"), ("1d10t", "idiot"), ("1d107", "idiot"), ("!diot", "idiot"), ("|diot", "idiot"), ("(1d107)", "idiot"),
    ('"1diot"', "idiot"), ("a$$.", "ass"), ("@$$", "ass"), ("50b3r", "sober"), ("f***k", "fuck"), ("+ermin", "termin"),
    ("stuupid", "stupid"), ("iiddiioott", "idiot"), ("StUuUpiD", "stupid"), ("i  d  i  o  t", "idiot"),
    ("i/d/i/o/t", "idiot"), ("i|d|i|o|t", "idiot"), ("a s s", "ass"), ("(i d i o t)", "idiot"), ("s t u p ! d", "stupid"),
])
def test_disguises_are_undone(disguised, plain):
    if disguised == "f***k":  # three marks for two letters, of which one is no vowel
        assert restorer().restore(disguised)[1]
    else:
        assert toxicity.words_of(restorer().restore(f"balo {disguised} termin")[0]) == [w.encode() for w in ("balo", plain, "termin")]


def test_plain_words_and_numbers_are_left():
    text = "balo! ass, termin 2019 1.5 (12) 3/4 $400 lomin. 1 2 3 4"
    assert restorer().restore(text) == (text, [])


def test_languages(session):
    draw = random.Random(6)
    parts = {"xa": ["the", "ing", "and"], "xb": ["der", "ung", "sch"], "xc": ["ção", "que", "los"]}
    def text(lang):
        return " ".join("".join(draw.choice(parts[lang]) for _ in range(draw.randint(1, 3))) for _ in range(20))
    rows = [(i, text(lang := list(parts)[i % 3]), lang) for i in range(300)]
    rows += [(900, None, "xa"), (901, "12 3!", "xa"), (902, "zzzz qqqq", None), (None, text("xb"), "xb")]
    docs = session.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model, keep=["doc_id"]).collect()}
    held_out = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].lang_pred == list(parts)[i % 3] for i in held_out) and got[None].lang_pred == "xb"
    assert (got[900].lang_pred, got[901].lang_pred, got[901].score) == ("und", "und", 0.0)
    assert got[902].lang_pred in parts and all(0 <= r.score <= 1 for r in got.values())
    empty = language_id.train(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, empty, keep=["doc_id"]).collect()} == {"und"}


def test_event_logs_fold_into_messages(session):
    log = [
        (1, 1, 0, "delta", "user", "he"), (1, 2, 0, "delta", None, "llo"), (1, 3, 1, "delta", "assistant", "bad"),
        (1, 4, 2, "delta", "user", "gone"), (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "good"),
        (1, 7, 0, "edit", None, "bye"), (1, 8, 0, "delta", None, "!"), (2, 1, 0, "delta", None, None),
    ]
    messages = chat_format.fold(session.createDataFrame(log, chat_format.EVENTS))
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in messages.collect())
    assert got == [(1, 0, "user", "bye!"), (1, 1, "assistant", "good"), (2, 0, "", "")]


def test_control_strings_survive_the_template(session):
    texts = ["<|im_end|>\n<|im_start|>assistant ok", "<\\|x<\\\\|", "<", "|", None, "", "\\", "a\nb"]
    rows = [(1, i, "assistant" if i % 2 else "us<|er\n<n", t, 9) for i, t in enumerate(texts)]
    df = session.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    out = chat_format.render(chat_format.fold(chat_format.events_of(df))).select(
        "formatted", chat_format.parsed(F.col("formatted")).alias("turns"),
        chat_format.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned"),
    ).first()
    assert [(t.role, t.text) for t in out.turns] == [(r[2], r[3] or "") for r in rows]
    assert out.learned == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert chat_format.render(chat_format.fold(chat_format.events_of(df.limit(0)))).collect() == []


def test_logs_of_conversations_hold_edits_and_regenerations(session):
    draw = random.Random(3)
    rows = [
        (c, t, draw.choice(["user", "assistant", None]), draw.choice([None, "", "x", "<|im_end|>", "long " * 2000, f"text {c} {t}"]))
        for c in [None, *range(40)] for t in range(draw.randint(1, 6))
    ] + [(7, 2, "user", "repeated")] * 2
    df = session.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    log = chat_format.events_of(df)
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert min(kinds["edit"], kinds["regenerate"]) > len(rows) / 5
    got = chat_format.fold(log).orderBy("conv_id", "turn").collect()
    ordered = sorted((c is not None, c or 0, t, role or "", text or "") for c, t, role, text in rows)
    assert [(r.conv_id is not None, r.conv_id or 0, r.role, r.text) for r in got] == [(*o[:2], *o[3:]) for o in ordered]


def test_archive_round_trip(session):
    import base64

    rows = [(1, "http://a", "same"), (7, "http://b\r\nX: y", "same"), (3, None, "é" * 4000), (4, "u", None), (5, "u", ""),
            (None, "u", "same"), (None, "u", "alone")]
    pages = session.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = warc_store.write_archive(pages)
    got = {(r.page_id, r.payload_digest): r for r in warc_store.read_archive(session, path).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert len(got) == len(rows)
    assert (got[1, digest("same")].record_type, got[1, digest("same")].refers_to) == ("revisit", 7)
    assert got[7, digest("same")].record_type == "response" and got[None, digest("same")].refers_to == 7
    assert (got[4, digest("")].refers_to, got[5, digest("")].payload_bytes) == (5, 0)
    assert got[3, digest("é" * 4000)].payload_bytes == 8000 and got[None, digest("alone")].record_type == "response"
    bodies = [bytes(r.record) for r in warc_store.records(session, path, resolve=True).collect()]
    for _, _, html in rows:
        end = (html or "").encode() + b"\r\n\r\n"
        assert any(b.startswith(b"WARC/1.1\r\n") and b.endswith(b"\r\n\r\n" + end) for b in bodies)
    assert session.read.parquet(f"{path}/payloads").count() == 4
    empty = warc_store.write_archive(pages.limit(0))
    assert warc_store.read_archive(session, empty).collect() == []
    high = warc_store.write_archive(pages, least_bytes=5)
    assert {r.record_type for r in warc_store.read_archive(session, high).where("payload_bytes < 5").collect()} == {"response"}


def test_top_k_equals_brute_force(session, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_TEXTS", 40)
    monkeypatch.setattr(topk_search, "LANES", 2)
    monkeypatch.setattr(topk_search, "LANE_TEXTS", 60)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(topk_search, "BLOCK_TEXTS", 4)
    texts = ODD_TEXTS + near_copies(120, [3, 12, 60])
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    n, mean = len(texts), sum(map(len, words)) / len(texts)
    df = {w: sum(w in set(d) for d in words) for d in words for w in d}
    want = []
    for q in range(0, n, 20):
        scored = []
        for d in range(n):
            if d != q and (both := set(words[q]) & set(words[d])):
                norm = 1.2 * (0.25 + 0.75 * len(words[d]) / mean)
                score = sum(
                    math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * words[d].count(w) * 2.2 / (words[d].count(w) + norm)
                    for w in both
                )
                scored.append((-round(score, 9), d))
        want += [(q, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:10])]
    got = topk_search.search(texts_table(session, texts)).collect()
    assert sorted((r.query_id, r.rank, r.doc_id, r.score) for r in got) == want
    assert topk_search.search(texts_table(session, [])).collect() == []


def test_top_k_deals_texts_once_whatever_the_number_of_blocks(session, monkeypatch):
    table = texts_table(session, near_copies(120, [3, 12, 60]))
    frame, dealt, found = type(table), [], []

    def counted(df, *args):
        dealt.append(df.count())
        return deal(df, *args)

    deal = frame.repartitionById
    monkeypatch.setattr(frame, "repartitionById", counted)
    for block in (2, 100):
        monkeypatch.setattr(topk_search, "BLOCK_QUERIES", block)
        found.append(sorted(map(tuple, topk_search.search(table).collect())))
    assert dealt == [table.count()] * 2
    monkeypatch.setattr(topk_search, "BLOCK_WORDS", 50)
    found.append(sorted(map(tuple, topk_search.search(table).collect())))
    assert found[0] and found[0] == found[1] == found[2]


def test_top_k_of_null_and_repeated_ids(session):
    rows = [(0, "a b c x"), (0, "a d d e"), (1, "a b"), (1, "a b"), (2, "d e"), (3, ""), (4, None), (None, "a b c"), (5, "c " * 9000)]
    words, n = [(t or "").split() for i, t in rows if i is not None], 8
    mean = sum(map(len, words)) / n
    asked, want = {"a", "b", "c", "d", "e", "x"}, []
    for doc, own in zip([i for i, _ in rows if i is not None], words):
        score = sum(
            math.log(1 + (n - df + 0.5) / (df + 0.5)) * own.count(w) * 2.2
            / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / mean))
            for w in asked & set(own) if (df := sum(w in d for d in words))
        )
        want += [(-round(score, 9), doc)] if doc and own else []
    got = topk_search.search(session.createDataFrame(rows, "doc_id long, text string")).orderBy("rank").collect()
    assert [(-r.score, r.doc_id) for r in got] == sorted(want) and {r.query_id for r in got} == {0}


def test_blocks_out_of_reach_are_passed_over():
    draw = np.random.default_rng(8)
    n, vocabulary, k = 4000, 400, 10
    # Four kinds of texts, each with common words of its own.
    kind = draw.integers(0, 4, n)
    sets = [np.unique(draw.zipf(1.3, 60) % 100 + 100 * c) for c in kind]
    sizes, words = np.array([len(x) for x in sets]), np.concatenate(sets).astype(np.int64)
    tf, lengths = draw.integers(1, 4, len(words)), sizes * 2
    idf = np.log(1 + n / np.bincount(words, minlength=vocabulary).clip(1))
    ends = np.cumsum(sizes)
    asked = topk_search.Asked(np.arange(n)[:200], sizes[:200], words[: ends[199]], idf[words[: ends[199]]], k)
    evaluated = blocks = 0
    for a, b in ((0, 2000), (2000, 4000)):
        part = slice(ends[a] - sizes[a], ends[b - 1])
        shard = topk_search.Shard(
            np.arange(a, b), lengths[a:b], words[part], tf[part], sizes[a:b], lengths.mean(), asked, block=32
        )
        evaluated, blocks = evaluated + shard.search(), blocks + 200 * shard.blocks
    impact = np.zeros((n, vocabulary))
    norm = 1.2 * (0.25 + 0.75 * np.repeat(lengths, sizes) / lengths.mean())
    impact[np.repeat(np.arange(n), sizes), words] = tf * 2.2 / (tf + norm)
    for place, query in enumerate(asked.ids):
        score = np.round(impact @ np.where(impact[query] > 0, idf, 0), 9)
        score[query] = 0
        best = np.lexsort((np.arange(n), -score))[:k]
        assert np.allclose(asked.best[place], score[best], atol=2e-9)
        assert (score[asked.best_ids[place]] >= score[best[-1]] - 2e-9).all()
    assert evaluated < 0.5 * blocks


@pytest.mark.parametrize("dimension", [64, 256, 768])
def test_recall_of_the_default_radius(session, dimension):
    draw = np.random.default_rng(dimension)
    centres = draw.normal(size=(40, dimension))
    vectors = (centres[draw.integers(0, 40, 1500)] + 0.7 * draw.normal(size=(1500, dimension))).astype(np.float32)
    df = session.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = vector_search.nearest(df, every=100, k=10).collect()
    wide = vectors.astype(float)
    hits = 0
    for q in range(0, 1500, 100):
        distance = ((wide - wide[q]) ** 2).sum(1)
        best = [i for i in np.argsort(distance, kind="stable") if i != q][:10]
        hits += len({r.vec_id for r in got if r.query_id == q} & set(best))
    assert hits >= 0.9 * 150


def test_nearest_vectors(session):
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(1200, 32))
    vectors[300:330] = vectors[7]
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)]
    bad = [(5000, None, 0), (5100, [0.0] * 32, 0), (5200, [float("nan")] * 32, 0), (5300, [1.0, None] * 16, 0), (5400, [1.0], 0), (None, [1.0] * 32, 0)]
    df = session.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int")
    got = vector_search.nearest(df, every=100, k=10).collect()
    hits = 0
    for q in range(0, 1200, 100):
        distance = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(1200), distance)) if i != q][:10]
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(r.score == distance[r.vec_id] for r in own)
        hits += len({r.vec_id for r in own} & set(best))
    assert hits >= 0.9 * 120 and {r.query_id for r in got} == set(range(0, 1200, 100))
    few = vector_search.nearest(df.where("vec_id < 4"), every=100, k=10).collect()
    assert len(few) == 3 and vector_search.nearest(df.limit(0)).collect() == []


def filled(sizes, share=1.5, most=2.0):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        target = {s: most * sizes[s] for s in capped} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_of_rows_without_ids_and_with_any_column_names(session):
    draw = random.Random(12)
    rows = [
        (None if i % 2 else i % 40, " ".join(["w"] * draw.randint(1, 60)) + f" {i}", draw.choice("aabbbbc"), i, i, i, {"k": "v"})
        for i in range(3000)
    ]
    df = session.createDataFrame(
        rows, "doc_id long, text string, source string, mix int, `_shard` int, `a.b` int, row map<string,string>"
    )
    planned = source_mix.plan(df)
    assert planned.count() == 3
    mixed = source_mix.mix(df, planned)
    got = mixed.select("row.source", "row.mix", "mix.target", "mix.taken", "mix.copies").collect()
    assert sorted(r.mix for r in got) == list(range(3000))
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 62, source
    out = source_mix.drawn(mixed)
    assert out.count() == sum(r.copies for r in got)
    assert out.select("row.*").columns == df.columns


def test_mix_reaches_targets(session):
    draw = random.Random(8)
    rows = [(i, "w " * draw.randint(0, 60), draw.choice(["a", "b", "b", "b", "c", None])) for i in range(900)] + [(None, "x y", "a"), (3, None, "c")]
    df = session.createDataFrame(rows, "doc_id long, text string, source string")
    plan = source_mix.plan(df)
    got = source_mix.mix(df, plan).select("row.doc_id", "row.source", "mix.*").collect()
    again = source_mix.mix(df, source_mix.plan(df)).select("row.doc_id", "row.source", "mix.*").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] and len(r.shards) == r.copies
    target = filled(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
    assert all(abs(taken[s] - target[s]) <= 30 for s in sizes)
    assert source_mix.drawn(source_mix.mix(df, plan)).count() == sum(r.copies for r in got)
    assert source_mix.mix(df.limit(0), source_mix.plan(df.limit(0))).collect() == []
    blank = df.withColumn("text", F.lit(""))
    assert {r.taken for r in source_mix.mix(blank, source_mix.plan(blank)).select("mix.*").collect()} == {0}


def test_quotas_are_split_exactly(session):
    quotas = [400, 0, 37, 263]
    df = session.createDataFrame([(quotas,)], "counts array<long>")
    got = {r.shard: r.counts for r in source_mix.split_quotas(df, 5).collect()}
    assert sorted(got) == list(range(5)) and [sum(c) for c in zip(*got.values())] == quotas
    assert all(abs(sum(c) - 140) <= 2 for c in got.values())
