"""Merkle manifest, whitening and language-model scores against brute force."""

import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapdelta.llm import embedding_whitening, lm_scoring, merkle_manifest
from snapdelta.llm.registry import make_importable, oracle_sql, queries


@pytest.fixture(scope="module")
def session(spark):
    make_importable(spark)
    return spark


# Merkle manifest


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf_of(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def proofs_of(nodes, fanout):
    """Root, and per node the digests beside its path, level by level."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            first = i // fanout * fanout
            path.append(("".join(level[first:i]), "".join(level[i + 1:first + fanout])))
            i //= fanout
        paths.append(path)
    return levels[-1][0], paths


def manifest_of(rows, fanout):
    """Sorted ``(id, leaf, steps, subroot, root)``."""
    by_group = {}
    for row in rows:
        by_group.setdefault(row[1], []).append((row[0], leaf_of(*row)))
    order = sorted(by_group, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        leaves = sorted(by_group[g], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = leaves, *proofs_of([leaf for _, leaf in leaves], fanout)
    root, tops = proofs_of([trees[g][1] for g in order], fanout) if order else (None, [])
    return sorted(
        (
            (id, leaf, path + top, trees[g][1], root)
            for g, top in zip(order, tops)
            for (id, leaf), path in zip(trees[g][0], trees[g][2])
        ),
        key=str,
    )


@pytest.mark.parametrize("fanout, levels, digits", [(2, 3, 3), (2, 1, 2), (2, 2, 1), (3, 1, 2)])
def test_manifest_equals_brute_force(session, monkeypatch, fanout, levels, digits):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "DIGITS", digits)
    draw = random.Random(fanout)
    groups = [("en", 75), (None, 9), ("", 1), ("é", 2), ("de", 16), ("EN", 5), ("fr", 17)]
    rows = [(i, g, draw.choice([None, "", "text", "é" * 3, "x" * 20_000])) for g, n in groups for i in range(n)]
    rows += [(None, "en", "a"), (None, "en", "b"), (3, "en", "same id"), (3, "en", "same id"), (-5, "fr", None)]
    draw.shuffle(rows)
    df = session.createDataFrame(
        [(*r, "x", r[0]) for r in rows], "doc_id long, lang string, text string, leaf string, rank long"
    ).repartition(5)
    found = merkle_manifest.manifest(df, ["doc_id", "lang", "text"], fanout=fanout)
    got = [
        (r.doc_id, r.leaf, [(s.before, s.after) for s in r.steps], r.subroot, r.root) for r in found.collect()
    ]
    assert sorted(got, key=str) == manifest_of(rows, fanout)
    assert found.where(merkle_manifest.folded(F.col("leaf"), F.col("steps")) != F.col("root")).count() == 0
    for wrong in ("lit", "steps"):
        leaf = F.lit(sha("other")) if wrong == "lit" else F.col("leaf")
        steps = F.col("steps") if wrong == "lit" else F.reverse("steps")
        assert found.where(merkle_manifest.folded(leaf, steps) != F.col("root")).count() > 0


def test_manifest_of_nothing_and_plan(session):
    df = session.createDataFrame([], "doc_id long, lang string, text string")
    assert merkle_manifest.manifest(df, ["doc_id", "text"]).collect() == []
    one = session.createDataFrame([(1, "en", "a")], "doc_id long, lang string, text string")
    only = merkle_manifest.manifest(one, ["doc_id", "lang", "text"])
    row = only.first()
    assert row.leaf == row.subroot == row.root and row.steps == []
    assert "Join" not in only._jdf.queryExecution().optimizedPlan().toString()


def test_manifest_digests(session, small_sf):
    """The registered query against brute force, tampering included."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = [tuple(r) for r in session.read.parquet(f"{small_sf}/documents.parquet").select(*columns).collect()]
    by_lang = {}
    for r in sorted(rows):
        by_lang.setdefault(r[2], []).append(r)
    order = sorted(by_lang)
    subroots = {lang: proofs_of([leaf_of(*r) for r in by_lang[lang]], 2) for lang in order}
    root, tops = proofs_of([subroots[lang][0] for lang in order], 2)
    expected = {}
    for lang, top in zip(order, tops):
        for r, path in zip(by_lang[lang], subroots[lang][1]):
            changed = zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(*r[:3], r[3] + changed, r[4])
            for before, after in path + top:
                node = sha(before, node, after)
            beside = sha("".join(b + a for b, a in path + top))
            expected[r[0]] = (leaf_of(*r), subroots[lang][0], root, beside, node, node == root)
    got = queries()["op11_merkle_manifest"](session, small_sf).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected
    assert 0 < sum(not v[-1] for v in expected.values()) < len(expected) / 3
    assert "op11_merkle_manifest" in oracle_sql()


# Whitening


def whole(c):
    return math.floor(64 * c) + 1_000_000


def exact_covariance(vectors):
    n, d = len(vectors), len(vectors[0])
    sums = [sum(v[i] for v in vectors) for i in range(d)]
    return sums, [
        [Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in vectors), n**3) for j in range(d)]
        for i in range(d)
    ]


def whitened_by(session, vectors, components=16, kind="float"):
    rows = [(i, v, "x", 0.5) for i, v in enumerate(vectors)]
    df = session.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, x string, whitened double")
    return embedding_whitening.whiten(df.repartition(3), components).orderBy("vec_id", "component").collect()


def check_whitening(got, vectors, components):
    kept = {
        i: tuple(whole(c) for c in v) for i, v in enumerate(vectors)
        if v and all(c is not None and math.isfinite(c) for c in v)
    }
    fit = sorted(set(kept.values()))
    n, d = len(fit), len(fit[0])
    sums, matrix = exact_covariance(fit)
    assert [(r.vec_id, r.component) for r in got] == [(i, k + 1) for i in kept for k in range(min(d, components))]
    plain = np.array([[float(v) for v in row] for row in matrix])
    values = np.linalg.eigvalsh(plain)[::-1]
    z = {}
    for r in got:
        assert r.n == n
        assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(kept[r.vec_id], sums))
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9, abs=1e-13)
        assert r.identity_error < 1e-9
        z.setdefault(kept[r.vec_id], {})[r.component] = r.whitened
    table = np.array([[z[v][k + 1] for k in range(min(d, components))] for v in fit], float)
    held = ~np.isnan(table[0])
    assert held.tolist() == [v > 1e-12 * values[0] for v in values[:components]]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    found = table[:, held]
    assert found.T @ found / n == pytest.approx(np.eye(held.sum()), abs=1e-9)
    # Each whitened column is the projection on an eigenvector: V^-1-images of the data's covariance with it.
    axes = centred.T @ found / n
    roots = np.sqrt(values[:components][held])
    assert plain @ (axes / roots) == pytest.approx((axes / roots) * values[:components][held], rel=1e-9, abs=1e-9 * values[0])
    assert centred @ (axes / roots) / roots == pytest.approx(found, rel=1e-8, abs=1e-9)


def test_whitening_equals_brute_force(session):
    draw = np.random.default_rng(5)
    vectors = (draw.normal(size=(300, 20)) * np.geomspace(30, 0.5, 20) + draw.normal(size=20)).astype(np.float32)
    vectors = [[float(c) for c in v] for v in vectors]
    vectors += vectors[:100]  # repeats are fitted once
    vectors += [None, [], [None] * 20, [math.nan] + [1.0] * 19, [math.inf] + [1.0] * 19]
    check_whitening(whitened_by(session, vectors), [v or [] for v in vectors], 16)


def test_whitening_of_clustered_eigenvalues(session):
    """Equal and nearly equal variances, one dimension without any, fewer dimensions than components."""
    vectors = []
    for i in range(6):
        for sign in (1, -1):
            for size in (1.0, 3.0):
                v = [0.0] * 8
                v[i] = sign * size * (1 + (i == 5) / 64)
                vectors.append(v)
    check_whitening(whitened_by(session, vectors, kind="double"), vectors, 16)


def test_eigenvectors_reach_extended_precision():
    draw = np.random.default_rng(2)
    base, _ = np.linalg.qr(draw.normal(size=(24, 24)))
    values = np.array([5.0] * 4 + [5.0 + 1e-9, 3, 3 + 1e-12, 2] + [1.0] * 6 + [1e-6 * i for i in range(10)])
    plain = (base * values) @ base.T
    matrix = [[Fraction(float(v)) for v in row] for row in (plain + plain.T) / 2]
    found, vectors = embedding_whitening.eigen(matrix)
    exact = np.array(matrix, float).astype(np.longdouble)
    assert np.abs(vectors.T @ vectors - np.eye(24)).max() < 1e-17
    assert np.abs(exact @ vectors - vectors * found).max() < 1e-16
    assert np.all(np.diff(found) <= 0)


def test_whitening_odd_tables(session):
    schema = "vec_id long, embedding array<float>"
    assert embedding_whitening.whiten(session.createDataFrame([], schema)).collect() == []
    assert embedding_whitening.whiten(session.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    alone = embedding_whitening.whiten(session.createDataFrame([(None, [1.0, 2.0])] * 2, schema)).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in alone] == 2 * [
        (None, 1, 1, 0, None, None), (None, 2, 1, 0, None, None),
    ]
    with pytest.raises(ValueError, match="between 1 and 2"):
        embedding_whitening.whiten(session.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], schema))
    huge = session.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])], schema)
    found = embedding_whitening.whiten(huge).collect()
    assert {r.deviation for r in found} == {None, 50_000_000} or len(found) == 6
    assert max(r.identity_error for r in found) < 1e-4


def test_exact_products():
    for top in (300, 1 << 24, 1 << 40):
        y = np.random.default_rng(0).integers(-top, top, (50, 4))
        assert embedding_whitening._exact_products(y).tolist() == [
            sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for i in range(4) for j in range(i, 4)
        ]


# Language-model scores


def tokens_of(text):
    return [*(text or "").encode().lower().split(), 2]


def scores_of(rows, order, rounds):
    """``rows``: text and kind. The model in dictionaries."""
    texts = [([0] * order + tokens_of(t), kind) for t, kind in rows]
    counts = {lm_scoring.MAIN: Counter(), lm_scoring.TUNING: Counter()}
    for stream, kind in texts:
        if kind in counts:
            for i in range(order - 1, len(stream)):
                for k in range(1, order + 1):
                    counts[kind][tuple(stream[i - k + 1:i + 1])] += 1
    whole_counts = counts[lm_scoring.MAIN] + counts[lm_scoring.TUNING]

    def words(c):
        return sum(n for g, n in c.items() if len(g) == 1 and g != (0,))

    n_words = sum(1 for g in whole_counts if len(g) == 1 and g != (0,))
    uniform = 1 / (n_words + 1)

    def estimates(c, n, stream, i):
        bucket, made = 0, [uniform]
        for k in range(1, order + 1):
            gram = tuple(stream[i - k + 1:i + 1])
            context = c[gram[:-1]] if k > 1 else n
            made.append(c[gram] / context if context else 0)
            if k > 1 and context:
                bucket = (k - 1) * 40 + min(int(math.log2(context)), 39)
        return bucket, made

    held = [
        estimates(counts[lm_scoring.MAIN], words(counts[lm_scoring.MAIN]), stream, i)
        for stream, kind in texts if kind == lm_scoring.TUNING for i in range(order, len(stream))
    ]
    start = {b: [1 / (2 + b // 40)] * (2 + b // 40) + [0] * (order - 1 - b // 40) for b in range(order * 40)}
    weights, before = dict(start), -math.inf
    for _ in range(rounds):
        sums, logs = {b: list(w) for b, w in start.items()}, 0
        for b, p in held:
            shares = [w * x for w, x in zip(weights[b], p)]
            logs += math.log10(sum(shares))
            for k, s in enumerate(shares):
                sums[b][k] += s / sum(shares)
        weights = {b: [x / sum(s) for x in s] for b, s in sums.items()}
        if logs - before < 1e-6 * abs(logs):
            break
        before = logs
    n = words(whole_counts)
    made = []
    for stream, _ in texts:
        places = range(order, len(stream))
        found = [estimates(whole_counts, n, stream, i) for i in places]
        known = [whole_counts[(stream[i],)] for i in places]
        made.append((
            len(places), sum(c > 0 for c in known),
            sum(math.log10((c + 0.1) / (n + 0.1 * (n_words + 1))) for c in known),
            sum(math.log10(sum(w * x for w, x in zip(weights[b], p))) for b, p in found),
        ))
    return made, n


def scored(session, rows, order, rounds=25, partitions=4):
    df = session.createDataFrame(
        [(i, t, k, "x", 1) for i, (t, k) in enumerate(rows)], "doc_id long, text string, kind int, unit string, row int"
    ).repartition(partitions)
    trained = lm_scoring.train(
        df, F.col("kind") != lm_scoring.OTHER, F.col("kind") == lm_scoring.TUNING, ["doc_id", "unit"], order=order, rounds=rounds
    )
    return trained.model, lm_scoring.score(trained).orderBy("doc_id").collect()


def sample_texts(n, seed=4):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "A", "a", "!", "x y", "😀"]
    made = [None, "", " \t\n", "a A\x0b\x0ca", "long " * 3000]
    for _ in range(n):
        at, text = draw.randrange(60), []
        for _ in range(draw.randrange(1, 40)):
            at = (at * 7 + draw.choice([1, 1, 1, 2, 9])) % len(words)
            text.append(words[at])
        made.append(draw.choice([" ", "\n", "  "]).join(text))
    return made + made[5:25]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(session, monkeypatch, order):
    monkeypatch.setattr(lm_scoring, "UNIT_TOKENS", 700)
    monkeypatch.setattr(lm_scoring, "BUCKET_KEYS", 2000)
    draw = random.Random(order)
    rows = [(t, draw.choice([0, 1, 1, 1, 1, 2])) for t in sample_texts(150)]
    expected, n = scores_of(rows, order, 25)
    model, got = scored(session, rows, order)
    assert model.n_tokens == n
    assert [(r.n_tokens, r.n_known) for r in got] == [e[:2] for e in expected]
    assert [r.unit for r in got] == ["x"] * len(rows)
    assert [r.base_score for r in got] == pytest.approx([e[2] for e in expected], rel=1e-12)
    assert [r.score for r in got] == pytest.approx([e[3] for e in expected], rel=1e-5)
    assert np.allclose(model.weights.sum(axis=1), 1) and (model.weights[:, :2] > 0).all()


def test_scores_beat_the_base_on_held_out_texts(session, small_sf):
    got = queries()["op13_lm_scoring"](session, small_sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) > len(held) > 0
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)
    assert len({r.train_tokens for r in got}) == 1


def test_scores_without_training_or_rows(session):
    _, got = scored(session, [("a b", 0), (None, 0)], 3)
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in got] == [(3, 0, 0, 0), (1, 0, 0, 0)]
    assert scored(session, [], 2)[1] == []
    _, got = scored(session, [("a b", 2), ("a b", 2)], 2)  # nothing but tuning texts
    assert all(r.score < 0 for r in got)


def test_packing():
    for values in ([], [0], [5, 1 << 55, (1 << 64) - 1]):
        values = np.array(values, np.uint64)
        assert lm_scoring.unpack(lm_scoring.pack(values)).tolist() == values.tolist()
        assert lm_scoring.unpack_sorted(lm_scoring.pack_sorted(values)).tolist() == values.tolist()


def test_a_bucket_is_summed_in_little_memory():
    class Asked:
        def groupBy(self, *keys):
            return self

        def applyInArrow(self, run, schema):
            return run

    units, n = 8, 50_000
    keys = [np.arange(u, u + 3 * n, 3).astype(np.uint64) << np.uint64(20) for u in range(units)]
    asked = pa.table(
        {
            "size": pa.array([2] * units, pa.int32()), "bucket": pa.array([0] * units, pa.int32()),
            "unit": pa.array(range(units), pa.int64()), "tuning": pa.array([u == 0 for u in range(units)]),
            "keys": pa.array([lm_scoring.pack_sorted(k) for k in keys], pa.binary()),
            "counts": pa.array([lm_scoring.pack(np.ones(n, np.uint64)) for _ in keys], pa.binary()),
        }
    )
    tracemalloc.start()
    answers = lm_scoring._answers(Asked())(asked)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Units 1, 4 and 7 share the middle of their keys; unit 0 asks but does not count here.
    assert lm_scoring.unpack(answers["main"][4].as_py())[n // 2] == 3
    assert lm_scoring.unpack(answers["tuned"][3].as_py())[n // 2] == 1
    assert peak < 65 * units * n
