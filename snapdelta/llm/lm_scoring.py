"""Language-model scores by deleted interpolation.

A text is lower-cased (A-Z) and split at ASCII white space; one end token closes it. Its
probability is a product over its tokens of::

    P(w | h) = sum over k of  weight[b, k] * p_k(w | last k - 1 tokens of h)

where ``p_k`` is the maximum-likelihood estimate from n-gram counts, ``p_0`` is
``1 / (V + 1)``, and ``b`` is the bucket of the context: how many of its last tokens were
seen together in training, and the power of two below that context's count. The weights of
each bucket are learned by expectation-maximisation on a held-out share of the training
texts with the counts of the other training texts; the scores use the counts of all.

Work at scale: texts are packed into *units* of about ``UNIT_TOKENS`` tokens, stored once.
A unit sends each of its distinct n-grams once, as a hash with a count, to the bucket of
that hash; the bucket sums the counts of all units and answers every unit in the order it
asked. An n-gram that holds a third of all tokens so arrives once per unit, and no table
of counts is ever broadcast or collected: the driver sees the number of words and tokens
and the weights. Units, answers and the held-out estimates are tables in the shared folder.

Defined cases: a null text is empty; it is scored as its end token. A null id trains.
Repeated rows count and are scored each. Without training texts both scores are 0, as the
end token is the only class. A bucket that no held-out token falls into weighs its
estimates equally. A text of any length is scored whole; one text is always in one unit,
so a task's memory follows the larger of a unit and the longest text. Columns but the
named are ignored. Words and n-grams are told apart by hashes of 56 bits: of a million
million n-grams about one in 70 thousand shares its count with another.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapdelta.llm.arrow_tasks import release, small_batches
from snapdelta.sources.shared_storage import stored

UNIT_TOKENS = 900_000
BUCKET_KEYS = 2_000_000
KEY_BITS = 56
COUNT_CLASSES = 40
_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_START, _END = np.uint64(0x1234567), np.uint64(0x89ABCDF)

OTHER, MAIN, TUNING = 0, 1, 2


def pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class _Numbers(dict):
    """Numbers words as they turn up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _OpenUnit:
    def __init__(self) -> None:
        self.numbers, self.rows, self.kinds, self.ids, self.tokens = _Numbers(), [], [], [], 0

    def add(self, row: pa.Array, kind: int, text: bytes) -> None:
        words = text.lower().split()  # both look at ASCII only
        self.ids.append(np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words)))
        self.rows.append(row)
        self.kinds.append(kind)
        self.tokens += len(words) + 1

    def columns(self) -> list[pa.Array]:
        flat = np.concatenate([*self.ids, np.zeros(0, np.int64)])
        order = np.argsort(-np.bincount(flat, minlength=len(self.numbers)), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        words = list(self.numbers)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(words[i]) for i in order), np.uint64, len(words))
        rows = pa.concat_arrays(self.rows)
        lengths, kinds = np.array([len(i) for i in self.ids]), np.array(self.kinds)
        trained = int(((lengths + 1) * (kinds != OTHER)).sum())
        return [
            pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
            pa.array([kinds.astype(np.uint8).tobytes()], pa.binary()), pa.array([pack(lengths)], pa.binary()),
            pa.array([pack(place[flat])], pa.binary()), pa.array([hashes.tobytes()], pa.binary()),
            pa.array([self.tokens], pa.int64()), pa.array([trained], pa.int64()),
        ]


def _units(docs: DataFrame, text_col: str, kind: Column, keep: Iterable[str]) -> DataFrame:
    """One row per unit; texts of the tuning share are in units of their own."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), kind.alias("kind"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    schema = T.StructType().add("unit", "long").add("tuning", "boolean")
    schema.add("rows", T.ArrayType(rows.schema["row"].dataType))
    for name in ("kinds", "lengths", "ids", "words"):
        schema.add(name, "binary")
    schema.add("n_tokens", "long").add("n_trained", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 24, 0
        units = {False: _OpenUnit(), True: _OpenUnit()}

        def closed(tuning: bool) -> pa.RecordBatch:
            columns = [pa.array([first + made], pa.int64()), pa.array([tuning]), *units[tuning].columns()]
            units[tuning] = _OpenUnit()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in (small for whole in batches for small in small_batches(whole)):
            for i, (kind, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                tuning = kind == TUNING
                units[tuning].add(batch.column(0).slice(i, 1), kind, text)
                if units[tuning].tokens >= UNIT_TOKENS:
                    yield closed(tuning)
                    made += 1
        for tuning in (False, True):
            if units[tuning].rows:
                yield closed(tuning)
                made += 1
        units = batch = text = None
        release()

    return rows.mapInArrow(run, schema)


class _Grams:
    """The n-grams of a unit.

    Every text is a run of ``order`` start marks, its words and the end. The last start
    mark counts as a place too, so that it has a count as a context.
    """

    def __init__(self, order: int, kinds: bytes, lengths: bytes, ids: bytes, words: bytes):
        self.kinds, lengths = np.frombuffer(kinds, np.uint8), unpack(lengths).astype(np.int64)
        hashes = np.concatenate([np.frombuffer(words, np.uint64), [_START, _END]])
        spans = lengths + order + 1
        ends = np.cumsum(spans)
        stream = np.full(int(spans.sum()), len(hashes) - 2, np.int32)
        inside = np.ones(len(stream), bool)
        starts = ends - spans
        for k in range(order):
            inside[starts + k] = False
        inside[ends - 1] = False
        stream[inside] = unpack(ids).astype(np.int32)
        stream[ends - 1] = len(hashes) - 1
        placed = np.ones(len(stream), bool)
        for k in range(order - 1):
            placed[starts + k] = False
        # Among the places, the first of each text is its start mark.
        self.n_places = lengths + 2
        self.is_token = np.ones(int(self.n_places.sum()), bool)
        self.is_token[np.cumsum(self.n_places) - self.n_places] = False
        self.trains = np.repeat(np.isin(self.kinds, (MAIN, TUNING)), self.n_places)
        self.keys, self.at = [], []
        value = np.zeros(len(stream), np.uint64)
        for k in range(order):
            value[1:] = value[:-1] * _FACTOR
            value[0] = 0
            value += hashes[stream]
            distinct, at = np.unique(_key(value[placed], k), return_inverse=True)
            self.keys.append(distinct)
            self.at.append(at.astype(np.int32))

    def counts(self, k: int) -> np.ndarray:
        return np.bincount(self.at[k], weights=self.trains, minlength=len(self.keys[k])).astype(np.uint64)


def _key(values: np.ndarray, k: int) -> np.ndarray:
    mixed = (values + np.full(1, k + 1, np.uint64) * _SPREAD) * _SPREAD
    mixed ^= mixed >> np.uint64(32)
    mixed *= _FACTOR
    mixed ^= mixed >> np.uint64(29)
    return mixed >> np.uint64(64 - KEY_BITS)


_START_KEY = _key(np.array([_START]), 0)[0]


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among the sorted keys."""
    bounds = np.array([((b << KEY_BITS) + buckets - 1) // buckets for b in range(buckets)], np.uint64)
    return np.concatenate([np.searchsorted(keys, bounds), [len(keys)]])


def _grams_of(order: int, batch, i: int) -> _Grams:
    return _Grams(order, *[batch.column(c)[i].as_py() for c in ("kinds", "lengths", "ids", "words")])


def _asked(units: DataFrame, order: int, buckets: int) -> DataFrame:
    """Rows ``size, bucket, unit, tuning, keys, counts``: the distinct n-grams of each unit."""
    names = ["size", "bucket", "unit", "tuning", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                grams = _grams_of(order, batch, i)
                for k in range(order):
                    cuts, counts = _cuts(grams.keys[k], buckets), grams.counts(k)
                    full = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k] * len(full), pa.int32()), pa.array(full, pa.int32()),
                            pa.array([batch.column("unit")[i].as_py()] * len(full), pa.int64()),
                            pa.array([batch.column("tuning")[i].as_py()] * len(full), pa.bool_()),
                            pa.array([pack_sorted(grams.keys[k][cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
                            pa.array([pack(counts[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
                        ],
                        names=names,
                    )
        grams = counts = None
        release()

    needed = units.select("unit", "tuning", "kinds", "lengths", "ids", "words")
    return needed.mapInArrow(run, "size int, bucket int, unit long, tuning boolean, keys binary, counts binary")


def _answers(asked: DataFrame) -> DataFrame:
    """The sums over all units, for each unit in its own order; ``n_words`` counts known words."""

    def summed(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x.as_py()) for x in table.column("keys")]
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        distinct, at = np.unique(keys, return_inverse=True)
        del keys
        at = at.astype(np.int32)
        tuning = np.repeat(table.column("tuning").to_numpy(), sizes)
        counts = np.concatenate([unpack(x.as_py()) for x in table.column("counts")]).astype(np.float64)
        main = np.bincount(at, weights=counts * ~tuning, minlength=len(distinct)).astype(np.uint64)
        tuned = np.bincount(at, weights=counts * tuning, minlength=len(distinct)).astype(np.uint64)
        del counts
        is_word = (main + tuned > 0) & (distinct != _START_KEY) & (table.column("size")[0].as_py() == 0)
        ends = np.cumsum(sizes)
        mine = [at[e - n:e] for n, e in zip(sizes, ends)]
        return pa.table(
            {
                "unit": table.column("unit"), "tuning": table.column("tuning"), "size": table.column("size"),
                "bucket": table.column("bucket"),
                "main": pa.array([pack(main[m]) for m in mine], pa.binary()),
                "tuned": pa.array([pack(tuned[m]) for m in mine], pa.binary()),
                "n_words": pa.array([int(is_word.sum()) if i == 0 else 0 for i in range(len(mine))], pa.int64()),
            }
        )

    def run(table: pa.Table) -> pa.Table:
        made = summed(table)
        release()
        return made

    return asked.groupBy("size", "bucket").applyInArrow(
        run, "unit long, tuning boolean, size int, bucket int, main binary, tuned binary, n_words long"
    )


class _Counts:
    """Counts of every place's n-gram and of its context, by length of the n-gram."""

    def __init__(self, grams: _Grams, answers: pa.Table, with_tuning: bool, n_tokens: int):
        rows = sorted(zip(*[answers.column(c).to_pylist() for c in ("size", "bucket", "main", "tuned")]))
        self.of, self.context = [], []
        for k, at in enumerate(grams.at):
            total = np.concatenate([np.zeros(0, np.uint64), *[unpack(r[2]) for r in rows if r[0] == k]])
            if with_tuning:
                total = total + np.concatenate([np.zeros(0, np.uint64), *[unpack(r[3]) for r in rows if r[0] == k]])
            if len(total) != len(grams.keys[k]):
                raise ValueError("answers do not fit the unit")
            placed = total[at].astype(np.float64)
            self.context.append(np.full(len(at), float(n_tokens)) if k == 0 else self._before(self.of[-1]))
            self.of.append(placed)
        self.tokens = grams.is_token

    @staticmethod
    def _before(counts: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1), counts[:-1]])

    def estimates(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Per token: the bucket of its context, and the estimates of all lengths."""
        shown = np.zeros(len(self.tokens), np.int64)
        probabilities = []
        for k, (count, context) in enumerate(zip(self.of, self.context)):
            seen = context > 0
            probabilities.append(np.divide(count, context, out=np.zeros_like(count), where=seen)[self.tokens])
            if k:
                level = np.minimum(np.frexp(context)[1] - 1, COUNT_CLASSES - 1)
                shown = np.where(seen, k * COUNT_CLASSES + level, shown)
        return shown[self.tokens], probabilities


@dataclass(frozen=True)
class Model:
    """``weights[b, k]``: the weight of the estimate from n-grams of k tokens in bucket b."""

    order: int
    n_tokens: int
    n_words: int
    weights: np.ndarray


@dataclass(frozen=True)
class Trained:
    model: Model
    units: DataFrame
    answers: DataFrame
    keep: list[str]


def _start_weights(order: int) -> np.ndarray:
    weights = np.zeros((order * COUNT_CLASSES, order + 1))
    for b in range(len(weights)):
        usable = 2 + b // COUNT_CLASSES
        weights[b, :usable] = 1 / usable
    return weights


def _learned_weights(parts: DataFrame, order: int, uniform: float, rounds: int) -> np.ndarray:
    """Expectation-maximisation; each round is one pass over the stored estimates.

    One pseudo-token per bucket, shared equally, keeps every weight above zero.
    """
    prior = weights = _start_weights(order)
    before = -math.inf
    for _ in range(rounds):
        def expected(batches: Iterator[pa.RecordBatch], weights=weights) -> Iterator[pa.RecordBatch]:
            sums, logs = np.zeros_like(weights), 0.0
            for batch in batches:
                for b, p in zip(batch.column("buckets").to_pylist(), batch.column("estimates").to_pylist()):
                    bucket = np.frombuffer(b, np.uint16)
                    values = np.frombuffer(p, np.float32).reshape(order, -1)
                    shares = weights[bucket].T * np.vstack([np.full(len(bucket), uniform), values])
                    whole = shares.sum(axis=0)
                    logs += float(np.log10(whole).sum())
                    for k in range(order + 1):
                        sums[:, k] += np.bincount(bucket, weights=shares[k] / whole, minlength=len(sums))
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *at.tolist()], pa.int64()), pa.array([logs, *sums.ravel()[at].tolist()], pa.float64())],
                names=["place", "value"],
            )

        found = parts.mapInArrow(expected, "place long, value double").groupBy("place").agg(F.sum("value")).collect()
        sums = np.zeros(weights.size)
        likelihood = 0.0
        for place, value in found:
            if place < 0:
                likelihood = value
            else:
                sums[place] = value
        sums = sums.reshape(weights.shape) + prior
        weights = sums / sums.sum(axis=1, keepdims=True)
        if likelihood - before < 1e-6 * abs(likelihood):
            break
        before = likelihood
    return weights


def train(
    docs: DataFrame,
    trains: Column,
    tunes: Column,
    keep: Iterable[str],
    order: int = 3,
    text_col: str = "text",
    rounds: int = 25,
) -> Trained:
    """Counts of the rows where ``trains`` holds; ``tunes`` picks the share for the weights.

    The texts of all rows are packed here, so that :func:`score` can go on from there.
    """
    keep = list(keep)
    kind = F.when(~trains, OTHER).when(tunes, TUNING).otherwise(MAIN)
    units = stored(_units(docs, text_col, kind, keep))
    found = units.agg(
        F.sum("n_tokens"), F.sum("n_trained"), F.sum(F.when(F.col("tuning"), F.col("n_trained")))
    ).first()
    n_all, n_trained, n_tuned = (int(x or 0) for x in found)
    buckets = max(1, math.ceil(n_all / BUCKET_KEYS))
    answers = stored(_answers(_asked(units, order, buckets)))
    n_words = int(answers.agg(F.sum("n_words")).first()[0] or 0)
    uniform = 1 / (n_words + 1)

    def estimates(left: pa.Table, right: pa.Table) -> pa.Table:
        shown, values = [], []
        for i in range(left.num_rows):
            counts = _Counts(_grams_of(order, left, i), right, False, n_trained - n_tuned)
            b, p = counts.estimates()
            shown.append(b.astype(np.uint16).tobytes())
            values.append(np.array(p, dtype=np.float32).tobytes())
        counts = b = p = None
        release()
        return pa.table({"buckets": pa.array(shown, pa.binary()), "estimates": pa.array(values, pa.binary())})

    held = units.where("tuning").select("unit", "kinds", "lengths", "ids", "words").groupBy("unit")
    parts = stored(
        held.cogroup(answers.where("tuning").groupBy("unit")).applyInArrow(estimates, "buckets binary, estimates binary")
    )
    weights = _learned_weights(parts, order, uniform, rounds)
    if not n_trained:  # nothing was counted: one class has it all
        weights = np.eye(order + 1)[np.zeros(len(weights), np.int64)]
    return Trained(Model(order, n_trained, n_words, weights), units, answers, keep)


def score(trained: Trained) -> DataFrame:
    """Per row: the kept columns, ``n_tokens, n_known, base_score, score``.

    ``base_score`` is the add-a-tenth unigram score, ``score`` the model's; both are
    base-10 logarithms of the text's probability.
    """
    model = trained.model
    row = trained.units.schema["rows"].dataType.elementType
    uniform = 1 / (model.n_words + 1)
    divisor = model.n_tokens + 0.1 * (model.n_words + 1)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for i in range(left.num_rows):
            grams = _grams_of(model.order, left, i)
            counts = _Counts(grams, right, True, model.n_tokens)
            bucket, p = counts.estimates()
            mixed = model.weights[bucket, 0] * uniform
            for k in range(model.order):
                mixed += model.weights[bucket, k + 1] * p[k]
            known = counts.of[0][counts.tokens]
            n_tokens = grams.n_places - 1
            starts = np.cumsum(n_tokens) - n_tokens
            made.append(
                pa.table(
                    {
                        "row": pa.concat_arrays(left.column("rows").chunks).slice(i, 1).flatten(),
                        "n_tokens": pa.array(n_tokens, pa.int64()),
                        "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), starts), pa.int64()),
                        "base_score": pa.array(np.add.reduceat(np.log10((known + 0.1) / divisor), starts), pa.float64()),
                        "score": pa.array(np.add.reduceat(np.log10(mixed), starts), pa.float64()),
                    }
                )
            )
        grams = counts = bucket = p = mixed = known = None
        release()
        return pa.concat_tables(made)

    units = trained.units.select("unit", "rows", "kinds", "lengths", "ids", "words").groupBy("unit")
    schema = T.StructType().add("row", row).add("n_tokens", "long").add("n_known", "long")
    schema.add("base_score", "double").add("score", "double")
    out = units.cogroup(trained.answers.groupBy("unit")).applyInArrow(scored, schema)
    return out.select(*[F.col(f"row.`{c}`") for c in trained.keep], "n_tokens", "n_known", "base_score", "score")
