"""Language identification by bit-sliced Bloom filters of n-grams.

A text becomes its 4-byte grams (lower case, UTF-8, all that is no letter as one space).
From a bounded sample of labelled rows per language, the grams that belong to a language
are found, and go into one Bloom filter per language. The filters are stored sideways:
each slot holds one bit per language, so that and-ing a gram's three slots gives the set
of all languages that contain it. A text's bits are counted per language, each count is
corrected for the false positives that its filter's fill lets expect, and the largest
corrected share decides.

Defined cases: a null text, or one without any letter, is ``und`` with score 0. Equal
shares go to the language whose name sorts first; if no gram is known, the prediction is
the most frequent language of the sample with score 0. If nothing could be learned, all
texts are ``und``. A null id counts as not held out. Rows are independent, so repeated
rows get equal results; columns but the named ones are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapdelta.llm.arrow_tasks import hash_share, in_fold, map_texts, release

SLOT_BITS = 20
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
BLOCK_BYTES = 1 << 20
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
# ASCII characters that are no letters become spaces; a zero byte is kept for text ends.
_TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    default: str
    slots: np.ndarray  # (words of 64 languages, slots), one bit per language
    false_rate: np.ndarray  # per language


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts and their grams, in blocks; long texts span several blocks."""
    encoded = [t.lower().encode("utf-8", "replace").translate(_TABLE) for t in texts]
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1
    ends = np.cumsum(lengths)
    joined = np.frombuffer(b"\0".join(encoded) + b"\0", np.uint8)
    for a in range(0, len(joined), BLOCK_BYTES):
        part = joined[a : a + BLOCK_BYTES + 3].astype(np.uint32)
        if len(part) < 4:
            continue
        codes = (part[:-3] << 24) | (part[1:-2] << 16) | (part[2:-1] << 8) | part[3:]
        zero, blank = part == 0, part == 32
        whole = ~(zero[:-3] | zero[1:-2] | zero[2:-1] | zero[3:])
        whole &= ~((blank[:-3] & blank[1:-2]) | (blank[1:-2] & blank[2:-1]) | (blank[2:-1] & blank[3:]))
        at = np.flatnonzero(whole)
        yield np.searchsorted(ends, at + a, "right"), codes[at]


def slots_of(codes: np.ndarray) -> list[np.ndarray]:
    wide = codes.astype(np.uint64)
    return [((wide * np.uint64(h)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for h in HASHES]


def train(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    fold: tuple[int, int] | None = (3, 1),
    docs_per_language: int = 2000,
    grams_per_language: int = 60_000,
    least_share: float = 0.3,
) -> Model:
    """Learns from about ``docs_per_language`` texts of each language, chosen by hash.

    Rows of the held-out ``fold`` (modulus, remainder) and null languages are not used. A
    language gets a gram if it occurs twice at least and its frequency there is at least
    ``least_share`` of its highest frequency in any language: passages in a foreign
    language do not count as the text's own. Both sizes bound what is learned from.
    """
    usable = F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    if fold:
        usable &= ~in_fold(id_col, *fold)
    rows = df.select(id_col, text_col, F.col(lang_col).alias("_lang")).where(usable)
    sizes = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    words = -(-max(len(languages), 1) // 64)
    table = np.zeros((words, 1 << SLOT_BITS), np.uint64)
    if not languages:
        return Model([], UNKNOWN, table, np.zeros(0))
    shares = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k]))])
    sample = rows.where(hash_share(id_col, seed=11) < shares[F.col("_lang")]).select("_lang", text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                for _, codes in grams([t for t, k in zip(texts, langs) if k == lang]):
                    new, n = np.unique(codes, return_counts=True)
                    if lang in totals:
                        old, m = totals[lang]
                        new, back = np.unique(np.concatenate([old, new]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([m, n])).astype(np.int64)
                    totals[lang] = (new, n)
        for lang, (codes, n) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))],
                names=["lang", "code", "n"],
            )
        totals = codes = n = None
        release()

    counted = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("lang"))
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    kept = (
        counted.withColumn("share", share)
        .withColumn("top", F.max("share").over(Window.partitionBy("code")))
        .where((F.col("n") >= 2) & (F.col("share") >= least_share * F.col("top")))
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code")))
        .where(F.col("rank") <= grams_per_language)
        .select(number[F.col("lang")].alias("number"), "code")
    )
    # At most grams_per_language for each language.
    found = kept.toArrow()
    numbers, codes = found.column(0).to_numpy(), found.column(1).to_numpy()
    fill = np.zeros(len(languages))
    for i in range(len(languages)):
        bit = np.uint64(1 << (i % 64))
        for at in slots_of(codes[numbers == i]):
            np.bitwise_or.at(table[i // 64], at, bit)
        fill[i] = np.count_nonzero(table[i // 64] & bit) / table.shape[1]
    default = max(languages, key=lambda k: (sizes[k], [-ord(c) for c in k]))
    return Model(languages, default, table, fill ** len(HASHES))


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.model = model

    def shares(self, texts: list[str]) -> np.ndarray:
        """Corrected share of each text's grams that each language contains."""
        model = self.model
        hits, total = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
        for owner, codes in grams(texts):
            if not len(codes):
                continue
            first, last = owner[0], owner[-1]
            bounds = np.searchsorted(owner, np.arange(first, last + 2))
            at = slots_of(codes)
            total[first : last + 1] += np.diff(bounds)
            for word in range(len(model.slots)):
                sets = model.slots[word][at[0]] & model.slots[word][at[1]] & model.slots[word][at[2]]
                for i in range(64 * word, min(64 * (word + 1), len(model.languages))):
                    bits = ((sets >> np.uint64(i % 64)) & np.uint64(1)).astype(np.uint32)
                    sums = np.append(np.uint32(0), np.cumsum(bits, dtype=np.uint32)).astype(np.int64)
                    hits[first : last + 1, i] += sums[bounds[1:]] - sums[bounds[:-1]]
        expected = total[:, None] * model.false_rate
        return np.maximum(0, hits - expected) / (1 - model.false_rate) / np.maximum(total, 1)[:, None]

    def __call__(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        model = self.model
        if not model.languages:
            return {"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts))}
        shares = self.shares(texts)
        best, sums = shares.argmax(1), shares.sum(1)
        score = np.where(sums > 0, shares.max(1) / np.where(sums > 0, sums, 1), 0.0)
        lettered = np.fromiter((bool(_LETTER.search(t)) for t in texts), bool, len(texts))
        names = [
            UNKNOWN if not letter else model.languages[b] if s > 0 else model.default
            for letter, b, s in zip(lettered, best, sums)
        ]
        return {"lang_pred": names, "score": np.where(lettered, np.clip(score, 0.0, 1.0), 0.0)}


def identify(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` beside ``lang_pred`` and ``score``, in one pass without a shuffle.

    The model, a few megabytes of fixed size, goes to each task by broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    return map_texts(
        df, text_col, keep, lambda: _Scorer(shared.value),
        {"lang_pred": pa.string(), "score": pa.float64()}, "lang_pred string, score double", release_after=True,
    )
