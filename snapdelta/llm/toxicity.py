"""Toxicity of texts, scored after undoing disguises of words.

Disguise is seen as a noisy channel: a writer means letters, and the channel replaces
some by look-alikes (``m0r0n``), puts spaces or marks between them (``s t u p i d``) or
repeats them (``stuuupid``). Each word with a look-alike or a doubled letter, numbers
excepted, and each run of single characters becomes a lattice of the letters that
may have been meant, and a Viterbi search finds the likeliest reading under a character
model of order four, whose counts come from all texts. Then the words of the restored
text, and their beginnings, are looked up among the features that a bounded sample of
labelled rows shows to be toxic, and a logistic curve turns the hits into a probability.

Letters are folded to a-z; text in other scripts passes unread. A null or empty text, or
one without hits, gets the low score of a text without hits. Labels of the held-out fold
are never read; null labels are left out; of repeated labels of one row the highest
counts. Without toxic rows in the sample no feature is learned and all scores are low.
Rows are independent, so repeated rows score alike; columns but the named are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.arrow_tasks import in_fold, map_texts, release, slices_by_size

SYMBOLS = 27  # 0 for what is no letter, then a to z
CONTEXTS = SYMBOLS**3
PREFIXES = (4, 5, 6, 7, 8)
# Look-alikes of letters and how readily a writer picks them, in natural logarithms.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
SUBSTITUTED, DROPPED, KEPT_APART, REPEATED = -1.0, -2.5, -1.5, -0.7

_LOOK = re.escape("".join(LOOK_ALIKES))
_LETTER = r"[^\W\d_]"
# A word with one of these may be disguised, unless it is a number.
_ODD = re.compile(rf"[{_LOOK}]|(?i:({_LETTER})\1)")
_NUMBER = re.compile(r"[\W_]*\d[\d\W_]*")
# Single characters with up to three marks or spaces between them.
_ONE = r"(?:[^\W_]|[@$]|(?<=[\s./,_-])[!|+(€](?=[\s./,_-]))"
_APART = re.compile(rf"(?<![^\W_@$]){_ONE}(?:[\W_]{{1,3}}?{_ONE}(?![^\W_@$])){{2,}}")


def _folding() -> bytes:
    table = bytearray(256)
    for code in range(256):
        letter = unicodedata.normalize("NFKD", {"ß": "s", "Æ": "a", "æ": "a", "Ø": "o", "ø": "o"}.get(chr(code), chr(code)))[0]
        if letter.isascii() and letter.isalpha():
            table[code] = ord(letter.lower()) - 96
    return bytes(table)


FOLD = _folding()
_LETTERS_OF = bytes(96 + c if c else 32 for c in FOLD)
_FOLDED = "".join(chr(c) for c in range(256) if FOLD[c])
# Letters none of which is followed by itself.
_ONCE = re.compile(rf"(?i:([{_FOLDED}])(?!\1))+")
_TAIL = re.compile(rf"[^{_FOLDED}]*\Z")
_LETTERS = b" " + bytes(range(97, 123)) + bytes(229)
# Small letters, accents kept; all else a space.
_WORDS = bytes(
    ord(chr(b).lower()) if chr(b).isalpha() and ord(chr(b).lower()) < 256 else 32 for b in range(256)
)


def folded(text: str) -> bytes:
    """One symbol per character."""
    return text.encode("latin-1", "replace").translate(FOLD)


def _pieces(text: str) -> Iterator[tuple[int, int, bool]]:
    """The text in pieces: runs of single characters that hold a letter, and what is between."""
    begin = 0
    for run in _APART.finditer(text):
        if any(c.isalpha() for c in run.group()):
            yield begin, run.start(), False
            yield run.start(), run.end(), True
            begin = run.end()
    yield begin, len(text), False


def _may_be_disguised(word: str) -> bool:
    return bool(_ODD.search(word)) and not _NUMBER.fullmatch(word)


@dataclass(frozen=True)
class CharacterModel:
    """Log probability of a symbol after three others."""

    log_p: np.ndarray

    @classmethod
    def of_counts(cls, codes: np.ndarray, counts: np.ndarray) -> CharacterModel:
        n = np.zeros(SYMBOLS**4)
        n[codes] = counts
        p = np.full(SYMBOLS, 1 / SYMBOLS)
        for order in range(1, 5):
            # Counts of the last `order` symbols, smoothed by the next shorter context.
            own = n.reshape(-1, SYMBOLS**order).sum(0).reshape(-1, SYMBOLS)
            before = np.tile(p.reshape(-1, SYMBOLS), (len(own) // max(1, p.size // SYMBOLS), 1))
            weight = 5.0
            p = (own + weight * before) / (own.sum(1, keepdims=True) + weight)
        return cls(np.log(p).astype(np.float32).reshape(CONTEXTS, SYMBOLS))


def character_model(df: DataFrame, text_col: str = "text") -> CharacterModel:
    """Counts windows of four symbols over all texts; the driver gets one number per window."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**4, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices_by_size(texts, 2_000_000):
                s = np.frombuffer(b"\0" + folded("\n".join(texts[a:b])) + b"\0", np.uint8)
                s = s[np.append(True, (s[1:] | s[:-1]) != 0)]
                if len(s) > 3:
                    code = s[:-3].astype(np.int64)
                    for later in (s[1:-2], s[2:-1], s[3:]):
                        code *= SYMBOLS
                        code += later
                    total += np.bincount(code, minlength=SYMBOLS**4)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    rows = df.where(F.col(text_col).isNotNull()).select(text_col)
    found = rows.mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return CharacterModel.of_counts(found.column(0).to_numpy(), found.column(1).to_numpy())


def lattice(span: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """For each place of a span, the letters that may have been meant and their cost.

    Letters that stand once are one place together, as nothing else can be meant.
    """
    places: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(span):
        once = _ONCE.match(span, i)
        if once:
            places.append([(once.group().encode("latin-1").translate(_LETTERS_OF).decode("latin-1"), 0.0)])
            i = once.end()
            continue
        letter = span[i]
        run = 1
        while i + run < len(span) and span[i + run].lower() == letter.lower():
            run += 1
        plain = FOLD[ord(letter)] if ord(letter) < 256 else 0
        if plain:
            name = chr(96 + plain)
            if run >= 3:
                places.append([(name, REPEATED), (2 * name, REPEATED)])
            else:
                places.append([(run * name, 0.0)] if run == 1 else [(2 * name, 0.0), (name, 2 * REPEATED)])
        elif letter in LOOK_ALIKES:
            apart = spaced and not letter.isdigit() and letter not in "@$"  # may stand between letters, too
            for _ in range(run):
                meant = LOOK_ALIKES[letter]
                share = SUBSTITUTED - math.log(len(meant))
                none = [("", -0.3), (" ", KEPT_APART)] if apart else [("", DROPPED), (" ", DROPPED)]
                places.append([(c, share) for c in meant] + none)
        elif spaced and not letter.isalnum():
            places.append([("", -0.3), (" ", KEPT_APART)])
        else:
            places.append([(" ", 0.0), ("", DROPPED)] if letter in " .-_" else [(" ", 0.0)])
        i += run
    return places


def _read(link: tuple | None) -> str:
    parts = []
    while link:
        link, meant = link
        parts.append(meant)
    return "".join(reversed(parts))


_TO_SYMBOLS = bytes(c - 96 if 97 <= c <= 122 else 0 for c in range(256))


class Restorer:
    def __init__(self, log_p: np.ndarray) -> None:
        self.log_p = log_p.ravel().tolist()
        self.plain: set[str] = set()
        self.known: dict[str, str | None] = {}
        self.ends: dict[tuple[int, str, bool], tuple[float, str]] = {}

    def _search(
        self, paths: dict[int, tuple[float, tuple | None]], places: list[list[tuple[str, float]]]
    ) -> dict[int, tuple[float, tuple | None]]:
        """The best path to every context that the places lead to."""
        log_p = self.log_p
        for options in places:
            after: dict[int, tuple[float, tuple | None]] = {}
            for meant, cost in options:
                symbols = meant.encode().translate(_TO_SYMBOLS)
                letters = meant.isalpha()
                for context, (score, link) in paths.items():
                    total, state = score + cost, context
                    if letters:
                        for symbol in symbols:
                            at = state * SYMBOLS + symbol
                            total += log_p[at]
                            state = at % CONTEXTS
                    elif symbols and state % SYMBOLS:  # one space is enough
                        at = state * SYMBOLS
                        total += log_p[at]
                        state = at % CONTEXTS
                    known = after.get(state)
                    if known is None or total > known[0]:
                        after[state] = (total, (link, meant) if meant else link)
            paths = after
        return paths

    def _best_end(self, context: int, tail: str, spaced: bool) -> tuple[float, str]:
        """The best way on from a context through the marks that end a span, and its score.

        The same few endings follow many words, so they are remembered by context.
        """
        key = (context, tail, spaced)
        if key not in self.ends:
            if len(self.ends) > 100_000:
                self.ends.clear()
            paths = self._search({context: (0.0, None)}, [*lattice(tail, spaced), [(" ", 0.0)]])
            best = max(score for score, _ in paths.values())
            self.ends[key] = best, max(_read(link) for score, link in paths.values() if score == best)
        return self.ends[key]

    def decode(self, span: str, spaced: bool) -> str:
        """The likeliest reading of a span that stands between spaces.

        The search is exact; a context, of which the last places allow a few hundred at
        most, keeps its best path as a chain of links, so work is linear in the length.
        """
        cut = _TAIL.search(span).start()
        found = []
        for context, (score, link) in self._search({0: (0.0, None)}, lattice(span[:cut], spaced)).items():
            end, meant = self._best_end(context, span[cut:], spaced)
            found.append((score + end, link, meant))
        best = max(f[0] for f in found)
        return max(" ".join((_read(link) + meant).split()) for score, link, meant in found if score == best)

    def changed_reading(self, span: str, spaced: bool) -> str | None:
        """The reading of a span, unless its letters stand there plainly."""
        reading = self.decode(span, spaced)
        return None if reading.split() == folded(span).translate(_LETTERS).decode().split() else reading

    def changed_words(self, words: set[str]) -> dict[str, str]:
        """The words among these that read differently from what stands there.

        A bounded number of short words is remembered; longer ones are seldom repeated.
        """
        found = {}
        for word in words.difference(self.plain):
            if not _may_be_disguised(word):
                self.plain.add(word)
                continue
            if word in self.known:
                reading = self.known[word]
            else:
                reading = self.changed_reading(word, False)
                if len(word) <= 64:
                    self.known[word] = reading
            if reading is not None:
                found[word] = reading
        for remembered, most in ((self.plain, 200_000), (self.known, 150_000)):
            if len(remembered) > most:
                remembered.clear()
        return found

    def restore(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The restored text and the spans replaced, with their readings."""
        spans: list[tuple[int, int, str]] = []
        for begin, end, spaced in _pieces(text):
            if spaced:
                reading = self.changed_reading(text[begin:end], True)
                if reading is not None:
                    spans.append((begin, end, reading))
                continue
            changed = self.changed_words(set(text[begin:end].split()))
            found = []
            for word, reading in changed.items():
                at = text.find(word, begin, end)
                while at >= 0:
                    after = at + len(word)
                    if (at == begin or text[at - 1].isspace()) and (after == end or text[after].isspace()):
                        found.append((at, after, reading))
                    at = text.find(word, after, end)
            spans += sorted(found)
        if not spans:
            return text, spans
        parts, done = [], 0
        for a, b, reading in spans:
            parts += [text[done:a], " ", reading, " "]
            done = b
        return "".join([*parts, text[done:]]), spans


def words_of(text: str) -> list[bytes]:
    return text.encode("latin-1", "replace").translate(_WORDS).split()


def features_of(words: set[bytes]) -> set[bytes]:
    """The words themselves and, marked, their beginnings."""
    found = set(words)
    for n in PREFIXES:
        found.update(w[:n] + b"*" for w in words if len(w) >= n)
    return found


@dataclass(frozen=True)
class Model:
    log_p: np.ndarray
    toxic_features: dict[bytes, float]  # with the logarithm of their likelihood ratio
    weights: tuple[float, float, float]


class _Scorer:
    def __init__(self, model: Model) -> None:
        self.restorer = Restorer(model.log_p)
        self.model = model
        # A word of four letters or more shares them with any feature that it has.
        self.starts = {f[:4] for f in model.toxic_features}

    def evidence(self, text: str) -> tuple[int, float, int]:
        """Toxic words, the strongest one's log likelihood ratio, and spans restored."""
        restored, spans = self.restorer.restore(text)
        words = words_of(restored)
        for a, b, _ in spans:  # the plain reading counts as well
            words += words_of(text[a:b])
        toxic = self.model.toxic_features
        hits, strongest, starts = 0, 0.0, self.starts
        for word, n in Counter([w for w in words if w[:4] in starts]).items():
            own = max([toxic.get(word, 0.0), *(toxic.get(word[:k] + b"*", 0.0) for k in PREFIXES if len(word) >= k)])
            if own:
                hits += n
                strongest = max(strongest, own)
        return hits, strongest, len(spans)

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        found = np.array([self.evidence(t) for t in texts], float).reshape(-1, 3)
        return {"score": probability(found[:, 0], found[:, 1], self.model.weights), "strongest": found[:, 1],
                "n_hits": found[:, 0].astype(np.int64), "n_restored": found[:, 2].astype(np.int64)}


def _inputs(hits: np.ndarray, strongest: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(hits)), np.log1p(hits), strongest], 1)


def probability(hits: np.ndarray, strongest: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(hits, strongest) @ np.array(weights), -30, 30)))


def fit_curve(hits: np.ndarray, strongest: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression with a small ridge, by Newton's method."""
    x, w = _inputs(hits, strongest), np.array([math.log(0.05), 0.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.array([1e-4, 0.05, 0.05])
        gradient = x.T @ (weight * (p - label)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w - np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return tuple(float(v) for v in w)


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fold: tuple[int, int] | None = (4, 2),
    rows_per_label: int = 10_000,
    n_features: int = 4_000,
    least_evidence: float = 30.0,
) -> Model:
    """Learns from at most ``rows_per_label`` rows of either label, those of smallest hash.

    A feature is toxic if its log-likelihood ratio against independence of the label is at
    least ``least_evidence`` and it is ten times as frequent among toxic texts. At most
    ``n_features`` are kept, those of the highest ratio.
    """
    spark = df.sparkSession
    log_p = character_model(df, text_col).log_p
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    if fold:
        known = known.where(~in_fold(id_col, *fold))
    known = known.groupBy(id_col).agg((F.max(label_col) > 0).alias("_toxic"))
    order = [F.xxhash64(F.lit(5), id_col), F.col(id_col)]
    chosen = [known.where(F.col("_toxic") == value).orderBy(*order).limit(rows_per_label) for value in (True, False)]
    sizes = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Bounded by rows_per_label on either side.
    sample = df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).join(
        F.broadcast(chosen[0].unionByName(chosen[1])), id_col
    ).select("_toxic", "_text")
    shared = spark.sparkContext.broadcast(log_p)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, of = Restorer(shared.value), {True: Counter(), False: Counter()}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                restored, spans = restorer.restore(text)
                words = set(words_of(restored)) | (set(words_of(text)) if spans else set())
                of[toxic].update(features_of(words))
        # A feature needs toxic texts; clean counts matter for those only, but others may have them.
        names = list(of[True].keys() | of[False].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), pa.array([of[True][n] for n in names], pa.int64()),
             pa.array([of[False][n] for n in names], pa.int64())], names=["feature", "t", "c"])
        restorer = of = names = None
        release()

    bad, good = (float(min(sizes.get(v, 0), rows_per_label)) for v in (True, False))
    if not bad or not good:
        return Model(log_p, {}, (math.log(0.01), 0.0, 0.0))
    both = bad + good
    t, c = F.col("t").cast("double"), F.col("c").cast("double")
    n = t + c

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))

    ratio = 2 * (
        part(t, n * bad / both) + part(c, n * good / both)
        + part(bad - t, (both - n) * bad / both) + part(good - c, (both - n) * good / both)
    )
    learned = (
        sample.mapInArrow(count, "feature binary, t long, c long")
        .groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where((t > 3) & ((t + 0.5) / (bad + 1) >= 10 * (c + 0.5) / (good + 1)))
        .withColumn("ratio", ratio).where(F.col("ratio") >= least_evidence)
        .orderBy(F.desc("ratio"), "feature").limit(n_features)
        .select("feature", F.log((t + 0.5) / (bad + 1)) - F.log((c + 0.5) / (good + 1))).toArrow()
    )
    features = dict(zip(learned.column(0).to_pylist(), learned.column(1).to_pylist()))
    model = Model(log_p, features, (math.log(0.01), 0.0, 0.0))
    seen = _scored(sample, "_text", model, ["_toxic"], ["n_hits", "strongest"]).toArrow()
    label, hits, strongest = (seen.column(i).to_numpy().astype(float) for i in range(3))
    weight = np.where(label > 0, sizes.get(True, 0) / bad, sizes.get(False, 0) / good)
    return Model(log_p, model.toxic_features, fit_curve(hits, strongest, label, weight / weight.sum() * len(weight)))


_FIELDS = {"score": "double", "n_hits": "long", "strongest": "double", "n_restored": "long"}


def _scored(df: DataFrame, text_col: str, model: Model, keep: list[str], fields: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((model.log_p, model.toxic_features, model.weights))
    kinds = {"double": pa.float64(), "long": pa.int64()}
    return map_texts(
        df, text_col, keep, lambda: _Scorer(Model(*shared.value)),
        {f: kinds[_FIELDS[f]] for f in fields}, ", ".join(f"{f} {_FIELDS[f]}" for f in fields), release_after=True,
    )


def score(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` beside ``score``, ``n_hits`` and ``n_restored``, in one pass without a shuffle."""
    return _scored(df, text_col, model, keep, ["score", "n_hits", "n_restored"])


def restore(df: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` beside ``restored``, the whole text with disguised words undone."""
    shared = df.sparkSession.sparkContext.broadcast(model.log_p)

    def make():
        restorer = Restorer(shared.value)
        return lambda texts: {"restored": [restorer.restore(t)[0] for t in texts]}

    return map_texts(df, text_col, keep, make, {"restored": pa.string()}, "restored string")
