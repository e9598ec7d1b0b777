"""Similarity join of texts by the Jaccard similarity of their word shingles.

A text's set holds its distinct shingles of ``width`` words (letters A-Z lowered, words
split at white space); with fewer words the whole sequence is the one shingle. Two sets
link when 100 times their intersection is at least ``percent`` times their union.

Candidates come from token-combination prefixes. Shingles are ordered by the document
frequency of their rarest word, rare ones first; equal texts order alike, whatever the
order is. A set of n shingles shares at least c = ceil(n * percent / 100) of them with a
partner, so two partners share one of the first n - c + 1 shingles, and two of the first
n - c + 2. A rare shingle of that extended prefix is indexed alone. Frequent ones, those
whose words are all frequent, are indexed in pairs: partners that share no rare one share
two frequent ones. Sets of ``pairs_below`` shingles and more index all shingles alone, as
pairs would be too many, but over a prefix that is longer by m, as partners share m
shingles of it; sets close below that size do both, so that any two partners have one way
in common. Sets that share too few signatures with sets of a size near theirs drop out.

Of each signature the least set is the pivot; a pivot and all sets that share a signature
with it are a group, and any two partners are in one group. Groups are verified exactly,
in blocks of bounded size: a large group is dealt into blocks and each two blocks are one
task, which returns a forest and counts instead of all its links. Links then join to
components. Equal sets are one node throughout, however many texts have them.

Defined cases: a null text or one without words has an empty set, links with nothing and
is its own component. Texts of equal sets link (a repeated id too). A null id is passed
over when the smallest id of a component is sought, and keeps its row. An empty table
gives no rows. Columns but the named are ignored.

Sets are identified by 64-bit hashes of their shingles and confirmed by a second such
hash; shingles by 64-bit hashes.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm.arrow_tasks import release, slices_by_size, small_batches
from snapdelta.llm import row_filter
from snapdelta.llm.row_filter import bloom, maybe_in
from snapdelta.sources.shared_storage import stored

BLOCK_CHARS = 500_000
WORD_SLOT_BITS = 24
LISTED_WORDS = 1 << 22
LEVELS_PER_DOUBLING = 12
REQUIRED_EVERY = 50
BLOCK_SETS, BLOCK_SHINGLES = 512, 2_000_000
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of the words of many texts at once."""

    def __init__(self) -> None:
        self.values = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grown(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.full(n, _BASE, np.uint64))
            self.inverse = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its hash and the number of its text."""
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join([b"", *encoded, b""]).translate(_FOLD), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1)
        inside = data != 32
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        stops = np.flatnonzero(~inside[1:] & inside[:-1]) + 1
        self._grown(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return mixed((sums[stops] - sums[starts]) * self.inverse[starts]), np.searchsorted(ends, starts, "right")


class Shingles:
    """Sets of shingles in the common order, with the class of each shingle."""

    def __init__(self, word_df: np.ndarray, width: int) -> None:
        self.words, self.word_df, self.width = Words(), word_df, width

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of shingles of each text; all shingles in turn, and their frequencies."""
        word, text = self.words(texts)
        df = self.word_df[(word >> np.uint64(64 - WORD_SLOT_BITS)).astype(np.int64)]
        per_text = np.bincount(text, minlength=len(texts))
        first = np.cumsum(per_text) - per_text
        place = np.arange(len(word)) - first[text]
        begins = np.flatnonzero((place + self.width <= per_text[text]) | (place == 0))
        hashes, rarest = np.zeros(len(begins), np.uint64), np.full(len(begins), 255, np.uint8)
        for k in range(self.width):
            at = np.minimum(begins + k, max(len(word) - 1, 0))
            own = place[begins] + k < per_text[text[begins]]
            hashes = mixed(hashes * _ODD[2] + np.where(own, word[at], np.uint64(k + 1)))
            rarest = np.where(own, np.minimum(rarest, df[at]), rarest)  # of equal shingles equal
        owner = text[begins]
        order = np.lexsort((hashes, rarest, owner))
        hashes, rarest, owner = hashes[order], rarest[order], owner[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        return np.bincount(owner[new], minlength=len(texts)), hashes[new], rarest[new]


def set_hashes(sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    found = []
    for factor in _ODD[2:]:
        sums = np.append(np.uint64(0), np.cumsum(mixed(hashes * factor + np.uint64(1)), dtype=np.uint64))
        ends = np.cumsum(sizes)
        found.append(mixed(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)).view(np.int64))
    return found[0], found[1]


def signatures(hashes: np.ndarray, rarest: np.ndarray, percent: int, frequent: int, pairs_below: int) -> np.ndarray:
    """Signatures of one set; none if only an equal set can be a partner, as neither a set of
    all but one of its shingles nor one of them all and one more is near enough."""
    n = len(hashes)
    shared = -(-n * percent // 100)
    if shared == n and 100 * n < percent * (n + 1):
        return np.empty(0, np.uint64)
    plain = n - shared + 1
    # The requirement of the largest partner decides how far singles reach.
    reach = plain + n * 100 // (percent * REQUIRED_EVERY) + 1
    if n >= pairs_below:
        return hashes[:reach]
    common = rarest >= frequent
    if 100 * n >= percent * pairs_below:
        found = [hashes[:reach]]
    else:
        # Where one shared shingle may be enough, no pair of them is sure to be shared.
        found = [hashes[: plain + 1][~common[: plain + 1] | (shared < 2)]]
    if (m := hashes[: plain + 1][common[: plain + 1]]).size > 1:
        a, b = np.triu_indices(m.size, 1)
        found.append(mixed(m[a] * _ODD[2] + m[b] * _ODD[3]))
    return np.concatenate(found)


def frequency_level(df: int) -> int:
    """A byte that grows with the logarithm of a document frequency; 0 for one text or none."""
    return min(255, int(np.floor(np.log2(max(df, 1)) * LEVELS_PER_DOUBLING)))


def _word_frequencies(rows: DataFrame) -> np.ndarray:
    """Frequency levels of words, by slot of their hash, 16 MB whatever the input.

    Listed are words of more than one text, the most frequent LISTED_WORDS at most; others
    have level 0. Only an order is made of the levels, so clashes of slots do no harm.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found = Words(), []
        for batch in (small for whole in batches for small in small_batches(whole)):
            texts = batch.column(0).to_pylist()
            for a, b in slices_by_size(texts, BLOCK_CHARS):
                word, text = words(texts[a:b])
                both = np.unique(word * _ODD[1] + text.astype(np.uint64) * _ODD[2], return_index=True)[1]
                found.append(np.unique(word[both], return_counts=True))
                if len(found) > 40:
                    found = [merged(found)]
        if found:
            keys, n = merged(found)
            for a in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000].astype(np.int64))],
                    names=["word", "df"],
                )
        keys = n = found = words = None
        release()

    counted = stored(
        rows.select("text").mapInArrow(count, "word long, df long").groupBy("word").agg(F.sum("df").alias("df")).where("df > 1")
    )
    level = F.least(F.lit(255), F.floor(F.log2("df") * LEVELS_PER_DOUBLING)).cast("int").alias("level")
    total, least = 0, None
    for row in counted.groupBy(level).count().orderBy(F.desc("level")).collect():
        if total + row["count"] > LISTED_WORDS:
            break
        total, least = total + row["count"], row["level"]
    table = np.zeros(1 << WORD_SLOT_BITS, np.uint8)
    if least is not None:
        slot = F.shiftrightunsigned("word", 64 - WORD_SLOT_BITS).cast("int").alias("slot")
        found = counted.where(level >= least).select(slot, level.cast("smallint")).toArrow()
        np.maximum.at(table, found.column(0).to_numpy(), found.column(1).to_numpy().astype(np.uint8))
    return table


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in found]))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the least node reachable, from rows ``a, b``."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        lowered = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("root").alias("was"), F.least("root", "near").alias("now")
        )
        onward = labels.select(F.col("node").alias("now"), F.col("root").alias("next"))
        after = stored(lowered.join(onward, "now").select("node", "was", F.least("now", "next").alias("root")))
        labels = after.select("node", "root")
        if after.where("was <> root").isEmpty():
            return labels


def _linked(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which sets of ``left`` link with which of ``right``, both numbers of sets."""
    used = np.unique(np.concatenate([left, right]))
    sizes = np.array([len(t) for t in tokens])
    flat = np.concatenate([tokens[i] for i in used])
    owner = np.repeat(used, sizes[used])
    _, local, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[local] > 1
    owner, local = owner[shared], np.unique(local[shared], return_inverse=True)[1]
    order = np.argsort(local, kind="stable")
    owner, local = owner[order], local[order]
    total = np.zeros((len(left), len(right)), np.float32)
    row = np.full(len(tokens), -1)
    column = row.copy()
    row[left], column[right] = np.arange(len(left)), np.arange(len(right))
    width = 2048
    for a in range(0, int(local[-1]) + 1 if len(local) else 0, width):
        low, high = np.searchsorted(local, [a, a + width])
        own, at = owner[low:high], local[low:high] - a
        parts = []
        for place, count in ((row, len(left)), (column, len(right))):
            matrix = np.zeros((count, width), np.float32)
            mine = place[own] >= 0
            matrix[place[own][mine], at[mine]] = 1
            parts.append(matrix)
        total += parts[0] @ parts[1].T
    union = sizes[left][:, None] + sizes[right][None, :] - total
    return 100 * total >= percent * union


def verify(group: pa.Table, percent: int) -> pa.Table:
    """Of each set of a group that links: the least set of its part of the forest, and the
    number of linked texts, each link counted in the group of the least pivot both have."""
    node = group.column("node").to_numpy()
    node, at = np.unique(node, return_index=True)
    pick = lambda name: group.column(name).to_numpy()[at]
    tokens_column, pivots_column = (group.column(n).combine_chunks() for n in ("tokens", "pivots"))
    tokens = [tokens_column[int(i)].values.to_numpy() for i in at]
    pivot, first, second = (group.column(n)[0].as_py() for n in ("pivot", "first", "second"))
    block, copies = pick("block"), pick("copies")
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    if not len(left) or not len(right):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
    linked = _linked(tokens, left, right, percent)
    if first == second:
        np.fill_diagonal(linked, False)
    smaller = [[p for p in pivots_column[int(i)].values.to_numpy().tolist() if p < pivot] for i in at]
    number = {p: k for k, p in enumerate(sorted({p for own in smaller for p in own}))}
    elsewhere = np.zeros((len(node), max(len(number), 1)), np.float32)
    for i, own in enumerate(smaller):
        elsewhere[i, [number[p] for p in own]] = 1
    own = linked & ~((elsewhere[left] @ elsewhere[right].T) > 0)
    links = np.zeros(len(node), np.int64)
    links[left] += own @ copies[right]
    if first != second:
        links[right] += own.T @ copies[left]
    label = np.arange(len(node))
    while True:
        before = label.copy()
        best = np.where(linked, label[right][None, :], len(node)).min(1)
        label[left] = np.minimum(label[left], best)
        best = np.where(linked, label[left][:, None], len(node)).min(0)
        label[right] = np.minimum(label[right], best)
        if (label == before).all():
            break
    some = np.zeros(len(node), bool)
    some[left] |= linked.any(1)
    some[right] |= linked.any(0)
    return pa.table({"a": node[some], "b": node[label[some]], "links": links[some]})


def _shared(posted: DataFrame, key: list[str]) -> DataFrame:
    """Rows of keys that two nodes at least have, with the key's least node."""
    pivots = posted.groupBy(*key).agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last")
    return posted.join(pivots.drop("last"), key)


def _pivots(shared: DataFrame, percent: int, pairs_below: int) -> DataFrame:
    """``node, pivot`` for signatures that sets of near sizes share, often enough.

    Sizes of partners differ by a factor of 100 / percent at most. Each set stands in the
    step of its size and in the next one, so partners share a step; steps are a little
    wider than that factor, so that rounding cannot part them. Larger sets have all
    shingles of a longer prefix as signatures, and share n // REQUIRED_EVERY of them with
    each partner, all in one step; those that share fewer in a step are dropped from it.
    """
    step = F.floor(F.log(F.col("n")) / (math.log(100 / percent) + 1e-9)).cast("int")
    near = shared.select("node", "n", "signature", F.explode(F.array(step, step + 1)).alias("step"))
    found = stored(_shared(near, ["signature", "step"]).select("node", "n", "step", "pivot"))
    required = F.when(F.col("n") >= pairs_below, F.floor(F.col("n") / REQUIRED_EVERY)).otherwise(F.lit(1))
    enough = found.groupBy("node", "n", "step").agg(F.count(F.lit(1)).alias("signatures")).where(F.col("signatures") >= required)
    pairs = found.select("node", "step", "pivot").distinct().join(enough.select("node", "step"), ["node", "step"])
    pairs = stored(pairs.select("node", "pivot").distinct())
    several = pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    return pairs.join(several.select("pivot"), "pivot").select("node", "pivot")


def similarity_join(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 4,
    percent: int = 85,
    pairs_below: int = 160,
) -> DataFrame:
    """``id_col, n_shingles, component_id, n_links`` for each row.

    ``component_id`` is the smallest id reachable by links, ``n_links`` the number of
    other rows that link with the row itself.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    word_df = _word_frequencies(rows)
    shared = spark.sparkContext.broadcast(word_df)
    frequent = frequency_level(max(50, rows.count() // 1000))

    def blocks(batches: Iterator[pa.RecordBatch], make: Shingles) -> Iterator[tuple]:
        for batch in (small for whole in batches for small in small_batches(whole)):
            texts = batch.column(1).to_pylist()
            for a, b in slices_by_size(texts, BLOCK_CHARS):
                sizes, hashes, rarest = make(texts[a:b])
                node, check = set_hashes(sizes, hashes)
                yield batch.column(0).slice(a, b - a), sizes, hashes, rarest, node, check
        texts = batch = make = sizes = hashes = rarest = node = check = None
        release()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, hashes, rarest, node, check in blocks(batches, Shingles(shared.value, width)):
            ends = np.cumsum(sizes)
            own = [
                signatures(hashes[e - n : e], rarest[e - n : e], percent, frequent, pairs_below)
                for n, e in zip(sizes.tolist(), ends.tolist())
            ]
            offsets = np.append(0, np.cumsum([len(s) for s in own])).astype(np.int32)
            flat = np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes.astype(np.int64)), pa.array(node), pa.array(check),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["id", "n", "node", "check", "signatures"],
            )

    signed = stored(rows.mapInArrow(sign, f"id {id_type}, n long, node long, check long, signatures array<long>"))
    differ = F.min("check") != F.max("check")
    facts = stored(
        signed.where("n > 0").groupBy("node").agg(
            F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"),
            F.when(differ, F.raise_error(F.lit("two sets have one hash"))).otherwise(F.min("check")).alias("check"),
        )
    )
    posted = signed.select("node", "n", F.explode("signatures").alias("signature"))
    repeated = stored(
        posted.groupBy("signature").agg(F.min("node").alias("first"), F.max("node").alias("last"))
        .where("first <> last").select("signature")
    )
    # Most signatures occur once; the filter, of a fixed size, takes out nearly all of them.
    again = posted.where(row_filter.maybe_column(spark, repeated, F.col("signature")))
    pairs = stored(_pivots(again, percent, pairs_below))
    members = pairs.join(facts, "node")
    groups = members.groupBy("pivot").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    own = pairs.groupBy("node").agg(F.collect_list("pivot").alias("pivots"))
    dealt = (
        members.join(groups, "pivot").join(own, "node")
        .withColumn("block", F.pmod(F.xxhash64("node", "pivot"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "pivot", "copies", "pivots", "block", F.least("block", "other").alias("first"),
                F.greatest("block", "other").alias("second"))
    )
    # Only sets of some group are needed; the filter has a fixed size and errs by letting more through.
    filter_bits = spark.sparkContext.broadcast(bloom(own.select("node")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, sizes, hashes, _, node, _ in blocks(batches, Shingles(shared.value, width)):
            maybe = (sizes > 0) & maybe_in(filter_bits.value, node)
            ends = np.cumsum(sizes)
            chosen = [i for i in np.flatnonzero(maybe).tolist() if not (node[i] in seen or seen.add(node[i]))]
            if chosen:
                own_sets = [hashes[ends[i] - sizes[i] : ends[i]].view(np.int64) for i in chosen]
                offsets = np.append(0, np.cumsum([len(s) for s in own_sets])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[chosen]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(own_sets)))],
                    names=["node", "tokens"],
                )

    # A task sends a set once; what several tasks send is one row again before it is dealt to groups.
    full = rows.mapInArrow(sets, "node long, tokens array<long>").groupBy("node").agg(F.first("tokens").alias("tokens"))
    linked = stored(
        dealt.join(full, "node").groupBy("pivot", "first", "second")
        .applyInArrow(lambda table: verify(table, percent), "a long, b long, links long")
    )
    roots = components(linked.select("a", "b"))
    degrees = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    labelled = (
        facts.select("node", "copies").join(degrees, "node", "left").join(roots, "node", "left")
        .select("node", F.coalesce("root", "node").alias("root"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    least = signed.where("n > 0").groupBy("node").agg(F.min("id").alias("least"))
    named = labelled.join(least, "node").groupBy("root").agg(F.min("least").alias("component"))
    by_node = labelled.join(named, "root").select("node", "component", "n_links")
    texts = signed.select("id", "n", "node")
    with_words = texts.where("n > 0").join(by_node, "node")
    without = texts.where("n = 0").select("*", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return with_words.unionByName(without).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links"
    )
