"""Token counts by a compiled finite-state tokenizer.

The tokenizer's splitting rule is compiled into a deterministic transducer over twelve
character classes. A transition says whether a piece begins at the character just read
or at the one before it. A block of texts is cut into many short chunks that all advance
in step; since a chunk does not know the state it will be entered in, it carries the map
from every entry state to its exit state. The maps compose associatively, so a prefix
scan over them yields each chunk's true entry state in a logarithmic number of rounds,
and a second sweep emits the outputs. Where a piece begins, a second transducer, over
bytes, is in its first state whatever came before; the tokens emitted on its transitions
(see :mod:`token_transducer`) add up to the weight of the piece's path. Weights are kept
per task in a fixed-size table keyed by a 64-bit hash of the piece, so that a frequent
path is walked once.

Null texts count as empty; an empty text has 0 tokens. Each input row gives one output
row, repeated rows too. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm import byte_bpe
from snapdelta.llm.arrow_tasks import map_texts, slices_by_size
from snapdelta.llm.token_transducer import TokenTransducer, borders

BLOCK_CHARS = 500_000
FIRST_POWERS = 1 << 17
CHUNK = 128
CACHE_BITS = 20

# Character classes: letters (those that occur in contractions apart), digits, marks, spaces.
LETTER, SINGLE, LETTER_R, LETTER_V, LETTER_L, LETTER_E, NUMBER, MARK, QUOTE, SPACE, BLANK, END = range(12)
N_CLASSES = 12
# States: a piece must begin next; inside letters, digits, marks; inside white space of one
# or of more characters, the last a space or another blank; after a quote that began a
# piece, and after such a quote and r, v or l.
(FRESH, LETTERS, NUMBERS, MARKS, SPACE_1, BLANK_1, SPACE_N, BLANK_N, QUOTED, QUOTED_R, QUOTED_V,
 QUOTED_L) = range(12)
N_STATES = 12
HERE, BEFORE = 1, 2  # a piece begins at this character; at the one before


def _step(state: int, cls: int) -> tuple[int, int]:
    letter = cls <= LETTER_E
    inside = LETTERS if letter else NUMBERS if cls == NUMBER else MARKS
    begun = QUOTED if cls == QUOTE else inside
    if cls == END:
        return FRESH, HERE | (BEFORE if state in (QUOTED_R, QUOTED_V, QUOTED_L) else 0)
    if state in (QUOTED_R, QUOTED_V, QUOTED_L):
        if cls == (LETTER_L if state == QUOTED_L else LETTER_E):
            return FRESH, 0
        after, out = _step(LETTERS, cls)
        return after, out | BEFORE
    if cls in (SPACE, BLANK):
        if state in (SPACE_1, BLANK_1, SPACE_N, BLANK_N):
            return (SPACE_N if cls == SPACE else BLANK_N), 0
        return (SPACE_1 if cls == SPACE else BLANK_1), HERE
    if state == SPACE_1:
        return inside, 0
    if state == SPACE_N:
        return inside, BEFORE
    if state == BLANK_1:
        return begun, HERE
    if state == BLANK_N:
        return begun, HERE | BEFORE
    if state == QUOTED:
        if cls == SINGLE:
            return FRESH, 0
        if cls in (LETTER_R, LETTER_V, LETTER_L):
            return {LETTER_R: QUOTED_R, LETTER_V: QUOTED_V, LETTER_L: QUOTED_L}[cls], 0
        return inside, 0 if inside == MARKS else HERE
    if state == inside:
        return inside, 0
    return begun, HERE


def compiled() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output for class * N_STATES + state."""
    steps = [_step(s, c) for c in range(N_CLASSES) for s in range(N_STATES)]
    return (np.array([s for s, _ in steps], np.uint8), np.array([o for _, o in steps], np.uint8))


def entry_states(classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """State in which each chunk, a column of ``classes``, is entered; the first from FRESH."""
    length, chunks = classes.shape
    maps = np.tile(np.arange(N_STATES, dtype=np.uint8), (chunks, 1))
    base = classes.astype(np.int16) * N_STATES
    for j in range(length):
        maps = table[base[j][:, None] + maps]
    # Inclusive scan: afterwards maps[i] leads from the start of the block to the end of i.
    shift = 1
    while shift < chunks:
        maps = np.concatenate([maps[:shift], np.take_along_axis(maps[shift:], maps[:-shift], 1)])
        shift *= 2
    return np.concatenate([np.array([FRESH], np.uint8), maps[:-1, FRESH]])


def piece_starts(classes: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each character of a block that ends with END."""
    table, output = compiled()
    n = len(classes)
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    state = entry_states(steps, table)
    out = np.empty(steps.shape, np.uint8)
    for j in range(CHUNK):
        at = steps[j].astype(np.int16) * N_STATES + state
        out[j], state = output[at], table[at]
    out = np.ascontiguousarray(out.T).reshape(-1)
    starts = (out & HERE).astype(bool)
    starts[:-1] |= (out[1:] & BEFORE).astype(bool)
    return starts[:n]


class PieceScanner:
    """Finds the tokenizer's pieces in a block of texts and hashes each to 64 bits."""

    def __init__(self, path: str) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        self.bpe = byte_bpe.load(path)
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.classes = np.full(0x110001, 255, np.uint8)
        self.classes[0x110000] = END
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 0x3000, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15
        self.powers = np.cumprod(np.full(FIRST_POWERS, base, np.uint64))
        self.inverse = np.cumprod(np.full(FIRST_POWERS, pow(base, -1, 1 << 64), np.uint64))

    def _class_of(self, code: int) -> int:
        letter = chr(code)
        fixed = {" ": SPACE, "'": QUOTE, "r": LETTER_R, "v": LETTER_V, "l": LETTER_L, "e": LETTER_E}
        fixed |= dict.fromkeys("stmd", SINGLE)
        if letter in fixed:
            return fixed[letter]
        for beside, cls in (("a", LETTER), ("1", NUMBER), ("!", MARK)):
            if len(self.splitter.pre_tokenize_str(beside + letter + beside)) == 1:
                return cls
        return BLANK

    def _classify(self, codes: np.ndarray) -> np.ndarray:
        found = self.classes[codes]
        if (unknown := found == 255).any():
            for code in np.unique(codes[unknown]).tolist():
                self.classes[code] = self._class_of(code)
            found = self.classes[codes]
        return found

    def _grown(self, n: int) -> None:
        while len(self.powers) < n:
            for name in ("powers", "inverse"):
                known = getattr(self, name)
                setattr(self, name, np.concatenate([known, known * known[-1]]))

    def pieces(self, units: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The joined texts, and of each piece its hash, start, end and text.

        The texts must have no special tokens.
        """
        joined = "\0".join(units) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1) - 1
        codes[ends] = 0x110000
        starts = np.flatnonzero(piece_starts(self._classify(codes)))
        self._grown(len(codes))
        values = self.values[np.minimum(codes, len(self.values) - 1)]
        rare = np.flatnonzero(codes >= len(self.values))
        values[rare] = (codes[rare].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values * self.powers[: len(codes)], out=sums[1:])
        bounds = np.append(starts, len(codes))
        hashes = (sums[bounds[1:]] - sums[bounds[:-1]]) * self.inverse[starts]
        hashes ^= hashes >> np.uint64(29)
        real = codes[starts] != 0x110000
        unit = np.cumsum(~real) - (~real)
        return joined, hashes[real], starts[real], bounds[1:][real], unit[real]

    def ids_of(self, piece: bytes) -> list[int]:
        """Ids of one piece by the merge ranks."""
        rank = self.bpe.ranks.get(piece)
        return self.bpe.encoding._core_bpe.encode_single_piece(piece) if rank is None else [rank]


def slots(hashes: np.ndarray) -> np.ndarray:
    low = hashes & np.uint64((1 << CACHE_BITS) - 1)
    return ((hashes >> np.uint64(64 - CACHE_BITS)) ^ low).astype(np.int64)


class _Counter:
    def __init__(self, path: str) -> None:
        self.scanner = PieceScanner(path)
        self.transducer = TokenTransducer(borders(path))
        self.special = self.scanner.bpe.special
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.weights = np.zeros(1 << CACHE_BITS, np.int32)

    def block(self, units: list[str]) -> np.ndarray:
        """Tokens of each text; texts have no special tokens."""
        joined, hashes, first, last, unit = self.scanner.pieces(units)
        slot = slots(hashes)
        weights = self.weights[slot]
        missed = np.flatnonzero(self.keys[slot] != hashes)
        if len(missed):
            distinct, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[at]
            spans = zip(first[at].tolist(), last[at].tolist())
            walk = self.transducer.count
            new = np.fromiter((walk(joined[s:e].encode("utf-8", "surrogatepass")) for s, e in spans), np.int32, len(at))
            weights[missed] = new[back]
            self.keys[slot[at]], self.weights[slot[at]] = distinct, new
        return np.bincount(unit, weights, len(units)).astype(np.int64)

    def __call__(self, texts: list[str]) -> dict[str, np.ndarray]:
        units, owner, special = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            for part in byte_bpe.split_special(text, self.special):
                if isinstance(part, int):
                    special[i] += 1
                else:
                    units.append(part)
                    owner.append(i)
        counts = [self.block(units[a:b]) for a, b in slices_by_size(units, BLOCK_CHARS)]
        total = np.bincount(owner, np.concatenate(counts), len(texts)) if counts else 0
        return {"n_tokens": special + np.asarray(total).astype(np.int64)}


def count_tokens(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    tokenizer_path: str | None = None,
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row, in one pass without a shuffle."""
    path = tokenizer_path or byte_bpe.default_path()
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = df.select(F.col(id_col), F.col(text_col).alias("_whole"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = map_texts(
        sized, "_whole", [id_col, "n_bytes"], lambda: _Counter(path),
        {"n_tokens": pa.int64()}, "n_tokens long",
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
