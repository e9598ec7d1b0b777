"""Byte-level BPE encoding and decoding that reuses content-defined chunks.

A rolling hash over the last 16 characters cuts each text wherever the hash meets a
fixed pattern, so equal passages of different documents are cut alike wherever they
stand. A chunk that was seen before in the task (a table of bounded size) is not encoded
again. Encoding chunks apart is wrong near the cuts, so each join is repaired: what
stands between the last safe place of the left chunk and the first safe place of the
right one is encoded anew, and the window grows over further chunks until it reaches a
safe place. A place is safe if a plain space or line feed follows a character that is no
white space: there the tokenizer's splitting rule always begins a new piece, whatever
stands around it, so both encodings agree from there on.

Reuse is per task on purpose: the encodings are larger than the texts, and moving them
between tasks costs more than encoding does. A lost task is simply run again.

Null texts count as empty; an empty text has no ids and decodes to an empty text. Rows
are independent, so ties and repeated rows give equal results. Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import re
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapdelta.llm import byte_bpe
from snapdelta.llm.arrow_tasks import map_texts, slices_by_size, small_batches
from snapdelta.llm.token_counts import CACHE_BITS, PieceScanner, slots

BLOCK_CHARS = 125_000
CUT_BITS = 11  # a cut every 2048 characters in the mean
POOL_IDS = 4_000_000
REUSE_CHARS = 4_000_000
_SAFE = re.compile(r"\S[ \n]")
_SAFE_REVERSED = re.compile(r"[ \n]\S")


def cut_places(text: str) -> np.ndarray:
    """Where the rolling hash of the 16 characters before a place cuts the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    factor = 0xBF58476D1CE4E5B9
    for width in (1, 2, 4, 8):
        if len(mixed) <= width:
            break
        shifted = mixed[:-width] * np.uint64(pow(factor, width, 1 << 64))
        mixed[width:] += shifted
    return np.flatnonzero(mixed >> np.uint64(64 - CUT_BITS) == 0) + 1


class _PieceIds:
    """Ids of many texts at once; the ids of pieces stay in tables of a fixed size."""

    def __init__(self, path: str) -> None:
        self.scanner = PieceScanner(path)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.begin = np.zeros(1 << CACHE_BITS, np.int32)
        self.size = np.zeros(1 << CACHE_BITS, np.int32)
        self.pool, self.used = np.empty(POOL_IDS, np.int32), 0

    def _add(self, joined: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Stores the ids of pieces in the pool; where each begins and how many it has."""
        ids_of = self.scanner.ids_of
        found = [ids_of(joined[s:e].encode("utf-8", "surrogatepass")) for s, e in spans]
        size = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter((i for x in found for i in x), np.int32, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(len(self.pool) + len(flat), np.int32)])
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(size) - size
        self.used += len(flat)
        return begin, size

    def __call__(self, units: list[str]) -> list[np.ndarray]:
        done = []
        for a, b in slices_by_size(units, BLOCK_CHARS):
            done += self._block(units[a:b])
        return done

    def _block(self, units: list[str]) -> list[np.ndarray]:
        if self.used > POOL_IDS // 2:
            self._clear()
        joined, hashes, first, last, unit = self.scanner.pieces(units)
        slot = slots(hashes)
        begin, size = self.begin[slot], self.size[slot]
        missed = np.flatnonzero(self.keys[slot] != hashes)
        if len(missed):
            distinct, at, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[at]
            new_begin, new_size = self._add(joined, list(zip(first[at].tolist(), last[at].tolist())))
            begin[missed], size[missed] = new_begin[back], new_size[back]
            self.keys[slot[at]], self.begin[slot[at]], self.size[slot[at]] = distinct, new_begin, new_size
        ends = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        per_unit = np.bincount(unit, size, len(units)).astype(np.int64)
        return np.split(ids, np.cumsum(per_unit)[:-1])


_NONE = np.empty(0, np.int32)


class _Encoder:
    def __init__(self, path: str) -> None:
        self.encode = _PieceIds(path)
        self.special = self.encode.scanner.bpe.special
        self.chunks: dict[str, tuple[str, np.ndarray, str] | None] = {}
        self.held = 0

    def _learn(self, chunks: list[str]) -> None:
        """Encodes the middles of chunks that are not held yet.

        Held of a chunk: its text up to the first safe place, the ids of the middle, and
        its text from the last safe place; nothing if it has no safe place.
        """
        if self.held > REUSE_CHARS:
            self.chunks, self.held = {}, 0
        new = [c for c in dict.fromkeys(chunks) if c not in self.chunks]
        places = []
        for chunk in new:
            self.held += len(chunk) + 200
            self.chunks[chunk] = None
            if first := _SAFE.search(chunk):
                last = len(chunk) - _SAFE_REVERSED.search(chunk[::-1]).start() - 1
                places.append((chunk, first.start() + 1, last))
        for (chunk, a, b), ids in zip(places, self.encode([c[a:b] for c, a, b in places])):
            self.chunks[chunk] = (chunk[:a], ids.copy(), chunk[b:])

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        segments = [s for text in texts for s in (*byte_bpe.split_special(text, self.special), None)]
        plain = [s for s in segments if isinstance(s, str)]
        ends = np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))
        cuts = cut_places("".join(plain))
        starts = ends - np.fromiter(map(len, plain), np.int64, len(plain))
        low, high = np.searchsorted(cuts, starts, "right"), np.searchsorted(cuts, ends, "left")
        split = []
        for text, start, a, b in zip(plain, starts.tolist(), low.tolist(), high.tolist()):
            at = [0, *(cuts[a:b] - start).tolist(), len(text)]
            split.append([text[x:y] for x, y in zip(at, at[1:]) if x < y])
        self._learn([c for chunks in split for c in chunks])
        # Of each text: texts to encode anew, in turn with the ids of middles.
        parts: list[list[str | np.ndarray]] = []
        own: list[str | np.ndarray] = []
        at = iter(split)
        for segment in segments:
            if segment is None:
                parts.append(own)
                own = []
            elif isinstance(segment, int):
                own.append(np.array([segment], np.int32))
            else:
                window: list[str] = []
                for chunk in next(at):
                    if (known := self.chunks[chunk]) is None:
                        window.append(chunk)
                    else:
                        own += ["".join([*window, known[0]]), known[1]]
                        window = [known[2]]
                own.append("".join(window))
        repaired = iter(self.encode([x for part in parts for x in part if isinstance(x, str)]))
        return [np.concatenate([_NONE, *(next(repaired) if isinstance(x, str) else x for x in part)]) for part in parts]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [x for a, b in slices_by_size(texts, BLOCK_CHARS) for x in self._block(texts[a:b])]

    def __call__(self, texts: list[str]) -> dict[str, pa.Array]:
        found = self.ids(texts)
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        values = np.concatenate([_NONE, *found])
        return {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
) -> DataFrame:
    """``id_col, ids array<int>``: the ids the tokenizers library gives, without added ones."""
    path = tokenizer_path or byte_bpe.default_path()
    return map_texts(df, text_col, [id_col], lambda: _Encoder(path), {"ids": pa.list_(pa.int32())}, "ids array<int>")


class _Decoder:
    def __init__(self, path: str) -> None:
        table = [*byte_bpe.load(path).token_bytes, b""]  # the last for unknown ids
        self.lengths = np.fromiter(map(len, table), np.int64, len(table))
        self.begins = np.append(0, np.cumsum(self.lengths)[:-1])
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def texts(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of consecutive runs of ids."""
        lengths = self.lengths
        ids = np.where((ids < 0) | (ids >= len(lengths)), len(lengths) - 1, ids)
        found, at = [], 0
        for size in sizes.tolist():
            own = ids[at : at + size]
            at += size
            n = lengths[own]
            ends = np.cumsum(n)
            places = np.arange(int(ends[-1]) if size else 0) + np.repeat(self.begins[own] - (ends - n), n)
            found.append(self.bytes[places].tobytes().decode("utf-8", "replace"))
        return found


def decode(df: DataFrame, keep: list[str], ids_col: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """``keep`` beside ``decoded``, the text of the ids with special tokens spelled out.

    Null ids count as none. Bytes that are no UTF-8 become the replacement character, as
    the library does; ids the vocabulary lacks are left out.
    """
    path = tokenizer_path or byte_bpe.default_path()
    kept = list(keep)
    plain = df.select(*kept, F.col(ids_col).alias("_ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.select(*kept).schema)

    def run(batches):
        decoder = None
        for batch in (small for whole in batches for small in small_batches(whole)):
            decoder = decoder or _Decoder(path)
            column = batch.column(len(kept))
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            texts = decoder.texts(column.flatten().fill_null(-1).to_numpy(zero_copy_only=False), sizes)
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "decoded"])

    return plain.mapInArrow(run, f"{schema}, decoded string")


class _Digester:
    """Encodes texts, decodes the ids, and digests both."""

    def __init__(self, path: str) -> None:
        self.encoder, self.decoder = _Encoder(path), _Decoder(path)
        self.names = [str(i) for i in range(len(self.decoder.lengths))]

    def __call__(self, texts: list[str]) -> dict[str, list]:
        found = self.encoder.ids(texts)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        decoded = self.decoder.texts(np.concatenate([_NONE, *found]), sizes)
        names = self.names
        return {
            "n_tokens": sizes,
            "ids_sha256": [sha256(",".join([names[i] for i in ids.tolist()]).encode()).hexdigest() for ids in found],
            "decoded_sha256": [sha256(text.encode()).hexdigest() for text in decoded],
        }


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """``id_col, n_tokens, ids_sha256, decoded_sha256``: each text encoded, then decoded.

    Both steps run in one task, so that the ids, larger than the texts, never leave it.
    """
    path = tokenizer_path or byte_bpe.default_path()
    return map_texts(
        df, text_col, [id_col], lambda: _Digester(path),
        {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()},
        "n_tokens long, ids_sha256 string, decoded_sha256 string", release_after=True,
    )
