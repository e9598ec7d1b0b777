"""A byte-level BPE vocabulary, read from the file of a public tokenizer.

The driver only passes the path around; each task reads the file once. The vocabulary's
own splitting pattern and merge ranks are taken from the file, so nothing of it is
stored here.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import tiktoken

# The splitting rule of the byte-level vocabularies, a fixed value of their format.
SPLIT_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself if printable, else one from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in set(printable)]
    return letters | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class ByteBpe:
    ranks: dict[bytes, int]
    special: dict[str, int]
    encoding: tiktoken.Encoding
    merges: np.ndarray  # left, right and resulting id of each merge, in order

    @property
    def token_bytes(self) -> list[bytes]:
        found = {i: b for b, i in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        return [found.get(i, b"") for i in range(max(found) + 1)]


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """Ranks, special tokens and an encoder that works without special tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space"):
        raise ValueError(f"{os.path.basename(path)} is not a byte-level BPE without prefix space")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _bytes_of_letters()
    ranks = {
        bytes(letters[c] for c in token): i
        for token, i in model["vocab"].items()
        if token not in special
    }
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merged]
    if order != sorted(order):
        raise ValueError("merge order and token ids disagree")
    encoding = tiktoken.Encoding(
        "byte_bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    vocab = model["vocab"]
    merges = np.array([(vocab[a], vocab[b], i) for (a, b), i in zip(merged, order)], np.int32).reshape(-1, 3)
    return ByteBpe(ranks, special, encoding, merges)


def split_special(text: str, special: dict[str, int]) -> list[str | int]:
    """Texts and ids of special tokens in turn, as the tokenizers library splits a text by default."""
    parts: list[str | int] = [text]
    for content, token_id in special.items():
        split: list[str | int] = []
        for part in parts:
            if isinstance(part, int) or content not in part:
                split.append(part)
                continue
            for k, piece in enumerate(part.split(content)):
                if k:
                    split.append(token_id)
                if piece:
                    split.append(piece)
        parts = split
    return parts
