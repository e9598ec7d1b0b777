"""The counting transducer against merging by hand and against the library."""

import random

import pytest
from tokenizers import Tokenizer

from snapdelta.llm import byte_bpe
from snapdelta.llm.token_transducer import TokenTransducer, borders


@pytest.fixture(scope="module")
def path():
    return byte_bpe.default_path()


def merged_by_hand(bpe, rank: dict, piece: bytes) -> int:
    """Merges the neighbours of least rank, leftmost first, until none is left."""
    tokens = [bpe.ranks[bytes((byte,))] for byte in piece]
    while found := min(((rank[p], i) for i, p in enumerate(zip(tokens, tokens[1:])) if p in rank), default=None):
        tokens[found[1] : found[1] + 2] = [found[0]]
    return len(tokens)


def pieces(seed: int, count: int, tokens: list[bytes]) -> list[bytes]:
    rng = random.Random(seed)
    kinds = [
        lambda n: bytes(rng.choice(b"abcdeinorst") for _ in range(n)),
        lambda n: bytes(rng.choice(b"aA= -") for _ in range(n)),
        lambda n: bytes(rng.randrange(256) for _ in range(n)),
        lambda n: rng.choice([b"a", b" ", b"=", b"-", b"\n", b"ab", "漢字".encode(), "é".encode()]) * n,
        lambda n: b"".join(rng.choice(tokens) for _ in range(n % 5 + 1)),
    ]
    return [rng.choice(kinds)(rng.choice([1, 2, 3, 5, 8, 13, 40, 90])) for _ in range(count)]


def test_counts_equal_merging_by_hand(path):
    bpe = byte_bpe.load(path)
    rank = {(left, right): token for left, right, token in bpe.merges.tolist()}
    transducer = TokenTransducer(borders(path))
    for piece in [b"", *pieces(1, 1500, list(bpe.ranks))]:
        assert transducer.count(piece) == merged_by_hand(bpe, rank, piece), piece


def test_every_token_is_one_token(path):
    transducer = TokenTransducer(borders(path), most_states=1 << 30)
    assert {transducer.count(text) for text in borders(path).tokens} == {1}


def test_counts_equal_the_library(path):
    library = Tokenizer.from_file(path)
    library.pre_tokenizer.use_regex = False  # a text is one piece
    transducer = TokenTransducer(borders(path))
    texts = ["donaudampfschifffahrt" * 40, " " * 3000, "aaab" * 999, "=-" * 777, "ñandú漢😀" * 60, "0123456789" * 300]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert transducer.count(text.encode()) == len(want), text[:20]


def test_forgetting_changes_no_count(path):
    tokens = list(byte_bpe.load(path).ranks)
    some = pieces(2, 400, tokens)
    small, large = (TokenTransducer(borders(path), n) for n in (30, 1 << 30))
    assert [small.count(p) for p in some] == [large.count(p) for p in some]
    assert len(small.states) <= 32 < len(large.states)


def test_a_long_piece_needs_few_states(path):
    transducer = TokenTransducer(borders(path))
    assert transducer.count(b"ab" * 200_000) > 0
    assert len(transducer.states) < 1000
