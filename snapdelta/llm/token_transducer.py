"""A byte-level BPE vocabulary compiled into a transducer that counts tokens.

The transducer reads a piece byte by byte. A transition carries the number of tokens by
which the encoding of the bytes read so far grows, which may be negative where a longer
token takes the place of several; the weights along a piece's path add up to its number
of tokens.

Two facts about merging in order of rank make the state finite. A sequence of tokens is
the encoding of its bytes if and only if no merge ever crosses the border of two
neighbours, which the two tokens alone decide. And so each prefix of a piece has exactly
one last token, the one that fits the last token of the prefix before it. A state
therefore holds the longest end of what was read that some token begins with, and for
each place in it where a token may have begun the last token before that place and the
number of tokens up to there, relative to the end.

There are far too many states to list beforehand, so a transition is compiled when it is
first taken. Past a bound all compiled ones are forgotten, which changes no result. A
token that merging cannot produce is never emitted, as in the tokenizers library.
"""

from __future__ import annotations

from functools import lru_cache

from snapdelta.llm import byte_bpe

MOST_STATES = 200_000
BEGIN, UNUSED = -1, -2  # no token yet; a place where no token may begin

Spine = list[tuple[int, float]]


class Borders:
    """Which tokens can stand beside each other, and which can occur at all."""

    def __init__(self, bpe: byte_bpe.ByteBpe) -> None:
        self.merged = {(left, right): token for left, right, token in bpe.merges.tolist()}
        self.parts = {token: pair for pair, token in self.merged.items()}
        if len(self.parts) != len(self.merged):
            raise ValueError("a token of the vocabulary is the result of two merges")
        self.spines: tuple[dict[int, Spine], dict[int, Spine]] = ({}, {})
        occurs: dict[int, bool] = {}
        for token, (left, right) in sorted(self.parts.items()):
            occurs[token] = occurs.get(left, True) and occurs.get(right, True) and not self._crossed(left, right, whole=False)
        self.tokens = {
            text: token for text, token in bpe.ranks.items()
            if (len(text) == 1 or token in self.parts) and occurs.get(token, True)
        }
        self.beginnings = {text[:n] for text in self.tokens for n in range(1, len(text))}

    def _spine(self, token: int, side: int) -> Spine:
        """The tokens that stand at one end of a token while it is merged, last ones first,
        each with the merge that ends it."""
        if (found := self.spines[side].get(token)) is None:
            found = self.spines[side][token] = [(token, float("inf"))]
            inner = token
            while inner in self.parts:
                inner, ends = self.parts[inner][side], inner
                found.append((inner, ends))
        return found

    def _crossed(self, left: int, right: int, whole: bool = True) -> bool:
        """Whether some merge crosses the border. Of equal merges the leftmost is first.

        Without ``whole``, that of the two whole tokens does not count.
        """
        merged, beside = self.merged.get, self._spine(right, 0)
        for a, a_ends in self._spine(left, 1):
            for b, b_ends in beside:
                merge = merged((a, b))
                if merge is not None and merge < a_ends and merge <= b_ends and (whole or (a, b) != (left, right)):
                    return True
        return False

    def fits(self, left: int, right: int) -> bool:
        return not self._crossed(left, right)


@lru_cache(maxsize=2)
def borders(path: str) -> Borders:
    return Borders(byte_bpe.load(path))


class TokenTransducer:
    def __init__(self, rules: Borders, most_states: int = MOST_STATES) -> None:
        self.rules = rules
        self.most_states = most_states
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple, int] = {}
        self.states: list[tuple[bytes, tuple[int, ...], tuple[int, ...]]] = []
        self.moves: list[dict[int, tuple[int, int]]] = []
        self.fitting: dict[tuple[int, int], bool] = {}
        self.begin = self._number((b"", (BEGIN,), (0,)))

    def _number(self, state: tuple[bytes, tuple[int, ...], tuple[int, ...]]) -> int:
        number = self.known.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            self.moves.append({})
        return number

    def _fits(self, left: int, right: int) -> bool:
        if left == BEGIN:
            return True
        found = self.fitting.get((left, right))
        if found is None:
            found = self.fitting[left, right] = self.rules.fits(left, right)
        return found

    def _compile(self, at: int, byte: int) -> tuple[int, int]:
        """Next state and weight of one transition."""
        end, last, count = self.states[at]
        end += bytes((byte,))
        tokens, beginnings = self.rules.tokens, self.rules.beginnings
        weight = token = None
        after_last: list[int] = []
        after_count: list[int] = []
        for i, before in enumerate(last):
            rest = end[i:]
            if token is None and before != UNUSED and (t := tokens.get(rest)) is not None and self._fits(before, t):
                token, weight = t, count[i] + 1
            if before != UNUSED and rest in beginnings:
                after_last.append(before)
                after_count.append(count[i])
            elif after_last:
                after_last.append(UNUSED)
                after_count.append(UNUSED)
        counts = [0 if a == UNUSED else n - weight for a, n in zip(after_last, after_count)]
        after = (end[len(end) - len(after_last) :], (*after_last, token), (*counts, 0))
        move = self.moves[at][byte] = (self._number(after), weight)
        return move

    def count(self, piece: bytes) -> int:
        """Number of tokens of one piece."""
        at, total = self.begin, 0
        for byte in piece:
            move = self.moves[at].get(byte)
            if move is None:
                if len(self.states) > self.most_states:
                    state = self.states[at]
                    self._forget()
                    at = self._number(state)
                move = self._compile(at, byte)
            at, weight = move
            total += weight
        return total
