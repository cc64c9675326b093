"""Pre-tokens of a byte-level vocabulary: the matches of ``public_tokenizers.PATTERN``, found for a whole piece of texts at once.

Character classes are looked up in a table, and the pattern's rules are applied to runs of one class: a run takes the one blank before
it; of white space before other text the last character stands alone; and the seven English contractions are cut where the pattern cuts
them. Distinct pre-tokens are then numbered, so that a step per pre-token runs once for all its copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from pulsegrid.llm.textbatch import Texts, pieces, span_hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Fixed by the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@dataclass(frozen=True)
class PreTokens:
    """Pre-tokens of ``texts`` in order: their rows, and for each the number of its distinct form in ``forms``."""

    texts: Texts
    row: np.ndarray
    form: np.ndarray
    forms: list[bytes]


@cache
def classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name, kind in (("L", LETTER), ("N", NUMBER)):
        for m in regex.finditer(rf"\p{{{name}}}+", everything):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[WHITE_SPACE] = SPACE
    return table


def _starts(chars: np.ndarray, row_starts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts; chars: code points of all rows, row_starts: of non-empty rows."""
    n = len(chars)
    kind = classes()[chars]
    cut = np.zeros(n + 1, dtype=bool)
    cut[row_starts] = cut[n] = True
    opens = cut[:n].copy()
    opens[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], n)
    of = kind[begin]
    starts = np.zeros(n, dtype=bool)

    space = of == SPACE
    starts[begin[space]] = True
    inner = space & ~cut[end]
    starts[end[inner] - 1] = True

    before = np.where(cut[begin], 0, chars[begin - 1])
    free = ~space & (before != 0x20)
    starts[begin[free]] = True

    tick = np.flatnonzero(free & (end - begin == 1) & (chars[begin] == ord("'")) & ~cut[end])
    tick = tick[of[np.minimum(tick + 1, len(of) - 1)] == LETTER]
    if len(tick):
        at, length = end[tick], end[tick + 1] - end[tick]
        one, two = chars[at], np.where(length > 1, chars[np.minimum(at + 1, n - 1)], 0)
        pair = lambda a, b: (one == ord(a)) & (two == ord(b))
        taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(pair("r", "e") | pair("v", "e") | pair("l", "l"), 2, 0))
        starts[at[taken > 0]] = False
        more = (taken > 0) & (length > taken)
        starts[(at + taken)[more]] = True
    return starts


def spans(column: pa.Array) -> Iterator[tuple[Texts, np.ndarray, np.ndarray]]:
    """(piece of texts, begin and end of its pre-tokens in bytes)."""
    for texts in pieces(column):
        data = texts.data
        head = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of characters
        if not len(head):
            yield texts, head, head
            continue
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
        filled = texts.starts[:-1][np.diff(texts.starts) > 0]
        begin = head[_starts(chars, np.searchsorted(head, filled))]
        yield texts, begin, np.append(begin[1:], len(data))


def pretokens(column: pa.Array) -> Iterator[PreTokens]:
    for texts, begin, end in spans(column):
        _, first, form = np.unique(span_hashes(texts.data, begin, end), return_index=True, return_inverse=True)
        yield PreTokens(texts, np.searchsorted(texts.starts, begin, side="right") - 1, form, _cut(texts, begin[first], end[first]))


def _cut(texts: Texts, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = texts.data.tobytes()
    return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]


class IdCache:
    """Ids of pre-tokens by the 64-bit hash of their bytes, in a table with one place per hash prefix; a later form takes a place over.

    ``encode`` turns one form into its ids. Hits cost a few array steps for a whole piece of texts.
    """

    def __init__(self, encode: Callable[[bytes], list[int]], dtype: str, bits: int = 20, limit: int = 1 << 23):
        self.encode, self.dtype, self.shift, self.limit = encode, dtype, np.uint64(64 - bits), limit
        self.keys = np.zeros(1 << bits, dtype=np.uint64)
        self.at, self.length = np.zeros(1 << bits, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype=dtype), 0

    def _add(self, forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self.encode(form) for form in forms]
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype=self.dtype, count=int(length.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(2 * (self.used + len(flat)), self.dtype)])
        at = self.used + np.cumsum(length) - length
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return at, length

    def find(self, texts: Texts, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``ids``, number of ids) of each pre-token, valid until the next call."""
        if self.used > self.limit:
            self.keys[:], self.used = 0, 0
        hashes = span_hashes(texts.data, begin, end) | np.uint64(1)
        place = (hashes >> self.shift).astype(np.int64)
        at, length = self.at[place], self.length[place].astype(np.int64)
        missing = np.flatnonzero(self.keys[place] != hashes)
        if len(missing):
            new, first, which = np.unique(hashes[missing], return_index=True, return_inverse=True)
            new_at, new_length = self._add(_cut(texts, begin[missing[first]], end[missing[first]]))
            at[missing], length[missing] = new_at[which], new_length[which]
            to = (new >> self.shift).astype(np.int64)
            self.keys[to], self.at[to], self.length[to] = new, new_at, new_length
        return at, length


class Memo:
    """Results by form in two generations of at most ``limit`` forms each; what is asked for again is kept. Long forms are not kept."""

    def __init__(self, work: Callable[[list[bytes]], Iterable], limit: int = 120_000, longest: int = 48):
        self.work, self.limit, self.longest = work, limit, longest
        self.new: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def many(self, forms: list[bytes]) -> list:
        """The results of all forms; ``work`` gets the unknown ones sorted, so that it can share what their prefixes have in common."""
        found = list(map(self.new.get, forms))
        unknown = []
        for at, value in enumerate(found):
            if value is None:
                value = found[at] = self.old.get(forms[at])
                if value is None:
                    unknown.append(at)
                else:
                    self.new[forms[at]] = value
        unknown.sort(key=forms.__getitem__)
        for at, value in zip(unknown, self.work([forms[i] for i in unknown])):
            found[at] = value
            if len(forms[at]) <= self.longest:
                self.new[forms[at]] = value
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        return found


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    at = 0
    while a[at] == b[at]:
        at += 1
    return at


def expand(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``offsets[i] .. offsets[i] + lengths[i]`` of all i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets - (ends - lengths), lengths) + np.arange(total)
