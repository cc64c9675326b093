"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has exactly one encoding, so it has exactly one last token: the token ``t`` that ends there, whose
neighbour is the last token of the prefix before ``t``, and whose merges are not undercut by a merge across the boundary between the two.
Storing that token per prefix gives the encoding of every prefix at once. Appending bytes only adds entries, and after an edit the entries
before it stay, while those behind it are taken over as soon as they agree over the length of the longest token.

``encode`` and ``decode`` work on DataFrames in one pass without a shuffle. Null texts count as empty; other columns are kept, and rows are
neither dropped nor joined, so repeated rows and repeated ids give repeated results.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.pretokens import Memo, PreTokens, common_prefix, expand, pretokens
from pulsegrid.llm.textbatch import per_batch

VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO_PAIRS = 400_000


class Vocabulary:
    """Tokens by rank, and the questions that the dynamic programme asks of them."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[int, bool] = {}
        size = max(self.tokens) + 1
        self.lengths = np.array([len(self.tokens.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.usable: dict[bytes, int | None] = {}
        self.memo = Memo(self.encode_pieces)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None if merges never make it."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.tokens[token]]
            while len(parts) > 2:
                ranks = [self.ranks.get(self.tokens[a] + self.tokens[b], token) for a, b in zip(parts, parts[1:])]
                best = min(ranks)
                if best >= token:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [best]
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def token(self, data: bytes) -> int | None:
        """The token of these bytes, if there is one that merges make."""
        try:
            return self.usable[data]
        except KeyError:
            rank = self.ranks.get(data)
            if rank is None:
                return None
            self.usable[data] = rank if len(data) == 1 or self.halves(rank) else None
            return self.usable[data]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: no merge across their boundary comes before a merge inside them."""
        known = self._fits.get(left << 32 | right)
        if known is None:
            if len(self._fits) >= MEMO_PAIRS:
                self._fits.clear()
            known = self._fits[left << 32 | right] = self._undo(left, right)
        return known

    def extend(self, data: bytes, last: list[int]) -> None:
        """Add the last tokens of the prefixes of ``data`` that are longer than those in ``last``."""
        token_of, fits, known, longest = self.token, self.fits, self._fits, self.longest
        usable, ranks = self.usable, self.ranks
        for end in range(len(last) + 1, len(data) + 1):
            for begin in range(end - 1, max(0, end - longest) - 1, -1):
                part = data[begin:end]
                if part not in ranks:
                    continue
                token = usable[part] if part in usable else token_of(part)
                if token is None:
                    continue
                if begin == 0:
                    break
                before = last[begin - 1]
                fit = known.get(before << 32 | token)
                if fit or fit is None and fits(before, token):
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
            last.append(token)

    def _undo(self, left: int, right: int) -> bool:
        """Take the merges at the boundary back, the last one first; a boundary merge of lower rank would have come before it."""
        tokens, ranks = self.tokens, self.ranks
        bound = len(ranks) + 1
        while True:
            across = ranks.get(tokens[left] + tokens[right])
            if across is not None and across < bound:
                return False
            of_left = left if len(tokens[left]) > 1 else -1
            of_right = right if len(tokens[right]) > 1 else -1
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:
                bound, left = left, self.halves(left)[1]
            else:  # of two equal merges the left one is made first, so a boundary merge of this very rank comes before it
                bound, right = right + 1, self.halves(right)[0]

    def walk(self, last: list[int]) -> list[int]:
        """The encoding of the prefix that ``last`` covers, from its end backwards."""
        at, found, tokens = len(last), [], self.tokens
        while at:
            found.append(last[at - 1])
            at -= len(tokens[found[-1]])
        return found[::-1]

    def encode_pieces(self, ordered: list[bytes]) -> Iterator[tuple[int, ...]]:
        """The ids of pre-tokens in sorted order; entries of a prefix shared with the one before are used again.

        A pre-token that is a token itself is that token.
        """
        before, last = b"", []
        for piece in ordered:
            whole = self.ranks.get(piece)
            if whole is not None:
                yield (whole,)
                continue
            del last[common_prefix(before, piece) :]
            self.extend(piece, last)
            before = piece
            yield tuple(self.walk(last))


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; no stored entry changes."""
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def edit(self, begin: int, end: int, new: bytes) -> int:
        """Replace ``data[begin:end]``; the number of entries that were worked out anew."""
        v, old = self.vocabulary, self.last
        self.data = self.data[:begin] + new + self.data[end:]
        self.last, shift, same = old[:begin], len(new) - (end - begin), 0
        at = begin
        while at < len(self.data):
            at += 1
            v.extend(self.data[:at], self.last)
            same = same + 1 if at > begin + len(new) and self.last[-1] == old[at - shift - 1] else 0
            if same >= v.longest:  # the next entry depends on these only
                self.last += old[at - shift :]
                return at - begin
        return at - begin

    def ids(self, length: int | None = None) -> list[int]:
        """The encoding of the prefix of ``length`` bytes, or of all."""
        return self.vocabulary.walk(self.last[:length])


@cache
def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(path)


def encoded(v: Vocabulary, found: PreTokens) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a piece of texts, and the position where each row's ids start (n + 1 of them)."""
    ids = v.memo.many(found.forms)
    lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    flat = np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(lengths.sum()))
    counts = lengths[found.form]
    every = flat[expand((np.cumsum(lengths) - lengths)[found.form], counts)]
    per_row = np.bincount(found.row, weights=counts, minlength=found.texts.n).astype(np.int64)
    return every, np.concatenate([[0], np.cumsum(per_row)])


def decoded(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    """The bytes of a run of ids."""
    return v.bytes[expand(v.offsets[ids], v.lengths[ids])]


def encode(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Each row's ``ids`` (array of int) beside the columns to keep (default: all but the text)."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    path = path or public_tokenizers.path(VOCABULARY)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "ids array<int>"])

    def step(batch: pa.RecordBatch):
        v = vocabulary(path)
        for found in pretokens(batch.column(len(keep))):
            ids, at = encoded(v, found)
            rows = batch.slice(found.texts.first, found.texts.n)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], lists], names=[*keep, "ids"])

    return per_batch(df, [*keep, text], schema, step)


def decode(df: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """``text`` (binary) of each row's ids beside its other columns; null ids count as none."""
    keep = [c for c in df.columns if c != ids]
    path = path or public_tokenizers.path(VOCABULARY)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "text binary"])

    def step(batch: pa.RecordBatch):
        v = vocabulary(path)
        text = [decoded(v, np.asarray(row.values, dtype=np.int64)).tobytes() if row.is_valid else b"" for row in batch.column(len(keep))]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(text, pa.binary())], names=[*keep, "text"])

    return per_batch(df, [*keep, ids], schema, step)


def encoding_digests(df: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None, ids: bool = False) -> DataFrame:
    """Per row its id, the number of ids, SHA-256 of the ids (little-endian, 32 bits) and of the bytes they decode to; if asked for, the ids."""
    path = path or public_tokenizers.path(VOCABULARY)
    names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if ids else [])]
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string{', ids array<int>' if ids else ''}"

    def digests(whole: bytes, cuts: list[int]) -> pa.Array:
        return pa.array([hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])], pa.string())

    def step(batch: pa.RecordBatch):
        v = vocabulary(path)
        for found in pretokens(batch.column(1)):
            flat, at = encoded(v, found)
            text_at = np.concatenate([[0], np.cumsum(v.lengths[flat])])[at]
            columns = [
                batch.column(0).slice(found.texts.first, found.texts.n), pa.array(np.diff(at)),
                digests(flat.astype("<u4").tobytes(), (4 * at).tolist()), digests(decoded(v, flat).tobytes(), text_at.tolist()),
            ]
            if ids:
                columns.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return per_batch(df, [id_column, text], schema, step)
