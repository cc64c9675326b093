"""Token counts under a unigram vocabulary, by dynamic programming on a trie.

The best segmentation of a pre-token is the one with the least total cost, and of equally cheap ones the one with the fewest tokens. The
forward cost of a prefix does not depend on what follows, so distinct pre-tokens are put into a trie (walked in sorted order, which visits it
depth first) and each node's forward cost is computed once for all pre-tokens below it. The token count at a pre-token's terminal node is
stored, and a document's count is the sum over its pre-tokens.

Costs are integers, so no rounding decides a tie: token ``r`` of a rank file costs ``round(10^6 * ln(r + 2))``, the code length of Zipf's law
over ranks up to a constant. That rule stands in for trained unigram probabilities, as tokenizers are not trained here. Every byte is a token,
so every text has a segmentation.

Null and empty texts count 0. Rows are neither dropped nor joined: repeated rows give repeated results, and other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.pretokens import Memo, common_prefix, pretokens
from pulsegrid.llm.textbatch import per_batch

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A cost and a count in one integer, so that the smaller sum is the cheaper segmentation and, of equals, the shorter one.
ONE_TOKEN, COST = 1, 1 << 32


class Trie:
    """Forward costs along the path to the node that was visited last, and the memo of terminal counts."""

    def __init__(self, path: str):
        self.cost: dict[bytes, int] = {}
        with open(path, "rb") as file:
            for token, rank in (line.split() for line in file if line.strip()):
                self.cost[base64.b64decode(token)] = round(1e6 * log(int(rank) + 2)) * COST + ONE_TOKEN
        self.longest = max(map(len, self.cost))
        #: How long a token that ends with this byte can be: no longer suffix need be looked up.
        self.reach = [0] * 256
        for token in self.cost:
            self.reach[token[-1]] = max(self.reach[token[-1]], len(token))
        self.memo = Memo(self.terminal_counts)

    def terminal_counts(self, ordered: list[bytes]) -> Iterator[int]:
        """Counts of pre-tokens in sorted order; nodes that two neighbours share are not computed again."""
        cost, reach = self.cost, self.reach
        before, forward = b"", [0]
        for form in ordered:
            del forward[common_prefix(before, form) + 1 :]
            for end in range(len(forward), len(form) + 1):
                best = None
                for begin in range(max(0, end - reach[form[end - 1]]), end):
                    own = cost.get(form[begin:end])
                    if own is not None and (best is None or forward[begin] + own < best):
                        best = forward[begin] + own
                forward.append(best)
            before = form
            yield forward[-1] % COST


@cache
def trie(path: str) -> Trie:
    """One per worker process."""
    return Trie(path)


def token_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row its id, the number of pre-tokens, of tokens and of bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    names = [id_column, "n_pretokens", "n_tokens", "n_bytes"]
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, n_pretokens bigint, n_tokens bigint, n_bytes bigint"

    def step(batch: pa.RecordBatch):
        known = trie(path)
        for found in pretokens(batch.column(1)):
            counts = np.fromiter(known.memo.many(found.forms), dtype=np.int64, count=len(found.forms))
            n = found.texts.n
            tokens = np.bincount(found.row, weights=counts[found.form], minlength=n).astype(np.int64)
            columns = [np.bincount(found.row, minlength=n), tokens, np.diff(found.texts.starts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(found.texts.first, n), *map(pa.array, columns)], names=names)

    return per_batch(docs, [id_column, text], schema, step)
