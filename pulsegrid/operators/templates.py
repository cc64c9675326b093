"""Message templates by leaders in a tree of fixed depth.

Masked message forms are dealt to leaves by their number of words and their leading words. In a leaf, forms go by frequency (of equally
frequent ones the greater text first): a form joins the first leader that agrees with it in enough positions, or becomes a leader itself.
Where the members of a group differ, its template has a wildcard.

A leaf is settled by one grouped step. A leaf with more than ``LEAF_FORMS`` forms is settled in blocks of that many: the leaders of a block
are found in one step, all later forms of the leaf are compared with them side by side in chunks of the same size, and those that joined
none go on. Every block settles all its forms, so the rounds follow from the number of leaders, not one by one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.logtext import WILDCARD, mask_variables
from pulsegrid.operators.ordered import key_sizes, positions
from pulsegrid.storage import durable

SIMILARITY = 0.5
LEAD_WORDS = 1
LEAF_FORMS = 20_000

_LEAF = ["size", "lead"]


class Leaders:
    """Leaders of one leaf, found by the words they share with a form.

    Two forms that agree in ``need`` of ``size`` positions share one of the ``size - need + 1`` rarest words of either, by any fixed order
    of the words. Leaders are listed under those, so a form meets only the leaders that it may agree with, and misses none.
    """

    def __init__(self, size: int, similarity: float, forms: Iterable[Sequence[str]]):
        self.need = math.ceil(similarity * size)
        self.kept = size - self.need + 1
        self.counts = Counter(pair for words in forms for pair in enumerate(words))
        self.numbers: dict[str, int] = {}
        self.listed: dict[tuple[int, str], list[int]] = {}
        self.rows = np.zeros((16, size), dtype=np.int64)
        self.n = 0

    def _numbered(self, words: Sequence[str]) -> np.ndarray:
        return np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], dtype=np.int64)

    def _rarest(self, words: Sequence[str]) -> list[tuple[int, str]]:
        return sorted(enumerate(words), key=lambda pair: (self.counts[pair], pair))[: self.kept]

    def first_near(self, words: Sequence[str]) -> int | None:
        """Number of the earliest leader that the form agrees with."""
        if self.need <= 0:
            return 0 if self.n else None
        met = sorted({i for pair in self._rarest(words) for i in self.listed.get(pair, ())})
        if not met:
            return None
        near = np.flatnonzero((self.rows[met] == self._numbered(words)).sum(axis=1) >= self.need)
        return met[near[0]] if near.size else None

    def add(self, words: Sequence[str]) -> None:
        if self.n == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n] = self._numbered(words)
        for pair in self._rarest(words):
            self.listed.setdefault(pair, []).append(self.n)
        self.n += 1


def cluster_forms(forms: Sequence[tuple[int, str, Sequence[str]]], similarity: float) -> list[str]:
    """The leader of each (n, form, words) of one leaf."""
    leaders, names = Leaders(len(forms[0][2]), similarity, (words for _, _, words in forms)), []
    out = [""] * len(forms)
    for i in sorted(range(len(forms)), key=lambda i: forms[i][:2], reverse=True):
        near = leaders.first_near(forms[i][2])
        if near is None:
            leaders.add(forms[i][2])
            names.append(forms[i][1])
            near = len(names) - 1
        out[i] = names[near]
    return out


def message_forms(messages: DataFrame, message: str = "message", lead_words: int = LEAD_WORDS) -> DataFrame:
    """Masked forms with their count, words and leaf."""
    counted = messages.where(F.length(message) > 0).groupBy(mask_variables(F.col(message)).alias("form")).agg(F.count(F.lit(1)).alias("n"))
    words = counted.withColumn("words", F.split("form", r"\s+"))
    return words.withColumns({"size": F.size("words"), "lead": F.array_join(F.slice("words", 1, lead_words), " ")})


def mine_templates(
    messages: DataFrame, message: str = "message", similarity: float = SIMILARITY, lead_words: int = LEAD_WORDS, leaf_forms: int = LEAF_FORMS
) -> DataFrame:
    """Map from masked message form to template: (form, n, leader, template)."""
    forms = durable(message_forms(messages, message, lead_words), "forms")
    total, largest = key_sizes(forms, _LEAF)
    if not total:
        return forms.select("form", "n", F.col("form").alias("leader"), F.col("form").alias("template"))
    grouped = durable(_settled(forms, similarity) if largest <= leaf_forms else _in_blocks(forms, similarity, leaf_forms), "grouped")
    spread = grouped.select("leader", F.posexplode("words").alias("at", "word"))
    same = spread.groupBy("leader", "at").agg(
        F.when(F.min("word") == F.max("word"), F.min("word")).otherwise(F.lit(WILDCARD)).alias("word")
    )
    templates = same.groupBy("leader").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"])).alias("template")
    )
    return grouped.join(templates, "leader").select("form", "n", "leader", "template")


_GROUPED = "form string, n long, words array<string>, size int, lead string, leader string"


def _settled(forms: DataFrame, similarity: float) -> DataFrame:
    """Every form of leaves of bounded size with its leader."""

    def settle(leaf: pd.DataFrame) -> pd.DataFrame:
        rows = list(zip(leaf["n"], leaf["form"], leaf["words"].map(list)))
        return leaf.assign(leader=cluster_forms(rows, similarity))

    return forms.select("form", "n", "words", *_LEAF).groupBy(*_LEAF).applyInPandas(settle, _GROUPED)


def _in_blocks(forms: DataFrame, similarity: float, leaf_forms: int) -> DataFrame:
    left, done = forms.select("form", "n", "words", *_LEAF), []
    while True:
        placed = durable(positions(left, _LEAF, [F.col("n").desc(), F.col("form").desc()], "_rank"), "placed")
        block = durable(_settled(placed.where(F.col("_rank") < leaf_forms), similarity), "block")
        done.append(block)
        rest = placed.where(F.col("_rank") >= leaf_forms)
        chunks = rest.groupBy(*_LEAF).agg(F.max("_rank").alias("_last"))
        if chunks.isEmpty():
            return reduce(DataFrame.unionByName, done)
        leaders = block.where("form = leader").join(placed.select("form", "_rank"), "form").join(chunks, _LEAF)
        chunk = F.expr(f"explode(sequence(1L, _last div {leaf_forms}))")
        # New names for the columns, as both sides come from one table.
        leaders = leaders.select(*[F.col(c).alias(c) for c in ("form", "words", "_rank", *_LEAF)], chunk.alias("_chunk"))
        rest = rest.withColumn("_chunk", F.expr(f"_rank div {leaf_forms}"))
        by = [*_LEAF, "_chunk"]

        def compare(chunk: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
            words = chunk["words"].map(list).tolist()
            known = known.sort_values("_rank")
            leaders_ = Leaders(int(chunk["size"].iloc[0]) if len(chunk) else 0, similarity, [*words, *known["words"].map(list)])
            for w in known["words"]:
                leaders_.add(list(w))
            names = known["form"].tolist()
            near = [leaders_.first_near(w) for w in words]
            return chunk[["form", "n", "words", *_LEAF]].assign(leader=[None if i is None else names[i] for i in near])

        compared = durable(rest.groupBy(*by).cogroup(leaders.groupBy(*by)).applyInPandas(compare, _GROUPED), "compared")
        done.append(compared.where("leader is not null"))
        left = compared.where("leader is null").drop("leader")
