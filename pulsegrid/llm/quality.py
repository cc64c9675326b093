"""Quality: logistic regression on hashed word and character n-grams, calibrated, scored in Arrow batches against fixed thresholds.

Words are runs of anything but the six ASCII blanks, in their own case. A text is described by two averages: over its words, word pairs and
over the character n-grams of its words. The regression is fitted on at most ``FIT_ROWS`` labelled rows of each label; a fifth of them is kept
back to fit the slope and offset that turn its output into probabilities (as if both labels were equally frequent).

The base counts are exact up to collisions of 64-bit hashes of word triples within one text. A text fails them with fewer than 50 words, or
if more than half of its words lie in repeated triples. Null and empty texts have no words and fail. Without rows of both labels every text
gets probability 1, so that the base counts alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pulsegrid.llm.hashed import BITS, Adam, bucket, character_grams, labelled_sample, sigmoid
from pulsegrid.llm.textbatch import NOT_BLANK, Texts, Words, filled, over_batches, per_batch, pieces, runs, shingles, span_hashes

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A text whose calibrated probability of label 1 is below this is rejected.
MIN_PROBABILITY = 0.3
#: Labelled rows of each label that the fit uses at most.
FIT_ROWS = 1_200
STEPS = 120
TRIPLE = 3
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))


@dataclass(frozen=True)
class Model:
    """Weights per bucket of words and of character n-grams, and what turns their averages into a log-odds."""

    words: np.ndarray
    grams: np.ndarray
    slope: float
    offset: float


def _features(texts: Texts) -> tuple[Words, list[list[tuple[np.ndarray, np.ndarray]]]]:
    """(row, bucket) pairs of the word features and of the n-gram features."""
    words = runs(NOT_BLANK[texts.data], texts.starts)
    hashes = span_hashes(texts.data, words.begin, words.end)
    pair_row, pair = shingles(words, hashes, 2, texts.n)
    grams = [(words.row[position], b) for position, b in character_grams(texts.data, words)]
    return words, [[(words.row, bucket(hashes)), (pair_row, bucket(pair))], grams]


def _averages(features: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int) -> np.ndarray:
    total, count = np.zeros(n), np.zeros(n)
    for row, b in features:
        total += np.bincount(row, weights=weights[b], minlength=n)
        count += np.bincount(row, minlength=n)
    return total / np.maximum(count, 1)


def raw_scores(model: Model, features, n: int) -> np.ndarray:
    return _averages(features[0], model.words, n) + _averages(features[1], model.grams, n)


def probabilities(model: Model, features, n: int) -> np.ndarray:
    return sigmoid(model.slope * raw_scores(model, features, n) + model.offset)


def _sparse(features: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, share of the row's features), each pair of row and bucket once."""
    row, b = (np.concatenate(x) for x in zip(*features))
    key, count = np.unique(row << BITS | b, return_counts=True)
    row = key >> BITS
    return row.astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32), (count / np.bincount(row, weights=count, minlength=n)[row]).astype(np.float32)


def _slices(group: list[np.ndarray], size: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """A group's entries in slices, so that products of them stay small."""
    for at in range(0, len(group[0]), size):
        yield [x[at : at + size] for x in group]


def _sums(weights: np.ndarray, group: list[np.ndarray], n: int) -> np.ndarray:
    return sum((np.bincount(row, weights=weights[b] * share, minlength=n) for row, b, share in _slices(group)), np.zeros(n))


def _gradient(error: np.ndarray, group: list[np.ndarray]) -> np.ndarray:
    found = np.zeros(1 << BITS)
    for row, b, share in _slices(group):
        found += np.bincount(b, weights=error[row] * share, minlength=1 << BITS)
    return found.astype(np.float32)


def fit(pairs: list[tuple[str, int]]) -> Model:
    zero = np.zeros(1 << BITS, dtype=np.float32)
    labels = np.array([y for _, y in pairs], dtype=np.float64)
    n = len(labels)
    if len(set(labels.tolist())) < 2:
        return Model(zero, zero, 0.0, 40.0)
    parts: list[list[list[np.ndarray]]] = [[], []]
    for texts in pieces(pa.array([t for t, _ in pairs], pa.large_string()), 1 << 18):
        _, features = _features(texts)
        for part, f in zip(parts, features):
            row, b, share = _sparse(f, texts.n)
            part.append([row + texts.first, b, share])
    groups = [[np.concatenate(x) for x in zip(*part)] for part in parts]
    kept_back = np.arange(n) % 5 == 0
    weight = np.where(labels == 1, 0.5 / labels[~kept_back].sum().clip(1), 0.5 / (1 - labels[~kept_back]).sum().clip(1)) * ~kept_back
    w = [np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)]
    bias, adam = np.zeros(1, np.float32), Adam(0.5)
    for _ in range(STEPS):
        z = sum(_sums(x, group, n) for x, group in zip(w, groups))
        error = (sigmoid(z + bias[0]) - labels) * weight
        steps = [_gradient(error, group) + 1e-6 * x for x, group in zip(w, groups)]
        adam.step(words=(w[0], steps[0]), grams=(w[1], steps[1]), bias=(bias, np.array([error.sum()], np.float32)))
    z = sum(_sums(x, group, n) for x, group in zip(w, groups))
    slope, offset = _calibrated(z[kept_back], labels[kept_back])
    return Model(w[0], w[1], slope, offset)


def _calibrated(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds on rows kept back, both labels weighed alike and smoothed; the plain output if a label is missing."""
    ones, zeros = labels.sum(), (1 - labels).sum()
    if not ones or not zeros:
        return 1.0, 0.0
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(labels == 1, 0.5 / ones, 0.5 / zeros)
    x = np.stack([z, np.ones_like(z)], axis=1)
    at = np.array([1.0, 0.0])
    for _ in range(30):
        p = sigmoid(x @ at)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        at -= np.linalg.solve(curve, x.T @ (weight * (p - target)) + 1e-6 * (at - [1.0, 0.0])).clip(-5, 5)
    return float(at[0]), float(at[1])


def _repeated_words(texts: Texts, words: Words) -> np.ndarray:
    """Per row the words that lie in a triple found twice or more in the row."""
    hashes = span_hashes(texts.data, words.begin, words.end)
    n = len(hashes)
    if n < TRIPLE:
        return np.zeros(texts.n, dtype=np.int64)
    whole = np.flatnonzero(words.row[2:] == words.row[:-2])
    triple = span_hashes(hashes, whole, whole + TRIPLE)
    order = np.lexsort((triple, words.row[whole]))
    row, triple, at = words.row[whole][order], triple[order], whole[order]
    same = (row[1:] == row[:-1]) & (triple[1:] == triple[:-1])
    twice = np.append(same, False) | np.insert(same, 0, False)
    marked = np.zeros(n, dtype=bool)
    for k in range(TRIPLE):
        marked[at[twice] + k] = True
    return np.bincount(words.row[marked], minlength=texts.n)


def _repeated_lines(raw: bytes) -> int:
    lines = raw.split(b"\n")
    if len(lines) == len(set(lines)):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.strip(b" \t\n\v\f\r"))
        seen.add(line)
    return n


def base_counts(texts: Texts, words: Words) -> dict[str, np.ndarray]:
    """The counts of every row of a piece of texts."""
    characters = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOLS[texts.data])])
    n_words = np.bincount(words.row, minlength=texts.n)
    repeated = _repeated_words(texts, words)
    return {
        "n_words": n_words,
        "word_chars": np.bincount(words.row, weights=characters[words.end] - characters[words.begin], minlength=texts.n).astype(np.int64),
        "n_symbols": np.diff(symbols[texts.starts]),
        "n_dup_lines": np.array([_repeated_lines(texts.raw(i)) for i in range(texts.n)], dtype=np.int64),
        "n_repeat_words": repeated,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n_words),
    }


def _fitted(docs: DataFrame, labels: DataFrame):
    model = fit(labelled_sample(docs, labels, "quality", rows=FIT_ROWS))
    return docs.sparkSession.sparkContext.broadcast((model.words, model.grams, model.slope, model.offset))


def _verdicts(column: pa.Array, model: Model) -> Iterator[tuple[Texts, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """(piece of texts, base counts, probability, kept) of a column of texts."""
    for texts in pieces(filled(column)):
        words, features = _features(texts)
        base = base_counts(texts, words)
        p = probabilities(model, features, texts.n)
        yield texts, base, p, ~base["base_failed"] & (p >= MIN_PROBABILITY)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` its doc_id, the base counts, ``base_failed``, the calibrated ``probability`` and ``kept``."""
    shared = _fitted(docs, labels)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["doc_id", *counts, "base_failed", "probability", "kept"]
    types = [f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{c} bigint" for c in counts), "base_failed boolean, probability double, kept boolean"]

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for texts, base, p, kept in _verdicts(batch.column(1), Model(*shared.value)):
            ids = batch.column(0).slice(texts.first, texts.n)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, [*base.values(), p, kept])], names=names)

    return per_batch(docs, ["doc_id", "text"], ", ".join(types), step)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    shared = _fitted(docs, labels)
    at = docs.columns.index("text")

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kept = [kept for *_, kept in _verdicts(batch.column(at), Model(*shared.value))]
        yield batch.filter(pa.array(np.concatenate(kept)))

    return over_batches(docs, step, docs.schema)
