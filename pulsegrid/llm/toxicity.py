"""Toxicity: embeddings of hashed subwords, averaged over short windows of words, into a linear softmax.

A word's vector is the mean of the embeddings of its character n-grams and of the whole word, so an unseen misspelling or ending shares most of its
vector with words that were seen. The vectors of eight words in a row are averaged, and the softmax scores that window; a text is as toxic as
its worst window, so that a few words count in a long text as in a short one. Embeddings and softmax are trained jointly in numpy, through a
smooth maximum over the windows that is sharpened in training. Since all of this is linear up to the maximum, a score needs one number per
bucket, which is all that tasks get.

Only labelled rows outside the held-out fifth are fitted on (at most ``FIT_ROWS`` of each label). Null and empty texts have no window: their
score is that of the bias alone. Where one label has no row, all scores are the share of label 1 among the rows there are (0 if none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.hashed import BITS, Adam, bucket, character_grams, labelled_sample, sigmoid
from pulsegrid.llm.textbatch import WORD, Texts, Words, lowered, per_batch, pieces, word_hashes

WINDOW = 8
WIDTH = 8
STEPS = 160
#: A form in fewer texts of the sample is not fitted on, and embeddings shrink by this share of the gradient: both against learning by heart.
LEAST_TEXTS, DECAY = 5, 1e-3
FOLDS, HELD_OUT = 5, 0


@dataclass(frozen=True)
class Model:
    """Per bucket its embedding times the softmax's weights, and the bias."""

    weights: np.ndarray
    bias: float


def _windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows among the words, their sizes, and their rows."""
    at = np.searchsorted(words.row, np.arange(n + 1))
    starts = np.flatnonzero((np.arange(len(words.row)) - at[words.row]) % WINDOW == 0)
    return starts, np.diff(np.append(starts, len(words.row))), words.row[starts]


def _word_features(texts: Texts) -> tuple[Words, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    words, hashes = word_hashes(texts, WORD)
    return words, hashes, [(np.arange(len(hashes)), bucket(hashes)), *character_grams(texts.data, words)]


def _known_forms(words_of: np.ndarray, sizes: np.ndarray, docs: np.ndarray, n_forms: int) -> np.ndarray:
    """Whether a form is in ``LEAST_TEXTS`` of the texts: what is in fewer could only be learnt by heart."""
    n_docs = int(docs.max()) + 1 if len(docs) else 1
    pairs = np.unique(words_of.astype(np.int64) * n_docs + np.repeat(docs, sizes))
    return np.bincount(pairs // n_docs, minlength=n_forms) >= LEAST_TEXTS


def fit(pairs: list[tuple[str, int]], seed: int = 1) -> Model:
    labels = np.array([y for _, y in pairs], dtype=np.float64)
    if len(set(labels.tolist())) < 2:
        share = labels.mean() if len(labels) else 0.0
        return Model(np.zeros(1 << BITS, dtype=np.float32), 40.0 if share else -40.0)
    words_of, sizes, docs, seen = [], [], [], {}
    owner, buckets, n_forms = [], [], 0
    for texts in pieces(lowered(pa.array([t for t, _ in pairs], pa.large_string()))):
        words, hashes, features = _word_features(texts)
        _, size, row = _windows(words, texts.n)
        forms, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ids = np.fromiter((seen.setdefault(h, len(seen)) for h in forms.tolist()), dtype=np.int64, count=len(forms))
        fresh = np.zeros(len(hashes), dtype=bool)
        fresh[first[ids >= n_forms]] = True
        of_word = ids[inverse]
        for position, b in features:
            keep = fresh[position]
            owner.append(of_word[position[keep]].astype(np.int32))
            buckets.append(b[keep].astype(np.int32))
        n_forms = len(seen)
        words_of.append(of_word.astype(np.int32))
        sizes.append(size)
        docs.append(row + texts.first)
    words_of, sizes, docs = map(np.concatenate, (words_of, sizes, docs))
    owner, buckets = np.concatenate(owner), np.concatenate(buckets)
    known = _known_forms(words_of, sizes, docs, n_forms)
    keep = known[owner]
    owner, buckets = owner[keep], buckets[keep]
    per_form = np.maximum(np.bincount(owner, minlength=n_forms), 1).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    first_window = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    if not len(docs):
        return Model(np.zeros(1 << BITS, dtype=np.float32), float(np.log(labels.mean() / (1 - labels.mean()))))
    target = labels[docs[first_window]]
    windows_of = np.diff(np.append(first_window, len(docs)))

    random = np.random.default_rng(seed)
    embeddings = random.normal(0, 0.05, (1 << BITS, WIDTH)).astype(np.float32)
    softmax, bias = random.normal(0, 1, WIDTH).astype(np.float32), np.zeros(1, np.float32)
    weight = np.where(target == 1, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1))
    adam = Adam(0.05)
    for step in range(STEPS):
        sharp = 1.0 + 20.0 * step / STEPS
        per_bucket = embeddings @ softmax
        per_word = np.bincount(owner, weights=per_bucket[buckets], minlength=n_forms) / per_form
        z = np.add.reduceat(per_word[words_of], starts) / sizes * WINDOW
        top = np.maximum.reduceat(z, first_window)
        share = np.exp(sharp * (z - np.repeat(top, windows_of)))
        share /= np.repeat(np.add.reduceat(share, first_window), windows_of)
        pooled = np.add.reduceat(share * z, first_window)
        error = (sigmoid(pooled + bias[0]) - target) * weight
        to_window = np.repeat(error, windows_of) * share / sizes * WINDOW
        to_form = np.bincount(words_of, weights=np.repeat(to_window, sizes), minlength=n_forms) / per_form
        to_bucket = np.bincount(buckets, weights=to_form[owner], minlength=1 << BITS).astype(np.float32)
        adam.step(
            embeddings=(embeddings, to_bucket[:, None] * softmax[None, :] + DECAY * embeddings),
            softmax=(softmax, to_bucket @ embeddings),
            bias=(bias, np.array([error.sum()], np.float32)),
        )
    return Model((embeddings @ softmax).astype(np.float32), float(bias[0]))


def scores(model: Model, texts: Texts) -> np.ndarray:
    words, _, features = _word_features(texts)
    total, count = np.zeros(len(words.row)), np.zeros(len(words.row))
    for position, b in features:
        total += np.bincount(position, weights=model.weights[b], minlength=len(total))
        count += np.bincount(position, minlength=len(total))
    worst = np.full(texts.n, -np.inf)
    if len(words.row):
        starts, size, row = _windows(words, texts.n)
        np.maximum.at(worst, row, np.add.reduceat(total / count, starts) / size * WINDOW)
    return sigmoid(np.where(np.isfinite(worst), worst, 0.0) + model.bias)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string")) % FOLDS == HELD_OUT


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, whether its label was held out, the score and the prediction. Null ids count as held out."""
    model = fit(labelled_sample(docs, labels, "toxic", ~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def step(batch: pa.RecordBatch):
        found = Model(*shared.value)
        values = np.concatenate([scores(found, texts) for texts in pieces(lowered(batch.column(1)))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc_id", "score"])

    scored = per_batch(docs, ["doc_id", "text"], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double", step)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
