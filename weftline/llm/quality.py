"""Quality by supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document is the mean of the vectors of its features: white-space tokens (case and punctuation kept),
their character n-grams (whole characters of any width), and pairs of neighbouring tokens; all hashed
into one table.  A softmax over the classes follows.  Since mean and output layer are linear, scoring
needs one number for each feature.

The fit uses at most ``rows`` labelled documents (a documented bound); scoring covers every row and
whole texts, however long.  Texts without tokens, null ones too, get the score of the output layer's
bias.  Repeated rows are scored each; null ids are not held out.  An empty table gives no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import rolling
from weftline.llm.common import pieces, record

BITS, GRAMS = 17, (3, 4)
_PAIR = np.uint64(0xA24BAED4963EE407)


def hashed_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table places of all features of a batch of texts, and the text that each is of."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, ends, counts = rolling.words(data, offsets)
    sums = rolling.prefix(data)
    size = np.uint64(64 - BITS)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    own = rolling.spans(sums, starts, ends)
    places, texts = [own >> size], [text]
    near = np.flatnonzero(text[1:] == text[:-1])
    places.append(rolling.mix(own[near] * _PAIR + own[near + 1]) >> size)
    texts.append(text[near])
    lengths = ends - starts
    inside = np.repeat(starts, lengths) + _within(lengths)
    token = np.repeat(np.arange(len(starts)), lengths)
    lead = (data[inside] & 0xC0) != 0x80  # bytes that begin a character
    first, token = inside[lead], token[lead]
    for n in GRAMS:
        if len(first) < n:
            continue
        end = np.append(first[n:], len(data))  # where the n characters from here end, if they are of one token
        end = np.minimum(end, ends[token[: len(end)]])
        fits = np.flatnonzero(token[n - 1 :] == token[: len(token) - n + 1])
        places.append(rolling.spans(sums, first[fits], end[fits]) >> size)
        texts.append(text[token[fits]])
    return np.concatenate(places).astype(np.int64), np.concatenate(texts)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


class Model:
    """One number for each feature and a bias: the difference of the two classes' softmax inputs."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def scores(self, column: pa.Array) -> np.ndarray:
        data, offsets = rolling.buffers(column)
        place, text = hashed_features(data, offsets)
        n = len(offsets) - 1
        sums = np.bincount(text, self.weights[place], minlength=n)
        means = sums / np.maximum(np.bincount(text, minlength=n), 1)
        return 1 / (1 + np.exp(-np.clip(means + self.bias, -30, 30)))


def train(texts: list[str], labels: list[int], dim: int = 12, epochs: int = 12, rate: float = 0.5, seed: int = 1) -> Model:
    """Fit vectors and output layer by stochastic gradient descent, a document at a time.

    The rate falls linearly to zero.  Without documents of both classes the score is 0.5 for all texts.
    """
    if len(set(labels)) < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    draw = np.random.default_rng(seed)
    rows = []
    for x in texts:
        place, _ = hashed_features(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))
        found, many = np.unique(place, return_counts=True)
        rows.append((found, (many / max(1, many.sum())).astype(np.float32)))
    vectors = draw.uniform(-1 / dim, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    steps = epochs * len(rows)
    order = np.concatenate([draw.permutation(len(rows)) for _ in range(epochs)])
    for step, r in enumerate(order):
        place, share = rows[r]
        if not len(place):
            continue
        speed = np.float32(rate * (1 - step / steps))
        mean = share @ vectors[place]
        z = mean @ out + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[r]] -= 1  # the slope of the loss
        back = out @ p
        out -= speed * np.outer(mean, p)
        bias -= speed * np.float32(0.1) * p
        # the mean spreads the slope over many features; scaled up so that rare ones learn as well
        vectors[place] -= (speed * np.float32(30)) * share[:, None] * back
    gap = out[:, 1] - out[:, 0]
    return Model(vectors @ gap, float(bias[1] - bias[0]))


RESULT = "doc_id long, held_out boolean, score double, predicted int"


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every row; ``held_out`` tells rows whose label is never learnt (see ``learnable``)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                scores = own.scores(part.column("text"))
                yield record(RESULT, [part.column("doc_id"), part.column("held_out"), scores, pa.array((scores >= threshold).astype(np.int32))])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.expr(f"coalesce(not ({learnable(doc_id)}), false)").alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(score, RESULT)


def learnable(doc_id: str = "doc_id") -> str:
    """SQL: whether the label of a row may be learnt."""
    return f"crc32(cast(cast({doc_id} as string) as binary)) % 5 <> 0"
