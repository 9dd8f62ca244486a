"""Toxicity by a chain of linear classifiers, one for each category.

The categories are predicted in order; each model sees the words of the text and the probabilities of
the earlier categories.  In training those are out-of-fold predictions, so that a later model learns
from what it will see on new texts.  Features are words (A-Z lower-cased) and their first 4 to 8
bytes, present or not; the ``features`` that tell flagged rows best are kept, if in two of them at least.

The table of labels has one flag, so the categories before the last are found in the labelled rows:
the flagged ones are parted into ``THEMES`` groups by spherical k-means over their features (started from
fixed draws), and a group is a category.  The chain is ``theme1``, ``theme2`` (1 for the larger group) and
``toxic``, the flag itself, which decides.  No list of words is given.

The fit uses at most ``rows`` labelled documents (a documented bound); scoring covers every row and
whole texts, however long.  Null and empty texts score by the models' biases.  Repeated rows are scored
each, null ids too.  An empty table gives no rows.  Extra columns are ignored, or kept by ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import rolling
from weftline.llm.common import pieces, record

THEMES = 2
CATEGORIES = (*(f"theme{k + 1}" for k in range(THEMES)), "toxic")
PREFIXES = (4, 5, 6, 7, 8)
_KIND = np.uint64(0x632BE59BD9B4E019)


def present(data: np.ndarray, offsets: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the features of a batch of texts, and the text of each; repeats are not removed.

    ``keep`` filters hashes early.
    """
    starts, ends, counts = rolling.words(data, offsets, rolling.WORD)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(counts))
    sums = rolling.prefix(data, rolling.VALUES_LOWER)
    hashes, texts = [], []
    for n in (0, *PREFIXES):
        fits = np.flatnonzero(ends - starts > n) if n else slice(None)
        first = starts[fits]
        found = rolling.spans(sums, first, first + n if n else ends)
        if n:
            found = found ^ _KIND
        of = text[fits]
        if keep is not None:
            hit = keep(found)
            found, of = found[hit], of[hit]
        hashes.append(found)
        texts.append(of)
    return np.concatenate(hashes), np.concatenate(texts)


class Chain:
    """Sorted feature hashes, and for each category its weights: features, earlier categories, bias."""

    def __init__(self, hashes: np.ndarray, weights: list[np.ndarray]):
        self.hashes, self.weights = hashes, weights
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def _keep(self, found: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.sieve[(found >> np.uint64(44)).astype(np.int64)])
        if not len(self.hashes):
            return maybe[:0]
        at = np.searchsorted(self.hashes, found[maybe])
        return maybe[self.hashes[np.minimum(at, len(self.hashes) - 1)] == found[maybe]]

    def features(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature number of each feature that is present, once each, sorted."""
        found, text = present(data, offsets, self._keep)
        pair = np.unique(text * len(self.hashes) + np.searchsorted(self.hashes, found)) if len(found) else np.zeros(0, np.int64)
        return pair // max(1, len(self.hashes)), pair % max(1, len(self.hashes))

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probabilities of the categories, a row for each text."""
        text, feature = self.features(data, offsets)
        n, f = len(offsets) - 1, len(self.hashes)
        done = np.zeros((n, 0))
        for w in self.weights:
            z = np.bincount(text, w[feature], minlength=n) + done @ w[f:-1] + w[-1]
            done = np.column_stack((done, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return done


def _fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, size: int, epochs: int, seed: int) -> np.ndarray:
    """Logistic regression by AdaGrad, a document at a time."""
    k = extra.shape[1]
    w, seen = np.zeros(size + k + 1), np.full(size + k + 1, 1e-6)
    draw = np.random.default_rng(seed)
    tail = np.arange(size, size + k + 1)
    values = np.column_stack((extra, np.ones(len(y))))
    for _ in range(epochs):
        for r in draw.permutation(len(rows)):
            at = rows[r]
            z = w[at].sum() + values[r] @ w[tail]
            slope = 1 / (1 + np.exp(-min(30, max(-30, z)))) - y[r]
            g = slope + 1e-3 * w[at]
            seen[at] += g * g
            w[at] -= 0.2 * g / np.sqrt(seen[at])
            g = slope * values[r]
            seen[tail] += g * g
            w[tail] -= 0.2 * g / np.sqrt(seen[tail])
    return w


def themes(rows: list[np.ndarray], size: int, seed: int, rounds: int = 20) -> np.ndarray:
    """A group for each row of feature numbers, the largest group first; rows without features are in the last."""
    if not size or not rows:
        return np.full(len(rows), THEMES - 1)
    x = np.zeros((len(rows), size))
    for r, at in enumerate(rows):
        x[r, at] = 1 / max(1, len(at)) ** 0.5
    draw = np.random.default_rng(seed)
    center = x[draw.choice(len(rows), THEMES, replace=len(rows) < THEMES)]
    for _ in range(rounds):
        group = (x @ center.T).argmax(axis=1)
        sums = np.stack([x[group == k].sum(axis=0) if (group == k).any() else center[k] for k in range(THEMES)])
        center = sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1))[:, None]
    order = np.argsort(-np.bincount(group, minlength=THEMES), kind="stable")
    group = np.argsort(order)[group]
    group[[not len(r) for r in rows]] = THEMES - 1
    return group


def train(texts: list[str], flags: list[int], features: int = 500, folds: int = 5, epochs: int = 8, seed: int = 3) -> Chain:
    """Fit the chain on texts and their 0/1 flags.  A category without both values gets a constant model."""
    raw = [x.encode() for x in texts]
    found = [np.unique(present(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]) if x else np.zeros(0, np.uint64) for x in raw]
    toxic = np.array(flags, bool)
    count = lambda chosen: np.unique(np.concatenate([np.zeros(0, np.uint64), *(f for f, c in zip(found, chosen, strict=True) if c)]), return_counts=True)
    kept, many = count(toxic)
    kept, many = kept[many >= 2], many[many >= 2]
    other, others = count(~toxic)
    clean = np.zeros(len(kept))
    if len(other):
        at = np.minimum(np.searchsorted(other, kept), len(other) - 1)
        clean = np.where(other[at] == kept, others[at], 0)
    gain = many / max(1, toxic.sum()) - clean / max(1, (~toxic).sum())
    hashes = np.sort(kept[np.argsort(-gain, kind="stable")[:features]])
    chain = Chain(hashes, [])
    rows = [chain.features(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[1] if x else np.zeros(0, np.int64) for x in raw]
    theme = np.full(len(rows), -1)
    theme[toxic] = themes([r for r, t in zip(rows, toxic, strict=True) if t], len(hashes), seed)
    targets = np.column_stack([*(theme == k for k in range(THEMES)), toxic]).astype(np.int64)
    part = np.random.default_rng(seed).permutation(len(rows)) % folds
    done = np.zeros((len(rows), 0))
    for c in range(targets.shape[1]):
        y = targets[:, c].astype(float)
        if len(set(y)) < 2:
            constant = np.zeros(len(hashes) + c + 1)
            constant[-1] = 30.0 if len(y) and y[0] else -30.0
            chain.weights.append(constant)
            done = np.column_stack((done, y))
            continue
        chain.weights.append(_fit(rows, done, y, len(hashes), epochs, seed))
        if c + 1 < targets.shape[1]:
            unseen = np.zeros(len(rows))
            for k in range(folds):
                mine = np.flatnonzero(part != k)
                w = _fit([rows[i] for i in mine], done[mine], y[mine], len(hashes), epochs, seed + k)
                for i in np.flatnonzero(part == k):
                    unseen[i] = 1 / (1 + np.exp(-np.clip(w[rows[i]].sum() + done[i] @ w[len(hashes) : -1] + w[-1], -30, 30)))
            done = np.column_stack((done, unseen))
    return chain


RESULT = "doc_id long, theme1 double, theme2 double, toxic double, rejected boolean"


def score_toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Probabilities of the categories and the decision for every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*shared.value)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                found = own.scores(*rolling.buffers(part.column("text")))
                yield record(RESULT, [part.column("doc_id"), *(np.ascontiguousarray(x) for x in found.T), pa.array(found[:, -1] >= threshold)])

    shared = docs.sparkSession.sparkContext.broadcast((chain.hashes, chain.weights))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(score, RESULT)


def keep_clean(docs: DataFrame, chain: Chain, threshold: float = 0.4, text: str = "text") -> DataFrame:
    """The rows that aren't rejected, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*shared.value)
        for batch in batches:
            for part in pieces(batch, text, 2 << 20):
                found = own.scores(*rolling.buffers(part.column(place)))
                yield part.filter(pa.array(found[:, -1] < threshold))

    place = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((chain.hashes, chain.weights))
    return docs.mapInArrow(keep, docs.schema)
