"""Context-triggered piecewise hashing: fingerprints that tell how alike two texts are.

A rolling hash of the last seven bytes cuts a text into chunks: at level k, after each byte where the
k low bits of the hash are zero, so the cuts of level k+1 are among those of level k.  Each chunk
gives one of 64 letters.  A fingerprint ``k:letters:letters`` has the letters at the lowest level
with at most 64 chunks and at the level above it.  Two fingerprints are compared at the levels they
share, by the edit distance with insertions and deletions (a replacement counts as both):
likeness = 1 - distance / (sum of lengths).  A pair without a common run of letters is not alike;
equal fingerprints have likeness 1.

Null and empty texts have the fingerprint ``0::``; it is like itself only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import rolling
from weftline.llm.common import arrow_schema, record, spread, staged

LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
WINDOW, LONGEST, RUN = 7, 64, 4


def fingerprints(texts: list[bytes]) -> list[str]:
    """Fingerprints of texts; work is done over all of them at once, in slices of bounded size."""
    found: list[str] = []
    start, held = 0, 0
    for i, x in enumerate(texts):
        if i > start and held + len(x) > 2 << 20:
            found += _fingerprints(texts[start:i])
            start, held = i, 0
        held += len(x)
    return found + (_fingerprints(texts[start:]) if start < len(texts) else [])


def _fingerprints(texts: list[bytes]) -> list[str]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    if not len(data):
        return ["0::"] * len(texts)
    sums = rolling.prefix(data)
    at = np.arange(len(data))
    first = np.repeat(offsets[:-1], np.diff(offsets))
    rolled = rolling.spans(sums, np.maximum(at - (WINDOW - 1), first), at + 1)
    low = rolled & (~rolled + np.uint64(1))  # the lowest bit that is set
    level = np.frexp(np.where(low == 0, 2.0**63, low.astype(np.float64)))[1] - 1  # its place
    level = np.minimum(level, 62).astype(np.int8)
    found = []
    for k in range(len(texts)):
        a, b = offsets[k], offsets[k + 1]
        if a == b:
            found.append("0::")
            continue
        own = level[a:b]
        many = np.bincount(own, minlength=64)[::-1].cumsum()[::-1]  # cuts of each level
        n = int(np.argmax(many < LONGEST))
        signs = []
        for cuts in (cut := np.flatnonzero(own >= n) + a + 1, cut[own[cut - a - 1] > n]):
            edges = np.concatenate(([a], cuts)) if len(cuts) and cuts[-1] == b else np.concatenate(([a], cuts, [b]))
            signs.append(LETTERS[(rolling.spans(sums, edges[:-1], edges[1:]) >> np.uint64(58)).astype(np.int64)].tobytes().decode())
        found.append(f"{n}:{signs[0]}:{signs[1]}")
    return found


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of ``a``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        met = row & masks.get(c, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def likeness(one: str, other: str) -> float:
    """From 0 (nothing in common, or levels too far apart) to 1 (equal)."""
    if one == other:
        return 1.0
    (n, a, b), (m, c, d) = one.split(":"), other.split(":")
    n, m = int(n), int(m)
    pairs = {0: [(a, c), (b, d)], 1: [(a, d)], -1: [(b, c)]}.get(n - m, [])
    best = 0.0
    for x, y in pairs:
        run = min(RUN, len(x), len(y))
        if run and any(x[i : i + run] in y for i in range(len(x) - run + 1)):
            best = max(best, 2 * _common(x, y) / (len(x) + len(y)))
    return min(best, 0.99)


def edited(text: str, other: str) -> str:
    """The last half of the code points replaced by the first as many of the other text (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: characters of a text that part rows of equal ids into ranges (ranges are found from a sample of them; rows are ordered by whole texts)
PREFIX = 64
ENDS = "place int, head string, tail string, tail_id long"


def _pair(ids: list, texts: list[str], marks: list[str], after: str, after_mark: str) -> dict:
    """Result columns of rows that follow one another; ``after`` is the text behind the last."""
    changed = [edited(x, y) for x, y in zip(texts, [*texts[1:], after], strict=True)]
    raw = [x.encode() for x in changed]
    own = fingerprints(raw)
    return {
        "doc_id": ids,
        "n_chars": [len(x) for x in texts],
        "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
        "fingerprint": marks,
        "edited_fingerprint": own,
        "near_edited": [likeness(x, y) for x, y in zip(marks, own, strict=True)],
        "near_next": [likeness(x, y) for x, y in zip(marks, [*marks[1:], after_mark], strict=True)],
    }


def fingerprint_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of each text, of its edit with the next text, and their likenesses.

    Rows follow one another by descending doc_id; null ids come last, rows of equal ids are ordered by
    text, and after the last row comes the first.  A table of one row is its own neighbour.  Texts are shuffled once, by
    ranges of doc_id and, for equal ids, of the text's first characters, so many rows without an id are
    parted too; each range gives its rows but the last, whose neighbour starts another range.
    One row of each end of a range is then joined to the next range's.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    parts = rows.repartitionByRange(spread(docs.sparkSession), order[0], F.substring("text", 1, PREFIX)).sortWithinPartitions(*order)
    schema, names, ends = f"{RESULT}, {ENDS}", arrow_schema(RESULT).names, arrow_schema(ENDS).names

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        last: tuple | None = None
        head = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(ids):  # slices of bounded size; each starts with the row that was held back
                upto, held = at, 0
                while upto < len(ids) and (upto == at or held < 1 << 21):
                    held += len(texts[upto])
                    upto += 1
                own_ids, own = ids[at:upto], texts[at:upto]
                if head is None:
                    head = own[0]
                marks = fingerprints([x.encode() for x in own])
                if last:
                    own_ids, own, marks = [last[0], *own_ids], [last[1], *own], [last[2], *marks]
                last = (own_ids[-1], own[-1], marks[-1])
                if len(own) > 1:
                    out = _pair(own_ids[:-1], own[:-1], marks[:-1], *last[1:])
                    yield record(schema, out | {k: [None] * (len(own) - 1) for k in ends})
                at = upto
        if last:
            yield record(schema, {k: [None] for k in names} | {"place": [TaskContext.get().partitionId()], "head": [head], "tail": [last[1]], "tail_id": [last[0]]})

    done = staged(parts.mapInArrow(within, schema), "fingerprints")
    edges = done.filter("place is not null").select(*ends)
    # a row for each range: its neighbour is the next range that has rows
    places = [r.place for r in edges.select("place").orderBy("place").collect()]
    if not places:
        return done.select(*names)
    follow = docs.sparkSession.createDataFrame(list(zip(places, [*places[1:], places[0]], strict=True)), "place int, following int")
    heads = edges.select(F.col("place").alias("following"), F.col("head").alias("after"))
    tails = edges.join(follow, "place").join(heads, "following").select("tail_id", "tail", "after")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, tail, after in zip(*(batch.column(c).to_pylist() for c in ("tail_id", "tail", "after")), strict=True):
                marks = fingerprints([tail.encode(), after.encode()])
                yield record(RESULT, _pair([key], [tail], marks[:1], after, marks[1]))

    return done.filter("place is null").select(*names).unionByName(tails.mapInArrow(across, RESULT))

