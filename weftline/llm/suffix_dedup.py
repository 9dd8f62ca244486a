"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else.  Suffixes
are compared on their first ``length`` bytes only, and never beyond their text's end.

1. Each suffix belongs to the bucket of its anchor: the leftmost ``gram``-byte string with the
   smallest hash among its first ``length`` bytes.  Equal strings have equal anchors at equal offsets,
   so equal suffixes meet in one bucket; suffixes in a row with one anchor form a run, and a run's
   context is the bytes that its suffixes' first ``length`` bytes cover.  Only hashes of runs are shuffled,
   and of runs that are equal within a batch of texts only one, which counts as two places; the ranges
   of the others are known at once, and overlapping ones are merged (a text of one letter is one range).
2. Buckets with one run are dropped.  Runs with equal contexts repeat each other as a whole.
3. What is left are buckets with several contexts.  One context of each kind is sent to its bucket, and
   the suffixes of the buckets are sorted, one block of buckets at a time (see ``equal_prefixes``).
4. A bucket with over ``crowd`` contexts is not sent: its runs are cut into shorter runs, whose buckets
   are told apart by all the bytes that their suffixes share, and go through 2 and 3 again.  Runs of one
   suffix end this: there contexts and buckets are the same.  So ``crowd`` bounds what a task sorts at
   once and has no influence on the result.

Runs and ranges go to their texts by sorting both by document, so no list is collected for a document.
Only texts that have any are moved, if their ids (8 bytes each) are few enough to be broadcast.

Null and empty texts have no bytes.  Repeated rows repeat each other wholly, also with one doc_id: if
ids repeat or are null, rows are numbered first.  Texts of over ``SEGMENT`` bytes are hashed in
overlapping segments.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import rolling
from weftline.llm.common import numbered, pieces, record, spread, staged

#: a difference cover modulo 31: every residue is the difference of two of these
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
LENGTH, GRAM, CROWD = 400, 64, 2000
#: widths of the runs that crowded buckets are cut into, in turn
WIDTHS = (48, 12, 3, 1)
#: ids and keys (8 bytes each) that may be broadcast
BROADCAST_IDS = 3_000_000
#: bytes of a text that are hashed at once
SEGMENT = 2 << 20

RUN = "uid long, s1 long, s2 long, anchor long, key long, context long, n long"
SENT = "key long, uid long, s1 long, s2 long, n long, bytes binary"


def _classes(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the distinct rows of the keys (two at a time; a number is below 2**32)."""
    now = keys[0]
    for k, more in enumerate((None, *keys[1:])):
        if more is not None:
            now = now << np.uint64(32) | more
        if more is not None or k == 0:
            now = np.unique(now, return_inverse=True)[1].astype(np.uint64)
    return now


def equal_prefixes(text: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> list[tuple[np.ndarray, np.ndarray]]:
    """Classes of the suffixes at ``starts`` whose first ``length`` bytes are equal.

    Gives groups of (index in starts, class number); two suffixes are equal if they share a class in
    any of the groups.  Every suffix has ``length`` bytes; ``length`` is 279 at least and 421 at most.

    * Suffixes are sorted by their first PERIOD bytes.
    * Ties are resolved by ranks of the sample: positions whose residue modulo PERIOD is in the cover.
      They are ranked by 8 * PERIOD bytes, by doubling within the sample, so only COVER / PERIOD of the
      positions hold ranks of long strings.
    * Two suffixes i and j have a shift below PERIOD with i + shift and j + shift both in the sample.
      For each shift, the suffixes that it takes to the sample are grouped by the ranks there, and a
      number of periods later, and by the last PERIOD bytes.
    """
    n, v, long = len(text), PERIOD, 8 * PERIOD
    padded = np.concatenate((text, np.zeros(long + 64, np.uint8)))
    word = np.zeros(n + 32, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + n + 32]
    eight = _classes(word)  # ranks of 8 bytes, then of 16, then of 31
    sixteen = _classes(eight[: n + 16] << np.uint64(32) | eight[8 : n + 24])
    short = _classes(sixteen[:n] << np.uint64(32) | sixteen[15 : n + 15])
    inside = np.zeros(v, bool)
    inside[list(COVER)] = True
    sample = np.flatnonzero(inside[np.arange(n) % v])
    rank = np.zeros(n + long + v, np.uint64)  # behind the text all strings are alike
    rank[sample] = short[sample] + np.uint64(1)
    for step in (v, 2 * v, 4 * v):
        rank[sample] = _classes(rank[sample] << np.uint64(32) | rank[sample + step]) + np.uint64(1)
    head = short[starts]
    ties = np.flatnonzero(np.bincount(head.astype(np.int64))[head.astype(np.int64)] > 1)
    found = []
    for shift in range(v):
        own = ties[inside[(starts[ties] + shift) % v]]
        if not len(own):
            continue
        at = starts[own]
        later = (length - long - shift) // v * v
        one = _classes(head[own] << np.uint64(32) | rank[at + shift])
        two = rank[at + shift + later] << np.uint64(32) | short[at + length - v]
        found.append((own, _classes(one, _classes(two))))
    return found


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    n = len(values) - width + 1
    pad = -len(values) % width
    full = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of a batch of texts: text number, first and last suffix, anchor (in the text), key, context."""
    n = len(data)
    sizes = np.diff(offsets)
    if n < length or sizes.max(initial=0) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = rolling.prefix(data)
    at = np.arange(n - gram + 1)
    hashes = rolling.spans(sums, at, at + gram)
    low = np.uint64(0xFFFFFFFF)
    anchor = (_least(hashes & ~low | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
    valid = np.zeros(n + 2, np.int8)
    long = sizes >= length
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(valid[: n - length + 1]).astype(bool)
    change = np.zeros(len(valid) + 1, bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | ~valid[1:] | ~valid[:-1]
    change[0] = change[-1] = True
    s1, s2 = np.flatnonzero(valid & change[:-1]), np.flatnonzero(valid & change[1:])
    a = anchor[s1]
    with np.errstate(over="ignore"):
        context = rolling.mix(rolling.spans(sums, s1, s2 + length) + (a - s1).astype(np.uint64))
    text = np.searchsorted(offsets, s1, side="right") - 1
    base = offsets[text]
    return text, s1 - base, s2 - base, a - base, hashes[a].view(np.int64), context.view(np.int64)


def _cut(data: np.ndarray, s1: int, s2: int, a: int, key: int, width: int, length: int) -> list[tuple]:
    """A run as runs of suffixes with offsets in one block of ``width``; key and context from the text."""
    out = []
    for b in range((a - s2) // width, (a - s1) // width + 1):
        first, last = max(s1, a - (b + 1) * width + 1), min(s2, a - b * width)
        core = data[a - b * width : a - (b + 1) * width + 1 + length].tobytes()
        new = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=key.to_bytes(8, "big", signed=True) + b.to_bytes(4, "big")).digest(), "big", signed=True)
        context = int.from_bytes(hashlib.blake2b(data[first : last + length].tobytes(), digest_size=8, key=(a - first).to_bytes(4, "big")).digest(), "big", signed=True)
        out.append((first, last, new, context))
    return out


def _few(df: DataFrame) -> DataFrame:
    """``df`` (staged, of one long column) with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _beside(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of the documents that have ``rows`` (uid and longs), each before its rows; ``rows`` is staged."""
    ids = staged(rows.select("uid").distinct(), "ids")
    texts = docs.join(_few(ids), "uid", "left_semi").withColumn("turn", F.lit(0))
    both = texts.unionByName(rows.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    return both.repartition(spread(docs.sparkSession), "uid").sortWithinPartitions("uid", "turn", *rows.columns[1:2])


def _gathered(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[dict, np.ndarray, dict[str, np.ndarray]]]:
    """(row, its text's bytes, columns of its rows) of each document of ``_beside``."""
    now, data, held = None, None, []

    def columns() -> dict[str, np.ndarray]:
        return {k: np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in names}

    for batch in batches:
        for part in pieces(batch, "text"):
            turn = part.column("turn").to_numpy()
            longs = {k: part.column(k).fill_null(0).to_numpy() for k in names}
            raw, offsets = rolling.buffers(part.column("text"))
            at = np.union1d(0, np.flatnonzero(turn == 0))
            for first, last in zip(at, np.append(at[1:], len(turn)), strict=True):
                if turn[first] == 0:
                    if now is not None:
                        yield now, data, columns()
                    now = {k: part.column(k)[int(first)].as_py() for k in part.schema.names if k not in ("text", "turn", *names)}
                    data, held, first = raw[offsets[first] : offsets[first + 1]].copy(), [], first + 1
                if last > first:
                    held.append({k: v[first:last] for k, v in longs.items()})
    if now is not None:
        yield now, data, columns()


def _flush(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    return record(ddl, [list(x) for x in zip(*rows, strict=True)] or [[] for _ in ddl.split(", ")])


def _compare(docs: DataFrame, wanted: DataFrame, length: int, block: int = 1 << 20) -> DataFrame:
    """Repeated ranges (uid, start, end) of the wanted runs, by sorting the suffixes of their buckets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row, data, runs in _gathered(batches, ("s1", "s2", "anchor", "key", "n")):
            for s1, s2, key, n in zip(*(runs[k].tolist() for k in ("s1", "s2", "key", "n")), strict=True):
                rows.append((key, row["uid"], s1, s2, n, data[s1 : s2 + length].tobytes()))
                held += s2 + length - s1
                if held > block:
                    yield _flush(SENT, rows)
                    rows, held = [], 0
        yield _flush(SENT, rows)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "uid", "s1", "s2", "n", "bytes")), strict=True):
                if held > block and row[0] != last:  # whole buckets only
                    yield _repeats(rows, length)
                    rows, held = [], 0
                rows.append(row)
                held, last = held + len(row[5]), row[0]
        if rows:
            yield _repeats(rows, length)

    sent = _beside(docs, wanted).mapInArrow(send, SENT)
    return sent.repartition(spread(docs.sparkSession), "key").sortWithinPartitions("key").mapInArrow(sort, "uid long, start long, end long")


def _repeats(rows: list[tuple], length: int) -> pa.RecordBatch:
    """Ranges of the suffixes that another suffix of the block equals; n = 2 counts as two places."""
    sizes = np.array([len(r[5]) for r in rows])
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    text = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
    many = np.array([r[3] - r[2] + 1 for r in rows])
    owner = np.repeat(np.arange(len(rows)), many)
    within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    starts = offsets[owner] + within
    weight = np.array([r[4] for r in rows])[owner]
    hit = np.zeros(len(starts), bool)
    for own, number in equal_prefixes(text, starts, length):
        number = number.astype(np.int64)
        hit[own[np.bincount(number, weight[own])[number] > 1]] = True
    hit &= weight == 1
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    new = np.flatnonzero(within == 0)  # a row's suffixes don't go on in the next row
    first = np.union1d(np.flatnonzero(edge == 1), new[hit[new]])
    last = np.union1d(np.flatnonzero(edge == -1) - 1, new[1:][hit[new[1:] - 1]] - 1)
    uid, base = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    return record("uid long, start long, end long", [uid[owner[first]], base[owner[first]] + within[first], base[owner[last]] + within[last] + length])


def _segments(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(uids, bases, bytes, offsets): all texts together, or one text's segments in turn if it is long."""
    data, offsets = rolling.buffers(part.column("text"))
    uid = part.column("uid").to_numpy()
    if len(uid) > 1 or len(data) <= SEGMENT:
        yield uid, np.zeros(len(uid), np.int64), data, offsets
        return
    for base in range(0, len(data) - length + 1, SEGMENT):
        own = data[base : base + SEGMENT + length - 1]
        yield uid, np.array([base]), own, np.array([0, len(own)])


def _combined(uid: np.ndarray, runs: tuple[np.ndarray, ...], length: int) -> pa.RecordBatch:
    """Runs of a batch, of equal ones the first with n = 2; n = 0 tells ranges (s1 to s2) of all those."""
    s1, s2, anchor, key, context = runs
    order = np.lexsort((context, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (context[order][1:] != context[order][:-1])
    group = np.cumsum(new) - 1
    many = np.zeros(len(order), bool)
    many[order] = np.bincount(group, minlength=len(order))[group] > 1
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    start, end, of = s1[many], s2[many] + length, uid[many]
    cut = np.ones(len(start), bool)
    cut[1:] = (of[1:] != of[:-1]) | (start[1:] > end[:-1])
    last = np.append(cut[1:], True)[: len(cut)]
    none = np.zeros(int(cut.sum()), np.int64)
    kept = first | ~many
    parts = zip((uid[kept], s1[kept], s2[kept], anchor[kept], key[kept], context[kept], 1 + many[kept].astype(np.int64)), (of[cut], start[cut], end[last], none, none, none, none), strict=True)
    return record(RUN, [np.concatenate(x) for x in parts])


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Ranges (uid, start, end) to be removed; they may overlap.  ``docs`` has uid and text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                for uid, base, data, offsets in _segments(part, length):
                    text, s1, s2, a, key, context = runs_of(data, offsets, length, gram)
                    yield _combined(uid[text], (s1 + base[text], s2 + base[text], a + base[text], key, context), length)

    runs = staged(docs.mapInArrow(scan, RUN), "runs")
    ranges = [runs.filter("n = 0").select("uid", F.col("s1").alias("start"), F.col("s2").alias("end"))]
    runs = runs.filter("n > 0")
    for width in (*WIDTHS, 0):
        # sums by key are written before they are joined, so that adaptive execution can split a key with very many runs
        again = staged(runs.groupBy("key").agg(F.sum("n").alias("t")).filter("t > 1").select("key"), "again")
        live = staged(runs.join(_few(again), "key", "left_semi"), "live")
        first = [F.first(c).alias(c) for c in ("uid", "s1", "s2", "anchor")]  # of one run
        kinds = staged(live.groupBy("key", "context").agg(F.sum("n").alias("c"), *first), "contexts")
        whole = live.filter("n = 1").join(kinds.filter("c > 1").select("key", "context"), ["key", "context"])
        ranges.append(whole.select("uid", F.col("s1").alias("start"), (F.col("s2") + length).alias("end")))
        mixed = staged(kinds.groupBy("key").agg(F.count("*").alias("k"), F.min("c").alias("low")).filter("k > 1 and low = 1").select("key", "k"), "mixed")
        left = staged(kinds.join(mixed, "key").select("uid", "s1", "s2", "anchor", "key", F.least("c", F.lit(2)).cast("long").alias("n"), "k"), "left")
        few, many = (left.filter(x).drop("k") for x in (f"k <= {crowd}", f"k > {crowd}"))
        ranges.append(_compare(docs, few, length))
        if not width or many.isEmpty():
            break

        def cut(batches: Iterator[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            rows: list[tuple] = []
            for row, data, runs in _gathered(batches, ("s1", "s2", "anchor", "key", "n")):
                for s1, s2, anchor, key, n in zip(*(x.tolist() for x in runs.values()), strict=True):
                    rows += [(row["uid"], first, last, anchor, new, context, n) for first, last, new, context in _cut(data, s1, s2, anchor, key, width, length)]
                    if len(rows) > 50_000:
                        yield _flush(RUN, rows)
                        rows = []
            yield _flush(RUN, rows)

        runs = staged(_beside(docs, many).mapInArrow(cut, RUN), "runs")
    out = ranges[0]
    for more in ranges[1:]:
        out = out.union(more)
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the ranges cover."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > ends[:-1])) if len(starts) else np.zeros(0, np.int64)
    return list(zip(starts[new].tolist(), ends[np.append(new[1:], len(ends)) - 1].tolist(), strict=True)) if len(new) else []


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean"


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """Counts and digest of what is left of every row, and whether anything repeats; with ``keep_text`` also its bytes."""
    rows, _ = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    ranges = staged(repeated_ranges(rows.select("uid", "text"), length), "ranges")
    result = RESULT + ", kept binary" * keep_text

    def left(doc: int | None, data: np.ndarray, spans: list[tuple[int, int]]) -> tuple:
        edges = [0, *(x for s in spans for x in s), len(data)]
        kept = b"".join(data[edges[k] : edges[k + 1]].tobytes() for k in range(0, len(edges), 2))
        return (doc, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(kept) < len(data), kept)[: 6 + keep_text]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for row, data, own in _gathered(batches, ("start", "end")):
            done.append(left(row["doc_id"], data, merged(own["start"], own["end"])))
            if len(done) >= (100 if keep_text else 2000):
                yield _flush(result, done)
                done = []
        yield _flush(result, done)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                data, offsets = rolling.buffers(part.column("text"))
                yield _flush(result, [left(doc, data[offsets[i] : offsets[i + 1]], []) for i, doc in enumerate(part.column("doc_id").to_pylist())])

    ids = staged(ranges.select("uid").distinct(), "repeating")
    rest = rows.join(_few(ids), "uid", "left_anti").select("doc_id", "text").mapInArrow(whole, result)
    return _beside(rows, ranges).mapInArrow(cut, result).union(rest)
