"""Near-duplicate groups: MinHash, banding, signature checks, exact links, connected components.

A document's set has the distinct five-word shingles of its lower-cased (A-Z) words; with fewer words
the whole sequence is the one shingle.  Documents with 100 * intersection >= ``percent`` * union are
linked.

* Every text gives its set's size, a 128-bit digest of the set, and ``bands`` hashes of ``width``
  minima each (one pass; nothing else of the set is kept).  Equal sets are one class from here on.
* Classes that share a band hash are candidates.  Each class is compared with the smallest class of
  each of its buckets: pairs whose signatures (a byte of each minimum) agree far too seldom go, the
  others are confirmed on the full sets, built anew from the texts, which are sent to the partition of
  the class they are compared with; a class that many others are compared with is salted, so no task
  gets an unbounded group.  Components of the confirmed links are found.
* A bucket is settled if its classes, but for the smallest, are in one component.  Of the classes of
  the other buckets, those that can be linked with none of them go: with n shingles, u of them in no
  other of these classes, an intersection has at most n - u and the union at least n.  What is left
  are families of near copies that aren't linked with their smallest member.  A family is cut into
  chunks of at most about ``CHUNK_ROWS`` classes or ``CHUNK_SHINGLES`` shingles, and two chunks are
  compared in a task of their own, by products of 0/1 matrices, on the full sets.  A component that is
  larger than a chunk has chunks of its own, which aren't compared with one another; the chunks of a
  family are parted by set sizes as well, and those whose sizes rule out a link aren't compared.
  Only links that join components leave a task, so nothing is emitted for each pair; the classes sent
  grow with those outside a family's large components, times its chunks.  No link is lost here:
  nothing is estimated.

Two chances of losing a link remain.  Banding misses a pair at the threshold with probability
(1 - 0.85**5)**24 < 1e-6, and the signature check drops it five standard deviations below the
threshold (3e-7); of 120 minima of a linked pair 102 agree on average, and at least 83 are asked for.

Null and empty texts have size 0 and are linked with nothing.  Rows without a doc_id are linked with
nothing, have no component and are kept.  Rows that share a doc_id are linked by their texts alone; a
component is named by the smallest doc_id in it.  Texts of any length are whole in one task's memory,
one at a time but for a comparison's chunk.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import rolling
from weftline.llm.common import fresh, numbered, pieces, record, spread, staged
from weftline.llm.components import components

WORDS, BANDS, WIDTH = 5, 24, 5
_draw = np.random.Generator(np.random.PCG64(97))
_A = _draw.integers(0, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(0, 1 << 64, BANDS * WIDTH, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: lists of ids up to this length may be broadcast (16 bytes each and little more)
BROADCAST_ROWS = 1_000_000
#: a chunk of a family has about so many classes, or shingles, whichever comes first
CHUNK_ROWS, CHUNK_SHINGLES = 800, 400_000
#: texts that one partition of the comparisons with a bucket's smallest class gets, on average at most
SALT = 100
#: columns of the 0/1 matrices at a time
_SLICE = 4096


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = rolling.buffers(column)
    n = len(offsets) - 1
    starts, ends, before = rolling.words(data, offsets)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * n
    own = rolling.spans(rolling.prefix(data, rolling.VALUES_LOWER), starts, ends)
    running = own.copy()
    size = max(0, len(own) - words + 1)
    full = np.zeros(size, np.uint64)
    for k in range(words):
        full = full * _STEP + own[k : k + size]
    full = rolling.mix(full)
    found = []
    for i in range(n):
        a, b = before[i], before[i + 1]
        if b - a >= words:
            x = np.sort(full[a : b - words + 1])
            found.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in running[a:b]:
                    h = h * _STEP + w
            found.append(rolling.mix(np.array([h], np.uint64) ^ np.uint64(0x5BF03635)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash function over a set."""
    best = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(best, (_A[:, None] * shingles[None, i : i + 512] + _B[:, None]).min(axis=1), out=best)
    return best


_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E6C63D0876A9A47)


def band_hashes(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(*least.shape[:-1], BANDS, WIDTH)
    h = np.broadcast_to(_BAND, rows.shape[:-1]).copy()
    for k in range(WIDTH):
        h = rolling.mix(h * _STEP + rows[..., k])
    return h


SIGNATURE = "uid long, n_shingles long, key long, more long, bands array<long>, marks binary"


def signatures(docs: DataFrame) -> DataFrame:
    """Size, digest (two longs), band hashes and a byte of each minimum for every row of (uid, text)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"))
                least = np.stack([minima(x) for x in sets])
                bands = band_hashes(least).view(np.int64)
                filled = np.array([len(x) > 0 for x in sets])
                where = np.concatenate(([0], np.cumsum(filled * BANDS))).astype(np.int32)
                with np.errstate(over="ignore"):
                    key = np.array([np.add.reduce(rolling.mix(x ^ np.uint64(0x51))) for x in sets], np.uint64)
                    more = np.array([np.add.reduce(rolling.mix(x * _STEP)) for x in sets], np.uint64)
                marks = (least >> np.uint64(56)).astype(np.uint8) ^ (least >> np.uint64(40)).astype(np.uint8)
                yield record(SIGNATURE, {
                    "uid": part.column("uid"), "n_shingles": [len(x) for x in sets], "key": key.view(np.int64), "more": more.view(np.int64),
                    "bands": pa.ListArray.from_arrays(pa.array(where), pa.array(bands[filled].ravel())), "marks": [m.tobytes() for m in marks],
                })

    return docs.select("uid", "text").mapInArrow(sign, SIGNATURE)


def _small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if a count of it (it is staged) shows that it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose signatures don't rule out a link (five standard deviations below the threshold)."""
    n, t = BANDS * WIDTH, percent / 100
    least = n * t - 5 * (n * t * (1 - t)) ** 0.5
    marks = classes.select("rep", "marks")
    both = pairs.join(marks.withColumnsRenamed({"rep": "a", "marks": "a_marks"}), "a").join(marks.withColumnsRenamed({"rep": "b", "marks": "b_marks"}), "b")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in ("a_marks", "b_marks"))
            yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select(["a", "b"])

    return both.mapInArrow(estimate, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, on the full sets; ``pairs`` is staged.

    The text of b goes to the partition of a and a salt; a's text goes to each of its salts.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).cast("int").alias("salts"))
    sent = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("uid"), F.lit(1).alias("role"))
    own = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("uid"), F.lit(0).alias("role"))
    roles = _small(staged(sent.union(own), "roles"))
    rows = docs.join(roles, "uid").select("a", "salt", "role", "uid", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, first = None, None
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                found = []
                columns = [part.column(c).to_pylist() for c in ("a", "salt", "role", "uid")]
                for a, s, role, b, x in zip(*columns, shingle_sets(part.column("text")), strict=True):
                    if not role:
                        group, first = (a, s), x
                    elif group == (a, s) and linked(first, x, percent):
                        found.append((a, b))
                yield record("a long, b long", [[x for x, _ in found], [x for _, x in found]])

    dealt = rows.repartition(spread(docs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role")
    return dealt.mapInArrow(compare, "a long, b long")


def own_shingles(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, u): how many shingles no other of these classes has, where there are any; ``classes`` is staged."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text"))
                yield record("rep long, shingle long", [np.repeat(part.column("uid").to_numpy(), [len(x) for x in sets]), np.concatenate(sets).view(np.int64)])

    rows = docs.join(_small(classes.withColumnRenamed("rep", "uid")), "uid").select("uid", "text")
    found = rows.mapInArrow(emit, "rep long, shingle long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep"))
    return found.filter("n = 1").groupBy("rep").agg(F.count("*").alias("u"))


def joining(first: list[tuple], second: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between (rep, root, set) of two chunks that join components, or within one if the second is empty."""
    rows, other = first, second or first
    mine, theirs = (np.concatenate([x for _, _, x in side]) for side in (rows, other))
    shared = np.intersect1d(mine, theirs)
    if not second:  # within a chunk: what two have at least
        shared, many = np.unique(mine, return_counts=True)
        shared = shared[many > 1]

    def places(side: list[tuple], sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(side)), [len(x) for _, _, x in side])
        at = np.minimum(np.searchsorted(shared, sets), len(shared) - 1)
        hit = shared[at] == sets
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    if not len(shared):
        return []
    (a_at, a_of), (b_at, b_of) = places(rows, mine), places(other, theirs)
    both = np.zeros((len(rows), len(other)), np.float32)
    for low in range(0, len(shared), _SLICE):
        flags = []
        for side, at, of in ((rows, a_at, a_of), (other, b_at, b_of)):
            part = slice(*np.searchsorted(at, (low, low + _SLICE)))
            flags.append(np.zeros((len(side), min(_SLICE, len(shared) - low)), np.float32))
            flags[-1][of[part], at[part] - low] = 1
        both += flags[0] @ flags[1].T
    n, m = (np.array([len(x) for _, _, x in side], np.float64) for side in (rows, other))
    apart = np.array([r for _, r, _ in rows])[:, None] != np.array([r for _, r, _ in other])
    found = []
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, j in np.argwhere((100 * both >= percent * (n[:, None] + m - both)) & apart):
        x, y = find(rows[i][1]), find(other[j][1])
        if x != y:
            root[max(x, y)] = min(x, y)
            found.append((rows[i][0], other[j][0]))
    return found


def families(opened: DataFrame) -> DataFrame:
    """(rep, family): classes that are tied by buckets; ``opened`` is staged."""
    centers = _small(staged(opened.groupBy("band").agg(F.min("rep").alias("low")), "centers"))  # so that members aren't dealt by band
    return components(opened.join(centers, "band").select("rep", "low")).withColumnsRenamed({"node": "rep", "root": "family"})


def blocks(named: DataFrame, percent: int) -> DataFrame:
    """(uid, root, family, i, j, side): the classes of ``named`` (rep, root, n, family) that each block (family, i, j) compares."""
    cuts = F.greatest(F.ceil(F.count("*") / CHUNK_ROWS), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int")
    mixed = named.groupBy("family").agg(cuts.alias("all"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("family", "all")
    large = named.groupBy("family", "root").agg(cuts.alias("own")).filter("own > 1")
    level = F.when(F.col("all") > 1, F.floor(F.log(F.col("n").cast("double")) / math.log(100 / min(percent, 99)))).otherwise(0)
    told = named.join(mixed, "family").join(large, ["family", "root"], "left").withColumn("level", level)
    told = told.withColumn("held", F.col("own").isNotNull()).withColumn("of", F.when(F.col("held"), F.col("root")).otherwise(0))
    group = ["family", "held", "of", "level"]
    cut = told.join(told.groupBy(*group).agg(cuts.alias("cuts")), group).withColumn("cut", F.pmod(F.xxhash64("rep"), "cuts").cast("int"))
    cut = staged(cut.select("rep", "root", "n", *group, "cut"), "cut")
    chunks = cut.groupBy(*group, "cut").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    chunks = staged(chunks.selectExpr("*", "row_number() over (partition by family order by held, of, level, cut) as chunk"), "chunks")
    one, other = (chunks.select("family", *(F.col(c).alias(f"{c}_{x}") for c in ("held", "of", "least", "most", "chunk"))) for x in "ij")
    apart = f"chunk_i < chunk_j and not (held_i and held_j and of_i = of_j) and 100 * most_i >= {percent} * least_j and 100 * most_j >= {percent} * least_i"
    met = one.join(other, "family").filter(f"chunk_i = chunk_j and not held_i or {apart}")
    sides = F.expr("filter(array(struct(chunk_i as chunk, 0 as side), struct(chunk_j as chunk, 1 as side)), x -> x.side = 0 or chunk_i < chunk_j)")
    met = met.select("family", F.col("chunk_i").alias("i"), F.col("chunk_j").alias("j"), F.explode(sides).alias("at")).select("family", "i", "j", "at.chunk", "at.side")
    placed = cut.join(chunks.select(*group, "cut", "chunk"), [*group, "cut"])
    return placed.join(met, ["family", "chunk"]).select(F.col("rep").alias("uid"), "root", "family", "i", "j", "side")


def joining_links(docs: DataFrame, opened: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components of the classes of ``opened`` (band, rep, root, n), which is staged."""
    named = staged(opened.select("rep", "root", "n").distinct().join(families(opened), "rep"), "families")
    dealt = _small(staged(blocks(named, percent), "blocks"))
    rows = docs.join(dealt, "uid").select("family", "i", "j", "side", "uid", "root", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, ([], [])

        def links() -> pa.RecordBatch:
            found = joining(*held, percent) if held[0] and (held[1] or block[1] == block[2]) else []
            return record("a long, b long", [[x for x, _ in found], [x for _, x in found]])

        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                columns = [part.column(c).to_pylist() for c in ("family", "i", "j", "side", "uid", "root")]
                for family, i, j, side, uid, root, x in zip(*columns, shingle_sets(part.column("text")), strict=True):
                    if block != (family, i, j):
                        if block:
                            yield links()
                        block, held = (family, i, j), ([], [])
                    held[side].append((uid, root, x))
        if block:
            yield links()

    return rows.repartition(spread(docs.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(compare, "a long, b long")


def _rooted(df: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``df`` with the component ``root`` of its ``rep``, which is its own if it has no link."""
    if roots is None:
        return df.withColumn("root", F.col("rep"))
    return df.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def near_duplicates(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows, once = numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    signed = staged(signatures(rows.filter("doc_id is not null")), "signatures")
    groups = signed.filter("n_shingles > 0").groupBy("key", "more")
    classes = staged(groups.agg(F.min("uid").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")), "classes")
    banded = classes.select("rep", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("center")).filter("n > 1").select("band", "center")
    members = staged(banded.join(buckets, "band").filter("rep <> center"), "members")
    pairs = staged(possible(members.select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), classes, percent), "pairs")
    roots = links = None
    if not pairs.isEmpty():
        links = staged(confirmed(rows, pairs, percent), "links")
        roots = components(links)

    def unsettled(placed: DataFrame) -> DataFrame:
        """Classes of buckets that hold several components (the smallest class of a bucket has been compared)."""
        mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("band")
        return staged(placed.join(_small(staged(mixed, "mixed")), "band"), "unsettled")

    opened = unsettled(_rooted(members.select("band", "rep"), roots))
    if not opened.isEmpty():
        alone = own_shingles(rows, staged(opened.select("rep").distinct(), "open"))
        told = opened.join(classes.select("rep", "n"), "rep").join(alone, "rep", "left")
        opened = unsettled(told.filter(f"100 * (n - coalesce(u, 0)) >= {percent} * n").select("band", "rep", "root", "n"))
        if not opened.isEmpty():
            more = staged(joining_links(rows, opened, percent), "more-links")
            roots = components(more if links is None else links.union(more))

    reps = _rooted(classes.select("key", "more", "rep"), roots).select("key", "more", "root")
    tied = signed.filter("n_shingles > 0").select("uid", "n_shingles", "key", "more").join(reps, ["key", "more"]).select("uid", "n_shingles", "root")
    found = tied.union(signed.filter("n_shingles = 0").select("uid", "n_shingles", F.col("uid").alias("root")))
    if once:
        named = found.select(F.col("uid").alias("doc_id"), "n_shingles", F.col("root").alias("component_id"))
    else:
        whose = staged(found.join(rows.select("uid", "doc_id"), "uid"), "named")
        named = whose.join(whose.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "n_shingles", "component_id")
        nameless = rows.filter("doc_id is null").withColumnRenamed("doc_id", "component_id")
        named = named.union(signatures(nameless).select(F.lit(None).cast("long"), "n_shingles", F.lit(None).cast("long")))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_copies(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each group: that of the smallest id.

    Where rows share that id, the one with the smallest text (null is smallest) and then the smallest hash of its other
    columns stays (of wholly equal rows, any one).  Rows without an id stay, with all their columns.
    """
    found = staged(near_duplicates(docs, percent, doc_id, text), "groups")
    gone, twice, row, place = fresh(docs, "gone", "twice", "row", "place")
    copies = _small(staged(found.filter("not kept").select(F.col("doc_id").alias(gone)).distinct(), "gone"))
    left = docs.join(copies, F.col(doc_id) == F.col(gone), "left_anti")
    again = staged(found.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(twice)), "twice")
    if again.isEmpty():
        return left
    same = F.col(doc_id) == F.col(twice)
    packed = left.join(_small(again), same, "left_semi").select(F.col(doc_id).alias(place), F.struct(F.col(text).alias("t"), F.xxhash64(*left.columns).alias("h"), F.struct(*left.columns).alias("r")).alias(row))
    one = packed.groupBy(place).agg(F.min(row).alias(row)).select(f"{row}.r.*")
    return left.join(_small(again), same, "left_anti").unionByName(one)
