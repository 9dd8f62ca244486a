"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Benchmark items are cut into windows of ``size`` words (an item of fewer words is one window); a
document word inside any occurrence of a window is hit.  A window is the set of its shingles of
``gram`` words.  A text that contains the window contains all of them, so for containment the
necessary prefix is one shingle, and the rarest is taken:

1. document shingles are joined to the benchmark's shingles (hashes); what is left is written out,
2. it is counted, which orders each window's shingles by rarity in the corpus,
3. each window's rarest shingle is joined to its places; its offset in the window gives the place
   where the window would start, which must leave room for the whole window in the text,
4. candidates go back to their documents, where the window's words are compared with the words there.

Benchmark shingles and the ids of documents with candidates are broadcast only after a count; beyond
the bounds they are shuffled.  Only texts with candidates are moved, once (all of them beyond the bound).

If ids repeat or are null, rows are numbered first, so each row is judged by its own text.  Null and
empty texts have no words; null item ids and texts are ignored; repeated items count once; without
benchmark items nothing is hit, and without documents there are no rows.  A text's words, and the
candidates of one text, are one row's arrays, whatever their length.  All columns of a document are
carried as one struct, so they may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import lower_ascii, numbered, staged

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: rows of about 40 bytes (shingles) and 16 bytes (ids) that may be broadcast
BROADCAST_SHINGLES, BROADCAST_IDS = 500_000, 2_000_000


def words_of(text: Column) -> Column:
    """Lower-cased words of digits, letters and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _shingles(words: Column, gram: int) -> Column:
    """Hash of the ``gram`` words from each place on."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - gram + 1, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, gram))))


def benchmark_windows(benchmark: DataFrame, size: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: wid, words, items that hold them."""
    items = benchmark.filter(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w")).filter("size(w) > 0")
    cut = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.slice("w", i + 1, size))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.md5(F.concat_ws(" ", "words")).alias("wid"), "words", "items")


def mark_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, gram: int = 4, doc_id: str = "doc_id", text: str = "text", tag: str = "decontaminate") -> DataFrame:
    """``row`` (a struct of the row's columns) and ``hits`` (n_words, n_hit, items as sorted strings) of every document."""
    rows, _ = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct("*").alias("row")))
    rows = rows.select("uid", "text", "row")
    windows = staged(benchmark_windows(benchmark, size), f"{tag}-windows")
    grams = [r.n for r in windows.select(F.least(F.size("words"), F.lit(gram)).cast("int").alias("n")).distinct().collect()]
    candidates = None
    for n in grams:  # one, unless items are shorter than a shingle
        own = windows.filter(F.least(F.size("words"), F.lit(gram)) == n)
        inside = own.select("wid", F.size("words").alias("long"), F.posexplode(_shingles(F.col("words"), n)).alias("offset", "shingle"))
        known = staged(inside.select("shingle").distinct(), f"{tag}-shingles")
        if known.count() <= BROADCAST_SHINGLES:
            known = F.broadcast(known)
        parts = rows.select("uid", words_of(F.col("text")).alias("w")).select("uid", F.size("w").alias("n_words"), F.posexplode(_shingles(F.col("w"), n)).alias("place", "shingle"))
        places = staged(parts.join(known, "shingle"), f"{tag}-places")
        rarity = places.groupBy("shingle").agg(F.count("*").alias("many"))
        ordered = inside.join(rarity, "shingle", "left").withColumn("many", F.coalesce("many", F.lit(0)))
        prefix = ordered.groupBy("wid", "long").agg(F.min(F.struct("many", "offset", "shingle")).alias("p")).filter("p.many > 0").select("wid", "long", "p.offset", "p.shingle")
        found = places.join(prefix, "shingle").withColumn("start", F.col("place") - F.col("offset")).filter("start >= 0 and start + long <= n_words").select("uid", "start", "wid")
        candidates = found if candidates is None else candidates.union(found)
    none = F.struct(F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    if candidates is None:
        return rows.select("row", none.alias("hits"))
    candidates = staged(candidates.distinct(), f"{tag}-candidates")
    ids = staged(candidates.select("uid").distinct(), f"{tag}-ids")
    if ids.count() > BROADCAST_IDS:
        return _verified(rows, candidates, windows)
    ids = F.broadcast(ids)  # so only the texts with candidates are moved
    return _verified(rows.join(ids, "uid", "left_semi"), candidates, windows).unionByName(rows.join(ids, "uid", "left_anti").select("row", none.alias("hits")))


def _verified(rows: DataFrame, candidates: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidates compared with the words of their texts; what agrees makes the ``hits``."""
    full = candidates.join(windows, "wid").groupBy("uid").agg(F.collect_list(F.struct("start", "words", "items")).alias("c"))
    joined = rows.join(full, "uid", "left").withColumn("w", words_of(F.col("text")))
    true = F.filter(F.coalesce("c", F.array().cast(full.schema["c"].dataType)), lambda c: F.slice("w", c["start"] + 1, F.size(c["words"])) == c["words"])
    joined = joined.withColumn("c", true)
    spans = F.array_sort(F.transform("c", lambda c: F.struct(c["start"].alias("s"), (c["start"] + F.size(c["words"])).alias("e"))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit"))
    n_hit = F.aggregate(spans, zero, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("hit")), lambda a: a["hit"])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("c", lambda c: c["items"]))))
    return joined.select("row", F.struct(F.size("w").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), items.alias("items")).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    marked = mark_hits(docs.select("doc_id", "text"), benchmark, size)
    return marked.select(
        "row.doc_id",
        "hits.n_words",
        "hits.n_hit",
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows that hold no window of the benchmark, with their columns."""
    return mark_hits(docs, benchmark, size).filter("hits.n_hit = 0").select("row.*")
