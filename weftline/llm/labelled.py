"""A bounded sample of labelled texts for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: str = "true") -> tuple[list[str], list[int]]:
    """Whole texts and 0/1 labels of at most ``rows`` labelled documents.

    ``learn`` is an SQL condition on doc_id.  The ids are the first ``rows`` in the order of a hash, so the
    sample is the same whatever the order of the tables; null ids, texts and labels are left out (a labelled id without a text is
    not replaced by another).  If ids repeat, the largest label and the smallest text of each are taken.  ``rows`` is the only bound: no
    text is cut or left out for its length.
    """
    flags = labels.filter(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(F.max(label).alias("label")).filter(learn)
    ids = flags.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    found = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")).collect()
    found.sort(key=lambda r: r.doc_id)
    return [r.text for r in found], [int(r.label) for r in found]
