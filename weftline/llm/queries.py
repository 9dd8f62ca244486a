"""Queries over the operators of this folder, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.fingerprints import fingerprint_neighbours

    return fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


#: the bound of the samples that classifiers are fitted on
FIT_ROWS = 4000


def toxicity_chain(spark: SparkSession, sf_dir: str):
    from weftline.llm import toxicity
    from weftline.llm.labelled import labelled_texts

    texts, flags = labelled_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", FIT_ROWS)
    return toxicity.train(texts, flags)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), toxicity_chain(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm import quality
    from weftline.llm.labelled import labelled_texts

    docs = table(spark, sf_dir, "documents")
    sample = labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", FIT_ROWS, quality.learnable())
    return quality.score_quality(docs, quality.train(*sample))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import mix_sources

    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "n_tokens", "copy", "block", "slot")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:2] == "op" and k[2].isdigit()}


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[p + 1:p + least(len(w), 10)], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS p FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, l, p, array_to_string(w[p + 1:p + l], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS p FROM d, (SELECT DISTINCT l FROM v))),
h AS (SELECT doc_id, p, l, item_id FROM g JOIN v USING (l, g)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
g AS (SELECT g, row_number() OVER () AS k, count(*) AS c FROM s GROUP BY g HAVING count(*) > 1),
t AS (SELECT doc_id, k FROM s JOIN g USING (g)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM t a JOIN t b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT x, y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON r.y = b.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m.y, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.x = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op8_near_dedup": OP8_SQL}
