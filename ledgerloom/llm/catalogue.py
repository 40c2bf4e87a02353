"""Queries pN_ of the problems on corpora of text, and their SQL twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from . import encoding, leakage, shared_spans

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"), TOKENIZERS).withColumnRenamed("id", "doc_id")


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Decodes every document's ids: the digest of what comes back."""
    coded = encoding.encode_corpus(table(spark, d, "documents"), TOKENIZERS)
    return encoding.decode_corpus(coded, TOKENIZERS).select(F.col("id").alias("doc_id"), F.sha2(F.encode("text", "utf-8"), 256).alias("digest"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Twelve equal words in a row score 24 at least; the run itself is checked on the words."""
    pairs = leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return pairs.filter("score >= 24 AND longest_run >= 12").select(F.col("id").alias("doc_id"), "item_id")


def p7_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Whole and edited copies: pairs whose alignment reaches half of the item's best score, or 12 equal words in a row."""
    pairs = leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"), edited=True)
    return pairs.filter("score >= n_words OR longest_run >= 12").withColumnRenamed("id", "doc_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_pairs(table(spark, d, "documents")).withColumnsRenamed({"id_a": "doc_id_a", "id_b": "doc_id_b"})


def p8_coverage(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_coverage(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p6_ids, p6_roundtrip, p7_found, p7_alignments, p8_found, p8_coverage)}
_WORDS = lambda t: f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = lambda key, table: f"(SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM (SELECT {key}, {_WORDS('text')} AS w FROM {table} WHERE text IS NOT NULL))"
#: Every window of 320 characters, by hash; and those that two documents have.
_WINDOWS = "g AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(text, i, 320)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 318)) AS i FROM documents WHERE length(text) >= 320)), s AS MATERIALIZED (SELECT h FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)), k AS MATERIALIZED (SELECT DISTINCT doc_id, h FROM g SEMI JOIN s USING (h)), p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b USING (h) WHERE a.doc_id <> b.doc_id)"
ORACLE = {
    "p6_roundtrip": "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents",
    "p7_found": f"SELECT DISTINCT doc_id, item_id FROM {_GRAMS('doc_id', 'documents')} JOIN {_GRAMS('item_id', 'eval_items')} USING (g)",
    "p8_found": f"WITH {_WINDOWS} SELECT x AS doc_id_a, y AS doc_id_b FROM p WHERE x < y",
    "p8_coverage": f"""WITH {_WINDOWS}, c AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g SEMI JOIN s USING (h)), d AS (SELECT doc_id, sum(least(320, coalesce(n - i, 320))) AS shared FROM c GROUP BY 1), l AS (SELECT x AS doc_id, count(*) AS n FROM p GROUP BY 1)
 SELECT doc_id, CAST(coalesce(length(text), 0) AS INT) AS n_chars, CAST(coalesce(shared, 0) AS INT) AS shared_chars, coalesce(n, 0) AS n_links FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN l USING (doc_id)""",
}
