"""Queries of retrieval, deduplication and metrics, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed, tokens
from ..operators import retrieval as ops
from ..sources.tables import table


def naive_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    out = ops.first_wins(docs, F.sha2(F.encode(squeezed(F.col("text")), "utf-8"), 256), "doc_id")
    return out.select(F.col("first").alias("doc_id"), "n_members")


def dedup_clusters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    body = F.sha2(F.encode(squeezed(F.col("text")), "utf-8"), 256)
    first = ops.first_wins(docs, body, "doc_id").filter("n_members > 1").select("key", "first")
    return docs.select(body.alias("key"), "doc_id").join(first, "key").select("doc_id", F.col("first").alias("cluster"))


def coalesce_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Dockets (courts, where there is none) delivered with different texts: as many versions as distinct digests."""
    docs = table(spark, d, "documents").withColumn("docket_no", F.coalesce("docket_no", "court_id"))
    return docs.groupBy("docket_no").agg(F.count_distinct(F.md5(F.encode("text", "utf-8"))).alias("n_versions"), F.min("doc_id").alias("kept")).filter("n_versions > 1")


def dedup_pairs_prf(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of equal texts against pairs of one docket (of one court, where there is none)."""
    docs = table(spark, d, "documents").select(F.coalesce("docket_no", "court_id").alias("docket_no"), F.md5(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("body"))
    return ops.cluster_pair_counts(docs, "body", "docket_no")


def lineage_pair_partition(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of one text, split by whether both lie at one court; counted without building them."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.coalesce("docket_no", F.lit("")).alias("docket_no"), F.md5(F.encode("text", "utf-8")).alias("body"))
    n = lambda *c: F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0))
    inside = docs.groupBy("body", "docket_no").agg(F.count("*").alias("n")).agg(n().alias("within_lineage"))
    all_pairs = docs.groupBy("body").agg(F.count("*").alias("n")).agg(n().alias("all_pairs"))
    return inside.crossJoin(all_pairs).select("within_lineage", (F.col("all_pairs") - F.col("within_lineage")).alias("cross_lineage"))  # one row each


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ops.bm25(docs, table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text"))


BM25_SQL = r"""WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), []) AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS al FROM t),
 q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM eval_items) GROUP BY 1, 2),
 p AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 w AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al)) AS w FROM p JOIN df USING (term), s),
 h AS (SELECT query_id, doc_id, round(sum(w * qtf), 6) AS score FROM w JOIN q USING (term) GROUP BY 1, 2),
 a AS (SELECT * FROM h UNION ALL SELECT item_id, doc_id, 0.0 FROM eval_items, (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) WHERE (item_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM h)),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM a) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10"""


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    toks = table(spark, d, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return toks.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def contamination(spark: SparkSession, d: str) -> DataFrame:
    """Per court, whether any of its texts still holds the court's old name as whole words."""
    courts = table(spark, d, "courts").select("court_id", F.col("court_name").alias("value"))
    return ops.contaminated(table(spark, d, "documents").select("court_id", "text"), courts, "court_id")


CONTAMINATION_SQL = r"""SELECT c.court_id, coalesce(bool_or(contains(text, court_name) AND regexp_matches(text, '(^|[^\p{L}\p{N}_])' || regexp_escape(court_name) || '($|[^\p{L}\p{N}_])')), false) AS contaminated FROM courts c LEFT JOIN documents d USING (court_id) GROUP BY 1"""


def contamination_rate(spark: SparkSession, d: str) -> DataFrame:
    x = contamination(spark, d)
    return x.agg(F.round(F.avg(F.col("contaminated").cast("int")), 6).alias("rate"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("contaminated"), F.col("court_id")))), ",").alias("offending"))


def percentiles(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.sum(F.octet_length("props")).cast("long").alias("bytes"))


def _arms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "event_type", (F.col("event_id") * 7 % 10 < 5).cast("int").alias("a"), (F.col("value") > 20).cast("int").alias("b"))


def paired_contrast(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).groupBy("event_type").agg(F.round((F.avg("b") - F.avg("a")) * 100, 6).alias("delta_pp"), F.count("*").alias("n"))


def discordance(spark: SparkSession, d: str) -> DataFrame:
    return _arms(spark, d).groupBy("event_type").agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), F.count_if(F.col("a") == F.col("b")).alias("concordant"))


def sign_test(spark: SparkSession, d: str) -> DataFrame:
    """Exact p-value per event type."""

    @F.pandas_udf("double")
    def p(up: pd.Series, down: pd.Series) -> pd.Series:
        return pd.Series([ops.sign_test(int(x), int(y)) for x, y in zip(up, down)], dtype=float)

    return discordance(spark, d).select("event_type", F.round(p("only_b", "only_a"), 6).alias("p_value"))


def blind_order(spark: SparkSession, d: str) -> DataFrame:
    """Every question under every arm, in one blind order: (question_id, arm, position). The order is that of a keyed hash, so
    it is the same on any cluster and needs no shuffle on the driver; positions come from counts of hash ranges."""
    arms = spark.createDataFrame([("A",), ("B",), ("C",)], "arm string")  # three rows, a fixed design
    batch = table(spark, d, "eval_items").select(F.col("item_id").alias("question_id")).crossJoin(F.broadcast(arms))
    batch = batch.withColumn("h", F.md5(F.concat_ws("|", F.lit("7"), F.col("question_id").cast("string"), "arm")))
    batch = batch.withColumn("range", F.substring("h", 1, 2))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 256 rows
    starts = batch.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("h", "question_id", "arm"))
    return batch.join(F.broadcast(starts), "range").select("question_id", "arm", (F.col("start") + within - 1).alias("position"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return ops.bootstrap_contrast(_arms(spark, d).select(F.col("event_id").alias("id"), "a", "b"))


def vocabulary_before(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ops.vocabulary_before(e.select(F.col("user_id").alias("scope"), F.date_format("ts", "yyyy-MM-dd HH").alias("session"), F.concat_ws(":", "event_type", F.floor(F.col("value") / 50).cast("string")).alias("subject")))


def session_build(spark: SparkSession, d: str) -> DataFrame:
    """A user's hour of events as one text of ``role: text`` lines in order."""
    e = table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("session"), F.struct("ts", "event_id", F.concat_ws(": ", "event_type", squeezed(F.col("props"))).alias("line")).alias("x"))
    lines = e.groupBy("user_id", "session").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return lines.select("user_id", "session", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("text"), F.size("xs").alias("n_lines"))


_SQ = r"trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))"
_ARMS = "x AS (SELECT event_type, CAST(event_id * 7 % 10 < 5 AS INT) AS a, CAST(value > 20 AS INT) AS b FROM events)"

QUERIES = {
    f.__name__: f
    for f in (naive_dedup, dedup_clusters, coalesce_collisions, dedup_pairs_prf, lineage_pair_partition, bm25_topk, term_stats, contamination, contamination_rate, percentiles, paired_contrast, discordance, sign_test, bootstrap_ci, blind_order, vocabulary_before, session_build)
}
_PAIRS = "x AS (SELECT coalesce(docket_no, court_id) AS docket_no, md5(coalesce(text, '')) AS body FROM documents), n AS (SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x GROUP BY body, docket_no)) AS tp, (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x GROUP BY body)) AS p, (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x GROUP BY docket_no)) AS l)"
ORACLE = {
    "naive_dedup": f"SELECT min(doc_id) AS doc_id, count(*) AS n_members FROM documents WHERE text IS NOT NULL GROUP BY {_SQ}",
    "dedup_clusters": f"WITH x AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_SQ}) AS cluster, count(*) OVER (PARTITION BY {_SQ}) AS n FROM documents WHERE text IS NOT NULL) SELECT doc_id, cluster FROM x WHERE n > 1",
    "coalesce_collisions": "SELECT coalesce(docket_no, court_id) AS docket_no, count(DISTINCT text) AS n_versions, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(DISTINCT text) > 1",
    "dedup_pairs_prf": f"WITH {_PAIRS}, r AS (SELECT tp, p, l, coalesce(tp / nullif(p, 0), 0) AS pr, coalesce(tp / nullif(l, 0), 0) AS rc FROM n) SELECT CAST(tp AS BIGINT) AS tp, CAST(p - tp AS BIGINT) AS fp, CAST(l - tp AS BIGINT) AS fn, round(pr, 6) AS \"precision\", round(rc, 6) AS recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1 FROM r",
    "lineage_pair_partition": "WITH x AS (SELECT coalesce(docket_no, '') AS k, md5(text) AS body FROM documents WHERE text IS NOT NULL), n AS (SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x GROUP BY body, k)) AS w, (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x GROUP BY body)) AS a) SELECT CAST(w AS BIGINT) AS within_lineage, CAST(a - w AS BIGINT) AS cross_lineage FROM n",
    "bm25_topk": BM25_SQL,
    "term_stats": r"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1",
    "contamination": CONTAMINATION_SQL,
    "contamination_rate": f"SELECT round(avg(CAST(contaminated AS INT)), 6) AS rate, coalesce(string_agg(court_id, ',' ORDER BY court_id) FILTER (contaminated), '') AS offending FROM ({CONTAMINATION_SQL})",
    "percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1",
    "paired_contrast": f"WITH {_ARMS} SELECT event_type, round((avg(b) - avg(a)) * 100, 6) AS delta_pp, count(*) AS n FROM x GROUP BY 1",
    "discordance": f"WITH {_ARMS} SELECT event_type, count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b, count(*) FILTER (a = b) AS concordant FROM x GROUP BY 1",
    "sign_test": f"WITH {_ARMS}, c AS (SELECT event_type, count(*) FILTER (a <> b) AS n, least(count(*) FILTER (a > b), count(*) FILTER (a < b)) AS k FROM x GROUP BY 1) SELECT event_type, round(least(1.0, 2 * list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))), 6) AS p_value FROM c",
    "blind_order": "SELECT item_id AS question_id, arm, CAST(row_number() OVER (ORDER BY md5('7|' || item_id || '|' || arm), item_id, arm) - 1 AS BIGINT) AS position FROM eval_items, (VALUES ('A'), ('B'), ('C')) AS t(arm)",
    "vocabulary_before": "WITH m AS (SELECT user_id AS scope, strftime(ts, '%Y-%m-%d %H') AS session, event_type || ':' || CAST(floor(value / 50) AS BIGINT) AS subject FROM events), f AS (SELECT scope, subject, min(session) AS session FROM m GROUP BY 1, 2), n AS (SELECT scope, session, count(*) AS k FROM f GROUP BY 1, 2), s AS (SELECT DISTINCT scope, session FROM m) SELECT s.scope, s.session, CAST(coalesce(sum(coalesce(k, 0)) OVER (PARTITION BY s.scope ORDER BY s.session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_known FROM s LEFT JOIN n ON s.scope = n.scope AND s.session = n.session",
    "session_build": r"SELECT user_id, strftime(ts, '%Y-%m-%d %H') AS session, string_agg(event_type || ': ' || trim(regexp_replace(props, '\s+', ' ', 'g')), chr(10) ORDER BY ts, event_id) AS text, CAST(count(*) AS INTEGER) AS n_lines FROM events GROUP BY 1, 2",
}
