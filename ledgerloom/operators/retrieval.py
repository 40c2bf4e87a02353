"""Ranking and scoring: BM25, deduplication, contamination, paired metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_by_words
from ..session import cut

K1, B = 1.5, 0.75


#: Postings of queries (query, term) that one pass over the documents takes.
BLOCK_POSTINGS = 2_000_000
#: Documents, and scores of documents under queries, that a task works out at a time.
SLICE_ROWS, SLICE_SCORES = 500, 4_000_000


def split_words(texts: pa.Array) -> tuple[pa.ListArray, np.ndarray]:
    """Lower-case runs of letters, digits and underscores of each text, among empty strings, and how many runs there are."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}_]+")
    real = pc.not_equal(parts.flatten(), "").to_numpy(zero_copy_only=False)
    return parts, np.bincount(pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)[real], minlength=len(parts))


def _terms(batches):
    for b in batches:
        parts, _ = split_words(b.column(1))
        term, row = parts.flatten(), pc.list_parent_indices(parts)
        real = pc.not_equal(term, "")
        yield pa.RecordBatch.from_arrays([b.column(0).take(row.filter(real)), term.filter(real)], ["query_id", "term"])


class _Queries:
    """Postings of a block of queries: sorted terms, and per term the queries that have it with their counts."""

    def __init__(self, rows: list):
        self.ids = sorted({r["query_id"] for r in rows})
        number = {q: i for i, q in enumerate(self.ids)}
        self.terms = sorted({r["term"] for r in rows})
        at = {t: i for i, t in enumerate(self.terms)}
        flat = sorted((at[r["term"]], number[r["query_id"]], r["qtf"]) for r in rows)
        self.start = np.searchsorted([x[0] for x in flat], np.arange(len(self.terms) + 1))
        self.query, self.qtf = np.array([x[1] for x in flat], np.int64), np.array([x[2] for x in flat], float)

    def postings(self, tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, count) of the queries' terms in lists of tokens."""
        code = pc.fill_null(pc.index_in(tokens.flatten(), value_set=pa.array(self.terms, pa.string())), -1).to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(tokens).to_numpy(zero_copy_only=False)
        pair, n = np.unique((row * len(self.terms) + code)[code >= 0], return_counts=True)
        return pair // max(1, len(self.terms)), pair % max(1, len(self.terms)), n  # np.unique sorts, so rows come in order


def _frequencies(known: _Queries):
    def run(batches):
        df = np.zeros(len(known.terms) + 2, np.int64)  # the last two: documents and tokens
        for b in batches:
            parts, length = split_words(b.column(0))
            df += np.bincount(known.postings(parts)[1], minlength=len(df))
            df[-2:] += b.num_rows, length.sum()
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen], pa.int64())], ["term", "df"])

    return run


def _best(query: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best documents of each query, each once with its best score; ties go to the smaller id."""
    order = np.lexsort((-score, doc, query))
    query, doc, score = query[order], doc[order], score[order]
    once = np.r_[True, (query[1:] != query[:-1]) | (doc[1:] != doc[:-1])][: len(query)]
    query, doc, score = query[once], doc[once], score[once]
    order = np.lexsort((doc, -score, query))
    query, doc, score = query[order], doc[order], score[order]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return query[rank < k], doc[rank < k], score[rank < k]


def _scoring(known: _Queries, idf: np.ndarray, average: float, k: int):
    def run(batches):
        none = np.zeros(0, np.int64)
        held = (none, none, np.zeros(0))
        for b in batches:
            parts, length = split_words(b.column(1))
            doc, n_queries = b.column(0).to_numpy(zero_copy_only=False), len(known.ids)
            row, term, tf = known.postings(parts)  # in order of rows
            w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / average))
            step = min(SLICE_ROWS, max(1, SLICE_SCORES // max(1, n_queries)))
            for s in range(0, b.num_rows, step):
                lo, hi = np.searchsorted(row, [s, s + step])
                t = term[lo:hi]
                n = known.start[t + 1] - known.start[t]
                flat = np.repeat(known.start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
                pair = np.repeat(row[lo:hi] - s, n) * n_queries + known.query[flat]
                score = np.bincount(pair, weights=np.repeat(w[lo:hi], n) * known.qtf[flat], minlength=1)
                own = np.flatnonzero(score)
                held = _best(*(np.concatenate(x) for x in zip(held, (own % n_queries, doc[s + own // n_queries], np.round(score[own], 6)))), k)
        if len(held[0]):
            ids = pa.array(known.ids).take(pa.array(held[0]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(held[1]), pa.array(held[2])], ["query_id", "doc_id", "score"])

    return run


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents per query; docs (doc_id, text), queries (query_id, text), BIGINT ids.

    Documents without a query term score 0 and fill up by id; ties go by id; scores are rounded to 6 places; a term repeated in
    a query counts again; counts cover all documents, and a repeated doc_id counts each time and is listed once, at its best.
    Documents are scored where they lie, and a task hands on its k best per query only. Queries go in blocks of bounded size.
    """
    docs = docs.select("doc_id", "text")
    terms = queries.select("query_id", "text").mapInArrow(_terms, "query_id bigint, term string").groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    blocks = 1 + terms.count() // BLOCK_POSTINGS
    hits = None
    for b in range(blocks):
        known = _Queries(terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect())  # bounded by the block
        df = np.zeros(len(known.terms) + 2)
        for r in docs.select("text").mapInArrow(_frequencies(known), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]
        n_docs, n_tokens = df[-2:]
        idf = np.log(1 + (n_docs - df[:-2] + 0.5) / (df[:-2] + 0.5))
        part = docs.mapInArrow(_scoring(known, idf, n_tokens / n_docs if n_tokens else 1.0, k), "query_id bigint, doc_id bigint, score double")
        hits = part if hits is None else hits.unionByName(part)
    hits = cut(hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")))
    fill = docs.select("doc_id").distinct().orderBy("doc_id").limit(k)  # k rows: the smallest ids can fill any query
    zero = queries.select("query_id").distinct().crossJoin(F.broadcast(fill)).withColumn("score", F.lit(0.0))
    scored = hits.unionByName(zero.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_wins(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """(key, first, n_members): one row per key, the first of its rows kept."""
    return rows.groupBy(key.alias("key")).agg(F.min(order).alias("first"), F.count("*").alias("n_members"))


def cluster_pair_counts(rows: DataFrame, predicted: str, labelled: str) -> DataFrame:
    """(true_positive, false_positive, false_negative) pairs, counted without building them: n rows of one cluster make
    n * (n - 1) / 2 pairs, and pairs right in both are those of the joint clusters."""

    def pairs(cols: list[str], name: str) -> DataFrame:
        n = rows.groupBy(*cols).agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias(name))

    x = pairs([predicted, labelled], "tp").crossJoin(pairs([predicted], "p")).crossJoin(pairs([labelled], "l"))  # one row each
    tp, p, l = F.col("tp"), F.col("p"), F.col("l")  # noqa: E741
    precision, recall = F.coalesce(F.try_divide(tp, p), F.lit(0.0)), F.coalesce(F.try_divide(tp, l), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return x.select("tp", (p - tp).alias("fp"), (l - tp).alias("fn"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def contaminated(texts: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """(key, contaminated): whether a text of the key holds one of the key's stale values as whole words; keys without texts are clean."""
    j = values.join(texts, key, "left")
    hit = F.coalesce(bounded_by_words(F.col("text"), F.col("value")), F.lit(False))
    return j.groupBy(key).agg(F.bool_or(hit).alias("contaminated"))


def vocabulary_before(mints: DataFrame) -> DataFrame:
    """(scope, session, n_known): how many subjects earlier sessions of the scope had introduced. mints: (scope, session, subject)."""
    first = mints.filter("subject IS NOT NULL").groupBy("scope", "subject").agg(F.min("session").alias("session"))
    new = first.groupBy("scope", "session").agg(F.count("*").alias("n_new"))
    w = Window.partitionBy("scope").orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    return mints.select("scope", "session").distinct().join(new, ["scope", "session"], "left").select("scope", "session", F.coalesce(F.sum(F.coalesce("n_new", F.lit(0))).over(w), F.lit(0)).alias("n_known"))


def bootstrap_contrast(pairs: DataFrame, replicates: int = 10_000, seed: int = 7) -> DataFrame:
    """(delta_pp, low_pp, high_pp): difference of two paired rates in percent points with its 95 % percentile interval.

    pairs: (id, a, b) with 0/1 outcomes. A pair's difference is -1, 0 or 1, so a resample of n pairs is a multinomial draw of
    three counts, and no row is resampled; one task draws all replicates from the three counts.
    """
    import numpy as np
    import pandas as pd

    counts = pairs.filter("a IS NOT NULL AND b IS NOT NULL").agg(F.count_if(F.col("b") > F.col("a")).alias("up"), F.count_if(F.col("b") < F.col("a")).alias("down"), F.count("*").alias("n"))

    def draw(frames):
        for f in frames:
            for up, down, n in f.itertuples(index=False):
                if not n:
                    yield pd.DataFrame({"delta_pp": [None], "low_pp": [None], "high_pp": [None]}, dtype="float64")
                    continue
                x = np.random.default_rng(seed).multinomial(n, [up / n, down / n, (n - up - down) / n], replicates)
                d = (x[:, 0] - x[:, 1]) / n * 100
                yield pd.DataFrame({"delta_pp": [(up - down) / n * 100], "low_pp": [np.percentile(d, 2.5)], "high_pp": [np.percentile(d, 97.5)]})

    return counts.mapInPandas(draw, "delta_pp double, low_pp double, high_pp double")


def sign_test(up: int, down: int) -> float:
    """Two-sided exact p-value of up against down; 1 without discordant pairs. Binomials are summed by their logarithms."""
    n, k = up + down, min(up, down)
    if not n:
        return 1.0
    i = np.arange(1, k + 1)
    logs = np.r_[0.0, np.cumsum(np.log(n - i + 1) - np.log(i))] - n * np.log(2)
    return float(min(1.0, 2 * np.exp(logs).sum()))
