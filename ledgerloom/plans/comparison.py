"""Queries on corpora, sessions and arms, each with its SQL twin. The arms and answers are made of the tables' own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.keys import digest_key, folded, uuid_key, uuid_text
from ..functions.text import squeezed
from ..operators import claims as claim_ops
from ..operators import evaluation as ops
from ..session import cut
from ..sources.tables import table
from .claims import _EV, _TIMED, NOON, _u, events_of, timed_claims
from .evaluation import _ARMS, ORACLE as EVALUATION
from .evaluation import _arms, blind_order


def questions(spark: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("q"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 7 == 0, "_abs").otherwise(""))
    return table(spark, d, "eval_items").select("item_id", q.alias("question_id"), F.col("task").alias("question_type"), "text")


_Q = "q AS (SELECT item_id, 'q' || item_id || CASE WHEN item_id % 7 = 0 THEN '_abs' ELSE '' END AS question_id, task AS question_type, text FROM eval_items)"


def ids_by_type(spark: SparkSession, d: str) -> DataFrame:
    return ops.ids_by_type(questions(spark, d)).select("question_type", F.array_join("ids", ",").alias("ids"))


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """The items against a copy that lacks some, and against counts of which one is wrong."""
    q = questions(spark, d)
    expected = q.groupBy("question_type").agg((F.count("*") + F.max((F.col("question_type") == "issue_spot").cast("int"))).alias("n"))
    return ops.ground_truth(q, q.filter("item_id % 50 <> 0"), expected)


TRUTH_SQL = f"""WITH {_Q}, e AS (SELECT question_type, count(*) + CASE WHEN question_type = 'issue_spot' THEN 1 ELSE 0 END AS n FROM q GROUP BY 1), x AS (SELECT 'rows a' AS "check", (SELECT count(*) FROM q) - (SELECT sum(n) FROM e) AS value UNION ALL SELECT 'rows b', (SELECT count(*) FROM q WHERE item_id % 50 <> 0) - (SELECT sum(n) FROM e)
 UNION ALL SELECT 'ids a', (SELECT count(DISTINCT question_id) FROM q) - (SELECT sum(n) FROM e) UNION ALL SELECT 'only a', (SELECT count(*) FROM q WHERE item_id % 50 = 0) UNION ALL SELECT 'type ' || question_type, (SELECT count(*) FROM q WHERE q.question_type = e.question_type) - n FROM e) SELECT "check", CAST(value AS BIGINT) AS value FROM x WHERE value <> 0"""


def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    """Twenty ids drawn with a seed, as a frozen split has them; rows only."""
    return ops.seeded_sample(questions(spark, d), 20, 20260717)


def denominator(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    return ops.denominator(q, q.filter("item_id % 11 = 0"))


def label_keys(spark: SparkSession, d: str) -> DataFrame:
    q = questions(spark, d)
    return ops.keyset_difference(q.filter("item_id % 5 <> 0"), ops.denominator(q, q.limit(0)))


def first_questions(spark: SparkSession, d: str) -> DataFrame:
    return ops.first_ids(questions(spark, d), 25)


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Items as questions, their sentences as sessions, some undated, the first with a blank turn."""
    parts = F.split("text", "[.?] *")
    turns = lambda x, i: F.array(F.struct(F.lit("user").alias("role"), x.alias("content")), F.struct(F.lit(None).cast("string").alias("role"), F.when(i == 0, "  ").otherwise(x).alias("content")))
    q = questions(spark, d).select(
        "question_id", F.array(F.lit("s1")).alias("answer_session_ids"), F.transform(parts, lambda x, i: F.concat(F.lit("s"), (9 - i).cast("string"))).alias("haystack_session_ids"),
        F.transform(parts, lambda x, i: F.when(i % 3 > 0, F.concat(F.lit("2031/0"), (1 + i % 4).cast("string"), F.lit("/02 (Mon) 10:0"), (F.char_length(x) % 10).cast("string")))).alias("haystack_dates"), F.transform(parts, turns).alias("haystack_sessions"),
    )
    return ops.sessions(q)


SESSIONS_SQL = rf"""WITH {_Q}, p AS (SELECT question_id, unnest(regexp_split_to_array(text, '[.?] *')) AS x, generate_subscripts(regexp_split_to_array(text, '[.?] *'), 1) - 1 AS i FROM q),
 y AS (SELECT question_id, i, 's' || (9 - i) AS session_id, CASE WHEN i % 3 > 0 THEN '2031-0' || (1 + i % 4) || '-02T10:0' || (length(x) % 10) || ':00Z' END AS occurred_at, trim(regexp_replace(x, '\s+', ' ', 'g')) AS s FROM p)
 SELECT question_id, session_id, occurred_at, 'user: ' || s || CASE WHEN i > 0 THEN chr(10) || '?: ' || s ELSE '' END AS text, CAST(row_number() OVER (PARTITION BY question_id ORDER BY occurred_at NULLS FIRST, session_id) - 1 AS INT) AS ordinal FROM y WHERE s <> ''"""


def vocabulary_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return ops.vocabulary(e.select(F.col("user_id").alias("scope"), F.date_format("ts", "yyyy-MM-dd HH").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("subject"), F.floor("value").cast("string").alias("value")))


VOCABULARY_SQL = """WITH m AS (SELECT user_id AS scope, strftime(ts, '%Y-%m-%d %H') AS session, event_id AS seq, event_type AS subject, CAST(CAST(floor("value") AS BIGINT) AS VARCHAR) AS v FROM events), s AS (SELECT DISTINCT scope, session FROM m),
 f AS (SELECT scope, subject, min((session, seq)) AS born FROM m GROUP BY 1, 2), n AS (SELECT s.scope, s.session, m.subject, max_by(m.v, (m.session, m.seq)) AS value FROM s JOIN m ON m.scope = s.scope AND m.session < s.session GROUP BY 1, 2, 3)
 SELECT scope, session, subject, value, CAST(row_number() OVER (PARTITION BY scope, session ORDER BY born, subject) AS INT) AS place FROM n JOIN f USING (scope, subject)"""


def judged(spark: SparkSession, d: str) -> DataFrame:
    """What a judge's output says, over documents with a last line that says it or not."""
    last = F.when(F.col("doc_id") % 4 == 0, "\n Correct.. \n\n").when(F.col("doc_id") % 4 == 1, "\nINCORRECT").when(F.col("doc_id") % 4 == 2, "\nincorrect or not").otherwise("")
    return table(spark, d, "documents").select("doc_id", ops.verdict(F.concat("text", last)).alias("verdict"))


JUDGED_SQL = r"""WITH x AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || ' Correct.. ' || chr(10) || chr(10) WHEN 1 THEN chr(10) || 'INCORRECT' WHEN 2 THEN chr(10) || 'incorrect or not' ELSE '' END AS o FROM documents),
 l AS (SELECT doc_id, upper(rtrim(rtrim(list_filter(list_transform(string_split(o, chr(10)), lambda y: trim(y, ' ' || chr(9) || chr(10) || chr(12) || chr(13))), lambda y: y <> '')[-1], '.'))) AS w FROM x) SELECT doc_id, CASE w WHEN 'CORRECT' THEN true WHEN 'INCORRECT' THEN false END AS verdict FROM l"""


def fairness(spark: SparkSession, d: str) -> DataFrame:
    """Event types as arms: their pins are the number of digits of their count."""
    arms = table(spark, d, "events").groupBy(F.col("event_type").alias("arm")).agg(F.when(F.max("event_type") != "error", F.length(F.count("*").cast("string"))).cast("string").alias("pins"), F.lit("bm25").alias("retriever"), F.count("*").alias("n_answers"))
    return ops.unfair(arms, 3)


FAIR_SQL = "WITH a AS (SELECT event_type AS arm, CASE WHEN event_type <> 'error' THEN CAST(length(CAST(count(*) AS VARCHAR)) AS VARCHAR) END AS pins, count(*) AS n FROM events GROUP BY 1), r AS (SELECT first(pins ORDER BY arm) AS p FROM a) SELECT arm, CASE WHEN pins IS NULL THEN 'no pins' WHEN pins IS DISTINCT FROM p THEN 'pins' ELSE 'answers' END AS problem FROM a, r WHERE pins IS NULL OR pins IS DISTINCT FROM p OR n <> 3"


def verdict_order(spark: SparkSession, d: str) -> DataFrame:
    """A recorded part of the blind order, with a hole, a repetition and a slot given to another question."""
    order = blind_order(spark, d)
    had = order.filter("position < 300 AND position % 17 <> 3").withColumn("question_id", F.when(F.col("position") == 9, -1).otherwise(F.col("question_id")))
    return ops.out_of_order(had.unionByName(had.filter("position = 40")), order)


ORDER_SQL = f"""WITH o AS ({EVALUATION['blind_order']}), h AS (SELECT CASE WHEN position = 9 THEN -1 ELSE question_id END AS question_id, arm, position FROM o WHERE position < 300 AND position % 17 <> 3), r AS (FROM h UNION ALL SELECT * FROM h WHERE position = 40)
 SELECT position, CASE WHEN k IS NULL THEN 'missing' WHEN k > 1 THEN 'twice' ELSE 'another' END AS problem FROM o LEFT JOIN (SELECT position, count(*) AS k, min(question_id) AS g FROM r GROUP BY 1) USING (position) WHERE position < (SELECT count(*) FROM r) AND (k IS NULL OR k > 1 OR g <> question_id)"""


def tripwires(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    perf = e.groupBy(F.col("event_type").alias("arm")).agg(F.round(F.percentile("value", 0.95), 6).alias("p95_ms"), F.round(F.avg(F.octet_length("props")), 6).alias("bytes_per_claim"))
    return ops.tripwires(perf, "view", 1.001)


TRIP_SQL = "WITH p AS (SELECT event_type AS arm, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(avg(strlen(props)), 6) AS bytes_per_claim FROM events GROUP BY 1), l AS (SELECT arm, 'p95_ms' AS measure, p95_ms AS value FROM p UNION ALL SELECT arm, 'bytes_per_claim', bytes_per_claim FROM p) SELECT l.arm, l.measure, l.value, r.value AS reference_value FROM l JOIN l r ON r.arm = 'view' AND r.measure = l.measure WHERE l.arm <> 'view' AND l.value > 1.001 * r.value"


def adversarial(spark: SparkSession, d: str) -> DataFrame:
    v = _arms(spark, d).select(F.col("event_id").alias("question_id"), (F.col("a") == 1).alias("b"), (F.col("b") == 1).alias("c"))
    return ops.adversarial(v, 3.0, 5.0, 15.0)


AG_SQL = f"WITH {_ARMS}, s AS (SELECT count(*) AS n, sum(a) AS a, sum(b) AS b FROM x) SELECT n, CAST(a AS BIGINT) AS correct_b, CAST(b AS BIGINT) AS correct_c, round(100.0 * (b - a) / n, 6) AS delta_pp, 100.0 * (b - a) / n > 3 AS breached, CASE WHEN 100.0 * (b - a) / n >= 15 THEN 'tier2' WHEN 100.0 * (b - a) / n >= 5 THEN 'tier1' ELSE 'none' END AS tier FROM s"


def context_diff(spark: SparkSession, d: str) -> DataFrame:
    """Items as discordant questions, with neighbours' ids as what the arms retrieved."""
    i = F.col("item_id")
    ids = lambda *k: F.array(*((i + x).cast("string") for x in k))
    rows = questions(spark, d).select("question_id", (i % 3 == 0).alias("b"), (i % 5 == 0).alias("c"), ids(3, 1, 2).alias("ids_b"), F.when(i % 2 == 0, ids(2, 4, 1)).otherwise(ids(3, 1, 2)).alias("ids_c"))
    return ops.context_differences(rows).withColumns({"only_b": F.array_join("only_b", ","), "only_c": F.array_join("only_c", ",")})


CONTEXT_SQL = f"WITH {_Q} SELECT question_id, CASE WHEN item_id % 5 = 0 THEN 'C' ELSE 'B' END AS winner, CASE WHEN item_id % 2 = 0 THEN CAST(item_id + 3 AS VARCHAR) ELSE '' END AS only_b, CASE WHEN item_id % 2 = 0 THEN CAST(item_id + 4 AS VARCHAR) ELSE '' END AS only_c, item_id % 2 <> 0 AS identical FROM q WHERE (item_id % 3 = 0) <> (item_id % 5 = 0)"


def deficit_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Equal texts as labels, dockets as lineages: what an arm by text and docket misses of one by squeezed text."""
    md5 = lambda c: F.md5(F.encode(c, "utf-8"))
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(md5(F.col("text")).alias("label"), F.coalesce("docket_no", F.lit("")).alias("lineage"), md5(squeezed(F.col("text"))).alias("control"), md5(F.concat(F.coalesce("docket_no", "court_id"), F.lit("|"), F.upper("text"))).alias("treatment"))
    return ops.attribution(docs)


_SQUEEZED = r"trim(regexp_replace(text, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+', ' ', 'g'))"
_N = lambda *c: f"(SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x WHERE {' AND '.join(f'{y} IS NOT NULL' for y in c)} GROUP BY {', '.join(c)}))"
DEFICIT_SQL = f"""WITH x AS (SELECT text AS label, coalesce(docket_no, '') AS lineage, {_SQUEEZED} AS control, coalesce(docket_no, court_id) || '|' || upper(text) AS treatment FROM documents WHERE text IS NOT NULL),
 n AS (SELECT {_N('label', 'control')} - {_N('label', 'control', 'treatment')} AS m, {_N('label', 'control', 'lineage')} - {_N('label', 'control', 'lineage', 'treatment')} AS w, {_N('treatment')} - {_N('label', 'treatment')} AS f)
 SELECT CAST(m AS BIGINT) AS missed, CAST(w AS BIGINT) AS within_missed, CAST(m - w AS BIGINT) AS cross_missed, CAST(f AS BIGINT) AS false_positives, m > 0 AND w = 0 AND f = 0 AS attributable FROM n"""


def _claims(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One row per claim, each column's greatest value under the reading rules."""
    t = table(spark, d, name)
    labels = F.col("labels") if "labels" in t.columns else F.lit(None).cast("map<string,string>")
    x = t.select(uuid_key("claim_id").alias("claim_id"), F.lower(F.hex(digest_key("hash"))).alias("hash"), folded("state").alias("state"), "path", F.array_sort(F.array_distinct("tags")).alias("tags"), F.array_sort(F.map_keys(labels)).alias("keys")).filter("claim_id IS NOT NULL")
    g = x.groupBy("claim_id").agg(*(F.max(c).alias(c) for c in ("hash", "state", "path", "tags", "keys")))
    return g.select(uuid_text("claim_id").alias("claim_id"), "hash", "state", "path", "tags", F.map_from_arrays("keys", "keys").alias("labels"))


_H = "CASE WHEN regexp_matches(lower(trim(hash)), '^(sha-?256[:=-])?[0-9a-f]{64}$') THEN right(lower(trim(hash)), 64) ELSE '00' || lower(hex(encode(hash))) END"
_MAX = lambda t, keys: f"(SELECT {_u('claim_id')} AS claim_id, max({_H}) AS hash, max(lower(trim(state))) AS state, max(path) AS path, max(list_sort(list_distinct(tags))) AS tags, {keys} AS keys FROM {t} WHERE claim_id IS NOT NULL GROUP BY 1)"
_TWO = f"a AS {_MAX('manifest', 'max(list_sort(map_keys(labels)))')}, b AS {_MAX('manifest_mirror', 'CAST(NULL AS VARCHAR[])')}"


def evidence_diff(spark: SparkSession, d: str) -> DataFrame:
    x = claim_ops.evidence_diff(_claims(spark, d, "manifest"), _claims(spark, d, "manifest_mirror"))
    return x.withColumns({c: F.array_join(c, ",") for c in ("tags_added", "tags_removed", "labels_added", "labels_removed")})


_APART = lambda x, y: f"array_to_string(list_sort(list_filter(coalesce({x}, []), lambda q: NOT list_contains(coalesce({y}, []), q))), ',')"
EVIDENCE_SQL = f"WITH {_TWO}, x AS (SELECT claim_id, a.hash IS DISTINCT FROM b.hash AS hash_changed, a.state IS DISTINCT FROM b.state AS state_changed, {_APART('b.tags', 'a.tags')} AS tags_added, {_APART('a.tags', 'b.tags')} AS tags_removed, {_APART('b.keys', 'a.keys')} AS labels_added, {_APART('a.keys', 'b.keys')} AS labels_removed FROM a JOIN b USING (claim_id)) SELECT * FROM x WHERE hash_changed OR state_changed OR tags_added || tags_removed || labels_added || labels_removed <> ''"


def agreement(spark: SparkSession, d: str) -> DataFrame:
    side = lambda n: _claims(spark, d, n).select(F.col("claim_id").alias("name"), F.col("state").alias("verdict"), F.encode(F.concat_ws("|", "path", "hash"), "utf-8").alias("content"))
    return ops.agreement(side("manifest"), side("manifest_mirror"))


AGREE_SQL = f"WITH {_TWO} SELECT count(*) FILTER (x AND y) AS compared, count(*) FILTER (x AND y AND concat_ws('|', p, h) = concat_ws('|', q, i)) AS equal_bytes, count(*) FILTER (x AND y AND s IS NOT DISTINCT FROM t) AS equal_verdicts, count(*) FILTER (y IS NULL) AS only_a, count(*) FILTER (x IS NULL) AS only_b FROM (SELECT claim_id, true AS x, path AS p, hash AS h, state AS s FROM a) FULL JOIN (SELECT claim_id, true AS y, path AS q, hash AS i, state AS t FROM b) USING (claim_id)"


def coalesce_conflicts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select(uuid_text(uuid_key("claim_id")).alias("claim_id"), F.lower(F.hex(digest_key("hash"))).alias("content_hash"), folded("state").alias("state"), uuid_key("superseded_by_claim_id").alias("over"))
    return ops.conflicts(m, ("state", "over"))


CONFLICT_SQL = f"SELECT claim_id, CASE WHEN min(h) <> max(h) THEN 'PX_E_5103' WHEN count(DISTINCT coalesce(s, '-') || '|' || coalesce(o, '-')) > 1 THEN 'disagree' END AS problem, count(*) AS n FROM (SELECT {_u('claim_id')} AS claim_id, {_H} AS h, lower(trim(state)) AS s, {_u('superseded_by_claim_id')} AS o FROM manifest WHERE claim_id IS NOT NULL) GROUP BY 1"


def store_clusters(spark: SparkSession, d: str) -> DataFrame:
    """The record that each arm keeps for a document: itself, the first of its body, the first of its docket and content."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.sha2(F.encode(squeezed(F.col("text")), "utf-8"), 256).alias("body"), F.coalesce("docket_no", F.lit("")).alias("lineage"))
    arms = {"A": ("id",), "B": ("body",), "C": ("lineage", "body")}
    out = None
    for arm, key in arms.items():
        part = ops.clusters(docs, *key).select(F.lit(arm).alias("arm"), F.col("id").alias("doc_id"), "first")
        out = part if out is None else out.unionByName(part)
    return out


STORES_SQL = f"WITH x AS (SELECT doc_id, {_SQUEEZED} AS body, coalesce(docket_no, '') AS k FROM documents WHERE text IS NOT NULL) SELECT 'A' AS arm, doc_id, doc_id AS first FROM x UNION ALL SELECT 'B', doc_id, min(doc_id) OVER (PARTITION BY body) FROM x UNION ALL SELECT 'C', doc_id, min(doc_id) OVER (PARTITION BY k, body) FROM x"


def claim_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", ops.claim_bytes(F.col("doc_id").cast("string"), F.col("text"), F.lit("{}")).cast("bigint").alias("n_bytes"))


SIZES_SQL = """SELECT doc_id, CAST(strlen('{"id": "' || doc_id || '", "metadata": {}, "text": ' || CAST(to_json(text) AS VARCHAR) || '}') AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL"""


def surfaced(spark: SparkSession, d: str) -> DataFrame:
    """What a reader shows of the stream's claims at an instant, those in a state that is read only left out first."""
    c = timed_claims(spark, d).withColumn("state", F.when(F.col("claim_id") % 13 == 0, "superseded").when(F.col("claim_id") % 17 == 0, "withdrawn").when(F.col("claim_id") % 2 == 0, "active"))
    return claim_ops.surfaced(cut(ops.unsuppressed(c)), F.lit(NOON))


_SHOWN = _TIMED.replace("act AS (SELECT * FROM c WHERE", "act AS (SELECT * FROM c WHERE claim_id % 13 <> 0 AND claim_id % 17 <> 0 AND")
SURFACED_SQL = f"""WITH {_SHOWN}, n AS (SELECT subject, count(*) AS n_active FROM act GROUP BY 1), r AS (SELECT subject, count(*) AS n, bool_or(polarity = 'affirm') AS aff, bool_or(polarity = 'negate') AS neg, bool_or(polarity = 'unknown') AS unk, first(claim_id ORDER BY created_at DESC, claim_id) AS recent FROM rest GROUP BY 1),
 k AS (SELECT subject, CASE WHEN n_active = 1 THEN 'only' WHEN n = 1 THEN 'one' WHEN (aff AND neg) OR (unk AND (aff OR neg)) THEN 'all' WHEN n IS NULL THEN 'none' ELSE 'one' END AS k, recent FROM n LEFT JOIN r USING (subject))
 SELECT subject, claim_id FROM act JOIN k USING (subject) WHERE k = 'only' UNION ALL SELECT subject, recent FROM k WHERE k = 'one' UNION ALL SELECT subject, claim_id FROM rest JOIN k USING (subject) WHERE k = 'all'"""


def store_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The ten best claims that a reader shows for each of a few queries, which rank the stream's claims by their ids."""
    c = cut(timed_claims(spark, d).withColumn("state", F.when(F.col("claim_id") % 13 == 0, "superseded").when(F.col("claim_id") % 17 == 0, "withdrawn").when(F.col("claim_id") % 2 == 0, "active")))
    ranked = c.select((F.col("claim_id") % 7).alias("query_id"), "claim_id", F.col("claim_id").alias("rank"))
    return claim_ops.retrieve(ranked, c, F.lit(NOON))


RETRIEVE_SQL = f"SELECT query_id, claim_id, rank FROM (SELECT claim_id % 7 AS query_id, claim_id, CAST(row_number() OVER (PARTITION BY claim_id % 7 ORDER BY claim_id) AS INT) AS rank FROM ({SURFACED_SQL})) WHERE rank <= 10"


def timeline_ids(spark: SparkSession, d: str) -> DataFrame:
    """Each package's events by line against those, but for publications, by instant."""
    e = events_of(spark, d, "package_id", "line_no", "ms", "event_type").filter("package_id IS NOT NULL")
    a = e.withColumn("at", F.struct("line_no", "event_id"))
    b = e.filter("event_type <> 'publish'").withColumn("at", F.struct("ms", "event_id"))
    return claim_ops.timeline_ids(a, b, "package_id", "event_id", "at")


IDS_SQL = f"""WITH {_EV}, e AS (SELECT * FROM ev WHERE package_id IS NOT NULL), j AS (SELECT package_id, event_id, (line_no, event_id) AS o, (ms, event_id) AS p FROM e WHERE event_type <> 'publish'), t AS (SELECT package_id, lag(p) OVER (PARTITION BY package_id ORDER BY o) > p AS turned, o, p FROM j),
 u AS (SELECT DISTINCT package_id FROM (SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY o) AS n, row_number() OVER (PARTITION BY package_id ORDER BY p) AS m FROM j) WHERE n <> m)
 SELECT package_id, event_id, 'removed' AS change FROM e WHERE event_type = 'publish' UNION ALL SELECT package_id, event_id, 'reordered' FROM j JOIN u USING (package_id)"""


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """Each package's first delivered manifest against its last."""
    raw = table(spark, d, "manifest_raw").select("received_at", "raw_id", canonical.shape(F.col("payload")).alias("doc")).filter("doc.kind = 'object'")
    package = F.try_element_at(F.col("doc.fields"), F.lit("package_id"))
    raw = raw.withColumn("key", uuid_text(uuid_key(F.when(package["kind"] == "string", package["text"])))).filter("key IS NOT NULL")
    at = F.struct("received_at", "raw_id")
    ends = raw.groupBy("key").agg(F.min(at)["raw_id"].alias("first"), F.max(at)["raw_id"].alias("last"))
    side = lambda c: ends.select("key", F.col(c).alias("raw_id")).join(raw.select("raw_id", "doc"), "raw_id").select("key", "doc")
    return claim_ops.manifest_diff(side("first"), side("last")).withColumnRenamed("key", "package_id")


_SORTED = lambda j: f"CASE WHEN json_type({j}) = 'OBJECT' THEN CAST(list_sort(list_transform(json_keys({j}), lambda k: k || CAST(json_extract({j}, '$.\"' || k || '\"') AS VARCHAR))) AS VARCHAR) ELSE json_type({j}) || CAST(json({j}) AS VARCHAR) END"
DIFF_SQL = f"""WITH r AS (SELECT {_u("json_extract_string(payload, '$.package_id')")} AS package_id, payload, received_at, raw_id FROM manifest_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND json_type(payload, '$.package_id') = 'VARCHAR'),
 e AS (SELECT package_id, min_by(payload, (received_at, raw_id)) AS a, max_by(payload, (received_at, raw_id)) AS b FROM r GROUP BY 1), k AS (SELECT package_id, a, b, unnest(list_distinct(list_concat(json_keys(a), json_keys(b)))) AS field FROM e),
 v AS (SELECT package_id, field, list_contains(json_keys(a), field) AS ina, list_contains(json_keys(b), field) AS inb, json_extract(a, '$.' || field) AS x, json_extract(b, '$.' || field) AS y FROM k WHERE field <> 'created_at')
 SELECT package_id, field, CASE WHEN NOT ina THEN 'added' WHEN NOT inb THEN 'removed' ELSE 'changed' END AS change FROM v WHERE NOT ina OR NOT inb OR (field <> 'claims' AND {_SORTED('x')} <> {_SORTED('y')})"""


QUERIES = {
    f.__name__: f
    for f in (
        ids_by_type, ground_truth, seeded_split, denominator, label_keys, first_questions, sessions, vocabulary_latest, judged, fairness, verdict_order, tripwires, adversarial, context_diff, deficit_attribution,
        evidence_diff, agreement, coalesce_conflicts, store_clusters, claim_sizes, surfaced, store_retrieve, timeline_ids, manifest_diff,
    )
}
ORACLE = {
    "ids_by_type": f"WITH {_Q} SELECT question_type, array_to_string(list_sort(list(DISTINCT question_id)), ',') AS ids FROM q GROUP BY 1",
    "ground_truth": TRUTH_SQL,
    "denominator": f"WITH {_Q} SELECT question_id, item_id % 11 <> 0 AS scored FROM q WHERE item_id % 7 <> 0",
    "label_keys": f"WITH {_Q} SELECT question_id, CASE WHEN item_id % 7 = 0 THEN 'extra' ELSE 'missing' END AS problem FROM q WHERE (item_id % 7 = 0) = (item_id % 5 <> 0)",
    "first_questions": f"WITH {_Q} SELECT question_id FROM q ORDER BY 1 LIMIT 25",
    "sessions": SESSIONS_SQL,
    "vocabulary_latest": VOCABULARY_SQL,
    "judged": JUDGED_SQL,
    "fairness": FAIR_SQL,
    "verdict_order": ORDER_SQL,
    "tripwires": TRIP_SQL,
    "adversarial": AG_SQL,
    "context_diff": CONTEXT_SQL,
    "deficit_attribution": DEFICIT_SQL,
    "evidence_diff": EVIDENCE_SQL,
    "agreement": AGREE_SQL,
    "coalesce_conflicts": CONFLICT_SQL,
    "store_clusters": STORES_SQL,
    "claim_sizes": SIZES_SQL,
    "surfaced": SURFACED_SQL,
    "store_retrieve": RETRIEVE_SQL,
    "timeline_ids": IDS_SQL,
    "manifest_diff": DIFF_SQL,
}
