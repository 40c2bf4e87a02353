"""Queries on claims and event logs, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import folded, instant_ms, uuid_key, uuid_text
from ..operators import claims as ops
from ..operators import linking
from ..session import cut
from ..sources.tables import table


def _u(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), 'urn:uuid:|[^0-9a-f]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"


_MS = "epoch_ms(CAST(trim(\"timestamp\") AS TIMESTAMPTZ))"
#: One row per event, as it first arrived.
_EV = f"""ev AS (SELECT * FROM (SELECT {_u('event_id')} AS event_id, {_u('claim_id')} AS claim_id, lower(trim(event_type)) AS event_type, {_MS} AS ms, {_u('prev_event_id')} AS prev_event_id,
 {_u('target_claim_instance_id')} AS target, {_u('claim_instance_id')} AS instance, {_u('package_id')} AS package_id, line_no, actor, superseded_by_claim_id, received_at,
 row_number() OVER (PARTITION BY {_u('event_id')} ORDER BY received_at, line_no) AS rn FROM provenance) WHERE rn = 1)"""


def events_of(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per event as it first arrived: event_id and the columns named; ties go to the smaller line."""
    p = table(spark, d, "provenance")
    made = {
        "received_at": F.col("received_at"),
        "line_no": F.col("line_no"),
        "claim_id": uuid_key("claim_id"),
        "prev_event_id": uuid_key("prev_event_id"),
        "package_id": uuid_key("package_id"),
        "event_type": folded("event_type"),
        "has_target": F.col("target_claim_instance_id").isNotNull(),
        "ms": instant_ms("timestamp"),
    }
    order = ["received_at", "line_no", *(c for c in cols if c not in ("received_at", "line_no"))]
    rows = p.select(uuid_key("event_id").alias("event_id"), *(made[c].alias(c) for c in order)).filter("event_id IS NOT NULL")
    first = rows.groupBy("event_id").agg(F.min_by(F.struct(*order), F.struct("received_at", "line_no")).alias("r"))
    text = lambda c: uuid_text(f"r.{c}").alias(c) if c in ("claim_id", "prev_event_id", "package_id") else F.col(f"r.{c}").alias(c)
    return first.select(uuid_text("event_id").alias("event_id"), *map(text, cols))


def lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d, "claim_id", "ms", "event_type", "has_target")
    return ops.lifecycle(e, ops.bad_target(F.col("event_type"), F.col("has_target")))


LIFECYCLE_SQL = f"""WITH {_EV}, o AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ms, event_id) AS n FROM ev),
 e AS (SELECT *, count(*) FILTER (event_type IN ('supersede', 'withdraw')) OVER (PARTITION BY claim_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM o),
 x AS (SELECT *, (event_type IN ('create', 'publish')) = (target IS NOT NULL) OR (n = 1 AND event_type NOT IN ('create', 'publish')) OR (n > 1 AND event_type IN ('create', 'publish')) OR ended > 0 AS bad FROM e),
 f AS (SELECT claim_id, min(n) FILTER (bad) AS wrong FROM x GROUP BY claim_id)
 SELECT x.claim_id, max_by(CASE event_type WHEN 'supersede' THEN 'superseded' WHEN 'withdraw' THEN 'withdrawn' ELSE 'active' END, n) FILTER (wrong IS NULL OR n < wrong) AS final_state,
 max(event_id) FILTER (n = wrong) AS first_illegal, max(CASE WHEN event_type = 'reaffirm' AND target IS NULL THEN 'PX_E_5102' ELSE 'PX_E_5101' END) FILTER (n = wrong) AS code FROM x JOIN f USING (claim_id) GROUP BY x.claim_id"""


def events_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """The same over the stream table: users as claims, with all their events."""
    kind = F.element_at(F.create_map(*(F.lit(x) for p in (("signup", "create"), ("view", "reaffirm"), ("click", "revise"), ("purchase", "supersede"), ("error", "withdraw")) for x in p)), F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("claim_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"), "event_id", kind.alias("event_type"))
    return ops.lifecycle(e).drop("code")


EVENTS_SQL = """WITH o AS (SELECT user_id AS claim_id, ts, event_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 x AS (SELECT *, (n = 1) <> (t = 'signup') OR coalesce(bool_or(t IN ('purchase', 'error')) OVER (PARTITION BY claim_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS bad FROM o),
 f AS (SELECT claim_id, min(n) FILTER (bad) AS wrong FROM x GROUP BY 1)
 SELECT x.claim_id, max_by(CASE t WHEN 'purchase' THEN 'superseded' WHEN 'error' THEN 'withdrawn' ELSE 'active' END, n) FILTER (wrong IS NULL OR n < wrong) AS final_state, max(event_id) FILTER (n = wrong) AS first_illegal FROM x JOIN f USING (claim_id) GROUP BY 1"""


def event_chain_check(spark: SparkSession, d: str) -> DataFrame:
    e = events_of(spark, d, "claim_id", "event_type", "prev_event_id", "package_id", "line_no").select("claim_id", "event_id", "event_type", "prev_event_id", F.struct("package_id", "line_no").alias("line"))
    return ops.event_chain(cut(e))


CHAIN_SQL = f"""WITH {_EV}, e AS (SELECT * REPLACE (line_no AS line_no), row(package_id, line_no) AS line FROM ev)
 SELECT e.claim_id, e.event_id, 'no_prev' AS problem FROM e LEFT JOIN e p ON e.claim_id = p.claim_id AND e.prev_event_id = p.event_id WHERE e.event_type <> 'create' AND (p.event_id IS NULL OR (p.line >= e.line AND p.event_type <> 'create'))
 UNION ALL SELECT claim_id, prev_event_id, 'fork' FROM e WHERE prev_event_id IS NOT NULL AND event_type <> 'create' GROUP BY 1, 2 HAVING count(*) > 1
 UNION ALL SELECT claim_id, NULL, 'creates' FROM e GROUP BY 1 HAVING count(*) FILTER (event_type = 'create') <> 1"""


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "manifest").select(uuid_text(uuid_key("claim_id")).alias("claim_id"))
    return events_of(spark, d, "claim_id").join(known, "claim_id", "left_anti").select("event_id", "claim_id")


def fileset_divergence(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "manifest").select("path").distinct().withColumn("in_manifest", F.lit(True))
    b = table(spark, d, "manifest_mirror").select("path").distinct().withColumn("in_files", F.lit(True))
    j = a.join(b, "path", "full_outer").filter("in_manifest IS NULL OR in_files IS NULL")
    return j.select("path", F.when(F.col("in_files").isNull(), "missing").otherwise("extra").alias("problem"))


def hash_verify(spark: SparkSession, d: str) -> DataFrame:
    """Digest of every text against that of the first text of its docket, or of its court where it has no docket."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("docket_no", "court_id").alias("docket_no"), F.sha2(F.encode("text", "utf-8"), 256).alias("digest"))
    first = docs.groupBy("docket_no").agg(F.min_by("digest", "doc_id").alias("expected"))
    j = docs.join(first, "docket_no")
    return j.filter(~F.col("digest").eqNullSafe(F.col("expected"))).select("doc_id", "digest", "expected")


def snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders, and the same after a day's changes."""
    a = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    b = a.filter("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")))
    return a, b.unionByName(a.filter("o_orderkey % 101 = 0").withColumn("o_orderkey", -F.col("o_orderkey")))


_SNAP = """a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM a WHERE o_orderkey % 97 <> 0
 UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM a WHERE o_orderkey % 101 = 0)"""


def snapshot_diff_set(spark: SparkSession, d: str) -> DataFrame:
    return ops.set_diff(*snapshot(spark, d), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])


def snapshot_diff_fields(spark: SparkSession, d: str) -> DataFrame:
    return ops.field_diff(*snapshot(spark, d), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])


def snapshot_diff_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Each package's event log in order of lines against the order of instants."""
    e = events_of(spark, d, "package_id", "line_no", "ms", "event_type").filter("package_id IS NOT NULL")
    later = e.filter("event_type <> 'publish'").withColumn("at", F.struct("ms", "event_id"))
    return ops.timeline_diff(e.withColumn("at", F.struct("line_no", "event_id")), later, "package_id", "event_id", "at")


TIMELINE_SQL = f"""WITH {_EV}, a AS (SELECT package_id, event_id, row(line_no, event_id) AS o FROM ev WHERE package_id IS NOT NULL), b AS (SELECT package_id, event_id, row(ms, event_id) AS p FROM ev WHERE package_id IS NOT NULL AND event_type <> 'publish'),
 j AS (SELECT package_id, event_id, o, p, a.event_id IS NOT NULL AS ina, b.event_id IS NOT NULL AS inb FROM a FULL JOIN b USING (package_id, event_id)),
 t AS (SELECT package_id, lag(p) OVER (PARTITION BY package_id ORDER BY o) > p AS turned FROM j WHERE ina AND inb), u AS (SELECT package_id, coalesce(bool_or(turned), false) AS reordered FROM t GROUP BY 1)
 SELECT package_id, count(*) FILTER (o IS NULL) AS added, count(*) FILTER (p IS NULL) AS removed, coalesce(any_value(reordered), false) AS reordered FROM j LEFT JOIN u USING (package_id) GROUP BY 1"""


def timed_claims(spark: SparkSession, d: str) -> DataFrame:
    """Stream events as claims on subjects, with valid times, polarity and links."""
    e = table(spark, d, "events")
    day = lambda n: F.date_format(F.date_add(F.col("ts").cast("date"), n), "yyyy-MM-dd'T'00:00:00'Z'")
    return e.select(
        (F.col("user_id") % 997).alias("subject"),
        F.col("event_id").alias("claim_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "negate").when(F.col("event_type") == "view", "unknown").when(F.col("event_type") == "click", None).otherwise("affirm").alias("polarity"),
        day(0).alias("created_at"),
        F.when(F.col("event_id") % 5 > 0, day(0)).alias("valid_from"),
        F.when(F.col("event_id") % 3 > 0, day(2)).alias("valid_until"),
        F.when(F.col("event_id") % 4 == 0, F.array(F.lag("event_id").over(_by_subject()), F.col("event_id") + 1_000_000_000)).otherwise(F.array()).alias("supersedes"),
    ).withColumn("supersedes", F.array_compact("supersedes"))


def _by_subject():
    from pyspark.sql import Window

    return Window.partitionBy(F.col("user_id") % 997).orderBy("event_id")


_TIMED = """c AS (SELECT user_id % 997 AS subject, event_id AS claim_id, event_id AS seq, CASE event_type WHEN 'error' THEN 'negate' WHEN 'view' THEN 'unknown' ELSE 'affirm' END AS polarity,
 strftime(CAST(ts AS DATE), '%Y-%m-%dT00:00:00Z') AS created_at, CASE WHEN event_id % 5 > 0 THEN strftime(CAST(ts AS DATE), '%Y-%m-%dT00:00:00Z') END AS valid_from,
 CASE WHEN event_id % 3 > 0 THEN strftime(CAST(ts AS DATE) + 2, '%Y-%m-%dT00:00:00Z') END AS valid_until, CASE WHEN event_id % 4 = 0 THEN lag(event_id) OVER (PARTITION BY user_id % 997 ORDER BY event_id) END AS over1,
 CASE WHEN event_id % 4 = 0 THEN event_id + 1000000000 END AS over2 FROM events),
 act AS (SELECT * FROM c WHERE (valid_from IS NULL OR valid_from <= '2024-01-03T12:00:00Z') AND ('2024-01-03T12:00:00Z' <= valid_until OR valid_until IS NULL)),
 edges AS (SELECT subject, claim_id AS "by", over1 AS claim_id FROM act WHERE over1 IS NOT NULL UNION ALL SELECT subject, claim_id, over2 FROM act WHERE over2 IS NOT NULL),
 rest AS (SELECT * FROM act WHERE NOT EXISTS (SELECT 1 FROM edges WHERE edges.subject = act.subject AND edges.claim_id = act.claim_id))"""
NOON = "2024-01-03T12:00:00Z"


def valid_time_active(spark: SparkSession, d: str) -> DataFrame:
    return ops.active_at(timed_claims(spark, d), F.lit(NOON)).select("subject", "claim_id", "polarity")


def r4_resolve(spark: SparkSession, d: str) -> DataFrame:
    return ops.resolve(cut(timed_claims(spark, d)), F.lit(NOON))


R4_SQL = f"""WITH {_TIMED}, s AS (SELECT DISTINCT subject FROM c), n AS (SELECT subject, count(*) AS n_active, min(claim_id) AS only_id FROM act GROUP BY 1),
 r AS (SELECT subject, count(*) AS n, bool_or(polarity = 'affirm') AS aff, bool_or(polarity = 'negate') AS neg, bool_or(polarity = 'unknown') AS unk, min(claim_id) FILTER (polarity <> 'unknown') AS definite FROM rest GROUP BY 1),
 w AS (SELECT subject, first(claim_id ORDER BY created_at DESC, claim_id) AS recent FROM rest GROUP BY 1),
 k AS (SELECT *, CASE WHEN n_active IS NULL THEN 0 WHEN n_active = 1 THEN 1 WHEN n = 1 THEN 2 WHEN aff AND neg THEN 3 WHEN unk AND (aff OR neg) THEN 4 WHEN n IS NULL THEN 5 ELSE 6 END AS k FROM s LEFT JOIN n USING (subject) LEFT JOIN r USING (subject) LEFT JOIN w USING (subject))
 SELECT subject, ['not_found','none','supersession','contradiction','ambiguity','supersession','supersession'][k + 1] AS conflict_class, CASE WHEN k = 1 THEN only_id WHEN k IN (2, 6) THEN recent WHEN k = 4 THEN definite END AS primary_id,
 CASE WHEN k IN (0, 5) THEN 0 WHEN k IN (1, 2) THEN 1 ELSE n END AS n_surfaced FROM k"""


def supersession_dangling(spark: SparkSession, d: str) -> DataFrame:
    claims = timed_claims(spark, d)
    _, dangling = ops.supersession(claims, ops.active_at(claims, F.lit(NOON)))
    return dangling.select("subject", "by", "claim_id")


def recency_primary(spark: SparkSession, d: str) -> DataFrame:
    c = timed_claims(spark, d)
    newest = c.groupBy("subject").agg(F.max(F.coalesce("created_at", F.lit(""))).alias("at"))
    return c.join(newest, "subject").filter(F.coalesce("created_at", F.lit("")) == F.col("at")).groupBy("subject").agg(F.min("claim_id").alias("claim_id"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("scope"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("subject"), F.col("event_id").alias("seq"), F.floor(F.col("value") / 20).alias("value"))


def structured_linker(spark: SparkSession, d: str) -> DataFrame:
    return ops.link(_facts(spark, d)).select("scope", "subject", "seq", "minted", "supersedes_seq")


LINK_SQL = """WITH f AS (SELECT user_id % 50 AS scope, user_id || ':' || event_type AS subject, event_id AS seq, floor("value" / 20) AS v FROM events), g AS (SELECT *, coalesce(lag(v) OVER w <> v, true) AS minted FROM f WINDOW w AS (PARTITION BY scope, subject ORDER BY seq))
 SELECT scope, subject, seq, minted, CASE WHEN minted THEN last_value(CASE WHEN minted THEN seq END IGNORE NULLS) OVER (PARTITION BY scope, subject ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS supersedes_seq FROM g"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Stream events as statements: two kinds with subject and value, the others as free text."""
    e = table(spark, d, "events")
    given = F.col("event_type").isin("click", "view")
    value = F.floor(F.col("value") / 20).cast("string")
    subject = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return e.select(
        F.concat(F.lit("q"), (F.col("user_id") % 50).cast("string")).alias("scope"), F.col("event_id").alias("seq"), F.when(given, F.concat_ws(" ", subject, F.col("event_id").cast("string"))).otherwise(F.concat_ws(" ", subject, F.lit("is"), value)).alias("body"),
        F.when(given, subject).alias("subject"), F.when(given, value).alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"),
    )


def exact_linker(spark: SparkSession, d: str) -> DataFrame:
    """Lineages of all statements, with edges and instants."""
    return linking.with_edges(linking.link(_records(spark, d))).select("scope", "seq", "claim_id", "subject", "object", "supersedes", "valid_from", "minted")


def linker_stats(spark: SparkSession, d: str) -> DataFrame:
    return linking.stats(linking.link(_records(spark, d)))


#: With a body a value, a record of either kind is new iff its value is not the one before it on its subject.
_LINKED = """r AS (SELECT 'q' || user_id % 50 AS scope, event_id AS seq, user_id || ':' || event_type || CASE WHEN event_type IN ('click', 'view') THEN '' ELSE ' is' END AS subject, CAST(CAST(floor("value" / 20) AS BIGINT) AS VARCHAR) AS v, event_type IN ('click', 'view') AS given, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events),
 m AS (SELECT *, coalesce(lag(v) OVER w <> v, true) AS minted, lag(v) OVER w IS NULL AS opens FROM r WINDOW w AS (PARTITION BY scope, subject ORDER BY seq)),
 n AS (SELECT *, scope || '#C' || lpad(CAST(count(*) OVER (PARTITION BY scope ORDER BY seq) - 1 AS VARCHAR), 5, '0') AS claim_id FROM m WHERE minted),
 e AS (SELECT *, lag(claim_id) OVER (PARTITION BY scope, subject ORDER BY seq) AS supersedes FROM n),
 l AS (SELECT m.scope, m.seq, m.subject, m.minted, m.v, m.given, last_value(e.claim_id IGNORE NULLS) OVER w AS claim_id, last_value(CASE WHEN m.minted THEN coalesce(e.supersedes, '-') END IGNORE NULLS) OVER w AS s, last_value(CASE WHEN m.minted THEN CASE WHEN e.supersedes IS NULL THEN '-' ELSE e.at END END IGNORE NULLS) OVER w AS f
 FROM m LEFT JOIN e USING (scope, seq) WINDOW w AS (PARTITION BY m.scope, m.subject ORDER BY m.seq ROWS UNBOUNDED PRECEDING))"""
EXACT_SQL = f"WITH {_LINKED} SELECT scope, seq, claim_id, subject, CASE WHEN given THEN v ELSE subject || ' ' || v END AS object, nullif(s, '-') AS supersedes, nullif(f, '-') AS valid_from, minted FROM l"
STATS_SQL = f"""WITH {_LINKED}, b AS (SELECT scope, count(*) AS restatement_groups FROM (SELECT scope FROM r WHERE NOT given GROUP BY scope, subject, v HAVING count(*) > 1) GROUP BY 1)
 SELECT scope, count(*) AS records, count(*) FILTER (minted) AS lineages, count(*) FILTER (minted AND s = '-') AS subjects, count(*) FILTER (minted AND s <> '-') AS supersedes_edges, count(DISTINCT CASE WHEN minted AND s <> '-' THEN subject END) AS updated_subjects, coalesce(any_value(restatement_groups), 0) AS restatement_groups FROM l LEFT JOIN b USING (scope) GROUP BY 1"""


def p3_found_sql() -> str:
    return f"""WITH {_EV}, m AS (SELECT {_u('claim_id')} AS k, min(received_at) AS a, min(deleted_at) AS x FROM manifest GROUP BY 1), i AS (SELECT {_u('claim_instance_id')} AS k, min(received_at) AS a FROM provenance WHERE claim_instance_id IS NOT NULL GROUP BY 1)
 SELECT event_id, 'claim_id' AS field, unnest(list_filter([CASE WHEN m.k IS NULL THEN 'missing' END, CASE WHEN m.a > ev.received_at THEN 'late' END, CASE WHEN m.x <= ev.received_at THEN 'deleted' END], lambda y: y IS NOT NULL)) AS kind FROM ev LEFT JOIN m ON ev.claim_id = m.k WHERE ev.claim_id IS NOT NULL
 UNION ALL SELECT event_id, 'target_claim_instance_id', unnest(list_filter([CASE WHEN i.k IS NULL THEN 'missing' END, CASE WHEN i.a > ev.received_at THEN 'late' END], lambda y: y IS NOT NULL)) FROM ev LEFT JOIN i ON ev.target = i.k WHERE ev.target IS NOT NULL"""


P4_SQL = f"""WITH {_EV}, s AS (SELECT claim_id, min((ms, event_id)) AS s FROM ev WHERE event_type IN ('create', 'publish') GROUP BY 1),
 t AS (SELECT ev.claim_id, min_by(event_type, (ms, event_id)) AS e FROM ev JOIN s USING (claim_id) WHERE event_type IN ('supersede', 'withdraw') AND (ms, event_id) > s GROUP BY 1),
 r AS (SELECT claim_id, CASE e WHEN 'supersede' THEN 'superseded' WHEN 'withdraw' THEN 'withdrawn' ELSE 'active' END AS state FROM s LEFT JOIN t USING (claim_id)),
 m AS (SELECT {_u('claim_id')} AS claim_id, min_by(lower(trim(state)), received_at) AS said FROM manifest WHERE state IS NOT NULL GROUP BY 1)
 SELECT claim_id, r.state FROM r JOIN m USING (claim_id) WHERE said <> r.state"""


def _p5_sql() -> str:
    digest = "CASE WHEN regexp_matches(lower(trim(hash)), '^(sha-?256[:=-])?[0-9a-f]{64}$') THEN right(lower(trim(hash)), 64) ELSE hash END"
    sides = {
        "manifest": ("claim_id", {"claim_instance_id": _u("claim_instance_id"), "hash": digest, "path": "path", "state": "lower(trim(state))", "superseded_by_claim_id": _u("superseded_by_claim_id"), "tags": "CAST(list_sort(list_distinct(tags)) AS VARCHAR)"}),
        "provenance": ("event_id", {"claim_id": _u("claim_id"), "event_type": "lower(trim(event_type))", "timestamp": f"CAST({_MS} AS VARCHAR)", "actor": "actor", "prev_event_id": _u("prev_event_id")}),
    }
    parts = []
    for name, (key, fields) in sides.items():
        cols = ", ".join(f"any_value({e}) AS f{i}" for i, e in enumerate(fields.values()))
        side = lambda t: f"(SELECT {_u(key)} AS k, {cols} FROM {t} GROUP BY 1)"  # noqa: B023, E731
        differs = ", ".join(f"CASE WHEN a.f{i} IS DISTINCT FROM b.f{i} THEN '{f}' END" for i, f in enumerate(fields))
        parts.append(
            f"SELECT '{name}' AS table_name, k AS key_id, unnest(CASE WHEN a.f0x IS NULL OR b.f0x IS NULL THEN ['*'] ELSE list_filter([{differs}], lambda y: y IS NOT NULL) END) AS field,"
            f" CASE WHEN b.f0x IS NULL THEN 'left_only' WHEN a.f0x IS NULL THEN 'right_only' ELSE 'differs' END AS diff FROM (SELECT *, 1 AS f0x FROM {side(name)}) a FULL JOIN (SELECT *, 1 AS f0x FROM {side(name + '_mirror')}) b USING (k)"
        )
    return " UNION ALL ".join(parts)


QUERIES = {
    f.__name__: f
    for f in (
        lifecycle_fold, events_lifecycle, event_chain_check, dangling_refs, fileset_divergence, hash_verify, snapshot_diff_set, snapshot_diff_fields,
        snapshot_diff_timeline, valid_time_active, r4_resolve, supersession_dangling, recency_primary, structured_linker, exact_linker, linker_stats,
    )
}
ORACLE = {
    "lifecycle_fold": LIFECYCLE_SQL,
    "events_lifecycle": EVENTS_SQL,
    "event_chain_check": CHAIN_SQL,
    "dangling_refs": f"WITH {_EV} SELECT event_id, claim_id FROM ev WHERE claim_id NOT IN (SELECT {_u('claim_id')} FROM manifest WHERE claim_id IS NOT NULL)",
    "fileset_divergence": "SELECT path, CASE WHEN b.x IS NULL THEN 'missing' ELSE 'extra' END AS problem FROM (SELECT DISTINCT path, 1 AS x FROM manifest) a FULL JOIN (SELECT DISTINCT path, 1 AS x FROM manifest_mirror) b USING (path) WHERE a.x IS NULL OR b.x IS NULL",
    "hash_verify": "WITH x AS (SELECT doc_id, coalesce(docket_no, court_id) AS docket_no, sha256(text) AS digest FROM documents), f AS (SELECT docket_no, arg_min_null(digest, doc_id) AS expected FROM x GROUP BY 1) SELECT doc_id, digest, expected FROM x JOIN f USING (docket_no) WHERE digest IS DISTINCT FROM expected",
    "snapshot_diff_set": f"WITH {_SNAP} SELECT o_orderkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b USING (o_orderkey) WHERE row(a.o_custkey, a.o_orderstatus, a.o_orderpriority) IS DISTINCT FROM row(b.o_custkey, b.o_orderstatus, b.o_orderpriority)",
    "snapshot_diff_fields": f"WITH {_SNAP} SELECT o_orderkey, 'o_orderstatus' AS field, a.o_orderstatus AS \"before\", b.o_orderstatus AS \"after\" FROM a JOIN b USING (o_orderkey) WHERE a.o_orderstatus IS DISTINCT FROM b.o_orderstatus",
    "snapshot_diff_timeline": TIMELINE_SQL,
    "valid_time_active": f"WITH {_TIMED} SELECT act.subject, act.claim_id, CASE WHEN event_type = 'click' THEN NULL ELSE polarity END AS polarity FROM act JOIN events ON events.event_id = act.claim_id",
    "r4_resolve": R4_SQL,
    "supersession_dangling": f'WITH {_TIMED} SELECT subject, "by", claim_id FROM edges WHERE claim_id NOT IN (SELECT claim_id FROM c)',
    "recency_primary": f"WITH {_TIMED} SELECT subject, first(claim_id ORDER BY created_at DESC, claim_id) AS claim_id FROM c GROUP BY 1",
    "structured_linker": LINK_SQL,
    "exact_linker": EXACT_SQL,
    "linker_stats": STATS_SQL,
    "p3_found": p3_found_sql(),
    "p4_found": P4_SQL,
    "p5_found": _p5_sql(),
}
