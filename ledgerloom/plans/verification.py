"""Queries of the package rules, each with a SQL twin written from the rules themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.keys import digest_key, folded, instant_ms, uuid_key, uuid_text
from ..operators import verification as ops
from ..sources import packages
from ..sources.tables import table
from .claims import _EV, _u

EVENT_FIELDS = ("actor", "claim_id", "event_id", "event_type", "timestamp", "claim_instance_id", "prev_event_id", "target_claim_instance_id", "superseded_by_claim_id", "reason")
ENTRY_FIELDS = ("claim_id", "claim_instance_id", "hash", "path", "state", "superseded_by_claim_id", "withdrawn_reason")


def spec_field(spark: SparkSession, d: str) -> str:
    """The manifests' field for the version of their specification, as the manifest table names it."""
    return next(c for c in table(spark, d, "manifest").columns if c.endswith("_spec_version"))


def _document(fields: tuple[str, ...], *more: Column) -> Column:
    """A row as the shape of the object that has its non-null fields."""
    part = lambda c: F.struct(F.lit("string").alias("kind"), F.col(c).alias("text"))
    pairs = [x for c in fields for x in (F.lit(c), part(c))]
    present = F.map_filter(F.create_map(*pairs, *more), lambda k, v: v["text"].isNotNull())
    return F.struct(F.lit(None).cast("string").alias("code"), F.lit("object").alias("kind"), present.alias("fields"), F.lit(None).cast(f"array<{canonical.PART}>").alias("items"))


def event_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The rule at which a reader of the logs stops, for each delivered event that breaks one."""
    p = table(spark, d, "provenance")
    key = F.struct("package_id", "line_no", "event_id", "received_at")
    v = ops.first_broken(ops.event_violations(p.select(key.alias("key"), F.col("line_no").alias("line"), _document(EVENT_FIELDS).alias("doc"))))
    return v.select("key.*", "code")


def _present(cols: tuple[str, ...]) -> str:
    return " OR ".join(f"{c} IS NULL" for c in cols)


def _first(cases: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {bad} THEN '{code}'" for code, bad in cases) + " END"


def _matches(c: str, regex: str) -> str:
    return f"NOT regexp_full_match({c}, '{regex.strip('^$')}')"


def _in(c: str, words: tuple[str, ...]) -> str:
    return f"{c} IN ({', '.join(repr(w) for w in words)})"


EVENT_CASES = [
    ("PX_E_2001", _present(ops.EVENT_REQUIRED)),
    ("PX_E_2003", "actor = ''"),
    *(("PX_E_4001", _matches(c, r)) for c, r in (("claim_id", ops.UUID7), ("event_id", ops.UUID7), ('"timestamp"', ops.STAMP))),
    ("PX_E_4002", f"NOT {_in('event_type', ops.EVENT_TYPES)}"),
    ("PX_E_2001", f"{_in('event_type', ops.WITH_INSTANCE)} AND claim_instance_id IS NULL"),
    ("PX_E_2004", f"{_in('event_type', ops.WITHOUT_INSTANCE)} AND claim_instance_id IS NOT NULL"),
    ("PX_E_2001", "event_type = 'supersede' AND superseded_by_claim_id IS NULL"),
    ("PX_E_2004", "event_type = 'create' AND prev_event_id IS NOT NULL"),
    ("PX_E_2001", "event_type <> 'create' AND prev_event_id IS NULL"),
    *(("PX_E_4001", _matches(c, ops.UUID7)) for c in ("prev_event_id", "claim_instance_id", "superseded_by_claim_id", "target_claim_instance_id")),
]
EVENT_SQL = f"SELECT DISTINCT * FROM (SELECT package_id, line_no, event_id, received_at, {_first(EVENT_CASES)} AS code FROM provenance) WHERE code IS NOT NULL"


def entry_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The first broken rule of each delivered claim entry that breaks one."""
    m = table(spark, d, "manifest")
    parts = F.transform("tags", lambda t: F.struct(F.when(t.isNotNull(), "string").otherwise("null").alias("kind"), F.coalesce(t, F.lit("null")).alias("text")))
    tags = F.struct(F.lit("array").alias("kind"), F.to_json("tags").alias("text"))
    labels = F.struct(F.lit("object").alias("kind"), F.to_json("labels").alias("text"))
    key = F.struct("package_id", "claim_id", "received_at", "hash")
    rows = m.select(key.alias("key"), _document(ENTRY_FIELDS, F.lit("tags"), tags, F.lit("labels"), labels).alias("doc"), parts.alias("parts"))
    v = ops.first_broken(ops.broken(rows, ops.claim_entry_rules(ops.Document("doc"), F.col("parts")), ops.CLAIMS))
    return v.select("key.*", "code")


_TAGS = "list_filter(list_transform(tags, lambda t, i: CASE WHEN t IS NULL THEN 'PX_E_1001' WHEN t = '' THEN 'PX_E_2003' WHEN list_contains(tags[1:i-1], t) THEN 'PX_E_4005' END), lambda c: c IS NOT NULL)[1]"
ENTRY_CASES = [
    ("PX_E_2001", _present(ops.CLAIM_REQUIRED)),
    *(("PX_E_4001", _matches(c, r)) for c, r in (("claim_id", ops.UUID7), ("claim_instance_id", ops.UUID7), ("hash", ops.DIGEST), ("path", ops.CLAIM_PATH))),
    ("PX_E_4002", f"NOT {_in('state', ops.CLAIM_STATES)}"),
    ("PX_E_2001", "state = 'superseded' AND superseded_by_claim_id IS NULL"),
    ("PX_E_4001", _matches("superseded_by_claim_id", ops.UUID7)),
]
ENTRY_SQL = f"SELECT DISTINCT package_id, claim_id, received_at, hash, min_by(code, rank) AS code FROM (SELECT package_id, claim_id, received_at, hash, coalesce(code, tag) AS code, CASE {' '.join(f'WHEN {bad} THEN {i}' for i, (_, bad) in enumerate(ENTRY_CASES))} ELSE 90 + instr('1001 2003 4005', right(tag, 4)) END AS rank FROM (SELECT *, {_first(ENTRY_CASES)} AS code, {_TAGS} AS tag FROM manifest)) WHERE code IS NOT NULL GROUP BY ALL"


def manifest_rules(spark: SparkSession, d: str) -> DataFrame:
    """All rules that the delivered manifests break, in the order in which a reader meets them."""
    raw = table(spark, d, "manifest_raw").select(F.col("raw_id").alias("key"), canonical.shape(F.col("payload")).alias("doc"))
    return ops.manifest_violations(raw, spec_field(spark, d)).select(F.col("key").alias("raw_id"), "stage", "line", "seq", "code")


def _json_sql() -> str:
    k = lambda n, j="payload": f"json_type({j}, '$.{n}')"
    t = lambda n, j="payload": f"CASE WHEN {k(n, j)} = 'VARCHAR' THEN json_extract_string({j}, '$.{n}') END"
    wrong = lambda n, kind="VARCHAR", j="payload": ("PX_E_1001", f"{k(n, j)} <> '{kind}'")
    pattern = lambda n, r, j="payload", code="PX_E_4001": (code, _matches(t(n, j), r))
    spec = "(SELECT list_filter(json_keys(payload), lambda x: regexp_full_match(x, 'a[a-z]*_spec_version'))[1])"
    lists = lambda words: "[" + ", ".join(map(repr, words)) + "]"
    lacks = lambda j, words: f"len(list_filter({lists(words)}, lambda x: NOT list_contains(json_keys({j}), x))) > 0"
    extra = lambda j, words, more="false": f"len(list_filter(json_keys({j}), lambda x: NOT list_contains({lists(words)}, x) AND NOT {more})) > 0"
    of_object = lambda j, bad: f"json_type({j}) = 'OBJECT' AND {bad}"
    head = [
        ("PX_E_1001", "json_type(payload) <> 'OBJECT'"),
        ("PX_E_2001", of_object("payload", lacks("payload", ops.MANIFEST_REQUIRED))),
        ("PX_E_2002", of_object("payload", extra("payload", ops.MANIFEST_REQUIRED + ops.MANIFEST_OPTIONAL, "regexp_full_match(x, 'a[a-z]*_spec_version')"))),
        wrong("format_version"),
        ("PX_E_3003", f"split_part({t('format_version')}, '.', 1) <> '2'"),
        ("PX_E_3001", f"split_part({t('format_version')}, '.', 1) = '2' AND {t('format_version')} <> '2.0'"),
        *(x for n in ("license", "producer") for x in (wrong(n), ("PX_E_2003", f"{t(n)} = ''"))),
        *(x for n, r in (("package_id", ops.UUID7), ("created_at", ops.STAMP)) for x in (wrong(n), pattern(n, r))),
        wrong("provenance_path"),
        ("PX_E_4003", f"{t('provenance_path')} <> 'provenance.jsonl'"),
        wrong("claims", "ARRAY"),
    ]
    tail = [wrong("notice_path"), pattern("notice_path", ops.NOTICE_PATH)]
    sv = f"json_type(payload, '$.' || {spec})", f"json_extract_string(payload, '$.' || {spec})"
    tail += [("PX_E_1001", f"{sv[0]} <> 'VARCHAR'"), ("PX_E_3004", f"{sv[0]} = 'VARCHAR' AND {_matches(sv[1], ops.SEMVER)}"), wrong("exchange_profile_version"), pattern("exchange_profile_version", ops.SEMVER, code="PX_E_3004")]
    entry = [("PX_E_1001", "json_type(c) <> 'OBJECT'"), ("PX_E_2001", of_object("c", lacks("c", ops.CLAIM_REQUIRED))), ("PX_E_2002", of_object("c", extra("c", ops.CLAIM_REQUIRED + ops.CLAIM_OPTIONAL)))]
    entry += [x for n, r in (("claim_id", ops.UUID7), ("claim_instance_id", ops.UUID7), ("hash", ops.DIGEST), ("path", ops.CLAIM_PATH)) for x in (wrong(n, j="c"), pattern(n, r, "c"))]
    entry += [
        ("PX_E_4002", f"coalesce({t('state', 'c')} NOT IN ('active', 'draft', 'superseded', 'withdrawn'), true)"),
        ("PX_E_2001", f"{t('state', 'c')} = 'superseded' AND {k('superseded_by_claim_id', 'c')} IS NULL"),
        pattern("superseded_by_claim_id", ops.UUID7, "c"),
        wrong("tags", "ARRAY", "c"),
    ]
    rows = lambda rules: "unnest(list_filter([" + ", ".join(f"CASE WHEN {bad} THEN {{'seq': {i}, 'code': '{code}'}} END" for i, (code, bad) in enumerate(rules)) + "], lambda r: r IS NOT NULL)) AS v"
    return f"""WITH j AS (SELECT raw_id, payload FROM manifest_raw WHERE json_valid(payload)), e AS (SELECT raw_id, unnest(CAST(json_extract(payload, '$.claims[*]') AS JSON[])) AS c, generate_subscripts(CAST(json_extract(payload, '$.claims[*]') AS JSON[]), 1) - 1 AS i FROM j WHERE json_type(payload, '$.claims') = 'ARRAY'),
 x AS (SELECT raw_id, 1 AS stage, 0 AS line, {rows(head)} FROM j UNION ALL SELECT raw_id, 2, i, {rows(entry)} FROM e UNION ALL SELECT raw_id, 3, 0, {rows(tail)} FROM j)
 SELECT raw_id, CAST(stage AS INT) AS stage, CAST(line AS BIGINT) AS line, CAST(v.seq AS INT) AS seq, v.code AS code FROM x UNION ALL SELECT raw_id, 0, 0, 0, 'PX_E_4006' FROM manifest_raw WHERE NOT json_valid(payload)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    """(key, line, claim_id, ms, event_id, event_type, has_target, prev_event_id): the packages' events as they first arrived."""
    p = table(spark, d, "provenance").select(
        uuid_key("event_id").alias("event_id"), uuid_key("package_id").alias("key"), F.col("line_no").alias("line"), uuid_key("claim_id").alias("claim_id"), instant_ms("timestamp").alias("ms"),
        folded("event_type").alias("event_type"), F.col("target_claim_instance_id").isNotNull().alias("has_target"), uuid_key("prev_event_id").alias("prev_event_id"), "received_at",
    )
    kept = ["key", "line", "claim_id", "ms", "event_type", "has_target", "prev_event_id"]
    one = p.filter("event_id IS NOT NULL").groupBy("event_id").agg(F.min_by(F.struct(*kept), F.struct("received_at", "line")).alias("r"))
    return one.select("event_id", "r.*").filter("key IS NOT NULL")


def _entries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(key, line, claim_id, path, hash) of the packages' claims as they first arrived, and (key, path, digest) of the mirror's."""
    m = table(spark, d, "manifest").select(uuid_key("package_id").alias("key"), uuid_key("claim_id").alias("claim_id"), "received_at", "path", digest_key("hash").alias("hash"))
    entry = m.filter("key IS NOT NULL AND claim_id IS NOT NULL").groupBy("key", "claim_id").agg(F.min(F.struct("received_at", "path", "hash")).alias("r"))
    entry = entry.select("key", "claim_id", F.unix_millis(F.col("r.received_at").cast("timestamp")).alias("line"), "r.path", "r.hash")
    f = table(spark, d, "manifest_mirror").select(uuid_key("claim_id").alias("claim_id"), "path", digest_key("hash").alias("digest")).filter("path IS NOT NULL")
    return entry, f.join(entry.select("key", "claim_id"), "claim_id").groupBy("key", "path").agg(F.min("digest").alias("digest"))


def package_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The rule at which the verification of each package stops, over the mirror as the packages' files."""
    v = ops.first_broken(ops.package_violations(_events(spark, d), *_entries(spark, d)))
    return v.select(uuid_text("key").alias("package_id"), "stage", "code")


def package_codes(spark: SparkSession, d: str) -> DataFrame:
    """How often each package breaks each rule, and the rule's category."""
    v = ops.package_violations(_events(spark, d), *_entries(spark, d))
    return v.groupBy("key", "stage", "code").agg(F.count("*").alias("n")).select(uuid_text("key").alias("package_id"), "stage", "code", ops.category(F.col("code")).alias("category"), "n")


_DIGEST = "CASE WHEN regexp_matches(lower(trim(hash)), '^(sha-?256[:=-])?[0-9a-f]{64}$') THEN right(lower(trim(hash)), 64) ELSE hash END"
_FOUND = f"""{_EV}, pe AS (SELECT * FROM ev WHERE package_id IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY package_id, claim_id ORDER BY ms, event_id) AS n, event_type IN ('reaffirm', 'revise', 'supersede', 'withdraw') AS needs FROM pe),
 b AS (SELECT *, (n = 1 AND needs) OR (n > 1 AND NOT needs) OR (needs <> (target IS NOT NULL)) OR count(*) FILTER (event_type IN ('supersede', 'withdraw')) OVER (PARTITION BY package_id, claim_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS bad FROM o),
 w AS (SELECT package_id, claim_id, min(n) FILTER (bad) AS wrong, min(line_no) AS line FROM b GROUP BY 1, 2),
 life AS (SELECT w.package_id, 5 AS stage, w.line, 0 AS seq, CASE WHEN event_type = 'reaffirm' AND target IS NULL THEN 'PX_E_5102' ELSE 'PX_E_5101' END AS code FROM w JOIN b ON b.package_id = w.package_id AND b.claim_id IS NOT DISTINCT FROM w.claim_id AND b.n = w.wrong),
 ent AS (SELECT p AS package_id, c AS claim_id, epoch_ms(min(received_at)) AS line, min_by(path, (received_at, path, h)) AS path, min_by(h, (received_at, path, h)) AS hash FROM (SELECT {_u('package_id')} AS p, {_u('claim_id')} AS c, received_at, path, {_DIGEST} AS h FROM manifest) WHERE p IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2),
 fil AS (SELECT package_id, m.path, min(m.h) AS digest FROM (SELECT {_u('claim_id')} AS claim_id, path, {_DIGEST} AS h FROM manifest_mirror WHERE path IS NOT NULL) m JOIN ent USING (claim_id) GROUP BY 1, 2),
 own AS (SELECT ent.package_id, 6 AS stage, line, 0 AS seq, CASE WHEN digest IS NULL THEN 'PX_E_5002' WHEN digest <> hash THEN 'PX_E_5001' END AS code FROM ent LEFT JOIN fil ON ent.package_id = fil.package_id AND ent.path = fil.path),
 ext AS (SELECT DISTINCT package_id, 6, 4611686018427387904, 1, 'PX_E_5002' FROM fil WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.package_id = fil.package_id AND ent.path = fil.path)),
 fork AS (SELECT package_id, claim_id FROM pe WHERE prev_event_id IS NOT NULL AND event_type <> 'create' GROUP BY package_id, claim_id, prev_event_id HAVING count(*) > 1),
 gap AS (SELECT e.package_id, e.claim_id FROM pe e LEFT JOIN pe p ON p.package_id = e.package_id AND p.claim_id = e.claim_id AND p.event_id = e.prev_event_id WHERE e.event_type <> 'create' AND (p.event_id IS NULL OR (p.line_no >= e.line_no AND p.event_type <> 'create'))),
 crea AS (SELECT package_id, claim_id FROM pe GROUP BY 1, 2 HAVING count(*) FILTER (event_type = 'create') <> 1),
 chain AS (SELECT DISTINCT package_id, claim_id FROM (FROM fork UNION ALL FROM gap UNION ALL FROM crea)),
 ref AS (SELECT pe.package_id, 8, line_no, 0, 'PX_E_5004' FROM pe WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.package_id = pe.package_id AND ent.claim_id = pe.claim_id)),
 allv AS (SELECT * FROM life UNION ALL SELECT * FROM own WHERE code IS NOT NULL UNION ALL SELECT * FROM ext UNION ALL SELECT package_id, 7, 0, 0, 'PX_E_5003' FROM chain UNION ALL SELECT * FROM ref)"""
VERDICT_SQL = f"WITH {_FOUND} SELECT package_id, CAST(first(stage ORDER BY stage, line, seq, code) AS INT) AS stage, first(code ORDER BY stage, line, seq, code) AS code FROM allv GROUP BY 1"
CODES_SQL = f"WITH {_FOUND} SELECT package_id, CAST(stage AS INT) AS stage, code, 'consistency' AS category, count(*) AS n FROM allv GROUP BY 1, 2, 3"


def timestamp_codes(spark: SparkSession, d: str) -> DataFrame:
    """Delivered instants that the log format does not allow: too fine or with an offset, or no instants."""
    p = table(spark, d, "provenance").select("event_id", "timestamp", ops.timestamp_code(F.col("timestamp")).alias("code"))
    return p.filter("code IS NOT NULL").distinct()


STAMPS_SQL = f"SELECT DISTINCT event_id, \"timestamp\", CASE WHEN regexp_full_match(\"timestamp\", '{ops.STAMP_ANY.strip('^$')}') THEN 'PX_E_3005' ELSE 'PX_E_4001' END AS code FROM provenance WHERE NOT regexp_full_match(\"timestamp\", '{ops.STAMP_MS.strip('^$')}')"


def archive_paths(spark: SparkSession, d: str) -> DataFrame:
    """Member names made of the documents' fields, and the code of those that no archive may have."""
    docs = table(spark, d, "documents")
    names = F.array(F.concat_ws("/", "source", "docket_no"), F.concat(F.lit("/"), "lang"), F.concat_ws(":/", F.substring("court_id", 1, 1), "docket_no"), F.concat_ws("\\", "court_id", "lang"), F.concat_ws("/..", "version_label", F.lit("/x")), F.substring("text", 1, 600), F.substring("text", 1, 0))
    v = docs.select("doc_id", F.posexplode(names).alias("n", "name")).filter("name IS NOT NULL")
    return v.select("doc_id", "n", ops.path_code(canonical.nfc(F.col("name"))).alias("code"))


_NFC = "nfc_normalize(name)"
_PATHS = [("PX_E_6006", "name = ''"), ("PX_E_6004", "contains(name, '\\')"), ("PX_E_6002", "starts_with(name, '/')"), ("PX_E_6003", "regexp_matches(name, '^[A-Za-z]:')"), ("PX_E_6005", f"length({_NFC}) > 512"), ("PX_E_6001", f"list_contains(string_split({_NFC}, '/'), '..')")]
PATHS_SQL = f"""WITH x AS (SELECT doc_id, [concat_ws('/', source, docket_no), '/' || lang, concat_ws(':/', court_id[1:1], docket_no), concat_ws('\\', court_id, lang), concat_ws('/..', version_label, '/x'), text[1:600], text[1:0]] AS ns FROM documents),
 y AS (SELECT doc_id, CAST(unnest(range(7)) AS INT) AS n, unnest(ns) AS name FROM x) SELECT doc_id, n, {_first(_PATHS)} AS code FROM y WHERE name IS NOT NULL"""


def _claim_documents(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries as claim documents: confidence is the format version, polarity the state, and so on; as dirty as they are."""
    m = table(spark, d, "manifest")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\n"))
    id_line, confidence = line("claim_id", F.col("claim_id")), line("confidence", F.col("format_version"))
    over = F.array_compact(F.array("superseded_by_claim_id", F.when(F.col("license").isNull(), F.col("claim_id"))))
    head = F.concat_ws(
        "", F.when(F.col("tags").isNull(), F.concat(confidence, id_line)).otherwise(F.concat(id_line, confidence)), line("polarity", F.col("state")), line("subject", F.col("producer")),
        F.when(F.size(over) > 0, F.concat(F.lit("supersedes:\n"), F.array_join(F.transform(over, lambda x: F.concat(F.lit("  - "), x, F.lit("\n"))), ""))), line("valid_from", F.col("created_at")), line("valid_until", F.date_format("deleted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    )
    return m.filter("claim_id IS NOT NULL AND format_version IS NOT NULL").select(F.struct("package_id", "claim_id", "received_at", "hash").alias("key"), F.concat(F.lit("---\n"), head, F.lit("---\nbody\n")).alias("text"))


def claim_violations(spark: SparkSession, d: str) -> DataFrame:
    """All broken rules of manifest entries as claim documents."""
    docs = _claim_documents(spark, d).select("key", packages.frontmatter(F.col("text")).alias("doc"))
    return ops.claim_document_violations(docs).select("key.*", "seq", "code").distinct()


_SUP = "list_filter([superseded_by_claim_id, CASE WHEN license IS NULL THEN claim_id END], lambda x: x IS NOT NULL)"
_ELEMENT = f"list_filter(list_transform({_SUP}, lambda e, i: CASE WHEN NOT regexp_full_match(trim(e), '{ops.UUID7.strip('^$')}') THEN 15 WHEN trim(e) = trim(claim_id) THEN 16 WHEN list_contains(list_transform({_SUP}[1:i-1], lambda q: trim(q)), trim(e)) THEN 17 END), lambda x: x IS NOT NULL)[1]"
_ISO = "trim(created_at)"
_UNTIL = "strftime(deleted_at, '%Y-%m-%dT%H:%M:%SZ')"
_OPENS = " OR ".join(f"coalesce(regexp_matches(trim({c}), '^[\\[{{&*!]'), false)" for c in ("claim_id", "format_version", "state", "producer", "created_at", "superseded_by_claim_id"))
CLAIM_SQL = rf"""WITH a AS (SELECT *, {_OPENS} AS unread FROM manifest WHERE claim_id IS NOT NULL AND format_version IS NOT NULL), m AS (SELECT * FROM a WHERE NOT unread), n AS (SELECT *, regexp_full_match(trim(format_version), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') AS num FROM m),
 x AS (SELECT package_id, claim_id, received_at, hash, unnest(list_filter([CASE WHEN NOT num THEN 1 END, CASE WHEN num AND CAST(trim(format_version) AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 2 END, CASE WHEN num AND NOT regexp_full_match(trim(format_version), '-?\d+\.\d{{3}}') THEN 3 END,
 CASE WHEN NOT regexp_full_match({_ISO}, '{ops.DAY.strip('^$')}') OR try_strptime({_ISO}, '%Y-%m-%dT%H:%M:%SZ') IS NULL AND created_at IS NOT NULL THEN 5 END, CASE WHEN {_ISO} > {_UNTIL} THEN 8 END, CASE WHEN trim(state) NOT IN ('affirm', 'negate', 'unknown') THEN 10 END, {_ELEMENT.replace('15', '12').replace('16', '13').replace('17', '14')},
 CASE WHEN (state IS NOT NULL OR len({_SUP}) > 0 OR created_at IS NOT NULL OR deleted_at IS NOT NULL) AND coalesce(trim(producer), '') = '' THEN 15 END, CASE WHEN tags IS NULL THEN 16 END], lambda q: q IS NOT NULL)) AS seq FROM n)
 SELECT DISTINCT package_id, claim_id, received_at, hash, CAST(seq AS INT) AS seq, ['', 'PX_E_4101', 'PX_E_4102', 'PX_E_4103', '', 'PX_E_4112', '', '', 'PX_E_4113', '', 'PX_E_4122', '', 'PX_E_4131', 'PX_E_4132', 'PX_E_4133', 'PX_E_4144', 'PX_E_4143'][seq + 1] AS code FROM x UNION ALL SELECT DISTINCT package_id, claim_id, received_at, hash, 0, 'PX_E_4006' FROM a WHERE unread"""


def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    """Manifest entries as claim documents in canonical form, and whether that changed them."""
    c = _claim_documents(spark, d).select("key", packages.canonical_document(F.col("text")).alias("c"))
    return c.select("key.*", F.sha2(F.encode("c.text", "utf-8"), 256).alias("digest"), "c.changed", "c.code")


def migrated_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Delivered manifests of legacy versions in the present one: their fields and versions, or the code of what cannot be migrated."""
    raw = table(spark, d, "manifest_raw").select(F.col("raw_id").alias("key"), canonical.shape(F.col("payload")).alias("doc"))
    spec = spec_field(spark, d)
    m = packages.migrated(raw, "dpkg_spec_version", spec, "0.4.0")
    part = lambda f: F.try_element_at(F.col("fields"), F.lit(f))
    names = F.array_join(F.array_remove(F.array_sort(F.map_keys("fields")), spec), ",")
    return m.select(F.col("key").alias("raw_id"), "code", names.alias("fields"), part("format_version")["text"].alias("format_version"), part(spec)["text"].alias("spec_version"), F.coalesce(part("extensions")["kind"] == "object", F.lit(False)).alias("extended"))


_K = "json_type(payload, '$.format_version')"
MIGRATED_SQL = f"""WITH j AS (SELECT raw_id, payload, json_valid(payload) AS ok FROM manifest_raw), k AS (SELECT raw_id, payload, CASE WHEN NOT ok THEN 'PX_E_4006' WHEN json_type(payload) <> 'OBJECT' THEN 'PX_E_1001' WHEN coalesce({_K} <> 'VARCHAR' OR json_extract_string(payload, '$.format_version') NOT IN ('1.0', '1.1'), true) THEN 'PX_E_3001' END AS code FROM j),
 e AS (SELECT *, CASE WHEN code IS NULL THEN json_type(payload, '$.extensions') END AS t, CASE WHEN code IS NULL AND json_type(payload, '$.extensions') = 'OBJECT' THEN len(list_filter(json_keys(payload, '$.extensions'), lambda x: x <> 'dpkg_spec_version')) END AS left_over FROM k)
 SELECT raw_id, code, CASE WHEN code IS NULL THEN array_to_string(list_sort(list_filter(list_distinct(list_append(json_keys(payload), 'format_version')), lambda x: x <> 'dpkg_spec_version' AND NOT regexp_full_match(x, 'a[a-z]*_spec_version') AND NOT (x = 'extensions' AND coalesce(left_over = 0, false)))), ',') END AS fields,
 CASE WHEN code IS NULL THEN '2.0' END AS format_version, CASE WHEN code IS NULL THEN '0.4.0' END AS spec_version, coalesce(left_over > 0, false) AS extended FROM e"""


def external_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The independent reader's verdict on each package."""
    v = ops.external_verdict(_events(spark, d), _entries(spark, d)[0])
    return v.select(uuid_text("key").alias("package_id"), "verdict")


EXTERNAL_SQL = f"""WITH {_EV}, ent AS (SELECT DISTINCT {_u('package_id')} AS package_id, {_u('claim_id')} AS claim_id FROM manifest WHERE package_id IS NOT NULL AND claim_id IS NOT NULL), pe AS (SELECT * FROM ev WHERE package_id IS NOT NULL),
 o AS (SELECT *, row_number() OVER (PARTITION BY package_id, claim_id ORDER BY ms, event_id) AS n FROM pe), b AS (SELECT package_id, (n = 1) <> (event_type IN ('create', 'publish')) OR count(*) FILTER (event_type IN ('supersede', 'withdraw')) OVER (PARTITION BY package_id, claim_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS bad FROM o),
 x AS (SELECT package_id FROM b WHERE bad UNION SELECT package_id FROM ent WHERE (package_id, claim_id) NOT IN (SELECT (package_id, claim_id) FROM pe)) SELECT package_id, CASE WHEN package_id IN (FROM x) THEN 'invalid' ELSE 'valid' END AS verdict FROM (SELECT package_id FROM ent UNION SELECT package_id FROM pe)"""


QUERIES = {f.__name__: f for f in (event_verdict, entry_verdict, manifest_rules, package_verdict, package_codes, timestamp_codes, archive_paths, claim_violations, canonical_documents, migrated_manifests, external_verdict)}
ORACLE = {"event_verdict": EVENT_SQL, "entry_verdict": ENTRY_SQL, "manifest_rules": _json_sql(), "package_verdict": VERDICT_SQL, "package_codes": CODES_SQL, "timestamp_codes": STAMPS_SQL, "archive_paths": PATHS_SQL, "claim_violations": CLAIM_SQL, "migrated_manifests": MIGRATED_SQL, "external_verdict": EXTERNAL_SQL}
