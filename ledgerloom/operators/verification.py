"""Rules of manifests, events, packages and archives. A broken rule is a row (key, stage, line, seq, code), never an exception;
the error of a document is the first of its rows in that order, which is the order in which a reader would stop.

Documents come as ``canonical.shape`` gives them: fields with kind and text. A rule that looks at a value of the wrong kind is
null and breaks nothing, as the rule for its kind comes before it. All rules are built-in expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import claims as ops

# Patterns, field sets, words and codes of the package format.
UUID7 = r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?Z$"
STAMP_MS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z$"
STAMP_ANY = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
DIGEST = r"^[0-9a-f]{64}$"
CLAIM_PATH = r"^claims/[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\.md$"
NOTICE_PATH = r"^[A-Za-z0-9_./-]+$"
SEMVER = r"^\d+\.\d+\.\d+(?:-[A-Za-z0-9.-]+)?$"
VERSIONS = ("2.0",)
LOG_PATH = "provenance.jsonl"
MANIFEST_REQUIRED = ("claims", "created_at", "format_version", "license", "package_id", "producer", "provenance_path")
MANIFEST_OPTIONAL = ("exchange_profile_version", "extensions", "notice_path", "signature")
CLAIM_REQUIRED = ("claim_id", "claim_instance_id", "hash", "path", "state")
CLAIM_OPTIONAL = ("labels", "superseded_by_claim_id", "tags", "withdrawn_reason")
CLAIM_STATES = ("active", "draft", "superseded", "withdrawn")
EVENT_REQUIRED = ("actor", "claim_id", "event_id", "event_type", "timestamp")
EVENT_OPTIONAL = ("claim_instance_id", "extensions", "prev_event_id", "reason", "superseded_by_claim_id", "target_claim_instance_id")
EVENT_TYPES = ("create", "publish", "reaffirm", "revise", "supersede", "withdraw")
WITH_INSTANCE, WITHOUT_INSTANCE = ("create", "revise", "supersede"), ("publish", "reaffirm", "withdraw")
TYPE, MISSING, EXTRA, EMPTY, FORBIDDEN = "PX_E_1001", "PX_E_2001", "PX_E_2002", "PX_E_2003", "PX_E_2004"
MINOR, MAJOR, SEMVER_CODE, PRECISION = "PX_E_3001", "PX_E_3003", "PX_E_3004", "PX_E_3005"
PATTERN, ENUM, CONSTANT, TWICE, TAG_TWICE = "PX_E_4001", "PX_E_4002", "PX_E_4003", "PX_E_4004", "PX_E_4005"
HASH, FILESET, CHAIN, DANGLING, ILLEGAL, NO_TARGET = "PX_E_5001", "PX_E_5002", "PX_E_5003", "PX_E_5004", "PX_E_5101", "PX_E_5102"
CATEGORIES = {"1": "type", "2": "structure", "3": "version", "4": "format", "5": "consistency", "6": "security", "9": "generic"}

Rules = list[tuple[str, Column]]


def category(code: Column) -> Column:
    """The category of an error or warning code; whatever is none of a known band is generic."""
    band = F.regexp_extract(code, r"^PX_[EW]_(.)", 1)
    return F.coalesce(reduce(lambda e, kv: e.when(band == kv[0], kv[1]), CATEGORIES.items(), F.when(F.lit(False), "")), F.lit("generic"))


def timestamp_code(c: Column) -> Column:
    """3005 for an instant finer than milliseconds or with an offset, 4001 for what is no instant, null for a good one."""
    return F.when(c.rlike(STAMP_MS), None).when(c.rlike(STAMP_ANY), PRECISION).otherwise(PATTERN)


class Document:
    """The rules' view of a column of ``canonical.shape``."""

    def __init__(self, column: str):
        self.column = F.col(column)
        self.keys = F.map_keys(self.column["fields"])

    def has(self, name: str) -> Column:
        return F.array_contains(self.keys, name)

    def text(self, name: str) -> Column:
        part = F.try_element_at(self.column["fields"], F.lit(name))
        return F.when(part["kind"] == "string", part["text"])

    def kind(self, name: str) -> Column:
        return F.try_element_at(self.column["fields"], F.lit(name))["kind"]

    def object_rules(self, required: tuple[str, ...], optional: tuple[str, ...]) -> Rules:
        names = F.array(*map(F.lit, required))
        known = F.array(*map(F.lit, required + optional))
        return [(TYPE, self.column["kind"] != "object"), (MISSING, F.size(F.array_except(names, self.keys)) > 0), (EXTRA, F.size(F.array_except(self.keys, known)) > 0)]

    def wrong(self, name: str, kind: str = "string") -> tuple[str, Column]:
        return TYPE, self.kind(name) != kind

    def pattern(self, name: str, regex: str) -> tuple[str, Column]:
        return PATTERN, ~self.text(name).rlike(regex)


def manifest_rules(m: Document, spec_version: str, lenient: bool = False) -> tuple[Rules, Rules]:
    """Rules of a manifest before and after those of its claims. ``lenient`` lets unknown minor versions of a known major pass."""
    version = m.text("format_version")
    unknown = ~version.isin(*VERSIONS)
    known_major = F.substring_index(version, ".", 1).isin(*{v.split(".")[0] for v in VERSIONS})
    head = [*m.object_rules(MANIFEST_REQUIRED, (*MANIFEST_OPTIONAL, spec_version)), m.wrong("format_version"), (MAJOR, unknown & ~known_major)]
    head += [] if lenient else [(MINOR, unknown & known_major)]
    for name in ("license", "producer"):
        head += [m.wrong(name), (EMPTY, m.text(name) == "")]
    for name, regex in (("package_id", UUID7), ("created_at", STAMP)):
        head += [m.wrong(name), m.pattern(name, regex)]
    head += [m.wrong("provenance_path"), (CONSTANT, m.text("provenance_path") != LOG_PATH), m.wrong("claims", "array")]
    tail = [m.wrong("notice_path"), m.pattern("notice_path", NOTICE_PATH)]
    for name in (spec_version, "exchange_profile_version"):
        tail += [m.wrong(name), (SEMVER_CODE, ~m.text(name).rlike(SEMVER))]
    return head, tail


def tag_code(tags: Column) -> Column:
    """Code of the first bad element of an array of parts: no string, empty, or there before."""
    bad = F.transform(tags, lambda t, i: F.when(t["kind"] != "string", TYPE).when(t["text"] == "", EMPTY).when(F.exists(F.slice(tags, 1, i), lambda u: u["text"] == t["text"]), TAG_TWICE))
    return F.get(F.array_compact(bad), F.lit(0))


def claim_entry_rules(c: Document, tags: Column) -> Rules:
    """Rules of a claim entry; tags: its elements as parts."""
    out = c.object_rules(CLAIM_REQUIRED, CLAIM_OPTIONAL)
    for name, regex in (("claim_id", UUID7), ("claim_instance_id", UUID7), ("hash", DIGEST), ("path", CLAIM_PATH)):
        out += [c.wrong(name), c.pattern(name, regex)]
    out += [(ENUM, ~F.coalesce(c.text("state").isin(*CLAIM_STATES), F.lit(False))), (MISSING, (c.text("state") == "superseded") & ~c.has("superseded_by_claim_id")), c.pattern("superseded_by_claim_id", UUID7), c.wrong("tags", "array")]
    code = tag_code(tags)
    return out + [(x, code == x) for x in (TYPE, EMPTY, TAG_TWICE)]


def event_rules(e: Document) -> Rules:
    kind = e.text("event_type")
    out = [*e.object_rules(EVENT_REQUIRED, EVENT_OPTIONAL), e.wrong("actor"), (EMPTY, e.text("actor") == "")]
    out += [e.pattern(n, r) for n, r in (("claim_id", UUID7), ("event_id", UUID7), ("timestamp", STAMP))]
    out += [
        (ENUM, ~F.coalesce(kind.isin(*EVENT_TYPES), F.lit(False))),
        (MISSING, kind.isin(*WITH_INSTANCE) & ~e.has("claim_instance_id")),
        (FORBIDDEN, kind.isin(*WITHOUT_INSTANCE) & e.has("claim_instance_id")),
        (MISSING, (kind == "supersede") & ~e.has("superseded_by_claim_id")),
        (FORBIDDEN, (kind == "create") & e.has("prev_event_id")),
        (MISSING, (kind != "create") & ~e.has("prev_event_id")),
    ]
    return out + [e.pattern(n, UUID7) for n in ("prev_event_id", "claim_instance_id", "superseded_by_claim_id", "target_claim_instance_id")]


DAY = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
CONFLICT_FIELDS = ("polarity", "supersedes", "valid_from", "valid_until")
POLARITIES = ("affirm", "negate", "unknown")


def claim_document_rules(c: Document, supersedes: Column) -> Rules:
    """Rules of a claim's frontmatter, over ``sources.packages.frontmatter``; supersedes: the elements of that field as parts."""
    number = F.when(c.kind("confidence") == "number", F.try_element_at(c.column["fields"], F.lit("confidence"))["text"])
    out = [("PX_E_4141", c.has("conflict_class")), ("PX_E_4101", c.kind("confidence") != "number")]
    out += [("PX_E_4102", ~number.try_cast("double").between(0, 1)), ("PX_E_4103", ~number.rlike(r"^-?\d+\.\d{3}$"))]
    for name in ("valid_from", "valid_until"):
        t = c.text(name)
        out += [("PX_E_4111", c.kind(name) != "string"), ("PX_E_4112", ~t.rlike(DAY) | F.try_to_timestamp(t, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNull() & t.isNotNull())]
    out += [("PX_E_4113", c.text("valid_from") > c.text("valid_until")), ("PX_E_4121", c.kind("polarity") != "string"), ("PX_E_4122", ~c.text("polarity").isin(*POLARITIES))]
    elements = F.transform(
        supersedes,
        lambda e, i: F.when((e["kind"] != "string") | ~e["text"].rlike(UUID7), "PX_E_4131").when(e["text"] == c.text("claim_id"), "PX_E_4132").when(F.exists(F.slice(supersedes, 1, i), lambda u: u["text"] == e["text"]), "PX_E_4133"),
    )
    first = F.get(F.array_compact(elements), F.lit(0))
    out += [("PX_E_4131", c.kind("supersedes") != "array"), *((x, first == x) for x in ("PX_E_4131", "PX_E_4132", "PX_E_4133"))]
    blank = F.coalesce(F.trim(c.text("subject")) == "", F.lit(True))
    return out + [("PX_E_4144", F.arrays_overlap(c.keys, F.array(*map(F.lit, CONFLICT_FIELDS))) & blank), ("PX_E_4143", c.keys != F.array_sort(c.keys))]


def claim_document_violations(documents: DataFrame) -> DataFrame:
    """Broken rules of claim documents (key, doc), doc being a frontmatter."""
    from ..functions import canonical

    listed = F.try_element_at(F.col("doc")["fields"], F.lit("supersedes"))
    rows = documents.withColumn("over", canonical.shape(F.when(listed["kind"] == "array", listed["text"]))["items"])
    unread = rows.filter("doc.code IS NOT NULL").select("key", F.lit(UNREADABLE).alias("stage"), F.lit(0).cast("bigint").alias("line"), F.lit(0).alias("seq"), F.col("doc.code").alias("code"))
    return unread.unionByName(broken(rows, claim_document_rules(Document("doc"), F.col("over")), HEAD))


def broken(rows: DataFrame, rules: Rules, stage: int, line: Column | int = 0) -> DataFrame:
    """(key, stage, line, seq, code): one row per rule broken by rows with a column key."""
    hits = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(i).alias("seq"), F.lit(code).alias("code"))) for i, (code, bad) in enumerate(rules))))
    at = F.lit(line) if isinstance(line, int) else line
    return rows.select("key", F.lit(stage).alias("stage"), at.cast("bigint").alias("line"), F.explode(hits).alias("v")).select("key", "stage", "line", "v.seq", "v.code")


def first_broken(found: DataFrame) -> DataFrame:
    """(key, stage, line, code) of the rule at which a reader stops."""
    first = found.groupBy("key").agg(F.min(F.struct("stage", "line", "seq", "code")).alias("v"))
    return first.select("key", "v.stage", "v.line", "v.code")


UNREADABLE, HEAD, CLAIMS, TAIL, EVENTS, LIFECYCLE, FILES, CHAINS, REFERENCES = range(9)


def claim_entries(manifests: DataFrame) -> DataFrame:
    """(key, i, c, tags) of the claims that manifests (key, doc) list: their places and shapes, and their tags' shapes."""
    from ..functions import canonical

    listed = F.try_element_at(F.col("doc")["fields"], F.lit("claims"))
    e = manifests.filter(listed["kind"] == "array").select("key", canonical.shape(listed["text"]).alias("claims"))
    e = e.select("key", F.posexplode("claims.items").alias("i", "part"))
    e = e.select("key", "i", canonical.shape(F.when(F.col("part.kind") == "string", F.to_json(F.array("part.text"))).otherwise(F.col("part.text"))).alias("c"))
    tags = F.try_element_at(F.col("c")["fields"], F.lit("tags"))
    return e.withColumn("tags", canonical.shape(F.when(tags["kind"] == "array", tags["text"])))


def manifest_violations(manifests: DataFrame, spec_version: str, lenient: bool = False) -> DataFrame:
    """Broken rules of manifests (key, doc), doc being a shape: the reader's code, or all rules that are broken.

    Claims are looked at one by one, in their order; a claim_id that an earlier claim has is 4004, after the claim's own rules.
    """
    head, tail = manifest_rules(Document("doc"), spec_version, lenient)
    unread = manifests.filter("doc.code IS NOT NULL").select("key", F.lit(UNREADABLE).alias("stage"), F.lit(0).cast("bigint").alias("line"), F.lit(0).alias("seq"), F.col("doc.code").alias("code"))
    read = manifests.filter("doc.code IS NULL")
    entries = claim_entries(read)
    by_entry = broken(entries, claim_entry_rules(Document("c"), F.col("tags.items")), CLAIMS, F.col("i"))
    ids = entries.select("key", "i", Document("c").text("claim_id").alias("claim_id")).filter("claim_id IS NOT NULL")
    first = ids.groupBy("key", "claim_id").agg(F.min("i").alias("first"), F.count("*").alias("n")).filter("n > 1")
    twice = ids.join(first, ["key", "claim_id"]).filter("i > first").select("key", F.lit(CLAIMS).alias("stage"), F.col("i").cast("bigint").alias("line"), F.lit(1000).alias("seq"), F.lit(TWICE).alias("code"))
    return reduce(DataFrame.unionByName, (unread, broken(read, head, HEAD), by_entry, twice, broken(read, tail, TAIL)))


def event_violations(events: DataFrame) -> DataFrame:
    """Broken rules of events (key, line, doc), doc being a shape; unreadable lines stop a reader before any rule."""
    unread = events.filter("doc.code IS NOT NULL").select("key", F.lit(UNREADABLE).alias("stage"), F.col("line").cast("bigint").alias("line"), F.lit(1).alias("seq"), F.col("doc.code").alias("code"))
    return unread.unionByName(broken(events.filter("doc.code IS NULL"), event_rules(Document("doc")), EVENTS, F.col("line")))


def lifecycle_violations(events: DataFrame) -> DataFrame:
    """(key, stage, line, seq, code) of events (key, line, claim_id, ms, event_id, event_type, has_target): per claim the first
    illegal event. Claims stop a reader in the order in which the log first names them."""
    scoped = events.withColumn("claim", F.struct("key", "claim_id"))
    run = ops.lifecycle(scoped.drop("claim_id").withColumnRenamed("claim", "claim_id"), ops.bad_target(F.col("event_type"), F.col("has_target")))
    order = events.groupBy("key", "claim_id").agg(F.min("line").alias("line"))
    bad = run.filter("first_illegal IS NOT NULL").select("claim_id.key", F.col("claim_id.claim_id").alias("claim_id"), "code")
    return bad.join(order, ["key", "claim_id"]).select("key", F.lit(LIFECYCLE).alias("stage"), F.col("line").cast("bigint").alias("line"), F.lit(0).alias("seq"), "code")


def file_violations(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Claim entries (key, line, path, hash) against files (key, path, digest): in the entries' order 5002 for a missing file and
    5001 for another digest, then 5002 for files that no entry names."""
    j = entries.join(files, ["key", "path"], "left")
    code = F.when(F.col("digest").isNull(), FILESET).when(F.col("digest") != F.col("hash"), HASH)
    own = j.select("key", F.lit(FILES).alias("stage"), F.col("line").cast("bigint").alias("line"), F.lit(0).alias("seq"), code.alias("code")).filter("code IS NOT NULL")
    extra = files.join(entries, ["key", "path"], "left_anti").select("key", F.lit(FILES).alias("stage"), F.lit((1 << 62)).alias("line"), F.lit(1).alias("seq"), F.lit(FILESET).alias("code")).distinct()
    return own.unionByName(extra)


def chain_violations(events: DataFrame) -> DataFrame:
    """5003 for events (key, line, claim_id, event_id, event_type, prev_event_id) that break their claim's chain."""
    scoped = events.select(F.struct("key", "claim_id").alias("claim_id"), "event_id", "event_type", "prev_event_id", "line")
    bad = ops.event_chain(scoped).select("claim_id.key", F.col("claim_id.claim_id").alias("claim_id")).distinct()
    return bad.select("key", F.lit(CHAINS).alias("stage"), F.lit(0).cast("bigint").alias("line"), F.lit(0).alias("seq"), F.lit(CHAIN).alias("code"))


def reference_violations(events: DataFrame, entries: DataFrame) -> DataFrame:
    """5004 for events (key, line, claim_id) whose claim the package does not list."""
    lost = events.join(entries.select("key", "claim_id"), ["key", "claim_id"], "left_anti")
    return lost.select("key", F.lit(REFERENCES).alias("stage"), F.col("line").cast("bigint").alias("line"), F.lit(0).alias("seq"), F.lit(DANGLING).alias("code"))


def package_violations(events: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """Broken rules across a package's documents, for well-formed ones: lifecycle, files, chains, references."""
    parts = (lifecycle_violations(events), file_violations(entries, files), chain_violations(events), reference_violations(events, entries))
    return reduce(DataFrame.unionByName, parts)


def signature_requirements(packages: DataFrame, envelopes: DataFrame, signed: bool = False, notarised: bool = False) -> DataFrame:
    """(key, code) of packages (key) under a caller's demands on envelopes (key, attestation): E_SIGNER_REQUIRED without any
    envelope, E_SIGNER_NOTARY_REQUIRED with one that no notary vouches for."""
    lone = packages.select("key").join(envelopes.select("key"), "key", "left_anti").select("key", F.lit("E_SIGNER_REQUIRED").alias("code"))
    local = envelopes.filter("NOT attestation <=> 'verified-by-notary'").select("key", F.lit("E_SIGNER_NOTARY_REQUIRED").alias("code")).distinct()
    return (lone if signed else lone.limit(0)).unionByName(local if notarised else local.limit(0))


# Codes of unsafe archive members, in the order of their rules.
def path_rules(name: Column, longest: int = 512) -> Rules:
    """Rules of an archive member's path, over its name in NFC."""
    return [
        ("PX_E_6006", name == ""),
        ("PX_E_6004", F.contains(name, F.lit("\\"))),
        ("PX_E_6002", F.startswith(name, F.lit("/"))),
        ("PX_E_6003", name.rlike("^[A-Za-z]:")),
        ("PX_E_6005", F.char_length(name) > longest),
        ("PX_E_6001", F.array_contains(F.split(name, "/"), "..")),
    ]


def path_code(name: Column, longest: int = 512) -> Column:
    return reduce(lambda e, r: e.when(r[1], r[0]), path_rules(name, longest), F.when(F.lit(False), ""))


def external_verdict(events: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, verdict) of packages with claims or events (as for ``package_violations``) under the independent reader's rules: the
    lifecycle without those on targets, and a claim that the manifest lists must have an event that begins it."""
    scoped = events.withColumn("claim", F.struct("key", "claim_id"))
    run = ops.lifecycle(scoped.drop("claim_id").withColumnRenamed("claim", "claim_id")).filter("first_illegal IS NOT NULL").select("claim_id.key")
    never = entries.select("key", "claim_id").join(events.select("key", "claim_id"), ["key", "claim_id"], "left_anti").select("key")
    bad = run.unionByName(never).distinct().withColumn("_bad", F.lit(True))
    keys = entries.select("key").unionByName(events.select("key")).distinct()
    return keys.join(bad, "key", "left").select("key", F.when(F.col("_bad"), "invalid").otherwise("valid").alias("verdict"))
