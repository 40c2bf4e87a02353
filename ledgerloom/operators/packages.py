"""Verification of packages as they are shipped: from the bytes of archives to the one code at which a reader stops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical
from ..functions.keys import instant_ms
from ..session import cut
from ..sources.packages import Budget, unpack
from . import claims as ops
from . import trust
from . import verification as v

# Members of a package, and the codes of a missing one and of text that is no UTF-8.
MANIFEST, LOG, CLAIMS, SIGNATURES, SIGNERS = "manifest.json", "provenance.jsonl", "claims/", "signatures.jsonl", "signers/"
ABSENT, NOT_UTF8 = "PX_E_2005", "PX_E_4010"
ARCHIVE, SIGNED = -1, 9


def _text(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))


def _found(df: DataFrame, stage: int, line: Column, code: Column) -> DataFrame:
    rows = df.select("key", F.lit(stage).alias("stage"), line.cast("bigint").alias("line"), F.lit(0).alias("seq"), code.alias("code"))
    return rows.filter("code IS NOT NULL")


def archive_violations(archives: DataFrame, spec_version: str, lenient: bool = False, signed: bool = False, notarised: bool = False, budget: Budget = Budget()) -> DataFrame:
    """(key, stage, line, seq, code) of archives (path, content): rules broken by the archive, its documents, what they say of each
    other, and its signatures, in the order in which a reader stops. Stages are those of ``verification``, with the archive
    before and signatures after them; ``signed`` and ``notarised`` ask for an envelope, and for a notary behind each.
    """
    m = cut(unpack(archives, budget).withColumnRenamed("path", "key"))
    whole = m.join(m.filter("code IS NOT NULL").select("key").distinct(), "key", "left_anti")
    keys = whole.select("key").distinct()
    out = [_found(m, ARCHIVE, F.col("ordinal"), F.col("code"))]

    file = lambda name: whole.filter(F.col("member") == name).select("key", "content", _text(F.col("content")).alias("text"))
    for name in (MANIFEST, LOG):
        out.append(_found(keys.join(file(name).select("key"), "key", "left_anti"), v.UNREADABLE, F.lit(0), F.lit(ABSENT)))
        out.append(_found(file(name).filter("text IS NULL AND content IS NOT NULL"), v.UNREADABLE, F.lit(0), F.lit(NOT_UTF8)))
    manifests = cut(file(MANIFEST).filter("text IS NOT NULL").select("key", canonical.shape(F.col("text")).alias("doc")))
    lines = file(LOG).filter("text IS NOT NULL").select("key", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("i", "text")).filter(F.btrim("text") != "")
    logged = cut(lines.select("key", (F.col("i") + 1).alias("line"), canonical.shape(F.col("text")).alias("doc")))
    out += [v.manifest_violations(manifests, spec_version, lenient), v.event_violations(logged)]

    e = v.Document("doc")
    events = logged.filter("doc.kind = 'object'").select(
        "key", "line", e.text("claim_id").alias("claim_id"), instant_ms(e.text("timestamp")).alias("ms"), e.text("event_id").alias("event_id"), e.text("event_type").alias("event_type"),
        e.has("target_claim_instance_id").alias("has_target"), e.text("prev_event_id").alias("prev_event_id"),
    )
    c = v.Document("c")
    entries = cut(v.claim_entries(manifests).select("key", F.col("i").alias("line"), *(c.text(f).alias(f) for f in ("claim_id", "claim_instance_id", "path", "hash"))))
    files = whole.filter(F.startswith("member", F.lit(CLAIMS)) & ~F.col("is_dir")).select("key", F.col("member").alias("path"), F.sha2("content", 256).alias("digest"))
    out.append(v.package_violations(events, entries, files))

    envelopes = cut(trust.read_signatures(file(SIGNATURES).select("key", F.col("text").alias("content"))))
    out.append(_found(envelopes.filter("code IS NOT NULL"), SIGNED, F.when(F.col("code") == "E_SIGNATURE_ORDER", F.lit(1 << 40)).otherwise(F.lit(0)) + F.col("line"), F.col("code")))
    doc = v.Document("doc")
    head = manifests.select("key", doc.text("format_version").alias("format_version"), doc.text("package_id").alias("package_id"))
    claims = head.join(entries, "key").select(F.col("key").alias("k"), "package_id", "format_version", "claim_id", "claim_instance_id", "hash")
    hashes = _package_hash(head, claims)
    signers = whole.filter(F.startswith("member", F.lit(SIGNERS)) & F.endswith("member", F.lit(".json"))).select("key", F.substring_index(F.substring_index("member", "/", -1), ".json", 1).alias("id"), _text(F.col("content")).alias("content"))
    scoped = lambda key, id_: F.concat(key, F.lit("\n"), id_)
    manifests_of = trust.read_signers(signers.select(scoped(F.col("key"), F.col("id")).alias("name"), "content"))
    known = manifests_of.select(F.col("name").alias("signer_id"), "algorithm", F.when(F.col("code").isNull(), F.col("public_key_b64")).alias("public_key_b64"), "key_fingerprint")
    asked = envelopes.filter("code IS NULL").select(F.col("key").alias("package_id"), scoped(F.col("key"), F.col("signer_id")).alias("signer_id"), "algorithm", "signed_at_iso", "package_canonical_hash", "signature_b64", "line")
    codes = trust.verify_envelopes(asked, known, hashes, "line")
    out.append(_found(codes.withColumnRenamed("package_id", "key"), SIGNED, F.lit(1 << 41) + F.col("line"), F.col("code")))
    wanted = v.signature_requirements(keys, envelopes.select("key", F.lit("verified-locally").alias("attestation")), signed, notarised)
    out.append(_found(wanted, SIGNED, F.lit(1 << 42), F.col("code")))
    return reduce(DataFrame.unionByName, out)


def _package_hash(head: DataFrame, claims: DataFrame) -> DataFrame:
    """(package_id, package_hash) by archive; a package without claims has the hash of none."""
    one = F.concat(F.lit('["'), F.concat_ws('","', "claim_id", "claim_instance_id", "hash"), F.lit('"]'))
    listed = claims.groupBy("k").agg(F.array_sort(F.collect_list(one)).alias("cs"))
    j = head.join(listed, head["key"] == listed["k"], "left")
    body = F.concat(F.lit('["'), "format_version", F.lit('","'), F.col("package_id"), F.lit('",['), F.array_join(F.coalesce("cs", F.array().cast("array<string>")), ","), F.lit("]]\n"))
    return j.select(F.col("key").alias("package_id"), F.sha2(F.encode(body, "utf-8"), 256).alias("package_hash"))


def verify_archives(archives: DataFrame, spec_version: str, **options) -> DataFrame:
    """(path, stage, code) of each archive: null for a package that passes, else where and at which rule a reader stops."""
    first = v.first_broken(archive_violations(archives, spec_version, **options)).withColumnRenamed("key", "path")
    return archives.select("path").distinct().join(first, "path", "left").select("path", "stage", "code")


def _opened(archives: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifests (key, doc), claims (key, claim_id, hash, state, tags, labels) and events (key, event_id, line) of archives."""
    m = cut(unpack(archives).withColumnRenamed("path", "key"))
    text = lambda name: m.filter(F.col("member") == name).select("key", _text(F.col("content")).alias("text"))
    manifests = cut(text(MANIFEST).select("key", canonical.shape(F.col("text")).alias("doc")))
    c = v.Document("c")
    labels = F.try_element_at(F.col("c")["fields"], F.lit("labels"))
    claims = v.claim_entries(manifests).select(
        "key", c.text("claim_id").alias("claim_id"), c.text("hash").alias("hash"), c.text("state").alias("state"), F.transform("tags.items", lambda t: t["text"]).alias("tags"),
        F.from_json(F.when(labels["kind"] == "object", labels["text"]), "map<string,string>").alias("labels"), F.to_json(F.map_entries(F.col("c")["fields"])).alias("whole"),
    )
    lines = text(LOG).select("key", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line", "text")).filter(F.btrim("text") != "")
    events = lines.select("key", "line", F.get_json_object("text", "$.event_id").alias("event_id"))
    return manifests, cut(claims), cut(events)


def diff_archives(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, layer, kind, item) of two versions of packages, archives (path, content) by one path: manifest fields, claims, claims'
    evidence and the log's events that were added, removed, changed or reordered. Equal packages give no row."""
    (ma, ca, ea), (mb, cb, eb) = _opened(a), _opened(b)
    pair = F.struct("key", "claim_id")
    scoped = lambda c: c.withColumn("claim_id", pair)
    manifest = ops.manifest_diff(ma, mb).select("key", F.lit("manifest").alias("layer"), F.col("change").alias("kind"), F.col("field").alias("item"))
    sets = ops.set_diff(scoped(ca), scoped(cb), "claim_id", ["whole"]).select("claim_id.key", F.lit("claims").alias("layer"), F.col("change").alias("kind"), F.col("claim_id.claim_id").alias("item"))
    evidence = ops.evidence_diff(scoped(ca), scoped(cb))
    kinds = F.array_compact(F.array(F.when(F.col("hash_changed"), "hash"), F.when(F.col("state_changed"), "state"), F.when(F.size("tags_added") + F.size("tags_removed") > 0, "tags"), F.when(F.size("labels_added") + F.size("labels_removed") > 0, "labels")))
    evidence = evidence.select("claim_id.key", F.lit("evidence").alias("layer"), F.explode(kinds).alias("kind"), F.col("claim_id.claim_id").alias("item"))
    log = ops.timeline_ids(ea, eb, "key", "event_id", "line").select("key", F.lit("log").alias("layer"), F.col("change").alias("kind"), F.col("event_id").alias("item"))
    return reduce(DataFrame.unionByName, (manifest, sets, evidence, log)).withColumnRenamed("key", "path")
