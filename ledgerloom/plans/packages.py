"""Queries of canonical bytes, archives, signatures and streams."""

from __future__ import annotations

import base64
import os
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, ed25519
from ..functions.keys import folded, instant_ms, uuid_key, uuid_text
from ..operators import trust
from ..operators.replay import Machine, replay
from ..session import ensure_checkpoint_dir
from ..sources import packages as pk
from ..sources.tables import table
from ..streaming import replay as stream
from .claims import _EV, _u


def nfc_digest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(F.encode(canonical.nfc(F.col("text")), "utf-8"), 256).alias("digest"))


def identity_hash(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes of documents with some of the identity fields, and others that must not count."""
    tags = F.array_compact(F.array("version_label", "lang", "source"))
    fields = F.struct(F.col("version_label").alias("version"), tags.alias("tags"), F.col("docket_no").alias("subject"), "source", F.col("lang").alias("locale"), F.lit("decision").alias("type"), "doc_id", F.col("court_id").alias("author"), F.create_map(F.lit("z"), "source", F.lit("a"), "court_id").alias("labels"))
    docs = table(spark, d, "documents").select("doc_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("payload"))
    return docs.select("doc_id", canonical.identity_hash(F.col("payload"))["value"].alias("content_hash"))


def strict_json(spark: SparkSession, d: str) -> DataFrame:
    """Every delivered manifest line under the strict reader: how many lines end in which code."""
    x = table(spark, d, "manifest_raw").select(canonical.canonical_json(F.col("payload"))["code"].alias("code"))
    return x.groupBy("code").agg(F.count("*").alias("n_lines"))


def package_canonical_hash(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").select(uuid_text(uuid_key("package_id")).alias("package_id"), F.lit("2.0").alias("format_version"), uuid_text(uuid_key("claim_id")).alias("claim_id"), uuid_text(uuid_key("claim_instance_id")).alias("claim_instance_id"), F.coalesce(folded("hash"), F.lit("")).alias("hash"))
    return trust.package_hash(m.distinct())


def _digit(c: str) -> Column:
    """First four digits of a text's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.encode(F.col(c), "utf-8")), 1, 4), 16, 10).cast("int")


def _signed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages, their envelopes, and the signers. Signer 2's manifest has a wrong fingerprint, signer 4 has none, signer 5's key
    is no base64, signer 6 names another algorithm; some envelopes carry another digest, algorithm or signature."""
    secrets = {f"signer-{i}": f"secret {i}".encode().ljust(32, b".") for i in range(8)}
    curve = "signer-3"
    keys = {s: ed25519.public_key(k) if s == curve else k for s, k in secrets.items()}
    rows = [(s, "ed25519" if s in (curve, "signer-6") else "hmac-sha256", "no base64!" if s == "signer-5" else base64.b64encode(k).decode(), "0" * 64 if s == "signer-2" else trust.fingerprint(k)) for s, k in keys.items() if s != "signer-4"]
    signers = spark.createDataFrame(rows, "signer_id string, algorithm string, public_key_b64 string, key_fingerprint string")
    packages = package_canonical_hash(spark, d)

    @F.pandas_udf("string")
    def sign(digest: pd.Series, signer: pd.Series) -> pd.Series:
        one = lambda h, s: base64.b64encode(ed25519.sign(secrets[s], bytes.fromhex(h))).decode() if s == curve else trust.sign_hmac(secrets[s], h)
        return digest.combine(signer, one)

    x = packages.withColumns({"n": _digit("package_id"), "signer_id": F.concat(F.lit("signer-"), F.pmod(_digit("package_id"), F.lit(8)).cast("string"))})
    right = sign("package_hash", "signer_id")
    e = x.select(
        "package_id",
        "signer_id",
        F.when(F.col("n") % 9 == 0, "rot13").when(F.col("signer_id") == curve, "ed25519").otherwise("hmac-sha256").alias("algorithm"),
        F.lit("2031-01-01T00:00:00Z").alias("signed_at_iso"),
        F.when(F.col("n") % 7 == 0, F.sha2("package_hash", 256)).otherwise(F.col("package_hash")).alias("package_canonical_hash"),
        F.when(F.col("n") % 11 == 0, "*").when(F.col("n") % 5 == 0, sign(F.sha2("package_hash", 256), "signer_id")).otherwise(right).alias("signature_b64"),
    )
    return packages, e, signers


def hmac_verify(spark: SparkSession, d: str) -> DataFrame:
    packages, envelopes, signers = _signed(spark, d)
    return trust.verify_envelopes(envelopes, signers, packages)


def attestation_verify(spark: SparkSession, d: str) -> DataFrame:
    """Courts vouched for by the supreme courts' notary: (signer_id, notary_id, code). Keys are made of the courts' fields."""
    secret = b"notary".ljust(32, b".")
    c = table(spark, d, "courts").select("court_id", "court_name", "level", _digit("court_id").alias("n"))
    key = F.encode("court_name", "utf-8")
    signers = c.select(F.col("court_id").alias("signer_id"), F.lit("hmac-sha256").alias("algorithm"), F.base64(key).alias("public_key_b64"), F.sha2(key, 256).alias("key_fingerprint"))
    notaries = spark.createDataFrame([("n-3", "hmac-sha256", base64.b64encode(secret).decode(), trust.fingerprint(secret)), ("n-2", "ed25519", base64.b64encode(ed25519.public_key(secret)).decode(), trust.fingerprint(ed25519.public_key(secret)))], "signer_id string, algorithm string, public_key_b64 string, key_fingerprint string")
    a = c.select(F.col("court_id").alias("signer_id"), F.concat(F.lit("n-"), F.col("level").cast("string")).alias("notary_id"), F.when(F.col("n") % 5 == 0, F.upper(F.sha2(key, 256))).when(F.col("n") % 6 == 0, F.sha2(F.col("court_id"), 256)).otherwise(F.sha2(key, 256)).alias("key_fingerprint"), F.when(F.col("n") % 4 == 0, "hmac-sha256").when(F.col("level") == 2, "ed25519").otherwise("hmac-sha256").alias("algorithm"), "n")

    @F.pandas_udf("string")
    def sign(digest: pd.Series, algorithm: pd.Series) -> pd.Series:
        return digest.combine(algorithm, lambda h, x: base64.b64encode(ed25519.sign(secret, bytes.fromhex(h))).decode() if x == "ed25519" else trust.sign_hmac(secret, h))

    digest = trust.attestation_digest(F.col("signer_id"), F.col("notary_id"), F.col("key_fingerprint"))
    a = a.withColumn("signature_b64", sign(F.when(F.col("n") % 3 == 0, F.sha2(digest, 256)).otherwise(digest), F.col("algorithm")))
    return trust.verify_attestations(a.drop("n"), signers, notaries)


def signature_lines(spark: SparkSession, d: str) -> DataFrame:
    """Unsigned envelopes of every manifest delivery, merged with themselves, as the lines of each package's file."""
    m = table(spark, d, "manifest").select(uuid_text(uuid_key("package_id")).alias("package_id"), F.lit("hmac-sha256").alias("algorithm"), F.coalesce(F.col("hash"), F.lit("")).alias("package_canonical_hash"), F.lit("").alias("signature_b64"), F.coalesce("created_at", F.lit("")).alias("signed_at_iso"), F.coalesce("producer", F.lit("")).alias("signer_id"))
    m = m.filter("package_id IS NOT NULL")
    return trust.signature_lines(trust.merge_envelopes(m, m))


def signature_files(spark: SparkSession, d: str) -> DataFrame:
    """The code of each package's signature file, its lines being the package's entries as they arrived; null fields are left out."""
    m = table(spark, d, "manifest").select("package_id", "received_at", "claim_id", F.to_json(F.struct(F.lit("x").alias("algorithm"), F.col("hash").alias("package_canonical_hash"), F.lit("").alias("signature_b64"), F.col("created_at").alias("signed_at_iso"), F.col("license").alias("signer_id"))).alias("line"))
    files = m.groupBy(F.col("package_id").alias("key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("received_at", "claim_id", "line"))), lambda x: x["line"]), "\n").alias("content"))
    ended = F.concat("content", F.when(F.substring("key", -1, 1) == "0", "\n\n").otherwise("\n"))
    return trust.signature_file_codes(files.select("key", ended.alias("content"))).withColumnRenamed("key", "package_id")


def tar_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed into one archive per docket, or court and month where there is none, and read back."""
    docs = table(spark, d, "documents")
    month = F.concat_ws(" ", "court_id", F.date_format("decided_on", "yyyy-MM"))
    files = docs.select(F.coalesce("docket_no", month).alias("docket_no"), F.concat(F.lit("claims/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    back = pk.unpack(pk.pack(files, "docket_no").select(F.col("docket_no").alias("path"), F.col("archive").alias("content")))
    return back.select(F.col("path").alias("docket_no"), "member", F.sha2("content", 256).alias("digest"), "code")


def _changes(files: DataFrame, machine: Machine) -> DataFrame:
    kind = folded("event_type")
    c = files.select(uuid_text(uuid_key("claim_id")).alias("key"), instant_ms("timestamp").alias("ms"), uuid_text(uuid_key("event_id")).alias("id"), machine.code(kind).alias("code"), kind.alias("event_type"))
    return c.filter("key IS NOT NULL AND ms IS NOT NULL AND id IS NOT NULL").withColumn("at", F.timestamp_millis("ms"))


def _streamed(spark: SparkSession, rows: DataFrame) -> str:
    """Runs a stream until it has caught up, and gives the folder that it has written."""
    out = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = rows.writeStream.outputMode("append").option("checkpointLocation", f"{out}/log").option("path", f"{out}/data").format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{out}/data"


def stream_states(spark: SparkSession, d: str) -> DataFrame:
    """The provenance feed as a file stream: each claim's state once the stream has caught up. Claims with changes that came
    too late for the stream are replayed from the log."""
    src, machine = f"{d}/provenance.parquet", Machine()
    delivered = spark.read.parquet(src)
    states = stream.stream_states(_changes(_folder_stream(spark, src, delivered.schema), machine), machine)
    written = spark.read.schema(stream.STATES).parquet(_streamed(spark, states))
    late = stream.late_keys(written)
    last = written.join(late, "key", "left_anti").groupBy("key").agg(F.max_by("state", "n").alias("state"))
    again = _changes(delivered, machine).join(late, "key").dropDuplicates(["id"]).select(F.col("key").cast("binary").alias("key"), F.col("id").cast("binary").alias("id"), "ms", "code")
    folded_again = replay(again, machine).select(F.col("key").cast("string").alias("key"), "state")
    return last.unionByName(folded_again).select(F.col("key").alias("claim_id"), machine.name(F.col("state")).alias("state"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Changes per type and thirty days, each once, of the windows that the stream's watermark has passed."""
    src = f"{d}/provenance.parquet"
    counts = stream.windowed_counts(_changes(_folder_stream(spark, src, spark.read.parquet(src).schema), Machine()), "30 days")
    flat = counts.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")
    return spark.read.schema("day string, event_type string, n long").parquet(_streamed(spark, flat))


def _folder_stream(spark: SparkSession, src: str, schema) -> DataFrame:
    """File streams read folders; a local table that is one file is picked from its folder by name."""
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", os.path.basename(src)).parquet(os.path.dirname(src)) if os.path.isfile(src) else reader.parquet(src)


QUERIES = {f.__name__: f for f in (nfc_digest, identity_hash, strict_json, package_canonical_hash, hmac_verify, attestation_verify, signature_lines, signature_files, tar_roundtrip, stream_states, stream_windows)}
_J = lambda c: f"coalesce(CAST(to_json({c}) AS VARCHAR), 'null')"
ORACLE = {
    "nfc_digest": "SELECT doc_id, sha256(nfc_normalize(text)) AS digest FROM documents",
    "identity_hash": "SELECT doc_id, sha256('{\"author\":' || " + _J("court_id") + " || ',\"labels\":{\"a\":' || " + _J("court_id") + " || ',\"z\":' || " + _J("source") + " || '},\"locale\":' || " + _J("lang") + " || ',\"source\":' || " + _J("source") + " || ',\"subject\":' || " + _J("docket_no") + " || ',\"tags\":[' || array_to_string(list_transform(list_sort(list_filter([version_label, lang, source], lambda x: x IS NOT NULL)), lambda x: CAST(to_json(x) AS VARCHAR)), ',') || '],\"type\":\"decision\"}') AS content_hash FROM documents",
    "tar_roundtrip": "SELECT coalesce(docket_no, concat_ws(' ', court_id, strftime(decided_on, '%Y-%m'))) AS docket_no, 'claims/' || doc_id || '.md' AS member, sha256(coalesce(text, '')) AS digest, CAST(NULL AS VARCHAR) AS code FROM documents",
}


def _package_sql() -> str:
    return f"""WITH m AS (SELECT DISTINCT {_u('package_id')} AS p, '["' || {_u('claim_id')} || '","' || {_u('claim_instance_id')} || '","' || coalesce(lower(trim(hash)), '') || '"]' AS c FROM manifest)
 SELECT p AS package_id, sha256('["2.0","' || p || '",[' || string_agg(c, ',' ORDER BY c) || ']]' || chr(10)) AS package_hash FROM m GROUP BY 1"""


ORACLE["package_canonical_hash"] = _package_sql()
_N = lambda c: f"CAST('0x' || left(md5({c}), 4) AS INT)"
ORACLE["hmac_verify"] = f"""WITH x AS (SELECT package_id, {_N('package_id')} AS n FROM ({_package_sql()})) SELECT package_id, 'signer-' || n % 8 AS signer_id, CASE WHEN n % 8 = 4 THEN 'E_SIGNER_MISSING' WHEN n % 8 = 5 THEN 'E_SIGNER_MALFORMED' WHEN n % 8 = 2 THEN 'E_SIGNER_FINGERPRINT_MISMATCH'
 WHEN n % 7 = 0 THEN 'E_SIGNATURE_HASH_MISMATCH' WHEN n % 9 = 0 THEN 'E_SIGNER_ALGORITHM_UNKNOWN' WHEN n % 8 = 6 THEN 'E_SIGNER_ALGORITHM_MISMATCH' WHEN n % 11 = 0 THEN 'E_SIGNATURE_MALFORMED' WHEN n % 5 = 0 THEN 'E_SIGNATURE_INVALID' END AS code FROM x"""
ORACLE["attestation_verify"] = f"""WITH x AS (SELECT court_id, level, {_N('court_id')} AS n FROM courts) SELECT court_id AS signer_id, 'n-' || level AS notary_id, CASE WHEN n % 5 = 0 OR n % 6 = 0 OR level NOT IN (2, 3) THEN 'E_SIGNER_NOTARY_INVALID'
 WHEN (level = 2) = (n % 4 = 0) AND level = 2 THEN 'E_SIGNER_ALGORITHM_MISMATCH' WHEN n % 3 = 0 THEN 'E_SIGNATURE_INVALID' END AS code FROM x"""
ORACLE["signature_lines"] = f"""WITH m AS (SELECT DISTINCT {_u('package_id')} AS package_id, coalesce(producer, '') AS s, coalesce(created_at, '') AS t, coalesce(hash, '') AS h FROM manifest WHERE package_id IS NOT NULL),
 l AS (SELECT *, '{{"algorithm":"hmac-sha256","package_canonical_hash":' || CAST(to_json(h) AS VARCHAR) || ',"signature_b64":"","signed_at_iso":' || CAST(to_json(t) AS VARCHAR) || ',"signer_id":' || CAST(to_json(s) AS VARCHAR) || '}}' AS line FROM m)
 SELECT package_id, string_agg(line, chr(10) ORDER BY s, t, line) || chr(10) AS lines FROM l GROUP BY 1"""
ORACLE["signature_files"] = """WITH m AS (SELECT package_id, license AS s, created_at AS t, hash, row_number() OVER w AS n, lag(license) OVER w AS s0, lag(created_at) OVER w AS t0 FROM manifest
 WINDOW w AS (PARTITION BY package_id ORDER BY received_at, claim_id, to_json({'algorithm': 'x', 'h': hash, 's': created_at, 'l': license}))) SELECT package_id, CASE WHEN right(package_id, 1) = '0' OR bool_or(hash IS NULL OR t IS NULL OR s IS NULL) THEN 'E_SIGNATURE_MALFORMED' WHEN bool_or(n > 1 AND (s0 > s OR (s0 = s AND t0 > t))) THEN 'E_SIGNATURE_ORDER' END AS code FROM m GROUP BY 1"""
ORACLE["stream_states"] = f"""WITH {_EV}, s AS (SELECT claim_id, min((ms, event_id)) AS s FROM ev WHERE event_type IN ('create', 'publish') GROUP BY 1),
 t AS (SELECT ev.claim_id, min_by(event_type, (ms, event_id)) AS e FROM ev JOIN s USING (claim_id) WHERE event_type IN ('supersede', 'withdraw') AND (ms, event_id) > s GROUP BY 1)
 SELECT c.claim_id, CASE WHEN s.claim_id IS NULL THEN NULL WHEN e = 'supersede' THEN 'superseded' WHEN e = 'withdraw' THEN 'withdrawn' ELSE 'active' END AS state FROM (SELECT DISTINCT claim_id FROM ev) c LEFT JOIN s USING (claim_id) LEFT JOIN t USING (claim_id)"""
ORACLE["strict_json"] = """WITH x AS (SELECT raw_id, CASE WHEN NOT json_valid(payload) THEN 'PX_E_4006' WHEN EXISTS (SELECT 1 FROM json_tree(CASE WHEN json_valid(payload) THEN payload END) t WHERE t.type = 'DOUBLE') THEN 'PX_E_4008' END AS code FROM manifest_raw) SELECT code, count(*) AS n_lines FROM x GROUP BY 1"""
ORACLE["stream_windows"] = f"""WITH {_EV}, e AS (SELECT event_id, event_type, ms, ms // 2592000000 AS w FROM ev WHERE claim_id IS NOT NULL AND ms IS NOT NULL), m AS (SELECT max(ms) - 172800000 AS mark FROM e)
 SELECT strftime(epoch_ms(w * 2592000000), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM e, m WHERE (w + 1) * 2592000000 <= mark GROUP BY 1, 2"""
