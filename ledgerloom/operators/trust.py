"""Signatures over packages and attestations over signers. Each chain of rules gives the code of the first rule broken, or null.

Envelopes meet signers and packages in joins, and the rules are built-in expressions; only signatures that have passed all other
rules go to Python, in Arrow batches, for the keyed hash (hmac-sha256) or the curve (ed25519).

Base64 is read strictly: text that is no whole base64 is malformed. Null fields are malformed or missing, never a crash.
"""

from __future__ import annotations

import base64
import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ed25519

ALGORITHMS = ("hmac-sha256", "ed25519")


def package_hash(claims: DataFrame) -> DataFrame:
    """(package_id, package_hash): SHA-256 of the canonical JSON [format_version, package_id, sorted claims].

    claims (package_id, format_version, claim_id, claim_instance_id, hash), as text without characters that JSON escapes. The
    digest runs over the whole sorted list, so a package is limited to what one row holds (2 GB, ten million claims).
    """
    one = F.concat(F.lit('["'), F.concat_ws('","', "claim_id", "claim_instance_id", "hash"), F.lit('"]'))
    g = claims.groupBy("package_id", "format_version").agg(F.array_sort(F.collect_list(one)).alias("cs"))
    body = F.concat(F.lit('["'), "format_version", F.lit('","'), "package_id", F.lit('",['), F.array_join("cs", ","), F.lit("]]\n"))
    return g.select("package_id", F.sha2(F.encode(body, "utf-8"), 256).alias("package_hash"))


def fingerprint(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()


def sign_hmac(key: bytes, digest_hex: str) -> str:
    return base64.b64encode(hmac.new(key, bytes.fromhex(digest_hex), hashlib.sha256).digest()).decode()


def _signature_code(key: bytes, digest_hex: str, signature: bytes, algorithm: str) -> str | None:
    message = bytes.fromhex(digest_hex)
    if algorithm == "ed25519":
        if ed25519.point(key) is None:
            return "E_SIGNER_MALFORMED"
        return None if ed25519.verify(key, message, signature) else "E_SIGNATURE_INVALID"
    return None if hmac.compare_digest(signature, hmac.new(key, message, hashlib.sha256).digest()) else "E_SIGNATURE_INVALID"


def _signed(passed: Column, key: Column, digest_hex: Column, signature: Column, algorithm: Column) -> Column:
    """Code of signatures where ``passed``; null elsewhere."""

    @F.pandas_udf("string")
    def run(k: pd.Series, d: pd.Series, s: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _signature_code(x, y, z, w) for x, y, z, w in zip(k, d, s, a)], dtype=object)

    return run(F.when(passed, key), digest_hex, signature, algorithm)


def _first(rules: list[tuple[str, Column]]) -> Column:
    """Code of the first rule broken; a null condition breaks its rule."""
    out = F.lit(None).cast("string")
    for code, bad in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(True)), code).otherwise(out)
    return out


def is_digest(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def _base64(c: Column) -> Column:
    return F.try_to_binary(c, F.lit("base64"))


def attestation_digest(signer_id: Column, notary_id: Column, key_fingerprint: Column) -> Column:
    """SHA-256 of the canonical JSON object that a notary signs."""
    text = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"^\{\"x\":(.*)\}$", 1)
    body = F.concat(F.lit('{"key_fingerprint":'), text(key_fingerprint), F.lit(',"notary_id":'), text(notary_id), F.lit(',"signer_id":'), text(signer_id), F.lit("}\n"))
    return F.sha2(F.encode(body, "utf-8"), 256)


def _signers(signers: DataFrame, p: str, key: str) -> DataFrame:
    cols = {"signer": "signer_id", "algorithm": "algorithm", "key": "public_key_b64", "fingerprint": "key_fingerprint"}
    return signers.select(F.col("signer_id").alias(key), *(F.col(c).alias(f"{p}_{k}") for k, c in cols.items()))


def verify_envelopes(envelopes: DataFrame, signers: DataFrame, packages: DataFrame, *more: str) -> DataFrame:
    """(package_id, signer_id, more, code) of envelopes (package_id, signer_id, algorithm, signed_at_iso, package_canonical_hash,
    signature_b64) against signer manifests and package hashes."""
    j = envelopes.join(_signers(signers, "s", "signer_id"), "signer_id", "left").join(packages, "package_id", "left")
    c = F.col
    key, given = _base64(c("s_key")), _base64(c("signature_b64"))
    plain = _first([
        ("E_SIGNER_MISSING", c("s_signer").isNull()),
        ("E_SIGNER_MALFORMED", key.isNull()),
        ("E_SIGNER_FINGERPRINT_MISMATCH", F.sha2(key, 256) != c("s_fingerprint")),
        ("E_SIGNATURE_HASH_MISMATCH", c("package_canonical_hash") != c("package_hash")),
        ("E_SIGNER_ALGORITHM_UNKNOWN", ~c("algorithm").isin(*ALGORITHMS)),
        ("E_SIGNER_ALGORITHM_MISMATCH", c("algorithm") != c("s_algorithm")),
        ("E_SIGNATURE_MALFORMED", given.isNull()),
    ])
    return j.select("package_id", "signer_id", *more, F.coalesce(plain, _signed(plain.isNull(), key, c("package_hash"), given, c("algorithm"))).alias("code"))


def verify_attestations(attestations: DataFrame, signers: DataFrame, notaries: DataFrame) -> DataFrame:
    """(signer_id, notary_id, code) of attestations (notary_id, signer_id, key_fingerprint, algorithm, signature_b64)."""
    j = attestations.join(_signers(signers, "s", "signer_id"), "signer_id", "left").join(_signers(notaries, "n", "notary_id"), "notary_id", "left")
    c = F.col
    key, given = _base64(c("n_key")), _base64(c("signature_b64"))
    plain = _first([
        ("E_SIGNER_NOTARY_INVALID", c("s_signer").isNull()),
        ("E_SIGNER_NOTARY_INVALID", ~is_digest(c("key_fingerprint"))),
        ("E_SIGNER_NOTARY_INVALID", c("key_fingerprint") != c("s_fingerprint")),
        ("E_SIGNER_NOTARY_INVALID", c("n_signer").isNull()),
        ("E_SIGNER_ALGORITHM_UNKNOWN", ~c("algorithm").isin(*ALGORITHMS)),
        ("E_SIGNER_ALGORITHM_MISMATCH", c("algorithm") != c("n_algorithm")),
        ("E_SIGNER_MALFORMED", key.isNull()),
        ("E_SIGNER_FINGERPRINT_MISMATCH", ~is_digest(c("n_fingerprint"))),
        ("E_SIGNER_FINGERPRINT_MISMATCH", F.sha2(key, 256) != c("n_fingerprint")),
        ("E_SIGNATURE_MALFORMED", given.isNull()),
    ])
    digest = attestation_digest(c("signer_id"), c("notary_id"), c("key_fingerprint"))
    return j.select("signer_id", "notary_id", F.coalesce(plain, _signed(plain.isNull(), key, digest, given, c("algorithm"))).alias("code"))


def acceptable(attestation: Column, notarised: bool) -> Column:
    """Whether an attestation meets a caller's demand for a notary; without the demand any does."""
    return F.coalesce(attestation == "verified-by-notary", F.lit(False)) if notarised else F.lit(True)


# The fields of one line.
ENVELOPE = ("algorithm", "package_canonical_hash", "signature_b64", "signed_at_iso", "signer_id")
ATTESTATION = ("algorithm", "key_fingerprint", "notary_id", "signature_b64", "signed_at_iso", "signer_id")


def parsed_line(line: Column, fields: tuple[str, ...]) -> Column:
    """struct<code, the fields> of a JSON line that must be an object with exactly these fields, all of them strings."""
    from ..functions import canonical

    doc = canonical.shape(line)
    keys = F.array_sort(F.map_keys(doc["fields"]))
    good = (doc["kind"] == "object") & (keys == F.array(*map(F.lit, sorted(fields)))) & F.forall(F.map_values(doc["fields"]), lambda p: p["kind"] == "string")
    value = lambda f: F.try_element_at(doc["fields"], F.lit(f))["text"].alias(f)
    return F.struct(F.when(~F.coalesce(good, F.lit(False)), "E_SIGNATURE_MALFORMED").alias("code"), *map(value, fields))


def read_signatures(files: DataFrame) -> DataFrame:
    """(key, line, code, the fields of ENVELOPE) of signature files (key, content): one row per line.

    A file must end in one line feed; else, and for a line that is no envelope, the code is E_SIGNATURE_MALFORMED. A line that
    sorts before the one above it, by signer and time, is E_SIGNATURE_ORDER.
    """
    ends = F.endswith("content", F.lit("\n")) & ~F.endswith("content", F.lit("\n\n"))
    bare = F.when(ends, F.expr("left(content, char_length(content) - 1)"))
    lines = files.filter("content IS NOT NULL").select("key", F.posexplode(F.split(F.coalesce(bare, F.lit("")), "\n")).alias("i", "text"))
    e = lines.select("key", (F.col("i") + 1).alias("line"), parsed_line(F.col("text"), ENVELOPE).alias("e")).select("key", "line", "e.*")
    w = Window.partitionBy("key").orderBy("line")  # the lines of one file
    own = F.struct("signer_id", "signed_at_iso")
    return e.withColumn("code", F.coalesce("code", F.when(F.lag(own).over(w) > own, "E_SIGNATURE_ORDER")))


def signature_file_codes(files: DataFrame) -> DataFrame:
    """(key, code): what a reader of the file reports, a malformed line before any line out of order; null for a good file."""
    return read_signatures(files).groupBy("key").agg(F.coalesce(F.max(F.when(F.col("code") == "E_SIGNATURE_MALFORMED", F.col("code"))), F.max("code")).alias("code"))


def read_signers(files: DataFrame) -> DataFrame:
    """(signer_id, algorithm, public_key_b64, key_fingerprint, notary_uri, code) of signer manifests (name, content)."""
    from ..functions import canonical

    s = files.select("name", canonical.shape(F.col("content")).alias("doc"))
    value = lambda f: F.try_element_at(F.col("doc.fields"), F.lit(f))["text"]
    needed = ("signer_id", "algorithm", "public_key_b64", "key_fingerprint")
    have = F.forall(F.array(*map(F.lit, needed)), lambda f: F.map_contains_key(F.col("doc.fields"), f))
    return s.select("name", *(value(f).alias(f) for f in (*needed, "notary_uri")), F.when(~F.coalesce((F.col("doc.kind") == "object") & have, F.lit(False)), "E_SIGNER_MALFORMED").alias("code"))


def sign_packages(packages: DataFrame, signer_id: str, algorithm: str, secret: bytes, signed_at_iso: str) -> DataFrame:
    """Envelopes of packages (package_id, package_hash) by one signer, whose secret travels with the tasks."""

    @F.pandas_udf("string")
    def run(digests: pd.Series) -> pd.Series:
        one = lambda h: base64.b64encode(ed25519.sign(secret, bytes.fromhex(h))).decode() if algorithm == "ed25519" else sign_hmac(secret, h)
        return digests.map(lambda h: None if h is None else one(h))

    return packages.select("package_id", F.lit(signer_id).alias("signer_id"), F.lit(algorithm).alias("algorithm"), F.lit(signed_at_iso).alias("signed_at_iso"), F.col("package_hash").alias("package_canonical_hash"), run("package_hash").alias("signature_b64"))


def merge_envelopes(have: DataFrame, new: DataFrame) -> DataFrame:
    """The envelopes of both, each once; ``signature_lines`` puts them in order."""
    return have.unionByName(new).distinct()


def signature_lines(envelopes: DataFrame) -> DataFrame:
    """(package_id, lines): a package's envelopes as JSON lines, by signer and time; an envelope delivered again counts once."""
    fields = ["algorithm", "package_canonical_hash", "signature_b64", "signed_at_iso", "signer_id"]
    line = F.struct("signer_id", "signed_at_iso", F.to_json(F.struct(*fields)).alias("line"))
    g = envelopes.groupBy("package_id").agg(F.array_sort(F.collect_set(line)).alias("x"))
    return g.select("package_id", F.concat(F.array_join(F.transform("x", lambda e: e["line"]), "\n"), F.lit("\n")).alias("lines"))
