"""Packages as archives, each with a fault or two, against the code at which a reader stops."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ed25519
from ledgerloom.operators import packages, trust
from ledgerloom.operators import verification as v
from ledgerloom.sources import packages as pk

U = "01930002-0000-7000-8000-0000000000"
BODY = b"---\nclaim_id: x\n---\nbody\n"


def sha(x):
    return hashlib.sha256(x).hexdigest()


def entry(i):
    return {"claim_id": f"{U}{i:02d}", "claim_instance_id": f"{U}5{i}", "hash": sha(BODY), "path": f"claims/{U}{i:02d}.md", "state": "active"}


def event(i, kind, line, **more):
    base = {"event_id": f"{U}9{line}", "event_type": kind, "timestamp": f"2031-01-01T00:00:0{line}Z", "actor": "a", "claim_id": f"{U}{i:02d}"}
    if kind in ("create", "revise", "supersede"):
        base["claim_instance_id"] = f"{U}5{i}"
    if kind not in ("create", "publish"):
        base |= {"prev_event_id": f"{U}9{line - 1}", "target_claim_instance_id": f"{U}5{i}"}
    return base | more


def package(claims=(1, 2), events=None, manifest=None, files=None, drop=(), raw=None):
    m = {"package_id": U + "00", "format_version": "2.0", "created_at": "2031-01-01T00:00:00Z", "producer": "p", "license": "l", "provenance_path": "provenance.jsonl", "claims": [entry(i) for i in claims]} | (manifest or {})
    events = [event(1, "create", 0), event(1, "revise", 1), event(2, "create", 2)] if events is None else events
    out = {"manifest.json": json.dumps(m).encode(), "provenance.jsonl": "".join(json.dumps(x) + "\n" for x in events).encode(), "claims": None}
    out |= {f"claims/{U}{i:02d}.md": BODY for i in claims} | (files or {}) | (raw or {})
    return pk.pack_members([(k, x) for k, x in out.items() if k not in drop])


def canonical_hash(claims=(1, 2)):
    rows = sorted([c["claim_id"], c["claim_instance_id"], c["hash"]] for c in map(entry, claims))
    return sha((json.dumps(["2.0", U + "00", rows], separators=(",", ":")) + "\n").encode())


def signed(signer="s", algorithm="hmac-sha256", key=b"secret", digest=None, sign=None, manifest=None, text=None):
    digest = digest or canonical_hash()
    public = ed25519.public_key(key) if algorithm == "ed25519" else key
    s = sign or (base64.b64encode(ed25519.sign(key, bytes.fromhex(digest))).decode() if algorithm == "ed25519" else trust.sign_hmac(key, digest))
    line = json.dumps({"algorithm": algorithm, "package_canonical_hash": digest, "signature_b64": s, "signed_at_iso": "t", "signer_id": signer}) + "\n"
    m = {"signer_id": signer, "algorithm": algorithm, "public_key_b64": base64.b64encode(public).decode(), "key_fingerprint": sha(public)} | (manifest or {})
    return {"signatures.jsonl": (text or line).encode(), "signers/s.json": json.dumps(m).encode()}


CASES = {
    "good": (package(), None),
    "empty": (package(claims=(), events=[]), None),
    "extensions": (package(manifest={"extensions": {"x": [1.5]}, "notice_path": "NOTICE"}, files={"NOTICE": b"n"}), None),
    "no archive": (b"junk" * 300, "PX_E_4006"),
    "unsafe": (package(raw={"../x": b""}, drop=("manifest.json",)), "PX_E_6001"),
    "no manifest": (package(drop=("manifest.json",)), "PX_E_2005"),
    "no log": (package(drop=("provenance.jsonl",)), "PX_E_2005"),
    "comma": (package(raw={"manifest.json": b'{"a": 1,}', "provenance.jsonl": b"{"}), "PX_E_4006"),
    "twice": (package(raw={"manifest.json": b'{"a": 1, "a": 2}'}), "PX_E_4007"),
    "nan": (package(raw={"manifest.json": b'{"a": NaN}'}), "PX_E_4009"),
    "bytes": (package(raw={"manifest.json": b'{"a": "\xff"}'}), "PX_E_4010"),
    "line": (package(raw={"provenance.jsonl": b'\n{"a"\n'}, manifest={"license": ""}), "PX_E_4006"),
    "version": (package(manifest={"format_version": "9.9", "license": ""}), "PX_E_3003"),
    "producer": (package(manifest={"producer": ""}, events=[{}]), "PX_E_2003"),
    "extra field": (package(manifest={"more": 1}), "PX_E_2002"),
    "event": (package(events=[event(1, "create", 0, prev_event_id="x"), event(2, "revise", 1)]), "PX_E_2004"),
    "first": (package(events=[event(1, "revise", 1), event(2, "create", 2)]), "PX_E_5101"),
    "target": (package(events=[event(1, "create", 0), {k: x for k, x in event(1, "reaffirm", 1).items() if k != "target_claim_instance_id"}], files={f"claims/{U}01.md": b"other"}), "PX_E_5102"),
    "tampered": (package(files={f"claims/{U}01.md": b"other"}), "PX_E_5001"),
    "lost file": (package(drop=(f"claims/{U}01.md",), files={f"claims/{U}02.md": b"other"}), "PX_E_5002"),
    "extra file": (package(files={"claims/more.md": b"x"}), "PX_E_5002"),
    "dangling": (package(events=[event(1, "create", 0), event(1, "revise", 2), event(2, "create", 3)]), "PX_E_5003"),
    "fork": (package(events=[event(1, "create", 0), event(1, "revise", 1), event(1, "revise", 2, prev_event_id=f"{U}90"), event(2, "create", 3)]), "PX_E_5003"),
    "published": (package(events=[event(1, "create", 0), event(2, "publish", 2, prev_event_id=f"{U}91")]), "PX_E_5003"),
    "unknown claim": (package(claims=(1,), events=[event(1, "create", 0), event(3, "create", 1)]), "PX_E_5004"),
    "signed": (package(files=signed()), None),
    "signed on the curve": (package(files=signed(algorithm="ed25519", key=bytes(32))), None),
    "no line feed": (package(files=signed(text="{}")), "E_SIGNATURE_MALFORMED"),
    "no signer": (package(files=signed(signer="t")), "E_SIGNER_MISSING"),
    "signer's field": (package(files=signed(manifest={"public_key_b64": "!"})), "E_SIGNER_MALFORMED"),
    "fingerprint": (package(files=signed(manifest={"key_fingerprint": "0" * 64}, digest="ab" * 32)), "E_SIGNER_FINGERPRINT_MISMATCH"),
    "digest": (package(files=signed(digest="ab" * 32, algorithm="hmac-sha256")), "E_SIGNATURE_HASH_MISMATCH"),
    "algorithm": (package(files=signed(algorithm="rot13")), "E_SIGNER_ALGORITHM_UNKNOWN"),
    "signature": (package(files=signed(sign=trust.sign_hmac(b"other", canonical_hash()))), "E_SIGNATURE_INVALID"),
    "tampered and signed": (package(files=signed(sign="") | {f"claims/{U}01.md": b"other"}), "PX_E_5001"),
    "null": (None, None),
}


def test_archives(spark):
    df = spark.createDataFrame([(k, x and bytearray(x), 1) for k, (x, _) in CASES.items()], "path string, content binary, code int")
    got = {r["path"]: r["code"] for r in packages.verify_archives(df, "spec_v").collect()}
    assert got == {k: code for k, (_, code) in CASES.items()}
    asked = {r["path"]: r["code"] for r in packages.verify_archives(df.filter("path IN ('good', 'signed', 'tampered')"), "spec_v", signed=True).collect()}
    assert asked == {"good": "E_SIGNER_REQUIRED", "signed": None, "tampered": "PX_E_5001"}
    asked = {r["path"]: r["code"] for r in packages.verify_archives(df.filter("path IN ('good', 'signed')"), "spec_v", notarised=True).collect()}
    assert asked == {"good": None, "signed": "E_SIGNER_NOTARY_REQUIRED"}


def test_external_verdict(spark):
    e = spark.createDataFrame([("a", "1", 1, "x", "create"), ("b", "1", 1, "x", "revise"), ("d", "9", 1, "x", "publish")], "key string, claim_id string, ms int, event_id string, event_type string")
    c = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "9")], "key string, claim_id string")
    assert {tuple(r) for r in v.external_verdict(e, c).collect()} == {("a", "valid"), ("b", "invalid"), ("c", "invalid"), ("d", "valid")}


@pytest.mark.parametrize("n", [0, 3])
def test_packing_is_canonical(spark, n):
    rows = [("p", f"f{i}", bytearray(str(i).encode())) for i in range(n)]
    got = [bytes(r["archive"]) for r in pk.pack(spark.createDataFrame(rows, "package string, path string, content binary").orderBy(F.rand(1))).collect()]
    assert got == ([pk.pack_members([(p, bytes(c)) for _, p, c in rows])] if n else [])


def test_sources_are_packed_and_signed(spark):
    """Digests are computed anew, documents are canonical, and what was packed and signed passes verification."""
    source = {f"claims/{U}01.md": BODY, "manifest.json": json.dumps({**json.loads(dict((m[2], m[5]) for m in pk.members(package(claims=(1,))))["manifest.json"]), "claims": [entry(1) | {"hash": "0" * 64}]}, indent=2).encode(), "provenance.jsonl": b"\n" + json.dumps(event(1, "create", 0), indent=None).encode(), "more.txt": b"left out"}
    rows = [("p", k, bytearray(x)) for k, x in source.items()] + [("lost", k, bytearray(x)) for k, x in source.items() if "claims" not in k] + [("none", "more.txt", bytearray(b""))]
    packed = {r["package"]: r for r in pk.pack_sources(spark.createDataFrame(rows, "package string, path string, content binary")).collect()}
    assert {k: r["code"] for k, r in packed.items()} == {"p": None, "lost": "PX_E_5002", "none": "PX_E_2005"}
    members = {m[2]: m[5] for m in pk.members(bytes(packed["p"]["archive"]))}
    assert set(members) == {f"claims/{U}01.md", "manifest.json", "provenance.jsonl"} and json.loads(members["manifest.json"])["claims"][0]["hash"] == sha(BODY) and members["manifest.json"].endswith(b"}\n")
    digest = canonical_hash((1,))
    for algorithm, key in (("hmac-sha256", b"k"), ("ed25519", bytes(32))):
        e = trust.sign_packages(spark.createDataFrame([("p", digest)], "package_id string, package_hash string"), "s", algorithm, key, "t")
        lines = trust.signature_lines(e).first()["lines"]
        whole = pk.pack_members([*members.items(), ("signatures.jsonl", lines.encode()), ("signers/s.json", signed(algorithm=algorithm, key=key)["signers/s.json"])])
        df = spark.createDataFrame([("p", bytearray(whole))], "path string, content binary")
        assert [r["code"] for r in packages.verify_archives(df, "spec_v", signed=True).collect()] == [None]


def test_archive_diffs(spark):
    frame = lambda x: spark.createDataFrame([("p", bytearray(x)), ("q", bytearray(package()))], "path string, content binary")
    claims = [entry(1) | {"state": "withdrawn", "tags": ["b"]}, entry(3)]
    events = [event(2, "create", 2), event(1, "create", 0), event(1, "withdraw", 3)]
    b = package(manifest={"license": "m", "notice_path": "NOTICE", "created_at": "2032-01-01T00:00:00Z", "claims": claims}, events=events, files={f"claims/{U}03.md": BODY})
    got = sorted(tuple(r) for r in packages.diff_archives(frame(package()), frame(b)).collect())
    one, two, three = (f"{U}0{i}" for i in (1, 2, 3))
    assert got == [
        ("p", "claims", "added", three),
        ("p", "claims", "changed", one),
        ("p", "claims", "removed", two),
        ("p", "evidence", "state", one),
        ("p", "evidence", "tags", one),
        ("p", "log", "added", f"{U}93"),
        ("p", "log", "removed", f"{U}91"),
        ("p", "log", "reordered", f"{U}90"),
        ("p", "log", "reordered", f"{U}92"),
        ("p", "manifest", "added", "notice_path"),
        ("p", "manifest", "changed", "license"),
    ]
