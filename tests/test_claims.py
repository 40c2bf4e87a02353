import base64
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import canonical as cj
from ledgerloom.functions import ed25519
from ledgerloom.functions.text import bounded_by_words, squeezed, tokens
from ledgerloom.operators import claims, retrieval, trust, verification
from ledgerloom.sources import packages as pk


def events(spark, *kinds, bad=()):
    return spark.createDataFrame([("c", i, f"e{i}", k, i in bad) for i, k in enumerate(kinds)], "claim_id string, ms int, event_id string, event_type string, bad boolean")


@pytest.mark.parametrize(
    ("kinds", "state", "wrong"),
    [
        (["create"], "active", None),
        (["publish"], "active", None),
        (["create", "reaffirm", "revise"], "active", None),
        (["create", "supersede"], "superseded", None),
        (["create", "withdraw"], "withdrawn", None),
        (["revise"], None, "e0"),
        (["withdraw", "create"], None, "e0"),
        (["create", "create"], "active", "e1"),
        (["create", "revise", "publish"], "active", "e2"),
        (["create", "supersede", "reaffirm"], "superseded", "e2"),
        (["create", "withdraw", "withdraw"], "withdrawn", "e2"),
        (["create", "odd"], "active", "e1"),
        (["create", None], "active", "e1"),
    ],
)
def test_lifecycle(spark, kinds, state, wrong):
    assert [tuple(r) for r in claims.lifecycle(events(spark, *kinds).drop("bad")).collect()] == [("c", state, wrong, wrong and "PX_E_5101")]


def test_lifecycle_with_a_rule_of_its_own(spark):
    e = events(spark, "create", "reaffirm", "withdraw", bad={1})
    assert [tuple(r) for r in claims.lifecycle(e.select("claim_id", "ms", "event_id", "event_type", "bad"), F.col("bad")).collect()] == [("c", "active", "e1", "PX_E_5102")]
    e = events(spark, "create", "revise", bad={1}).withColumn("has_target", ~F.col("bad") & (F.col("event_type") != "create"))
    assert claims.lifecycle(e, claims.bad_target(F.col("event_type"), F.col("has_target"))).first()["code"] == "PX_E_5101"


CLAIM = "subject string, claim_id string, seq int, polarity string, created_at string, valid_from string, valid_until string, supersedes array<string>"


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("a", "affirm", "1", "2", "3", [])], ("not_found", None, 0)),
        ([("a", "affirm", "1", None, None, ["gone"])], ("none", "a", 1)),
        ([("a", None, "1", None, None, []), ("b", None, "2", None, None, ["a"])], ("supersession", "b", 1)),
        ([("a", None, "1", None, None, []), ("b", "negate", "2", None, None, [])], ("contradiction", None, 2)),
        ([("a", "unknown", "1", None, None, []), ("b", "negate", "2", None, None, [])], ("ambiguity", "b", 2)),
        ([("a", None, "1", None, None, ["b"]), ("b", None, "2", None, None, ["a"])], ("supersession", None, 0)),
        ([("b", None, "2", None, None, []), ("a", None, "2", None, None, []), ("0", None, None, None, None, [])], ("supersession", "a", 3)),
    ],
)
def test_conflicts(spark, rows, want):
    df = spark.createDataFrame([("s", r[0], i, *r[1:]) for i, r in enumerate(rows)], CLAIM)
    assert [tuple(r) for r in claims.resolve(df, F.lit("9")).collect()] == [("s", *want)]


def test_linking(spark):
    df = spark.createDataFrame([("q", "x", i, v, v) for i, v in enumerate("AABA")] + [("q", None, 9, "z", "z")], "scope string, subject string, seq int, body string, value string")
    got = {r["seq"]: (r["minted"], r["supersedes_seq"]) for r in claims.link(df).collect()}
    assert got == {0: (True, None), 1: (False, None), 2: (True, 0), 3: (True, 2), 9: (True, None)}


def test_text(spark):
    df = spark.createDataFrame([(" a\u00a0 b\n", "x-1 x1"), (None, None), ("", "é_x ²")], "a string, b string")
    rows = df.select(squeezed(F.col("a")), tokens(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("a b", ["x", "1", "x1"]), (None, []), ("", ["é_x", "²"])]
    df = spark.createDataFrame([("the red-car", "red"), ("hundred", "red"), (r"a \E b", r"\E"), ("x.y", "."), (None, "a")], "t string, v string")
    assert [r[0] for r in df.select(bounded_by_words(F.col("t"), F.col("v"))).collect()] == [True, False, True, False, None]


def test_retrieval(spark):
    docs = spark.createDataFrame([(3, "cat cat dog"), (1, "dog"), (2, None), (4, "cat")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "cat"), (2, "")], "query_id long, text string")
    got = [(r["query_id"], r["rank"], r["doc_id"]) for r in retrieval.bm25(docs, q, 3).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 4), (1, 2, 3), (1, 3, 1), (2, 1, 1), (2, 2, 2), (2, 3, 3)]
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 2)], "p string, l int")
    assert tuple(retrieval.cluster_pair_counts(rows, "p", "l").first())[:3] == (1, 2, 1)
    assert retrieval.sign_test(0, 0) == 1 and retrieval.sign_test(5, 0) == 0.0625
    assert retrieval.bootstrap_contrast(spark.createDataFrame([(1, 0, 1)] * 9, "id int, a int, b int")).first()["delta_pp"] == 100
    assert retrieval.bootstrap_contrast(spark.createDataFrame([], "id int, a int, b int")).first()["delta_pp"] is None


def test_strict_json():
    for text, code in (('{"a":1,}', "4006"), ("{", "4006"), ('{"a":1,"a":2}', "4007"), ('{"a":NaN}', "4009"), (b"\xff", "4010")):
        with pytest.raises(cj.Refused, match=code):
            cj.load_strict(text)
    with pytest.raises(cj.Refused, match="4008"):
        cj.canonical_text({"a": 1.5})
    assert cj.canonical_text({"b": 10**30, "a": "e\u0301"}) == '{"a":"é","b":1' + "0" * 30 + "}\n"
    assert cj.content_hash({"tags": ["b", "a"], "hash": "x"}) == cj.content_hash({"tags": ["a", "b"]}) != cj.content_hash({})
    assert cj.jcs_bytes({"\ufb33": 1, "\U0001f600": 2}).startswith('{"\U0001f600"'.encode())
    assert cj.three_places(0.0625) == "0.062"


def test_frontmatter():
    text = "confidence: 0.9\ntags:\n  - b\n  - 'a: 1'\nlabels:\n  k: 3\nsupersedes:\n  - y\n  - x\n  - x\n# note\nsubject: null\n"
    data = pk.parse_frontmatter(text)
    assert data["labels"] == {"k": 3} and data["subject"] is None and data["tags"] == ["b", "a: 1"]
    assert pk.emit_frontmatter(data) == 'confidence: 0.900\nlabels:\n  k: 3\nsubject: null\nsupersedes:\n  - x\n  - y\ntags:\n  - b\n  - "a: 1"\n'
    assert pk.split_document("---\na: 1\n---\nbody\n") == ("a: 1\n", "body\n")
    for bad in ("a: [1]", "a:", "a: 1\na: 2", "- x", "a:\n  b:\n    c: 1"):
        with pytest.raises(cj.Refused):
            pk.parse_frontmatter(bad)


def test_documents(spark):
    good = "---\nclaim_id: x\nconfidence: 0.500\ntags:\n  - a\n---\nbody\n"
    df = spark.createDataFrame([(1, good), (2, "no document"), (3, None), (4, good.replace("0.500", "0.5"))], "key int, text string")
    got = {r["key"]: r["d"] for r in df.select("key", pk.frontmatter(F.col("text")).alias("d")).collect()}
    assert {k: tuple(v) for k, v in got[1]["fields"].items()} == {"claim_id": ("string", "x"), "confidence": ("number", "0.500"), "tags": ("array", '["a"]')} and got[1]["body"] == "body\n"
    assert got[2]["code"] == "PX_E_4006" and got[3]["code"] is None and got[3]["fields"] is None
    c = {r["key"]: tuple(r["c"]) for r in df.select("key", pk.canonical_document(F.col("text")).alias("c")).collect()}
    assert c == {1: (good, False, None), 2: (None, None, "PX_E_4006"), 3: (None, None, None), 4: (good, True, None)}


def test_migration(spark):
    rows = [(1, {"format_version": "1.1", "extensions": {"old_v": "x"}, "old_v": "0.1", "k": 1}), (2, {"format_version": "1.0", "extensions": {"old_v": 1, "a": "é\"", "b": [1]}}), (3, {"format_version": "2.0"}), (4, [1]), (5, {"format_version": "1.0", "extensions": 7})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in rows] + [(6, "{"), (7, None)], "key int, text string")
    out = pk.migrated(df.select("key", cj.shape(F.col("text")).alias("doc")), "old_v", "spec_v", "0.4.0").collect()
    got = {r["key"]: (r["code"], r["fields"] and {k: v["text"] for k, v in r["fields"].items()}) for r in out}
    new = {"format_version": "2.0", "spec_v": "0.4.0"}
    assert got[1] == (None, {**new, "k": "1"}) and got[5] == (None, {**new, "extensions": "7"})
    assert got[2][1].keys() == {*new, "extensions"} and json.loads(got[2][1]["extensions"]) == {"a": "é\"", "b": [1]}
    assert [got[k][0] for k in (3, 4, 6)] == ["PX_E_3001", "PX_E_1001", "PX_E_4006"]


def test_archives(spark):
    a = pk.pack_members([("b", b"2"), ("a/", None), ("a/x", b"1")])
    assert a == pk.pack_members([("a/x", b"1"), ("b", b"2"), ("a/", None)])
    assert [m[2] for m in pk.members(a)] == ["a", "a/x", "b"]
    names = [("../x", "6001"), ("/x", "6002"), ("C:x", "6003"), ("a\\b", "6004"), ("", "6006"), ("é" * 600, "6005"), ("ok", None), ("a/..b", None)]
    df = spark.createDataFrame(names, "name string, code string")
    assert all(r[0] == (r[1] and f"PX_E_{r[1]}") for r in df.select(verification.path_code(F.col("name")), "code").collect())

    def packed(*items):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for name, kind, content in items:
                info = tarfile.TarInfo(name)
                info.type, info.size, info.linkname = kind, len(content), "/etc" if kind == tarfile.SYMTYPE else ""
                t.addfile(info, io.BytesIO(content))
        return bytearray(out.getvalue())

    file = tarfile.REGTYPE
    archives = {
        "good": bytearray(a),
        "link": packed(("a", file, b"1"), ("l", tarfile.SYMTYPE, b""), ("z", file, b"1")),
        "many": packed(*((f"f{i}", file, b"x") for i in range(6))),
        "junk": bytearray(b"junk" * 200),
        "twice": packed(("e\u0301", file, b""), ("é", file, b"")),
        "up": packed(("a/../../x", file, b"")),
        "big": packed(("a", file, b"1" * 300)),
        "total": packed(*((f"f{i}", file, b"x" * 180) for i in range(4))),
        "none": None,
    }
    df = spark.createDataFrame(list(archives.items()), "path string, content binary")
    found = pk.unpack(df, pk.Budget(files=5, file_bytes=200, total_bytes=600)).collect()
    assert {r["path"]: r["code"] for r in found if r["code"]} == {"link": "PX_E_6008", "many": "PX_E_6009", "junk": "PX_E_4006", "twice": "PX_E_6007", "up": "PX_E_6001", "big": "PX_E_6010", "total": "PX_E_6011"}
    assert sorted((r["path"], r["ordinal"]) for r in found if not r["code"]) == [("good", 0), ("good", 1), ("good", 2), ("link", 0), *(("many", i) for i in range(5)), ("total", 0), ("total", 1), ("total", 2), ("twice", 0)]
    assert all(r["content"] is None for r in found if r["code"])


def test_jsonl_lines_keep_their_numbers(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a":1}\n\n{"a":2}\n')
    assert [(r["line_no"], r["line"]) for r in pk.read_jsonl(spark, str(tmp_path)).orderBy("line_no").collect()] == [(1, '{"a":1}'), (3, '{"a":2}')]


def test_signatures(spark):
    key, digest, seed = b"k", "ab" * 32, bytes(32)
    b64 = lambda x: base64.b64encode(x).decode()
    curve = ed25519.public_key(seed)
    ok = {"signer_id": "s", "algorithm": "hmac-sha256", "package_canonical_hash": digest, "signature_b64": trust.sign_hmac(key, digest), "s_id": "s", "s_algorithm": "hmac-sha256", "s_key": b64(key), "s_fingerprint": trust.fingerprint(key)}
    on_curve = {"algorithm": "ed25519", "s_algorithm": "ed25519", "s_key": b64(curve), "s_fingerprint": trust.fingerprint(curve), "signature_b64": b64(ed25519.sign(seed, bytes.fromhex(digest)))}
    cases = [
        ({}, None),
        (on_curve, None),
        (on_curve | {"signature_b64": b64(bytes(64))}, "E_SIGNATURE_INVALID"),
        (on_curve | {"s_key": b64(b"short"), "s_fingerprint": trust.fingerprint(b"short")}, "E_SIGNER_MALFORMED"),
        ({"s_id": "other", "algorithm": "rot13"}, "E_SIGNER_MISSING"),
        ({"s_key": "!", "s_fingerprint": "0"}, "E_SIGNER_MALFORMED"),
        ({"s_fingerprint": "0" * 64, "package_canonical_hash": "x"}, "E_SIGNER_FINGERPRINT_MISMATCH"),
        ({"package_canonical_hash": "cd" * 32, "algorithm": "rot13"}, "E_SIGNATURE_HASH_MISMATCH"),
        ({"package_canonical_hash": None}, "E_SIGNATURE_HASH_MISMATCH"),
        ({"algorithm": "rot13"}, "E_SIGNER_ALGORITHM_UNKNOWN"),
        ({"s_algorithm": "ed25519", "signature_b64": "!"}, "E_SIGNER_ALGORITHM_MISMATCH"),
        ({"signature_b64": "!"}, "E_SIGNATURE_MALFORMED"),
        ({"signature_b64": trust.sign_hmac(b"other", digest)}, "E_SIGNATURE_INVALID"),
    ]
    rows = [{**ok, **change} for change, _ in cases]
    e = spark.createDataFrame([(f"p{i}", f"{r['signer_id']}{i}", r["algorithm"], "t", r["package_canonical_hash"], r["signature_b64"]) for i, r in enumerate(rows)], "package_id string, signer_id string, algorithm string, signed_at_iso string, package_canonical_hash string, signature_b64 string")
    s = spark.createDataFrame([(f"{r['s_id']}{i}", r["s_algorithm"], r["s_key"], r["s_fingerprint"]) for i, r in enumerate(rows)], "signer_id string, algorithm string, public_key_b64 string, key_fingerprint string")
    p = spark.createDataFrame([(f"p{i}", digest) for i in range(len(rows))], "package_id string, package_hash string")
    got = {r["package_id"]: r["code"] for r in trust.verify_envelopes(e, s, p).collect()}
    assert got == {f"p{i}": code for i, (_, code) in enumerate(cases)}


def test_curve():
    # the second test vector of RFC 8032
    seed, key = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb"), bytes.fromhex("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c")
    signature = bytes.fromhex("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00")
    assert ed25519.public_key(seed) == key and ed25519.sign(seed, b"\x72") == signature and ed25519.verify(key, b"\x72", signature)
    assert not ed25519.verify(key, b"\x73", signature) and not ed25519.verify(b"", b"\x72", signature) and not ed25519.verify(key, b"\x72", b"\xff" * 64)


def test_signature_files(spark):
    one = lambda s, t: json.dumps({"algorithm": "a", "package_canonical_hash": "h", "signature_b64": "", "signed_at_iso": t, "signer_id": s})
    files = {"good": f"{one('a', '1')}\n{one('a', '2')}\n{one('b', '0')}\n", "turned": f"{one('b', '1')}\n{one('a', '2')}\n", "open": one("a", "1"), "blank": one("a", "1") + "\n\n", "more": '{"signer_id": "a"}\n', "kind": one("a", "1").replace('"h"', "1") + "\n", "empty": "", "none": None}
    got = {r["key"]: r["code"] for r in trust.signature_file_codes(spark.createDataFrame(list(files.items()), "key string, content string")).collect()}
    bad = "E_SIGNATURE_MALFORMED"
    assert got == {"good": None, "turned": "E_SIGNATURE_ORDER", "open": bad, "blank": bad, "more": bad, "kind": bad, "empty": bad}
    m = spark.createDataFrame([("s", '{"signer_id": "s", "algorithm": "a", "public_key_b64": "k", "key_fingerprint": "f"}'), ("t", "{}"), ("u", "[1]")], "name string, content string")
    assert {r["name"]: (r["signer_id"], r["code"]) for r in trust.read_signers(m).collect()} == {"s": ("s", None), "t": (None, "E_SIGNER_MALFORMED"), "u": (None, "E_SIGNER_MALFORMED")}
    envelopes = spark.createDataFrame([("a", "verified-locally"), ("b", "verified-by-notary")], "key string, attestation string")
    asked = verification.signature_requirements(spark.createDataFrame([("a",), ("b",), ("c",)], "key string"), envelopes, True, True)
    assert {tuple(r) for r in asked.collect()} == {("c", "E_SIGNER_REQUIRED"), ("a", "E_SIGNER_NOTARY_REQUIRED")}
