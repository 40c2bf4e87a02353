import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import canonical
from ledgerloom.operators import verification as v
from ledgerloom.sources import packages as pk

U = "01930002-0000-7000-8000-00000000000"
CLAIM = {"claim_id": U + "1", "claim_instance_id": U + "2", "hash": "a" * 64, "path": f"claims/{U}1.md", "state": "active"}
MANIFEST = {"package_id": U + "0", "format_version": "2.0", "created_at": "2031-01-01T00:00:00Z", "producer": "p", "license": "l", "provenance_path": "provenance.jsonl", "claims": [CLAIM]}
EVENT = {"event_id": U + "5", "event_type": "create", "timestamp": "2031-01-01T00:00:00.123Z", "actor": "a", "claim_id": U + "1", "claim_instance_id": U + "2"}
LATER = EVENT | {"event_type": "revise", "prev_event_id": U + "4", "target_claim_instance_id": U + "2"}


def without(d, *keys):
    return {k: x for k, x in d.items() if k not in keys}


def first(spark, cases, run):
    df = spark.createDataFrame([(i, x if isinstance(x, str) or x is None else json.dumps(x), 1) for i, (x, _) in enumerate(cases)], "key int, text string, line int")
    got = {r["key"]: r["code"] for r in v.first_broken(run(df.select("key", "line", canonical.shape(F.col("text")).alias("doc")))).collect()}
    assert {i: got.get(i) for i in range(len(cases))} == {i: code and f"PX_E_{code}" for i, (_, code) in enumerate(cases)}


def claims(*entries):
    return MANIFEST | {"claims": list(entries)}


def test_manifests(spark):
    """Two faults each where one must come first."""
    cases = [
        (MANIFEST, None),
        (MANIFEST | {"spec_v": "0.4.0-rc.1", "exchange_profile_version": "1.0.0", "notice_path": "NOTICE", "extensions": {"any": 1.5}, "claims": []}, None),
        (None, None),
        ("[1]", "1001"),
        ('{"a": 1,}', "4006"),
        ('{"a": 1, "a": 2}', "4007"),
        ('{"a": NaN}', "4009"),
        (without(MANIFEST, "license") | {"more": 1}, "2001"),
        (MANIFEST | {"more": 1, "format_version": "9.0"}, "2002"),
        (MANIFEST | {"format_version": 2, "license": ""}, "1001"),
        (MANIFEST | {"format_version": "2.1", "license": ""}, "3001"),
        (MANIFEST | {"format_version": "1.0", "license": ""}, "3003"),
        (MANIFEST | {"license": "", "producer": 1}, "2003"),
        (MANIFEST | {"producer": "", "package_id": "x"}, "2003"),
        (MANIFEST | {"package_id": "X", "created_at": 1}, "4001"),
        (MANIFEST | {"created_at": "2031-01-01T00:00:00.12Z", "provenance_path": "x"}, "4001"),
        (MANIFEST | {"provenance_path": "log.jsonl", "claims": {}}, "4003"),
        (MANIFEST | {"claims": {}, "notice_path": 1}, "1001"),
        (claims(1) | {"notice_path": 1}, "1001"),
        (claims(without(CLAIM, "state") | {"x": 1}), "2001"),
        (claims(CLAIM | {"x": 1, "hash": "b"}), "2002"),
        (claims(CLAIM | {"hash": "b", "path": 1}), "4001"),
        (claims(CLAIM | {"path": 1, "state": "odd"}), "1001"),
        (claims(CLAIM | {"state": "odd", "tags": [""]}), "4002"),
        (claims(CLAIM | {"state": "superseded", "tags": [""]}), "2001"),
        (claims(CLAIM | {"superseded_by_claim_id": "x", "tags": 1}), "4001"),
        (claims(CLAIM | {"tags": "a"}), "1001"),
        (claims(CLAIM | {"tags": ["a", "a", ""]}), "4005"),
        (claims(CLAIM | {"tags": ["a", "", "a", 1]}), "2003"),
        (claims(CLAIM | {"tags": ["a", 1, ""]}), "1001"),
        (claims(CLAIM, CLAIM | {"hash": "b"}), "4001"),
        (claims(CLAIM, CLAIM) | {"notice_path": "a b"}, "4004"),
        (claims(CLAIM, CLAIM, CLAIM | {"hash": "b"}), "4004"),
        (MANIFEST | {"notice_path": "a b", "spec_v": "1"}, "4001"),
        (MANIFEST | {"spec_v": "1", "exchange_profile_version": 1}, "3004"),
        (MANIFEST | {"exchange_profile_version": "1.0"}, "3004"),
    ]
    first(spark, cases, lambda df: v.manifest_violations(df, "spec_v"))
    first(spark, [(MANIFEST | {"format_version": "2.1"}, None), (MANIFEST | {"format_version": "3.0"}, "3003")], lambda df: v.manifest_violations(df, "spec_v", lenient=True))
    assert v.manifest_violations(spark.createDataFrame([], f"key int, doc struct<{canonical.SHAPE.replace('code string', 'code:string').replace('kind string', 'kind:string', 1).replace('fields map', 'fields:map').replace('items array', 'items:array')}>"), "s").collect() == []


def test_events(spark):
    cases = [
        (EVENT, None),
        (LATER, None),
        ("[]", "1001"),
        (without(EVENT, "actor") | {"more": 1}, "2001"),
        (EVENT | {"more": 1, "actor": ""}, "2002"),
        (EVENT | {"actor": 1, "claim_id": "x"}, "1001"),
        (EVENT | {"actor": "", "claim_id": "x"}, "2003"),
        (EVENT | {"claim_id": "x", "event_type": "odd"}, "4001"),
        (EVENT | {"timestamp": "2031-01-01T00:00:00.1234Z", "event_type": "odd"}, "4001"),
        (without(EVENT, "claim_instance_id") | {"event_type": "odd"}, "4002"),
        (without(EVENT, "claim_instance_id") | {"prev_event_id": U + "1"}, "2001"),
        (LATER | {"event_type": "reaffirm", "prev_event_id": "x"}, "2004"),
        (without(LATER, "prev_event_id") | {"event_type": "supersede"}, "2001"),
        (EVENT | {"prev_event_id": "x"}, "2004"),
        (without(LATER, "prev_event_id", "target_claim_instance_id"), "2001"),
        (LATER | {"prev_event_id": "x", "claim_instance_id": "y"}, "4001"),
        (without(LATER, "target_claim_instance_id"), None),
    ]
    first(spark, cases, v.event_violations)


CLAIM_DOC = {"claim_id": U + "1", "confidence": "0.500", "polarity": "affirm", "subject": "s", "valid_from": "2031-01-01T00:00:00Z", "valid_until": "2032-01-01T00:00:00Z"}


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({}, None),
        ({"conflict_class": "x", "confidence": "high"}, "4141"),
        ({"confidence": "high", "valid_from": "1"}, "4101"),
        ({"confidence": "true"}, "4101"),
        ({"confidence": "1.5"}, "4102"),
        ({"confidence": "0.5"}, "4103"),
        ({"valid_from": "12", "valid_until": "x"}, "4111"),
        ({"valid_from": "2031-02-30T00:00:00Z", "valid_until": "7"}, "4112"),
        ({"valid_until": "2030-01-01T00:00:00Z", "polarity": "odd"}, "4113"),
        ({"polarity": "1", "supersedes": [U + "1"]}, "4121"),
        ({"polarity": "odd", "supersedes": [U + "1"]}, "4122"),
        ({"supersedes": "x"}, "4131"),
        ({"supersedes": ["x", U + "1"]}, "4131"),
        ({"supersedes": [U + "2", U + "2", U + "1"]}, "4133"),
        ({"supersedes": [U + "1", U + "1"], "subject": "null"}, "4132"),
        ({"subject": None, "z": "1", "a": "2"}, "4144"),
        ({"polarity": None, "valid_from": None, "valid_until": None, "subject": None}, None),
        ({"z": "1", "a": "2"}, "4143"),
    ],
)
def test_claim_documents(spark, change, code):
    line = lambda k, x: f"{k}: {x}\n" if isinstance(x, str) else f"{k}:\n" + "".join(f"  - {y}\n" for y in x)
    fields = {k: x for k, x in (CLAIM_DOC | change).items() if x is not None}
    keys = list(fields) if "z" in change else sorted(fields)
    text = "---\n" + "".join(line(k, fields[k]) for k in keys) + "---\nbody\n"
    df = spark.createDataFrame([(1, text)], "key int, text string").select("key", pk.frontmatter(F.col("text")).alias("doc"))
    got = [r["code"] for r in v.first_broken(v.claim_document_violations(df)).collect()]
    assert got == ([f"PX_E_{code}"] if code else [])


def test_packages(spark):
    """Lifecycle comes before files, files before chains, chains before references."""
    e = lambda key, line, claim, ms, id_, kind, target, prev: (key, line, claim, ms, id_, kind, target, prev)
    good = [("create", False, None), ("revise", True, "1")]
    events = []
    for key in ("fine", "file", "hash", "extra", "chain", "lost"):
        events += [e(key, i, "c", i, f"{i + 1}", k, t, p) for i, (k, t, p) in enumerate(good)]
    events += [e("chain", 3, "c", 3, "3", "revise", True, "1"), e("lost", 4, "d", 1, "9", "create", False, None)]
    events += [e("life", 0, "c", 0, "1", "create", False, None), e("life", 1, "c", 1, "2", "reaffirm", False, "7")]
    events += [e("two", 5, "a", 0, "1", "revise", True, None), e("two", 2, "b", 9, "2", "reaffirm", False, None)]
    events = spark.createDataFrame(events, "key string, line int, claim_id string, ms int, event_id string, event_type string, has_target boolean, prev_event_id string")
    keys = ("fine", "file", "hash", "extra", "chain", "lost", "life", "two")
    entries = spark.createDataFrame([(k, i, c, f"{c}.md", "h") for k in keys for i, c in enumerate("cab" if k == "two" else "c")], "key string, line int, claim_id string, path string, hash string")
    files = spark.createDataFrame([(k, "c.md", "x" if k == "hash" else "h") for k in keys if k not in ("file", "life")] + [("extra", "more.md", "h")], "key string, path string, digest string")
    got = {r["key"]: (r["stage"], r["code"]) for r in v.first_broken(v.package_violations(events, entries, files)).collect()}
    assert got == {"file": (v.FILES, "PX_E_5002"), "hash": (v.FILES, "PX_E_5001"), "extra": (v.FILES, "PX_E_5002"), "chain": (v.CHAINS, "PX_E_5003"), "lost": (v.REFERENCES, "PX_E_5004"), "life": (v.LIFECYCLE, "PX_E_5102"), "two": (v.LIFECYCLE, "PX_E_5102")}
    assert v.package_violations(events.limit(0), entries.limit(0), files.limit(0)).collect() == []


def test_codes(spark):
    df = spark.createDataFrame([("PX_E_1001", "2031-01-01T00:00:00Z"), ("PX_W_4151", "2031-01-01T00:00:00.12Z"), ("PX_E_9001", "2031-01-01T00:00:00.1234Z"), ("odd", "2031-01-01T00:00:00+01:00"), (None, "yesterday")], "code string, at string")
    got = [tuple(r) for r in df.select(v.category(F.col("code")), v.timestamp_code(F.col("at"))).collect()]
    assert got == [("type", None), ("format", None), ("generic", "PX_E_3005"), ("generic", "PX_E_3005"), ("generic", "PX_E_4001")]
