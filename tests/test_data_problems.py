import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.keys import digest_key, instant_ms, uuid_key, uuid_text
from ledgerloom.operators import drift, reconcile, references, replay


def test_keys(spark):
    u = "01b8ef9a-691e-7255-8b9f-e8a4a6515c21"
    spelled = [u, u.upper(), "{" + u + "}", "urn:uuid:" + u, f" {u}\t", u.replace("-", "")]
    df = spark.createDataFrame([(x,) for x in [*spelled, None, "no id"]], "a string")
    assert [r[0] for r in df.select(uuid_text(uuid_key("a"))).collect()] == [u] * 6 + [None, "no id"]
    h = "ab" * 32
    df = spark.createDataFrame([(h,), ("SHA256:" + h.upper(),), (h[:-1],), (None,), ("",)], "a string")
    k = [None if r[0] is None else bytes(r[0]) for r in df.select(digest_key("a")).collect()]
    assert k[0] == k[1] == bytes.fromhex(h) and k[2] == b"\0" + h[:-1].encode() and k[3] is None and k[4] == b"\0"
    df = spark.createDataFrame([("2030-01-01T01:00:00Z",), ("2030-01-01T02:00:00.000+01:00",), ("x",), (None,)], "a string")
    t = [r[0] for r in df.select(instant_ms("a")).collect()]
    assert t[0] == t[1] and t[2:] == [None, None]


def changes(spark, rows):
    df = spark.createDataFrame(rows, "id string, key string, kind string, ms long, at int, log string, seq long, code string")
    df = df.select(*(F.col(c).cast("binary").alias(c) for c in ("id", "key", "log")), "kind", "ms", "at", "seq")
    return replay.changes(df, id="id", key="key", code=replay.Machine().code(F.col("kind")), ms="ms", arrival="at", log="log", seq="seq")


def delivered(spark, rows):
    return spark.createDataFrame([(x[5], x[6]) for x in rows], "log string, seq long").select(F.col("log").cast("binary").alias("log"), "seq")


def test_replay_equals_a_plain_fold(spark):
    r, m = random.Random(4), replay.Machine()
    kinds = [*m.types, None, "unknown"]
    rows = [(f"e{i:04d}", f"k{min(r.randrange(12), 3)}", r.choice(kinds), r.randrange(200), r.randrange(9), f"L{i % 3}", i // 3 + 1, "x") for i in range(400)]
    rows += [(*x[:4], x[4] + 1, *x[5:]) for x in rows[:50]]  # delivered again
    got = {bytes(x["key"]).decode(): m.states[x["state"]] for x in replay.replay(changes(spark, rows), m).collect()}
    want = {}
    for _, g in itertools.groupby(sorted({x[:4] for x in rows}, key=lambda x: (x[1], x[3], x[0])), key=lambda x: x[1]):
        s = "new"
        for x in g:
            s, k = replay.LIFECYCLE.get((s, x[2]), s), x[1]
        want[k] = s
    assert got == want


def test_gaps_hold_changes(spark):
    rows = [("a", "k", "create", 1, 0, "L", 1, ""), ("b", "k", "withdraw", 5, 0, "L", 3, ""), ("c", "j", "create", 2, 0, None, None, ""), ("d", "i", "create", 2, 0, "M", 2, ""), (None, "k", "create", 1, 0, "L", 4, ""), ("z", None, "create", 1, 0, "L", 9, "")]
    m = replay.Machine()
    got = {bytes(x["key"]).decode(): (m.states[x["state"]], m.states[x["committed_state"]], x["n_held"]) for x in replay.replay(replay.mark_held(changes(spark, rows), delivered(spark, rows)), m, held=True).collect()}
    assert got == {"k": ("withdrawn", "active", 1), "j": ("active", "active", 0), "i": ("active", "new", 1)}
    assert replay.replay(changes(spark, rows[:0]), m).collect() == []


def test_lines_without_a_change_leave_no_gap(spark):
    """Line 2 has no instant, line 3 no key, line 4 repeats an event: nothing is held. A late transaction fills its place."""
    rows = [("a", "k", "create", 1, 0, "L", 1, ""), ("b", "k", "revise", None, 0, "L", 2, ""), ("c", None, "revise", 3, 0, "L", 3, ""), ("a", "k", "create", 1, 5, "L", 4, ""), ("d", "k", "withdraw", 9, 0, "L", 5, "")]
    rows += [("e", "j", "supersede", 8, 9, "M", 2, ""), ("f", "j", "create", 2, 99, "M", 1, "")]
    rows += [("g", "i", "create", 4, 0, "N", 1, ""), ("h", "i", "revise", 4, 0, "N", 2, ""), ("p", "i", "withdraw", 4, 0, "N", 4, "")]  # one transaction, cut by a gap
    m = replay.Machine()
    got = {bytes(x["key"]).decode(): (m.states[x["state"]], m.states[x["committed_state"]], x["n_held"]) for x in replay.replay(replay.mark_held(changes(spark, rows), delivered(spark, rows)), m, held=True).collect()}
    assert got == {"k": ("withdrawn", "withdrawn", 0), "j": ("superseded", "superseded", 0), "i": ("withdrawn", "new", 3)}
    marks = {bytes(r["log"]).decode(): r["watermark"] for r in replay.watermarks(delivered(spark, rows)).collect()}
    assert marks == {"L": 5, "M": 2, "N": 2}


def test_orphans_and_cascade(spark):
    b = lambda df, *cs: df.withColumns({c: F.col(c).cast("binary") for c in cs})
    kids = b(spark.createDataFrame([("a", 5, "p", "x"), ("b", 5, None, "x"), ("c", 5, "q", "x"), ("d", 5, "r", "x"), ("e", 5, "s", "x")], "id string, arrival int, ref string, kind string"), "id", "ref")
    parents = b(spark.createDataFrame([("p", 9, None), ("p", 4, None), ("q", 9, None), ("r", 1, 5), (None, 1, 1)], "k string, arrival int, gone int"), "k")
    got = {(bytes(r["id"]).decode(), r["kind"]) for r in references.orphans(kids, {"ref": references.records(parents, "k", "arrival", "gone")}).collect()}
    assert got == {("c", "late"), ("d", "deleted"), ("e", "missing")}
    r = random.Random(2)
    par = {i: r.choice([None, *range(max(0, i - 3), i)]) for i in range(120)} | {200: 201, 201: 202, 202: 200, 203: 202}
    direct = {5, 40, 201}
    links = spark.createDataFrame(list(par.items()), "id int, parent int")
    lev = {r["id"]: r["level"] for r in references.cascade(spark.createDataFrame([(x,) for x in direct], "id int"), links).collect()}
    want = {}
    for x in par:
        y, n, seen = x, 0, set()
        while y is not None and y not in direct and y not in seen:
            seen.add(y)
            y, n = par.get(y), n + 1
        if y in direct:
            want[x] = n
    assert lev == want
    named = spark.createDataFrame([(5, 1, "f", "missing"), (5, 1, "f", "late"), (40, 2, "f", "missing"), (201, 3, "g", "late")], "id int, arrival int, field string, kind string")
    rows = references.orphan_rows(spark.createDataFrame([(x, x) for x in par], "id int, arrival int"), named, links).collect()
    assert sorted((r["id"], r["kind"]) for r in rows if r["level"] == 0) == [(5, "late"), (5, "missing"), (40, "missing"), (201, "late")]
    assert {r["id"]: r["level"] for r in rows} == want and all(r["arrival"] == r["id"] for r in rows if r["level"])


def least_cost(a, b, supply, demand):
    rows, cols = ([i for i, n in enumerate(x) for _ in range(n)] for x in (supply, demand))
    if len(rows) > len(cols):
        return least_cost(b, a, demand, supply)
    return min(sum(sum(x != y for x, y in zip(a[i], b[j])) for i, j in zip(rows, p)) for p in set(itertools.permutations(cols, len(rows))))


def test_transport_is_of_least_cost():
    r = random.Random(3)
    for _ in range(300):
        n, m, f = r.randrange(1, 5), r.randrange(1, 4), r.randrange(1, 5)
        a, b = ([[r.randrange(3) for _ in range(f)] for _ in range(k)] for k in (n, m))
        s, d = ([r.randrange(1, 3) for _ in range(k)] for k in (n, m))
        out = reconcile.transport(np.array(a), np.array(b), np.array(s), np.array(d))
        assert sum(k for *_, k in out) == min(sum(s), sum(d))
        assert all(sum(k for i, _, k in out if i == x) <= s[x] for x in range(n)) and all(sum(k for _, j, k in out if j == y) <= d[y] for y in range(m))
        assert sum(k * sum(x != y for x, y in zip(a[i], b[j])) for i, j, k in out) == least_cost(a, b, s, d)


def test_reconcile(spark):
    kind = "k string, a string, l int, t array<string>, extra int"
    left = spark.createDataFrame([("1", "x", 1, ["u"], 0), ("1", "x", 1, ["u"], 9), ("2", None, 1, None, 0), ("3", "q", 1, ["v", "w"], 0), ("3", "q", 2, ["u"], 0), (None, "x", 1, None, 0), ("5", "", 1, [], 0), ("6", "x", 1, ["u"], 0), ("6", "x", 1, ["u"], 0)], kind)
    right = spark.createDataFrame([("1", "x", 1, ["u"], 0), ("2", "", 1, None, 0), ("3", "q", 3, ["u"], 0), ("3", "w", 1, ["v", "w"], 0), ("4", "x", 1, None, 0), ("5", None, 1, None, 0), ("6", "x", 1, ["w"], 0), ("6", "x", 1, ["w"], 0), ("6", "x", 1, ["w"], 0)], kind)
    left, right = (d.withColumn("k", F.col("k").cast("binary")) for d in (left, right))
    run = lambda records: sorted((bytes(r["key"]).decode(), r["field"], r["diff"], r["n"]) for r in reconcile.reconcile(left, right, "k", ["a", "l", "t"], records).collect())
    rest = [("2", "a", "differs", 1), ("3", "a", "differs", 1), ("3", "l", "differs", 1), ("4", "*", "right_only", 1), ("5", "a", "differs", 1), ("5", "t", "differs", 1), ("6", "t", "differs", 2)]
    assert run(False) == sorted([("1", "*", "left_only", 1), ("6", "*", "right_only", 1), *rest])
    assert run(True) == rest
    assert reconcile.reconcile(left.limit(0), right.limit(0), "k", ["a"]).collect() == []


@pytest.mark.parametrize("spread", [100, 10_000])
def test_keys_with_hundreds_of_left_over_rows(spark, monkeypatch, spread):
    """Half of all rows have one key; each differs in one field from its partner, and an array tells the partners. Beyond the
    spread that is found in joins, and gives the same; "tied" has rows with two partners, which only the transport can pair."""
    monkeypatch.setattr(reconcile, "SPREAD", spread)
    calls = []
    monkeypatch.setattr(reconcile, "forced", lambda *a, f=reconcile.forced: (calls.append(1), f(*a))[1])
    row = lambda key, i, x: (key, f"{i % 7}", x, [str(i), "t"], {"m": i})
    kind = "k string, a string, s string, t array<string>, m map<string,int>"
    both = [(f"k{i}", "a", "b", ["c"], None) for i in range(1000)]
    left = [*both, *(row("hot", i, "old") for i in range(1000)), *(row("tied", i, "old") for i in range(150)), row("hot", -1, "x"), row("hot", -1, "x")]
    right = [*both, *(row("hot", i, "new") for i in range(1000)), *(row("tied", i, "new") for i in range(150)), row("tied", 3, "newer"), row("hot", -1, "x"), row("hot", 7, "new"), row("hot", 2000, "other")]
    left, right = (spark.createDataFrame(d, kind).select(F.col("k").cast("binary").alias("k"), "a", "s", "t", F.array_sort(F.map_entries("m")).alias("m")) for d in (left, right))
    got = {(bytes(r["key"]), r["field"], r["diff"], r["n"]) for r in reconcile.reconcile(left, right, "k", ["a", "s", "t", "m"]).collect()}
    assert bool(calls) == (spread == 100)
    rest = {(b"tied", "s", "differs", 150), (b"tied", "*", "right_only", 1)}
    # the last "x" of the left is four fields from what is left of the right: a repeated row, or one of another kind
    assert {x for x in got if x[0] == b"tied"} == rest
    hot = {x[1]: x[3] for x in got if x[0] == b"hot" and x[2] == "differs"}
    assert hot["s"] == 1001 and sum(hot.values()) in (1003, 1004) and (b"hot", "*", "right_only", 1) in got


@pytest.mark.parametrize("spread", [1, 100])
def test_fields_may_have_any_name(spark, monkeypatch, spread):
    monkeypatch.setattr(reconcile, "SPREAD", spread)
    names = ["k", "n_left", "row", "hub"]
    frame = lambda x: spark.createDataFrame([("p", f"{i}", x, i, "c", "more") for i in range(3)], "key string, k string, n_left string, row int, hub string, l string").withColumn("key", F.col("key").cast("binary"))
    got = [(bytes(r["key"]), r["field"], r["diff"], r["n"]) for r in reconcile.reconcile(frame("a"), frame("b"), "key", names).collect()]
    assert got == [(b"p", "n_left", "differs", 3)]


def test_forced_pairs(spark):
    """Without the odd rows the pairing is forced, and equals the transport's."""
    kind = "key string, row struct<a:string,b:int,c:string>, n_left long, n_right long"
    rows = [("f", ("x", i, "p"), 2, 0) for i in range(20)] + [("f", ("y", i, "p"), 0, 3) for i in range(20)]
    rows += [("g", ("x", 1, None), 1, 0), ("g", ("x", 2, None), 0, 1), ("g", (None, 1, None), 0, 1)]
    rows += [("h", ("x", 1, "p"), 0, 2), ("h", ("x", 2, "p"), 1, 0), ("h", ("x", 3, "p"), 1, 0), ("h", ("q", 9, "r"), 1, 0)]
    rest = spark.createDataFrame(rows, kind).withColumn("key", F.col("key").cast("binary"))
    keys = rest.groupBy("key").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    got = {(bytes(r["key"]).decode(), r["field"], r["diff"], r["n"]) for r in reconcile.forced(rest, keys, ["a", "b", "c"]).collect()}
    assert got == {("f", "a", "differs", 40), ("f", "*", "right_only", 20)}  # g has two ways; in h one row of the right has two partners


def lines(spark, files):
    rows = [(i * 100 + j, "f", f"f/{i}", i, j, json.dumps(x) if isinstance(x, dict) else x, "clash") for i, f in enumerate(files) for j, x in enumerate(f)]
    return spark.createDataFrame(rows, "raw_id long, feed string, file_name string, file_seq int, line_no int, payload string, field string")


def test_drift(spark):
    old = [{"package_id": f"p{i}", "a": i, "b": "x", "n": 1.0, "extensions": {"k": True}} for i in range(4)]
    new = [{"package_id": f"p{i}", "c": i, "b": ["x"], "n": 1, "extensions": {"j": None}} for i in range(4)]
    raw = lines(spark, [[*old, "{cut", None, "[1]", '{"z": NaN}'], new, [], new[:0] + ["bad"]])
    got = {(r["file_name"], r["field"], r["change"]) for r in drift.changes(drift.registry(raw)).collect()}
    gone = {("f/3", f, "removed") for f in ("package_id", "c", "b", "n", "extensions")}
    assert got == {("f/1", "c", "renamed"), ("f/1", "b", "retyped"), ("f/1", "extensions.k", "removed")} | gone
    assert drift.changes(drift.registry(raw.limit(0))).collect() == []


def test_two_packages_make_no_rename(spark):
    raw = lines(spark, [[{"package_id": f"p{i}", "a": i} for i in range(2)], [{"package_id": f"p{i}", "c": i} for i in range(2)]])
    assert {(r["field"], r["change"]) for r in drift.changes(drift.registry(raw)).collect()} == {("a", "removed"), ("c", "added")}


def test_records_are_routed_into_one_schema(spark):
    pk = [f"p{i}" for i in range(3)]
    files = [[{"package_id": p, "a": i} for i, p in enumerate(pk)], [{"package_id": p, "b": i} for i, p in enumerate(pk)], [{"package_id": p, "c": i, "d": "1"} for i, p in enumerate(pk)], [{"package_id": "p0", "c": "x", "a": "7"}]]
    got = drift.consistent_table(lines(spark, files)).collect()
    assert len(got) == 10 and all(set(r["fields"]) == {"package_id", "a", "d", "a@2"} for r in got)
    assert [r["fields"]["a"] for r in sorted(got, key=lambda r: r["raw_id"])] == ["0", "1", "2"] * 3 + ['"x"']
    last = next(r for r in got if r["file_seq"] == 3)
    assert {tuple(x) for x in last["changes"]} == {("a", "renamed from c"), ("a", "kept as string, not number"), ("a@2", "renamed from a")}
    other = lines(spark, files).withColumns({"feed": F.lit("g"), "file_name": F.concat(F.lit("g"), "file_name")}).filter("file_seq < 1")
    both = drift.consistent_table(lines(spark, files).unionByName(other)).collect()
    assert len(both) == 13 and all(set(r["fields"]) == {"package_id", "a", "d", "a@2"} for r in both)


def test_json_values():
    n = lambda x: drift._DECODER.decode(x)
    assert drift.json_text(drift.cast_json("7", "number")) == "7" and drift.cast_json("seven", "number") is drift._FAILED and drift.cast_json(n("7"), "string") == "7"
    assert drift.value_key(n("1")) == drift.value_key(n("1.0")) == drift.value_key(n("10e-1")) != drift.value_key(True)
    assert drift.value_key(n("-0")) == drift.value_key(n("0.00")) == drift.value_key(n("0e9"))
    assert drift.value_key(n("1e5000")) == drift.value_key(n("10e4999")) != drift.value_key(n("1e5001"))
    a, b = "1234567890123456789012345678901234567890.1", "1234567890123456789012345678901234567890.2"
    assert drift.value_key(n(a)) != drift.value_key(n(b)) and drift.json_text(n(a)) == a
    long = "9" * 6000
    assert drift.parse_object('{"a": ' + long + "}")["a"].text == long
    assert drift.value_key(n('{"a": 1, "b": [2.50]}')) == drift.value_key(n('{"b": [25e-1], "a": 1.0}'))
