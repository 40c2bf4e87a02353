import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import claims, retrieval
from ledgerloom.operators import evaluation as ev
from ledgerloom.operators.replay import LIFECYCLE, Machine
from ledgerloom.session import ensure_checkpoint_dir
from ledgerloom.streaming import replay as stream


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_corpora(spark):
    q = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", "x"), ("c_abs", "y"), (None, "y"), ("d", None)], "question_id string, question_type string")
    assert rows(ev.ids_by_type(q)) == [("x", ["a", "b"]), ("y", ["c_abs"])]
    assert rows(ev.denominator(q.filter("question_id IS NOT NULL"), q.filter("question_id = 'a'"))) == [("a", False), ("b", True), ("d", True)]
    assert rows(ev.keyset_difference(q.filter("question_id IN ('a', 'b')"), q.filter("question_id IN ('b', 'd')"))) == [("a", "extra"), ("d", "missing")]
    want = spark.createDataFrame([("x", 3), ("z", 1)], "question_type string, n long")
    assert rows(ev.ground_truth(q.filter("question_type = 'x'"), q.filter("question_id = 'a'"), want)) == [("ids a", -2), ("only a", 1), ("rows a", -1), ("rows b", -2), ("type z", -1)]
    ids = spark.createDataFrame([(f"{i:03d}",) for i in range(50)] * 2, "question_id string")
    assert rows(ev.seeded_sample(ids, 5, 7)) == sorted((x,) for x in random.Random(7).sample([f"{i:03d}" for i in range(50)], 5))
    with pytest.raises(ValueError, match="more than 10"):
        ev.seeded_sample(ids, 5, 7, most=10)
    assert rows(ev.first_ids(ids, 2)) == [("000",), ("001",)]


def test_sessions(spark):
    turn = lambda role, content: {"role": role, "content": content}
    kind = f"question_id string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<{ev.TURN}>"
    q = spark.createDataFrame(
        [
            ("q", ["s2"], ["s1", "s2", "s3", "s4"], ["2031/01/02 (Fri) 10:00", "2030/01/02 (Fri) 10:00", "some day"], [[turn("user", " a\n b "), turn("x", "  ")], [turn(None, "c")], [turn("user", "d")], [turn("user", None)]]),
            ("empty", [], [], [], []),
            ("none", None, None, None, None),
        ],
        kind,
    )
    got = [(r["session_id"], r["occurred_at"], r["text"]) for r in ev.sessions(q).orderBy("ordinal").collect()]
    assert got == [("s3", None, "user: d"), ("s2", "2030-01-02T10:00:00Z", "?: c"), ("s1", "2031-01-02T10:00:00Z", "user: a b")]
    assert rows(ev.sessions(q, evidence_only=True), "session_id") == [("s2",)]


def test_verdicts(spark):
    df = spark.createDataFrame([("so\nCorrect.\n\n",), ("INCORRECT",), ("correct or not",), ("",), (None,)], "o string")
    assert [r[0] for r in df.select(ev.verdict(F.col("o"))).collect()] == [True, False, None, None, None]
    arms = spark.createDataFrame([("A", "p", "r", 2), ("B", "p", "s", 2), ("C", "q", "r", 2), ("D", None, "r", 2), ("E", "p", "r", 1)], "arm string, pins string, retriever string, n_answers int")
    assert rows(ev.unfair(arms, 2)) == [("B", "retriever"), ("C", "pins"), ("D", "no pins"), ("E", "answers")]
    order = spark.createDataFrame([("A", f"q{i}", i) for i in range(6)], "arm string, question_id string, position int")
    had = spark.createDataFrame([("A", "q0", 0), ("B", "q1", 1), ("A", "q3", 3), ("A", "q3", 3)], "arm string, question_id string, position int")
    assert rows(ev.out_of_order(had, order)) == [(1, "another"), (2, "missing"), (3, "twice")]
    assert ev.out_of_order(had.limit(0), order).collect() == []


def test_comparisons(spark):
    perf = spark.createDataFrame([("A", 1.0, 10.0), ("B", 10.0, 101.0), ("C", 11.0, None)], "arm string, p95_ms double, bytes_per_claim double")
    assert rows(ev.tripwires(perf, "A", 10)) == [("B", "bytes_per_claim", 101.0, 10.0), ("C", "p95_ms", 11.0, 1.0)]
    v = spark.createDataFrame([("a", True, False), ("b", False, True), ("c", False, True), ("d", None, True)], "question_id string, b boolean, c boolean")
    assert rows(ev.adversarial(v, 3, 5, 40)) == [(3, 1, 2, 33.333333, True, "tier1")]
    assert rows(ev.adversarial(v.limit(0), 3, 5, 40)) == [(0, 0, 0, 0.0, False, "none")]
    a = spark.createDataFrame([("a", True, False, ["x", "y"], ["y", "z"]), ("b", True, True, ["x"], ["y"]), ("c", False, True, None, ["y"])], "question_id string, b boolean, c boolean, ids_b array<string>, ids_c array<string>")
    assert rows(ev.context_differences(a)) == [("a", "B", ["x"], ["z"], False), ("c", "C", None, ["y"], False)]
    d = spark.createDataFrame([("l", "1", "k", "t"), ("l", "1", "k", "t"), ("l", "2", "k", "u"), ("m", "3", "k2", "w"), ("n", "4", None, "w")], "label string, lineage string, control string, treatment string")
    assert rows(ev.attribution(d)) == [(2, 0, 2, 1, False)] and rows(ev.attribution(d.limit(3))) == [(2, 0, 2, 0, True)] and rows(ev.attribution(d.limit(0))) == [(0, 0, 0, 0, False)]
    x = spark.createDataFrame([("a", "valid", b"1"), ("b", "valid", b"2"), ("c", "valid", b"3")], "name string, verdict string, content binary")
    y = spark.createDataFrame([("a", "valid", b"1"), ("b", "invalid", b"2"), ("d", "valid", b"3")], "name string, verdict string, content binary")
    assert rows(ev.agreement(x, y)) == [(2, 2, 1, 1, 1)]
    c = spark.createDataFrame([("1", "h", "s"), ("1", "h", "s"), ("2", "h", "s"), ("2", "h", None), ("3", "h", "s"), ("3", "i", "s"), (None, "h", "s")], "claim_id string, content_hash string, state string")
    assert rows(ev.conflicts(c, ("state",))) == [("1", None, 2), ("2", "disagree", 2), ("3", "PX_E_5103", 2)]
    assert rows(ev.unsuppressed(c.withColumn("state", F.when(F.col("claim_id") == "3", "withdrawn"))), "claim_id") == [("1",), ("1",), ("2",), ("2",), (None,)]
    assert retrieval.sign_test(3000, 2900) == pytest.approx(0.19749, abs=1e-4)


def test_vocabulary(spark):
    m = spark.createDataFrame([("s", 1, 1, "a", "1"), ("s", 1, 2, "b", "1"), ("s", 1, 3, "a", "2"), ("s", 2, 4, "c", "1"), ("s", 2, 5, "b", "9"), ("s", 3, 6, None, "1")], "scope string, session int, seq int, subject string, value string")
    assert rows(ev.vocabulary(m)) == [("s", 2, "a", "2", 1), ("s", 2, "b", "1", 2), ("s", 3, "a", "2", 1), ("s", 3, "b", "9", 2), ("s", 3, "c", "1", 3)]


def test_diffs(spark):
    kind = "claim_id string, hash string, state string, tags array<string>, labels map<string,string>"
    a = spark.createDataFrame([("1", "h", "s", ["a", "b"], {"k": "1"}), ("2", "h", "s", None, None), ("3", "h", "s", [], {}), ("4", "h", "s", [], {})], kind)
    b = spark.createDataFrame([("1", "h", "t", ["b", "c"], {"l": "1"}), ("2", "h", "s", [], {}), ("3", None, "s", [], {"k": "1"})], kind)
    assert rows(claims.evidence_diff(a, b)) == [("1", False, True, ["c"], ["a"], ["l"], ["k"]), ("3", True, False, [], [], ["k"], [])]
    log = lambda *ids: spark.createDataFrame([("p", x, i) for i, x in enumerate(ids)], "package string, event string, at int")
    assert rows(claims.timeline_ids(log("a", "b", "c"), log("b", "a", "d"), "package", "event", "at"), "event", "change") == [("a", "reordered"), ("b", "reordered"), ("c", "removed"), ("d", "added")]
    long = [f"{i:04d}" for i in range(500)]
    swapped = [*long[:249], long[250], long[249], *long[251:]]
    assert rows(claims.timeline_diff(log(*long), log(*swapped), "package", "event", "at")) == [("p", 0, 0, True)]
    assert rows(claims.timeline_diff(log(*long), log(*long), "package", "event", "at")) == [("p", 0, 0, False)]


def test_stream_of_several_files(spark, tmp_path):
    """Files out of order, a repeated delivery, and one change that comes after the watermark has passed it."""
    day = 86_400_000
    files = [[("k", "a", 1, "create"), ("j", "x", 1, "create")], [("k", "b", 9, "withdraw"), ("k", "a", 1, "create")], [("k", "c", 8, "revise"), ("j", "y", 30, "withdraw")], [("j", "z", 2, "supersede")], [("k", "d", 31, "revise")]]
    kind = "key string, id string, day int, kind string"
    for i, f in enumerate(files):
        spark.createDataFrame(f, kind).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    m = Machine()
    feed = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    changes = feed.select("key", "id", (F.col("day").cast("long") * day).alias("ms"), m.code(F.col("kind")).alias("code"), F.timestamp_millis((F.col("day").cast("long") * day)).alias("at"))
    q = stream.stream_states(changes, m).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/log").option("path", f"{tmp_path}/out").format("parquet").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert "z" in {x for r in out.collect() for x in r["late"]} and "j" in {r["key"] for r in stream.late_keys(out).collect()}
    last = {r["key"]: m.states[r["s"]] for r in out.groupBy("key").agg(F.max_by("state", "n").alias("s")).collect()}
    assert last["k"] == "withdrawn" and LIFECYCLE["active", "withdraw"] == "withdrawn"


def test_checkpoints_on_a_cluster_need_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(_, default):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
