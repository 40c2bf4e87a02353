import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import corpora


def test_readers(spark, tmp_path):
    q = [{"question_id": "a", "question_type": "x", "haystack_session_ids": ["s"], "haystack_sessions": [[{"role": "user", "content": "hi"}]], "more": 1}, {"question_id": "b"}]
    (tmp_path / "q.json").write_text(json.dumps(q, indent=1))
    got = {r["question_id"]: r for r in corpora.read_corpus(spark, str(tmp_path / "q.json")).collect()}
    assert set(got) == {"a", "b"} and got["a"]["haystack_sessions"][0][0]["content"] == "hi" and got["b"]["haystack_sessions"] is None
    only = spark.createDataFrame([("b",), ("b",), ("z",)], "question_id string")
    assert [r["question_id"] for r in corpora.read_corpus(spark, str(tmp_path / "q.json"), only).collect()] == ["b"]
    text = json.dumps({"a": ["x", "y"], "b": []})
    (tmp_path / "labels.json").write_text(text)
    pin = hashlib.sha256(text.encode()).hexdigest()
    assert sorted(map(tuple, corpora.read_labels(spark, str(tmp_path / "labels.json"), pin).collect()), key=repr) == [("a", "x"), ("a", "y"), ("b", None)]
    with pytest.raises(corpora.WrongDigest):
        corpora.read_labels(spark, str(tmp_path / "labels.json"), "0" * 64)
    (tmp_path / "split.json").write_text(json.dumps({"seed": 7, "question_ids": {"ku": ["a", "b"], "ms": []}}))
    assert sorted(map(tuple, corpora.read_split(spark, str(tmp_path / "split.json")).collect())) == [("ku", "a", 7), ("ku", "b", 7)]


def test_extractions(spark):
    one = '{"text": " a  b", "subject": "s", "value": "v"}'
    cases = [(one, 1), (one + "\n" + one.replace(",", ",\n"), 2), (f"```json\n{one}\n```", 1), (one + " and more", None), ("[" + one + "]", None), (one.replace('"v"', '" "'), None), (one.replace('"v"', '"v", "x": "y"'), None), ('{"text": "a"}', None), ("", None), (one.replace('"v"', "1"), None)]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)] + [(99, None)], "i int, o string")
    got = {r["i"]: r["x"] for r in df.select("i", corpora.extracted(F.col("o")).alias("x")).collect()}
    assert {i: got[i]["claims"] and len(got[i]["claims"]) for i in range(len(cases))} == {i: n for i, (_, n) in enumerate(cases)}
    assert all((got[i]["code"] is None) == (n is not None) for i, (_, n) in enumerate(cases)) and got[99]["code"] is None and got[0]["claims"][0]["text"] == "a b"


def test_lines_and_ids(spark, tmp_path):
    s = spark.createDataFrame([("s", "a\n \nb"), ("t", ""), ("u", None)], "session_id string, text string")
    assert sorted(map(tuple, corpora.line_claims(s).collect())) == [("s", 0, "s#L000", "a"), ("s", 2, "s#L002", "b")]
    df = spark.createDataFrame([("z", 2, None), ("y", 1, "t")], "b string, a int, c string")
    corpora.write_lines(df, str(tmp_path / "out"), "a")
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":1,"b":"y","c":"t"}', '{"a":2,"b":"z","c":null}']
    ids = [r[0] for r in spark.range(50).select(corpora.uuid7(F.timestamp_millis(F.lit(1_900_000_000_000)))).collect()]
    assert len(set(ids)) == 50 and all(re.fullmatch(r"01ba60d3-3800-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", x) for x in ids), ids[0]
    files = spark.createDataFrame([("k", "b", b"2"), ("k", "a", b"1")], "key string, path string, content binary")
    want = hashlib.sha256("".join(f"{p}\n{hashlib.sha256(c).hexdigest()}\n" for p, c in (("a", b"1"), ("b", b"2"))).encode()).hexdigest()
    assert corpora.directory_digest(files).first()["digest"] == want
