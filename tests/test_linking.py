import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import linking


def link_plain(rows: list[tuple]) -> list[tuple]:
    """One scope, record by record."""
    value_token = re.compile(linking.VALUE_TOKEN)
    head: dict[str, tuple[str, str]] = {}
    head_meta: dict[str, dict] = {}
    known: dict[str, dict] = {}
    n_claims, subjects, out = 0, [], []
    for seq, body, subject, value, at in sorted(rows):
        body = " ".join(body.split())
        given = " ".join(subject.split()).lower() if subject and subject.strip() else None
        old = known.get(body)
        if old is not None and head[old["subject"]][0] == old["claim_id"]:
            meta, minted = old, False
        elif old is None and given is not None and given in head and head[given][1] == (value or "").strip():
            meta, minted = head_meta[given], False
        else:
            if old is not None:
                s, obj = old["subject"], old["object"]
            else:
                words = body.lower().split(" ")
                s = given or (" ".join(words[:-1]) if len(words) > 1 and value_token.match(words[-1]) else None)
                obj = (value or "").strip() if given else body
                s = s if s is not None else f"x#S{len(subjects):05d}"
            meta, minted = {"claim_id": f"x#C{n_claims:05d}", "subject": s, "object": obj, "supersedes": head[s][0] if s in head else None}, True
            meta["valid_from"] = at if meta["supersedes"] and at else None
            n_claims += 1
            if s not in head:
                subjects.append(s)
            head[s] = (meta["claim_id"], obj)
            head_meta[s] = meta
        known[body] = meta
        out.append((seq, meta["claim_id"], meta["subject"], meta["object"], meta["supersedes"], meta["valid_from"], minted))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_lineages_equal_a_plain_walk(spark, seed, monkeypatch):
    monkeypatch.setattr(linking, "RANGE", 16)
    r = random.Random(seed)
    scopes = {}
    for scope in ("x", "y"):
        rows = []
        for seq in range(150):
            kind = r.randrange(4)
            if kind == 0:
                rows.append((seq, f"my best {r.choice('ab')} is {r.randrange(4)}", None, None, r.choice(["2031-01-01T00:00:00Z", None, ""])))
            elif kind == 1:
                rows.append((seq, r.choice(["hello", "just talk", " just  talk "]), None, None, None))
            else:
                s, v = r.choice(["City", "job ", " job"]), str(r.randrange(3))
                rows.append((seq, f"{s.strip()} said {v}" + r.choice(["", " indeed", " again 7"]), s, v, "2032-01-01T00:00:00Z"))
        scopes[scope] = rows
    flat = [(scope, *x, "clash") for scope, rows in scopes.items() for x in rows] + [("x", *scopes["x"][0], "again"), (None, 1, "a", None, None, None, ""), ("x", None, "a", None, None, None, "")]
    df = spark.createDataFrame(flat, "scope string, seq long, body string, subject string, value string, occurred_at string, n string")
    got = linking.with_edges(linking.link(df)).collect()
    for scope, rows in scopes.items():
        mine = sorted((x["seq"], x["claim_id"], x["subject"], x["object"], x["supersedes"], x["valid_from"], x["minted"]) for x in got if x["scope"] == scope)
        want = [(a, b.replace("x#", scope + "#"), c.replace("x#S", scope + "#S"), o, s and s.replace("x#", scope + "#"), v, m) for a, b, c, o, s, v, m in link_plain(rows)]
        assert mine == want
    n = linking.stats(linking.link(df)).filter("scope = 'x'").first()
    assert n["records"] == 150 and n["lineages"] == n["subjects"] + n["supersedes_edges"]
    assert linking.link(df.limit(0)).collect() == []


def test_subjects_and_instants(spark):
    df = spark.createDataFrame([("My 5K best is 22:00",), ("just words",), ("12",), (None,), ("it costs $40.50",), ("2023/05/25 (Thu) 20:21",), (" 2023/05/25 20:21 ",)], "a string")
    got = [tuple(x) for x in df.select(linking.trailing_value_subject(F.col("a")), linking.corpus_instant(F.col("a"))).collect()]
    assert got == [("my 5k best is", None), (None, None), (None, None), (None, None), ("it costs", None), ("2023/05/25 (thu)", "2023-05-25T20:21:00Z"), ("2023/05/25", "2023-05-25T20:21:00Z")]
