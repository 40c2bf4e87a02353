import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hierarchy as h


def walk(par):
    out = {}
    for e in par:
        seen, x = {}, e
        while True:
            if x in seen:
                ring = [y for y in seen if seen[y] >= seen[x]]
                out[e] = (min(ring), min(seen[y] for y in ring), True)
                break
            seen[x] = len(seen)
            p = par[x]
            if p is None or p not in par:
                out[e] = (x, len(seen) - 1, False)
                break
            x = p
    return out


def forest(n, seed):
    r = random.Random(seed)
    ids = [f"n{i:04d}" for i in range(n)]
    return {x: r.choice([None, *ids[max(0, i - 3) : i + 1], *ids[i : i + 2], "gone"]) for i, x in enumerate(ids)}


def frame(spark, par, blocks=7):
    rows = [(bytearray(k, "ascii"), bytearray(v, "ascii") if v else None, bytearray(str(hash(k) % blocks), "ascii")) for k, v in par.items()]
    return spark.createDataFrame(rows, "id binary, parent binary, block binary")


@pytest.mark.parametrize(("n", "seed", "most"), [(60, 1, 10**6), (300, 2, 10**6), (80, 3, 5)])
def test_walks_equal_brute_force(spark, n, seed, most):
    par = forest(n, seed)
    got = h.hierarchy(frame(spark, par), max_component=most).collect()
    assert {r["id"].decode(): (r["root"].decode(), r["depth"], r["in_circle"]) for r in got} == walk(par)
    assert len(got) == n


def test_small_blocks_give_the_same(spark, monkeypatch):
    par = forest(200, 5)
    monkeypatch.setattr(h, "BLOCK_ROWS", 20)
    got = h.hierarchy(frame(spark, par)).collect()
    assert {r["id"].decode(): (r["root"].decode(), r["depth"], r["in_circle"]) for r in got} == walk(par)


def test_paths_and_descendants(spark):
    par = {"a": None, "b": "a", "c": "b", "d": "a", "x": "y", "y": "x", "t": "x", "s": "s"}
    got = {r["id"].decode(): r for r in h.hierarchy(frame(spark, par), full=True).collect()}
    assert [p.decode() for p in got["c"]["path"]] == ["a", "b", "c"]
    assert sorted(p.decode() for p in got["a"]["descendants"]) == ["b", "c", "d"]
    assert got["y"]["back_to"].decode() == "x" and got["s"]["back_to"].decode() == "s"
    assert got["t"]["depth"] == 1 and got["t"]["root"].decode() == "x" and not got["t"]["on_circle"]


def test_nodes_keep_the_first_arrival_and_drop_nulls(spark):
    rows = [("a", "p", "k", 2, 9), ("a", None, "k", 1, 9), (None, "a", "k", 1, 9), ("b", "a", None, 1, 9)]
    df = spark.createDataFrame(rows, "i string, p string, b string, at int, id int").select(*(F.col(c).cast("binary").alias(c) for c in "ipb"), "at", "id")
    got = {bytes(r["id"]): r for r in h.nodes(df, "i", "p", "b", "at").collect()}
    assert set(got) == {b"a", b"b"} and got[b"a"]["parent"] is None and got[b"b"]["block"] is None


def test_empty(spark):
    assert h.hierarchy(frame(spark, {"a": None}).limit(0)).collect() == []


@pytest.mark.parametrize("most", [10**6, 3])
def test_large_components_have_paths_descendants_and_back_edges(spark, monkeypatch, most):
    monkeypatch.setattr(h, "MAX_LIST", most)
    par = {"a": None, "b": "a", "c": "b", "d": "a", "e": "c", "f": "e", "x": "y", "y": "z", "z": "x", "t": "y"}
    whole = {bytes(r["id"]): r for r in h.hierarchy(frame(spark, par), full=True).collect()}
    assert len(whole) == len(par)
    got = {}
    for r in h.hierarchy(frame(spark, par), full=True, max_component=2).collect():
        got.setdefault(bytes(r["id"]), []).append(r)
    assert set(got) == set(whole) and (most > 3) == all(len(x) == 1 for x in got.values())
    for k, rows in got.items():
        below = [bytes(y) for r in rows for y in r["descendants"]]
        assert sorted(below) == sorted(bytes(y) for y in whole[k]["descendants"])
        for r in rows:
            assert (r["path"], r["back_to"], r["n_descendants"], r["root"], r["depth"]) == (whole[k]["path"], whole[k]["back_to"], len(below), whole[k]["root"], whole[k]["depth"])


def test_deep_walks_hold_bounded_lists(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(h, "MAX_LIST", 1000)
    n = 400
    ids = [b"%04d" % i for i in range(n)]
    rows = pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (ids, [None, *ids[:-1]], ids, [b"c"] * n)], ["id", "parent", "block", "component"])
    out = list(h._walker(True)([rows]))
    assert all(sum(len(x) for c in ("path", "descendants") for x in b.column(c).to_pylist()) < 1000 + n + 1 for b in out)
    assert sum(b.num_rows for b in out) == n and sum(len(x) for b in out for x in b.column("path").to_pylist()) == n * (n + 1) // 2


def test_doubling_keeps_size_estimates_bounded(spark, monkeypatch):
    # an estimate that is squared each round once filled the driver's memory; a ring with a tail takes the most rounds
    par = {f"n{i:03d}": f"n{i - 1 if i else 29:03d}" for i in range(60)}
    cut, sizes = h.cut, []

    def seen(df):
        sizes.append((out := cut(df))._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return out

    monkeypatch.setattr(h, "cut", seen)
    got = h.hierarchy(frame(spark, par), max_component=5).collect()
    assert {r["id"].decode(): (r["root"].decode(), r["depth"], r["in_circle"]) for r in got} == walk(par)
    assert len(sizes) > 10 and max(sizes) < 1 << 63
