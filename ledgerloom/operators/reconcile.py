"""Differences between two copies of data, field by field, for keys with one or many rows.

1. Identical rows cancel by multiplicity: both copies are grouped by key and all fields with the counts of either side, which
   combines on the map side, so a key that holds a third of all rows shrinks before the shuffle.
2. What is left over keeps its multiplicities, as capacities, and is paired within its key at the least total number of
   differing fields. A key with one distinct row on either side, the usual case, is compared in codegen; others are solved as
   minimum-cost transport by ``transport``, exactly and whatever their size.
3. Rows without partner are ``left_only`` or ``right_only``.

With ``records`` the rows of a key are one record delivered again, so what is left on one side is no difference while the
other side has the key at all.

Sizes: a key's distinct left-over rows meet in one task as dictionary codes (eight bytes a field); payloads stay outside.
``transport`` holds no cost matrix, so memory grows with the rows of the key, its time with left times right distinct rows. Keys
with more than ``SPREAD`` such rows are first looked at in joins, by ``forced``: where every row of the smaller side differs from
exactly one row of the other in a single field, and those have room, that pairing is the only one of least cost, and the key
needs no task of its own.

Defined cases: null equals only null; a null key is dropped; empty tables give rows of one side only; of several pairings of
least cost one is taken, the same in every run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, parallelism

#: Distinct left-over rows of a key beyond which its pairing is sought in joins first.
SPREAD = 5_000


def transport(a: np.ndarray, b: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> list[tuple[int, int, int]]:
    """(row of a, row of b, amount) of least total number of differing fields; as much is paired as the smaller side has.

    a, b: field codes, one row per distinct record. Any two rows may be paired at a cost of at most the number of fields, so
    shortest augmenting paths take that many lengths at most: for each length, potentials are raised by distances (by level, as
    costs are small whole numbers), and then augmenting paths of tight pairs are used up.
    """
    n, m = len(a), len(b)
    left, right = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    up, vp = np.zeros(n, np.int64), np.zeros(m, np.int64)
    flow: list[dict[int, int]] = [{} for _ in range(m)]
    far = np.iinfo(np.int64).max // 4

    def slack(i: int) -> np.ndarray:
        c = np.zeros(m, np.int64)
        for k in range(a.shape[1]):
            c += b[:, k] != a[i, k]
        return c + up[i] - vp

    def distances() -> bool:
        du, dv = np.where(left > 0, 0, far), np.full(m, far)
        done_u, done_v = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            level = min(du[~done_u].min(initial=far), dv[~done_v].min(initial=far))
            if level >= far:
                return False
            while len(now := np.flatnonzero((du == level) & ~done_u)) or len(to := np.flatnonzero((dv == level) & ~done_v)):
                for i in now:
                    done_u[i] = True
                    np.minimum(dv, level + slack(i), out=dv)
                if len(now):
                    continue
                for j in to:
                    done_v[j] = True
                    for i in flow[j]:
                        du[i] = min(du[i], level)
            if ((dv == level) & (right > 0)).any():
                up[:] += np.minimum(du, level)
                vp[:] += np.minimum(dv, level)
                return True

    def augment() -> None:
        tight: dict[int, np.ndarray] = {}
        moved = True
        while moved:
            moved, seen = False, np.zeros(m, bool)
            for start in np.flatnonzero(left > 0):
                while left[start] > 0 and (path := search(int(start), seen, tight)):
                    amount = min(left[start], right[path[-1][1]], *(flow[j][i] for i, (_, j) in zip((x[0] for x in path[1:]), path)))
                    left[start] -= amount
                    right[path[-1][1]] -= amount
                    for k, (i, j) in enumerate(path):
                        flow[j][i] = flow[j].get(i, 0) + amount
                        if k + 1 < len(path):
                            nxt = path[k + 1][0]
                            flow[j][nxt] -= amount
                            if not flow[j][nxt]:
                                del flow[j][nxt]
                    moved = True

    def search(start: int, seen: np.ndarray, tight: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        """A path start - j - i - j' ... to a row with demand left, as (i, j) steps; rights once seen lead nowhere."""
        stack: list[tuple[int, list[tuple[int, int]]]] = []  # per level: the left row, and (right, next left) to try

        def steps(i: int) -> list[tuple[int, int]]:
            if i not in tight:
                tight[i] = np.flatnonzero(slack(i) == 0)
            js = tight[i][~seen[tight[i]]]
            open_ = js[right[js] > 0]
            if len(open_):
                return [(int(open_[0]), -1)]
            seen[js] = True
            return [(int(j), x) for j in js[::-1] for x in sorted(flow[j], reverse=True) if x != i]

        stack.append((start, steps(start)))
        while stack:
            i, todo = stack[-1]
            if not todo:
                stack.pop()
                if stack:
                    stack[-1][1].pop()
                continue
            j, nxt = todo[-1]
            if nxt < 0:
                return [(x, t[-1][0]) for x, t in stack]
            stack.append((nxt, steps(nxt)))
        return []

    while left.any() and right.any() and distances():
        augment()
    return [(i, j, int(k)) for j, x in enumerate(flow) for i, k in sorted(x.items())]


def _codes(columns: list[pa.Array]) -> np.ndarray:
    """Numbers of the values, by column; null is a value of its own."""
    coded = [pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in columns]
    return np.stack(coded, axis=1).astype(np.int64)


def differences(t: pa.Table, fields: list[str]) -> list[tuple[str, str, int]]:
    """(field, diff, n) of one key's left-over rows: the fields as f0, f1, ..., and n_left and n_right, one of which is zero."""
    t = t.combine_chunks()
    l, r = (t.column(c).to_numpy() for c in ("n_left", "n_right"))  # noqa: E741
    codes = _codes([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column(f"f{k}") for k in range(len(fields)))])
    at, bt = np.flatnonzero(l), np.flatnonzero(r)
    count = dict.fromkeys(fields, 0)
    paired = 0
    for i, j, n in transport(codes[at], codes[bt], l[at], r[bt]):
        paired += n
        for k in np.flatnonzero(codes[at[i]] != codes[bt[j]]):
            count[fields[k]] += n
    alone = [("*", "left_only", int(l.sum()) - paired), ("*", "right_only", int(r.sum()) - paired)]
    return [x for x in [*((f, "differs", n) for f, n in count.items()), *alone] if x[2]]


def _solving(fields: list[str]):
    """Batches come sorted by key and row; each key's rows are gathered and solved."""

    def run(batches):
        held: list[pa.Table] = []
        out: list[tuple] = []

        def solve():
            t = pa.concat_tables(held)
            key = t.column("key")[0].as_py()
            out.extend((key, *x) for x in differences(t, fields))
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            key = b.column(b.schema.names.index("key"))
            turns = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1
            edges = [0, *turns.tolist(), b.num_rows]
            for s, e in zip(edges, edges[1:]):
                if held and held[-1].column("key")[0] != key[s]:
                    solve()
                held.append(t.slice(s, e - s))
            if out:
                yield _result(out)
                out = []
        if held:
            solve()
        if out:
            yield _result(out)

    return run


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "field", "diff", "n"])


def _plain(df: DataFrame, k: int) -> Column:
    """A field of the row as a value that Arrow can number: nested ones as JSON text, null staying null."""
    f = df.schema["row"].dataType.fields[k]
    c = F.col("row")[f.name]
    nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
    return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"})).alias(f"f{k}") if nested else c.alias(f"f{k}")


def forced(rest: DataFrame, keys: DataFrame, fields: list[str]) -> DataFrame:
    """(key, field, diff, n) of those keys whose pairing of least cost is forced; others give no row.

    rest (key, row, n_left, n_right): left-over rows, none of which both sides have, so that a pair costs one at least. keys (key,
    n_left, n_right). Rows meet by all their fields but one; a row that so meets one row of the other side in all has one
    partner at cost one and none other.
    """
    names = rest.schema["row"].dataType.names
    small = rest.join(keys.select("key", (F.col("n_left") <= F.col("n_right")).alias("by_left"), F.abs(F.col("n_left") - F.col("n_right")).alias("over")), "key")
    mine = F.when(F.col("by_left"), F.col("n_left")).otherwise(F.col("n_right"))
    small = small.withColumns({"mine": mine, "room": F.col("n_left") + F.col("n_right") - mine})
    but = lambda k: F.struct(F.lit(k).alias("k"), F.col("row").withField(names[k], F.lit(None).cast(rest.schema["row"].dataType[names[k]].dataType)).alias("others"))
    spread = small.withColumn("hub", F.explode(F.array(*map(but, range(len(fields))))))
    met = spread.filter("room > 0").groupBy("key", "hub").agg(F.count("*").alias("met"), F.max("row").alias("partner"))
    mine = spread.filter("mine > 0").select("key", "row", "mine", "by_left", "over", "hub").join(met, ["key", "hub"], "left")
    one = mine.groupBy("key", "row").agg(F.max("mine").alias("mine"), F.max("by_left").alias("by_left"), F.max("over").alias("over"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"), F.max("partner").alias("partner"), F.max(F.when(F.col("met") > 0, F.col("hub.k"))).alias("k"))
    room = small.filter("room > 0").select("key", F.col("row").alias("partner"), "room")
    full = one.groupBy("key", "partner").agg(F.sum("mine").alias("asked"), F.max("met").alias("met"), F.min("met").alias("least")).join(room, ["key", "partner"], "left")
    good = full.groupBy("key").agg(F.bool_and(F.coalesce((F.col("met") == 1) & (F.col("least") == 1) & (F.col("asked") <= F.col("room")), F.lit(False))).alias("good")).filter("good").select("key")
    pairs = one.join(good, "key", "left_semi")
    name = F.element_at(F.array(*map(F.lit, fields)), F.col("k") + 1)
    differ = pairs.groupBy("key", name.alias("field")).agg(F.sum("mine").alias("n")).select("key", "field", F.lit("differs").alias("diff"), "n")
    alone = pairs.filter("over > 0").select("key", F.lit("*").alias("field"), F.when(F.col("by_left"), "right_only").otherwise("left_only").alias("diff"), F.col("over").alias("n")).distinct()
    return differ.unionByName(alone)


def reconcile(left: DataFrame, right: DataFrame, key: str, fields: list[str], records: bool = False) -> DataFrame:
    """(key, field, diff, n): n rows of the key that differ in a field, or that one side has alone (field ``*``).

    left, right: the BINARY key and the fields, normalised to comparable values. Other columns are ignored; any names will do.
    """
    side = lambda df, l, r: df.select(F.col(key).alias("key"), F.struct(*(F.col(f).alias(f"f{k}") for k, f in enumerate(fields))).alias("row"), F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731, E741
    both = side(left, 1, 0).unionByName(side(right, 0, 1))
    counted = both.filter("key IS NOT NULL").groupBy("key", "row").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    counted = counted.withColumns({"n_left": F.greatest(F.col("l") - F.col("r"), F.lit(0)), "n_right": F.greatest(F.col("r") - F.col("l"), F.lit(0))})
    over = lambda c: F.when(F.col(c) > 0, F.col("row"))
    by_key = counted.groupBy("key").agg(
        F.sum("l").alias("in_left"),
        F.sum("r").alias("in_right"),
        F.count_if(F.col("n_left") > 0).alias("kinds_left"),
        F.count_if(F.col("n_right") > 0).alias("kinds_right"),
        F.sum("n_left").alias("n_left"),
        F.sum("n_right").alias("n_right"),
        F.max(over("n_left")).alias("a"),
        F.max(over("n_right")).alias("b"),
    )
    by_key = cut(by_key.filter("kinds_left + kinds_right > 0"))  # keys with a difference
    single = "kinds_left <= 1 AND kinds_right <= 1 OR kinds_left = 0 OR kinds_right = 0"
    n, met = F.least("n_left", "n_right"), F.col("kinds_left") * F.col("kinds_right") > 0
    cell = lambda when, field, diff, n: F.when(when, F.struct(F.lit(field).alias("field"), F.lit(diff).alias("diff"), n.alias("n")))
    cells = [cell(met & ~F.col("a")[f"f{k}"].eqNullSafe(F.col("b")[f"f{k}"]), f, "differs", n) for k, f in enumerate(fields)]
    cells += [cell(F.col("n_left") > n, "*", "left_only", F.col("n_left") - n), cell(F.col("n_right") > n, "*", "right_only", F.col("n_right") - n)]
    plain = by_key.filter(single).select("key", "in_left", "in_right", F.explode(F.array_compact(F.array(*cells))).alias("x")).select("key", "x.*", "in_left", "in_right")
    many = by_key.filter(f"NOT ({single})").select("key", "n_left", "n_right", "kinds_left", "kinds_right")
    out = plain
    if records:
        out = out.filter("diff = 'differs' OR in_left = 0 OR in_right = 0")
    out = out.drop("in_left", "in_right")
    if many.isEmpty():
        return out
    rest = counted.filter("l <> r").join(many.select("key"), "key", "left_semi").select("key", "row", "n_left", "n_right")
    large = many.filter(F.col("kinds_left") + F.col("kinds_right") > SPREAD)
    if not large.isEmpty():
        rest = cut(rest)
        settled = cut(forced(rest.join(large.select("key"), "key", "left_semi"), large, fields))
        rest = rest.join(settled.select("key").distinct(), "key", "left_anti")
        out = out.unionByName(settled.filter("diff = 'differs'") if records else settled)
    rest = rest.repartition(parallelism(left.sparkSession), "key").sortWithinPartitions("key", "row")
    solved = rest.select("key", *(_plain(rest, k) for k in range(len(fields))), "n_left", "n_right").mapInArrow(_solving(fields), "key binary, field string, diff string, n bigint")
    return out.unionByName(solved.filter("diff = 'differs'") if records else solved)
