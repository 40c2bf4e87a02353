"""Replay of a change feed through a transition table.

Changes of one key do not commute, so they are folded in commit order; different keys never conflict and run in parallel. A
change is a function on the finite set of states, and functions compose, so a key's changes may be cut anywhere: the feed is
range-partitioned on (key, instant, id), each task folds the runs it holds into one function per key, and the few functions of
a key are composed in order. A key that holds a third of all changes is thus spread over many tasks.

Commit order and holds: each change carries its log and its line there. The changes of one log with the same instant are one
transaction, complete once the log has no gap up to its last line. A log's watermark is the last line before its first gap;
transactions beyond it are held until the feed is closed, when gaps are given up and what was held falls into its place.
Lines count as delivered whatever they carry, so a row that makes no change (no key, no instant, a repeated id) leaves no gap.

Defined cases: repeated deliveries of an id are one change, the first to arrive; ties in the instant go by id; changes without
key, id or instant are dropped; types that the table does not allow in a state (null and unknown ones included) change nothing;
changes without log or line are never held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, parallelism

# The lifecycle's transition table, (state, change) -> next state; "new" is the state before any change.
LIFECYCLE = {
    ("new", "create"): "active",
    ("new", "publish"): "active",
    ("draft", "revise"): "draft",
    ("draft", "publish"): "active",
    ("draft", "withdraw"): "withdrawn",
    ("active", "reaffirm"): "active",
    ("active", "revise"): "active",
    ("active", "supersede"): "superseded",
    ("active", "withdraw"): "withdrawn",
}


class Machine:
    """A transition table over named states; ``start`` is the state before any change."""

    def __init__(self, table: dict[tuple[str, str], str] = LIFECYCLE, start: str = "new"):
        self.states = [start, *sorted({s for (a, _), b in table.items() for s in (a, b)} - {start})]
        self.types = sorted({t for _, t in table})
        at = {s: i for i, s in enumerate(self.states)}
        self.moves = [[at[table.get((s, t), s)] for s in self.states] for t in self.types]

    def code(self, kind: Column) -> Column:
        """Number of a change's type, -1 for types that never change anything."""
        e = F.lit(-1)
        for i, t in enumerate(self.types):
            e = F.when(kind == t, i).otherwise(e)
        return e

    def name(self, state: Column) -> Column:
        """Name of a state by number, null for the start."""
        return F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, self.states[1:])), state + 1)


def changes(df: DataFrame, *, id: str, key: str, code: Column, ms: str, arrival: str, log: str | None = None, seq: str | None = None) -> DataFrame:
    """One change (id, key, code, ms, log, seq) per id: the first to arrive; then the smallest log and line."""
    extra = [F.col(c) if c else F.lit(None).cast(k) for c, k in ((log, "binary"), (seq, "bigint"))]
    rec = F.struct(F.col(arrival).isNull(), F.col(arrival), extra[0].alias("log"), extra[1].alias("seq"), F.col(key).alias("key"), code.cast("int").alias("code"), F.col(ms).alias("ms"))
    one = df.filter(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(rec).alias("r"))
    kept = ("key", "code", "ms", "log", "seq") if log else ("key", "code", "ms")
    return one.select("id", *(f"r.{c}" for c in kept)).filter("key IS NOT NULL AND ms IS NOT NULL")


def _log_ends(delivered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct lines (log, seq), and per log (log, first, last, n): a log without gap has as many lines as it is long."""
    lines = delivered.filter("log IS NOT NULL AND seq IS NOT NULL").select("log", "seq").distinct()
    return lines, lines.groupBy("log").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count("*").alias("n"))


def _before_gap(lines: DataFrame, broken: DataFrame, first_line: int) -> DataFrame:
    """(log, watermark) of logs with gaps. Each line is joined to the next, which spreads a hot log over all tasks."""
    mine = lines.join(broken.select("log"), "log", "left_semi")
    ends = mine.join(mine.select("log", (F.col("seq") - 1).alias("seq")), ["log", "seq"], "left_anti").groupBy("log").agg(F.min("seq").alias("end"))
    return ends.join(broken, "log").select("log", F.when(F.col("first") == first_line, F.col("end")).otherwise(first_line - 1).alias("watermark"))


def watermarks(delivered: DataFrame, first_line: int = 1) -> DataFrame:
    """(log, watermark) of delivered rows (log, seq): the last line of each log before its first gap, first_line - 1 if the log's
    start is missing."""
    lines, logs = _log_ends(delivered)
    whole = (F.col("first") == first_line) & (F.col("last") - F.col("first") + 1 == F.col("n"))
    return logs.filter(whole).select("log", F.col("last").alias("watermark")).unionByName(_before_gap(lines, logs.filter(~whole), first_line))


def mark_held(changes: DataFrame, delivered: DataFrame, first_line: int = 1) -> DataFrame:
    """Adds ``held``: whether the change's transaction reaches beyond its log's watermark.

    delivered (log, seq): all lines that arrived, whatever they carry. Only changes of logs with gaps are looked at again.
    """
    lines, logs = _log_ends(delivered)
    broken = cut(logs.filter((F.col("first") != first_line) | (F.col("last") - F.col("first") + 1 != F.col("n"))))
    if broken.isEmpty():
        return changes.withColumn("held", F.lit(False))
    marks = _before_gap(lines, broken, first_line)
    last = changes.join(broken.select("log"), "log", "left_semi").groupBy("log", "ms").agg(F.max("seq").alias("last_line"))
    beyond = last.join(marks, "log").filter("last_line > watermark").select("log", "ms", F.lit(True).alias("held"))
    return changes.join(beyond, ["log", "ms"], "left").withColumn("held", F.coalesce("held", F.lit(False)))


def _folder(machine: Machine, held: bool):
    """Composes each key's run of changes into one function on states. Functions are numbered as they turn up, at most one for
    every map of states to states, so a change is one look-up."""
    identity = tuple(range(len(machine.states)))

    def fold(batches):
        functions, number = [identity], {identity: 0}
        after: dict[tuple[int, int], int] = {}

        def then(f: int, code: int) -> int:
            if (f, code) not in after:
                g = tuple(machine.moves[code][s] for s in functions[f])
                if g not in number:
                    number[g] = len(functions)
                    functions.append(g)
                after[f, code] = number[g]
            return after[f, code]

        key = first = None
        f = g = n = m = 0
        out: dict[str, list] = {c: [] for c in ("key", "ms", "id", "f", "g", "n", "n_held")}

        def close():
            for c, v in zip(out, (key, *first, functions[f], functions[g], n, m)):
                out[c].append(v)

        for b in batches:
            if not b.num_rows:
                continue
            c = {x: b.column(i) for i, x in enumerate(b.schema.names)}
            turns = np.flatnonzero(pc.not_equal(c["key"][1:], c["key"][:-1]).to_numpy(zero_copy_only=False)) + 1
            codes = c["code"].to_numpy(zero_copy_only=False)
            holds = c["held"].to_numpy(zero_copy_only=False) if held else None
            for s, e in zip([0, *turns.tolist()], [*turns.tolist(), b.num_rows]):
                k = c["key"][s].as_py()
                if k != key or first is None:
                    if first is not None:
                        close()
                    key, first = k, (c["ms"][s].as_py(), c["id"][s].as_py())
                    f = g = n = m = 0
                n += e - s
                moving = codes[s:e] >= 0
                for x in codes[s:e][moving].tolist():
                    f = then(f, x)
                if held:
                    m += int(holds[s:e].sum())
                    for x in codes[s:e][moving & ~holds[s:e]].tolist():
                        g = then(g, x)
            if len(out["key"]) > 50_000:
                yield pa.RecordBatch.from_pydict(out, schema=RUNS)
                out = {c: [] for c in out}
        if first is not None:
            close()
        if out["key"]:
            yield pa.RecordBatch.from_pydict(out, schema=RUNS)

    return fold


RUNS = pa.schema([("key", pa.binary()), ("ms", pa.int64()), ("id", pa.binary()), ("f", pa.list_(pa.int32())), ("g", pa.list_(pa.int32())), ("n", pa.int64()), ("n_held", pa.int64())])


def replay(changes: DataFrame, machine: Machine, held: bool = False) -> DataFrame:
    """(key, state, n_changes) after all changes, as state number; with ``held`` also committed_state and n_held.

    ``changes`` as the function of that name gives them, through ``mark_held`` if ``held``.
    """
    order = ["key", "ms", "id"]
    laid = changes.select(*order, "code", *(["held"] if held else [])).repartitionByRange(parallelism(changes.sparkSession), *order).sortWithinPartitions(*order)
    runs = laid.mapInArrow(_folder(machine, held), "key binary, ms bigint, id binary, f array<int>, g array<int>, n bigint, n_held bigint")
    by_key = runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ms", "id", "f", "g"))).alias("runs"), F.sum("n").alias("n_changes"), F.sum("n_held").alias("n_held"))

    def through(part: str) -> Column:
        return F.aggregate("runs", F.lit(0), lambda s, r: F.element_at(r[part], s + 1))

    out = by_key.select("key", through("f").alias("state"), "n_changes", through("g").alias("committed_state"), "n_held")
    return out if held else out.select("key", "state", "n_changes")
