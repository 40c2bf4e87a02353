"""Schemas that drift between files.

Each file of JSON lines has a schema: the fields it fills and the JSON types they take, with a fingerprint over both.
``registry`` keeps one row per file: its fingerprint, its version in its feed (which goes up whenever the fingerprint changes),
and the migration steps from the version before: ``added``, ``removed``, ``renamed``, ``retyped``. Files with the fingerprint of
the file before them have no step and are not read again; of the others, only gone and new fields are, to tell renames.

``rules`` chains the steps of a feed into one rule per file: a field keeps the name under which it first came, so that feeds
that renamed it in different ways agree, and has one type in all feeds, the one most files give it. ``consistent_table`` routes
every record through its file's rule (rename, default, cast) and records what was done to it.

Defined cases: a line counts only if it is one whole JSON object (NaN, Infinity and a cut or trailing text do not; of a
repeated key the last value counts); null values are absent; a file without valid lines has no fields; lines without package
take no part in finding renames; a package whose lines of one file disagree on a field supports no rename of it. Numbers keep
all their digits. Records with null feed, file or sequence are dropped. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import uuid_key
from ..session import cut

MIN_PACKAGES = 3
#: Files whose gone and new fields are broadcast to the second reading; beyond, lines are joined to them by a shuffle.
BROADCAST_FILES = 20_000


class Number:
    """A JSON number as it is written."""

    __slots__ = ("text",)

    def __init__(self, text: str):
        self.text = text

    def normal(self) -> str:
        """One text for equal numbers: digits without zeros at either end, and the power of ten of the last. Never expanded."""
        sign, whole, part, power = _NUMBER.fullmatch(self.text).groups()
        part = part or ""
        digits = (whole + part).lstrip("0")
        short = digits.rstrip("0")
        if not short:
            return "0"
        shift = len(digits) - len(short) - len(part)
        if power and len(power) > 4000:
            return f"{sign}{short}e{power}+{shift}"
        return f"{sign}{short}e{int(power or 0) + shift}"


_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d*))?(?:[eE]([+-]?\d+))?")


def _refuse(_: str):
    raise ValueError


_DECODER = json.JSONDecoder(parse_float=Number, parse_int=Number, parse_constant=_refuse)


def parse_object(text: str | None) -> dict | None:
    """The object that a line holds whole, else null."""
    if text is None:
        return None
    try:
        v = _DECODER.decode(text.strip(" \t\r\n"))
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def json_type(v: object) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, dict):
        return "object"
    return "array" if isinstance(v, list) else "number"


def json_text(v: object, normal: bool = False) -> str:
    """JSON with sorted keys; numbers as written, or ``normal`` so that equal values have equal texts."""
    if isinstance(v, Number):
        return v.normal() if normal else v.text
    if isinstance(v, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {json_text(v[k], normal)}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ", ".join(json_text(x, normal) for x in v) + "]"
    return json.dumps(v, ensure_ascii=False)


def value_key(v: object) -> bytes:
    """Equal for equal JSON values of one type only: key order does not matter, nor how a number is written."""
    return hashlib.blake2b((json_type(v) + json_text(v, normal=True)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def fields_of(o: dict) -> dict[str, object]:
    """The non-null top-level keys, and those inside ``extensions`` as ``extensions.key``."""
    out = {k: v for k, v in o.items() if v is not None}
    if isinstance(e := o.get("extensions"), dict):
        out |= {f"extensions.{k}": v for k, v in e.items() if v is not None}
    return out


def _utf8(x: str) -> str:
    return x.encode("utf-8", "replace").decode("utf-8")


def _typing(batches):
    """The distinct (file, field, type) of each batch; a file without any still gives a row, with nulls."""
    for b in batches:
        c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        rows = set()
        for feed, seq, name, text in zip(c["feed"], c["file_seq"], c["file_name"], c["payload"]):
            rows.add((feed, seq, name, None, None))
            if (o := parse_object(text)) is not None:
                rows.update((feed, seq, name, _utf8(k), json_type(v)) for k, v in fields_of(o).items())
        cols = list(zip(*rows)) or [[]] * 5
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], ["feed", "file_seq", "file_name", "field", "type"])


FILE = ["feed", "file_seq", "file_name"]
STEP = "struct<change:string,field:string,old_field:string,old_types:array<string>,new_types:array<string>>"
FIELDS = "array<struct<field:string,types:array<string>>>"


def _whole(raw: DataFrame) -> DataFrame:
    return raw.filter("feed IS NOT NULL AND file_seq IS NOT NULL AND file_name IS NOT NULL")


def file_schemas(raw: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, fields, fingerprint, version, and of the file before it old_seq, old_name, old_fields)."""
    typed = _whole(raw).select(*FILE, "payload").mapInArrow(_typing, "feed string, file_seq int, file_name string, field string, type string")
    per_field = typed.groupBy(*FILE, "field").agg(F.array_sort(F.collect_set("type")).alias("types"))
    fields = F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "types"))))
    s = per_field.groupBy(*FILE).agg(fields.alias("fields")).withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))
    w = Window.partitionBy("feed").orderBy("file_seq", "file_name")  # one row per file of a feed, never records
    s = s.withColumns({"old_seq": F.lag("file_seq").over(w), "old_name": F.lag("file_name").over(w), "old_fields": F.lag("fields").over(w), "moved": (~F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w))).cast("int")})
    return s.withColumn("version", F.sum("moved").over(w))


def _reading(batches):
    """(step, side, package, field, value) of the wanted fields: those gone after a line's file, and those new in it."""
    names = ["step", "old", "package", "field", "value"]
    kinds = (pa.string(), pa.bool_(), pa.string(), pa.string(), pa.binary())
    for b in batches:
        c = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        rows = set()
        for text, wanted in zip(c["payload"], c["wanted"]):
            o = parse_object(text)
            if o is None or not isinstance(p := o.get("package_id"), str):
                continue
            have = {_utf8(k): v for k, v in fields_of(o).items()}
            keys: dict[str, bytes] = {}
            for w in wanted:
                for f in w["fields"]:
                    if f in have:
                        if f not in keys:
                            keys[f] = value_key(have[f])
                        rows.add((w["step"], w["old"], _utf8(p), f, keys[f]))
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names)


def _renames(raw: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, f, g): gone fields f and new fields g that have equal values in all packages that have both, at least three."""
    both = steps.filter("size(gone) > 0 AND size(new) > 0")
    ask = lambda seq, name, old, fields: F.struct("feed", F.col(seq).alias("file_seq"), F.col(name).alias("file_name"), F.col("file_name").alias("step"), F.lit(old).alias("old"), F.transform(fields, lambda x: x["field"]).alias("fields"))
    asked = both.select(F.explode(F.array(ask("old_seq", "old_name", True, "gone"), ask("file_seq", "file_name", False, "new"))).alias("x")).select("x.*")
    wanted = cut(asked.groupBy(*FILE).agg(F.collect_list(F.struct("step", "old", "fields")).alias("wanted")))
    n = wanted.count()
    lines = _whole(raw).select(*FILE, "payload").join(F.broadcast(wanted) if n <= BROADCAST_FILES else wanted, FILE)
    values = lines.select("payload", "wanted").mapInArrow(_reading, "step string, old boolean, package string, field string, value binary")
    values = values.withColumn("package", uuid_key("package")).filter("package IS NOT NULL")
    per = values.groupBy("step", "package", "old", "field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    held = per.groupBy("step", "package").agg(F.collect_list(F.struct("old", "field", "lo", "hi")).alias("x"))  # fields of one package
    pairs = held.select("step", F.explode(F.filter("x", lambda y: y["old"])).alias("o"), "x").select("step", "o", F.explode(F.filter("x", lambda y: ~y["old"])).alias("n"))
    same = (F.col("o.lo") == F.col("o.hi")) & (F.col("o.lo") == F.col("n.lo")) & (F.col("o.lo") == F.col("n.hi"))
    found = pairs.groupBy("step", F.col("o.field").alias("f"), F.col("n.field").alias("g")).agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"))
    return found.filter(f"n >= {MIN_PACKAGES} AND n = n_same").select("step", "f", "g")


def registry(raw: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, version, fingerprint, fields, steps): the schema of each file and the steps that lead to it.

    file_name must be unique. Gone fields without rename are ``removed``, new ones ``added``; the first file of a feed has no step.
    """
    files = cut(file_schemas(raw))
    lacks = lambda fields, other: F.filter(fields, lambda x: ~F.exists(other, lambda y: y["field"] == x["field"]))
    moved = files.filter("moved = 1 AND old_fields IS NOT NULL").withColumns({"gone": lacks("old_fields", F.col("fields")), "new": lacks("fields", F.col("old_fields"))})
    pairs = _renames(raw, moved).groupBy("step").agg(F.collect_list(F.struct("f", "g")).alias("renames"))
    s = moved.join(pairs.withColumnRenamed("step", "file_name"), "file_name", "left").withColumn("renames", F.coalesce("renames", F.array().cast("array<struct<f:string,g:string>>")))
    types = lambda fields, name: F.get(F.filter(fields, lambda x: x["field"] == name), F.lit(0))["types"]
    none = F.lit(None)

    def step(change: str, field, old_field, old_types, new_types):
        return F.struct(F.lit(change).alias("change"), field.alias("field"), old_field.cast("string").alias("old_field"), old_types.cast("array<string>").alias("old_types"), new_types.cast("array<string>").alias("new_types"))

    named = lambda side: F.transform("renames", lambda r: r[side])
    renamed = F.transform("renames", lambda r: step("renamed", r["g"], r["f"], types("old_fields", r["f"]), types("fields", r["g"])))
    removed = F.transform(F.filter("gone", lambda x: ~F.array_contains(named("f"), x["field"])), lambda x: step("removed", x["field"], x["field"], x["types"], none))
    added = F.transform(F.filter("new", lambda x: ~F.array_contains(named("g"), x["field"])), lambda x: step("added", x["field"], none, none, x["types"]))
    stayed = F.filter("fields", lambda x: F.exists("old_fields", lambda y: (y["field"] == x["field"]) & (y["types"] != x["types"])))
    retyped = F.transform(stayed, lambda x: step("retyped", x["field"], x["field"], types("old_fields", x["field"]), x["types"]))
    steps = s.select("file_name", F.array_sort(F.concat(renamed, removed, added, retyped)).alias("steps"))
    out = files.join(steps, "file_name", "left").withColumn("steps", F.coalesce("steps", F.array().cast(f"array<{STEP}>")))
    return out.select(*FILE, "version", "fingerprint", "fields", "steps")


def changes(known: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, change, field, old_field, old_types, new_types): the steps of a registry, one a row."""
    return known.select(*FILE, F.explode("steps").alias("s")).select(*FILE, "s.*")


def _chained(pdf):
    """Per file of a feed the name that each of its fields first had. A name that is left and comes back is the old field,
    unless that lives on under another name; then the new one gets a number."""
    import pandas as pd

    pdf = pdf.sort_values(["file_seq", "file_name"], kind="stable").reset_index(drop=True)
    names: dict[str, str] = {}
    out = []
    for fields, steps in zip(pdf["fields"], pdf["steps"]):
        source = {s["field"]: s["old_field"] for s in steps if s["change"] == "renamed"}
        now: dict[str, str] = {}
        here = [x["field"] for x in fields]
        for f in here:
            origin = names.get(source.get(f, f))
            if origin is not None and origin not in now.values():
                now[f] = origin
        for f in here:
            if f not in now:
                k, taken = 1, set(now.values())
                while (f if k == 1 else f"{f}@{k}") in taken:
                    k += 1
                now[f] = f if k == 1 else f"{f}@{k}"
        names = now
        out.append([{"field": f, "origin": now[f]} for f in sorted(now)])
    return pd.DataFrame({"feed": pdf["feed"], "file_seq": pdf["file_seq"], "file_name": pdf["file_name"], "names": out})


def rules(known: DataFrame) -> DataFrame:
    """(feed, file_seq, file_name, rule): rule lists, for each field of all feeds by its first name (origin), the type that all
    records get (to) and the field that gives it in this file, null where it has none and the default, null, is taken.

    The type of a field is the one that most files give it alone; ties go to the first in the alphabet; without any it is mixed.
    """
    chained = known.select(*FILE, "fields", "steps").groupBy("feed").applyInPandas(_chained, "feed string, file_seq int, file_name string, names array<struct<field:string,origin:string>>")
    chained = cut(chained)
    named = chained.select(*FILE, F.explode("names").alias("n")).select(*FILE, "n.field", "n.origin")
    typed = named.join(known.select(*FILE, F.explode("fields").alias("x")).select(*FILE, "x.field", "x.types"), [*FILE, "field"])
    votes = typed.groupBy("origin", F.when(F.size("types") == 1, F.col("types")[0]).alias("type")).agg(F.count("*").alias("n"))
    to = votes.groupBy("origin").agg(F.min_by("type", F.when(F.col("type").isNotNull(), F.struct(-F.col("n"), "type"))).alias("to"))
    target = to.agg(F.array_sort(F.collect_list(F.struct("origin", F.coalesce("to", F.lit("mixed")).alias("to")))).alias("target"))  # one row: the fields of all feeds
    source = lambda o: F.get(F.filter("names", lambda n: n["origin"] == o), F.lit(0))["field"]
    return chained.crossJoin(F.broadcast(target)).select(*FILE, F.transform("target", lambda t: F.struct(source(t["origin"]).alias("field"), t["origin"].alias("origin"), t["to"].alias("to"))).alias("rule"))


_FAILED = object()


def cast_json(v: object, to: str) -> object:
    """A value in another JSON type, or ``_FAILED`` where that would lose something."""
    t = json_type(v)
    if t == to or to == "mixed":
        return v
    if to == "string":
        return json_text(v)
    if to == "number" and t == "string":
        return Number(v.strip()) if re.fullmatch(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?", v.strip()) else _FAILED
    if to == "boolean" and t == "string" and v.strip().lower() in ("true", "false"):
        return v.strip().lower() == "true"
    return [v] if to == "array" else _FAILED


ROUTED = "raw_id bigint, feed string, file_name string, file_seq int, line_no int, package_id string, fields map<string,string>, changes array<struct<field:string,change:string>>"


def _route(batches):
    keep = ["raw_id", "feed", "file_name", "file_seq", "line_no"]
    kinds = (pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.struct([("field", pa.string()), ("change", pa.string())])))
    for b in batches:
        at = {n: i for i, n in enumerate(b.schema.names)}
        codes = b.column(at["rule"])
        whole, packages, maps, done = [], [], [], []
        rule: list[dict] = []
        for i, (text, name) in enumerate(zip(b.column(at["payload"]).to_pylist(), b.column(at["file_name"]).to_pylist())):
            if not i or name != last:  # noqa: F821
                rule, last = codes[i].as_py(), name
            o = parse_object(text)
            whole.append(o is not None)
            if o is None:
                continue
            have = {_utf8(k): v for k, v in fields_of(o).items()}
            row, notes = {}, []
            for r in rule:
                v = have.get(r["field"]) if r["field"] is not None else None
                if v is None:
                    row[r["origin"]] = None
                    continue
                if r["field"] != r["origin"]:
                    notes.append({"field": r["origin"], "change": f"renamed from {r['field']}"})
                if (new := cast_json(v, r["to"])) is _FAILED:
                    notes.append({"field": r["origin"], "change": f"kept as {json_type(v)}, not {r['to']}"})
                    new = v
                elif new is not v:
                    notes.append({"field": r["origin"], "change": f"cast from {json_type(v)} to {r['to']}"})
                row[r["origin"]] = _utf8(json_text(new))
            p = o.get("package_id")
            packages.append(_utf8(p) if isinstance(p, str) else None)
            maps.append(sorted(row.items()))
            done.append(notes)
        mask = pa.array(whole, pa.bool_())
        yield pa.RecordBatch.from_arrays([*(b.column(at[n]).filter(mask) for n in keep), *(pa.array(x, k) for x, k in zip((packages, maps, done), kinds))], [*keep, "package_id", "fields", "changes"])


def consistent_table(raw: DataFrame) -> DataFrame:
    """(raw_id, feed, file_name, file_seq, line_no, package_id, fields, changes): every whole record under the names and types
    that all feeds share. fields maps each field to its JSON text, null by default; changes says what was renamed, cast, or
    kept in another type because a cast would lose something."""
    known = cut(registry(raw))
    rows = _whole(raw).select("raw_id", *FILE, "line_no", "payload").join(rules(known), FILE)
    return rows.select("raw_id", "feed", "file_name", "file_seq", "line_no", "payload", "rule").mapInArrow(_route, ROUTED)
