"""Lineages of repeated and changing facts within scopes (conversations).

A record's body that is new to its scope opens a lineage, or, where the extractor gave subject and value, rests on the subject's
head if that has the same value. A body seen before is its old lineage while that is the head of its subject, else the value
came back and a new lineage is minted. A minted lineage supersedes its subject's head, and is valid from its session's instant.

Subjects are walked apart: which subject a body belongs to is settled by the body's first record, so the walk of one subject
needs no other. Records stream sorted through the tasks; a walk keeps one entry per body of its subject. Lineages and subjects
are numbered through their scope by counts per range of records, not by walking it.

Defined cases: records without scope or place are dropped; a null body is a body; blanks around a given subject and its letter
case do not matter; a record without subject has one of its own per body; repeated rows of one place count once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..session import cut, parallelism

# Fixed value: a token that reads as a value.
VALUE_TOKEN = r"^[+-]?[$€£¥]?\d[\d.,:/\-]*[a-z%°]{0,4}[.!?]?$"
#: Records of a scope that share one count.
RANGE = 4096


def plain_subject(c: Column) -> Column:
    return F.lower(squeezed(c))


def trailing_value_subject(text: Column) -> Column:
    """The words before a trailing value ("my best is 22:00" is about "my best is"); null where no value ends the text."""
    t = plain_subject(text)
    last = F.substring_index(t, " ", -1)
    return F.when((F.instr(t, " ") > 0) & last.rlike(VALUE_TOKEN.replace(r"\d", r"\p{Nd}")), F.left(t, F.char_length(t) - F.char_length(last) - 1))


def corpus_instant(raw: Column) -> Column:
    """``2023/05/25 (Thu) 20:21`` as 2023-05-25T20:21:00Z, null for anything else; the weekday is not looked at."""
    return F.when(raw.rlike(r"^\s*\d{4}/\d{2}/\d{2}\s*(\([^)]*\))?\s*\d{2}:\d{2}\s*$"), F.regexp_replace(raw, r"^\s*(\d{4})/(\d{2})/(\d{2})\s*(?:\([^)]*\))?\s*(\d{2}:\d{2})\s*$", "$1-$2-$3T$4:00Z"))


WALKED = pa.schema([("scope", pa.string()), ("subject", pa.string()), ("seq", pa.int64()), ("body", pa.string()), ("minted", pa.bool_()), ("node", pa.int64()), ("over", pa.int64()), ("object", pa.string())])


def _walk(batches):
    """Per record, in order of scope, subject and place: the place of the record that minted its lineage, and of the one superseded."""
    here = None
    head: tuple[int, str | None] | None = None
    bodies: dict[str | None, tuple[int, str | None]] = {}
    for b in batches:
        rows = []
        for scope, subject, own, seq, body, value, given in zip(*(b.column(b.schema.names.index(c)).to_pylist() for c in ("scope", "subject", "own", "seq", "body", "value", "given"))):
            if (scope, subject, own) != here:
                here, head, bodies = (scope, subject, own), None, {}
            known, over = bodies.get(body), None
            if known is not None and known[0] == head[0]:
                minted, node = False, known
            elif known is None and given and head is not None and head[1] == value:
                minted, node = False, head
            else:
                minted, node = True, (seq, known[1] if known else value if given else body)
                over, head = head[0] if head else None, node
            bodies[body] = node
            rows.append((scope, subject, seq, body, minted, node[0], over, node[1]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), WALKED)], schema=WALKED)


def _numbered(rows: DataFrame, counted: Column, name: str) -> DataFrame:
    """Adds how many rows before each one in its scope are counted, by counts per range of places."""
    rows = rows.withColumns({"_range": F.floor(F.col("seq") / RANGE), "_one": counted.cast("long")})
    per = rows.groupBy("scope", "_range").agg(F.sum("_one").alias("_n"))
    before = Window.partitionBy("scope").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("scope", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("scope", "_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, ["scope", "_range"]).withColumn(name, F.col("_start") + F.coalesce(F.sum("_one").over(within), F.lit(0))).drop("_range", "_one", "_start")


def link(records: DataFrame) -> DataFrame:
    """(scope, seq, claim_id, subject, object, supersedes, valid_from, minted) of records (scope STRING, seq BIGINT, body, subject,
    value, occurred_at): subject and value as the extractor gave them, both null for free text, whose subject is read from it."""
    r = records.filter("scope IS NOT NULL AND seq IS NOT NULL").groupBy("scope", "seq").agg(F.min(F.struct("body", "subject", "value", "occurred_at")).alias("x")).select("scope", "seq", "x.*")
    r = r.withColumn("body", squeezed(F.col("body")))
    given = F.when(F.trim("subject") != "", plain_subject(F.col("subject")))
    r = r.withColumns({"given": given.isNotNull(), "subject": F.coalesce(given, trailing_value_subject(F.col("body"))), "value": F.trim(F.coalesce("value", F.lit("")))})
    first = r.groupBy("scope", "body").agg(F.min_by(F.struct("subject", "given"), "seq").alias("f")).select("scope", F.col("body").alias("_b"), F.col("f.subject").alias("_s"))
    r = r.join(first, (r["scope"] == first["scope"]) & r["body"].eqNullSafe(F.col("_b"))).drop(first["scope"])
    r = r.withColumns({"subject": F.col("_s"), "own": F.when(F.col("_s").isNull(), F.coalesce("body", F.lit("")))})
    r = cut(r.select("scope", "subject", "own", "seq", "body", "value", "given", "occurred_at"))
    laid = r.repartition(parallelism(r.sparkSession), "scope", "subject", "own").sortWithinPartitions("scope", "subject", "own", "seq")
    kind = "scope string, subject string, seq bigint, body string, minted boolean, node bigint, over bigint, object string"
    walked = cut(laid.drop("occurred_at").mapInArrow(_walk, kind))
    minted = walked.filter("minted").select("scope", "subject", "seq", F.col("over").isNull().alias("opens"))
    ids = _numbered(_numbered(minted, F.lit(1), "n"), F.col("opens"), "s")
    number = ids.select("scope", F.col("seq").alias("node"), "n", F.when(F.col("subject").isNull(), F.col("s")).alias("s"))
    name = lambda letter, c: F.concat("scope", F.lit(f"#{letter}"), F.lpad(c.cast("string"), 5, "0"))
    out = walked.join(number, ["scope", "node"]).join(number.select("scope", F.col("node").alias("over"), F.col("n").alias("n_over")), ["scope", "over"], "left")
    when = r.select("scope", F.col("seq").alias("node"), "occurred_at")
    out = out.join(when, ["scope", "node"])
    return out.select(
        "scope", "seq", name("C", F.col("n")).alias("claim_id"), F.coalesce("subject", name("S", F.col("s"))).alias("subject"), "object", "minted", F.when(F.col("over").isNotNull(), name("C", F.col("n_over"))).alias("supersedes"),
        F.when(F.col("over").isNotNull() & (F.col("occurred_at") != ""), F.col("occurred_at")).alias("valid_from"), "body",
    )


def with_edges(linked: DataFrame) -> DataFrame:
    """Every record with the edge and the instant of its lineage: restatements carry what the lineage was minted with."""
    node = linked.filter("minted").select("scope", "claim_id", F.col("supersedes").alias("s"), F.col("valid_from").alias("v"))
    return linked.drop("supersedes", "valid_from").join(node, ["scope", "claim_id"]).withColumnsRenamed({"s": "supersedes", "v": "valid_from"})


def stats(linked: DataFrame) -> DataFrame:
    """Per scope: records, lineages, subjects, supersedes_edges, updated_subjects, restatement_groups."""
    edge = F.col("minted") & F.col("supersedes").isNotNull()
    per = linked.groupBy("scope").agg(F.count("*").alias("records"), F.count_if("minted").alias("lineages"), F.count_if(F.col("minted") & F.col("supersedes").isNull()).alias("subjects"), F.count_if(edge).alias("supersedes_edges"))
    moved = linked.filter(edge).select("scope", "subject").distinct().groupBy("scope").agg(F.count("*").alias("updated_subjects"))
    again = linked.groupBy("scope", "body").agg(F.count("*").alias("n")).filter("n > 1").groupBy("scope").agg(F.count("*").alias("restatement_groups"))
    return per.join(moved, "scope", "left").join(again, "scope", "left").na.fill(0, ["updated_subjects", "restatement_groups"])
