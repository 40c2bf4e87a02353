"""Readers of evaluation corpora and what stands beside them, structured extractions, and sinks of sorted JSON lines."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "question_id string, question_type string, question string, answer string, question_date string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<struct<role:string,content:string>>>"


def read_corpus(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """The questions of a file that is one JSON array of records; with ids (question_id) only those. A file is read by one task."""
    q = spark.read.schema(QUESTION).json(path, multiLine=True)
    return q if ids is None else q.join(ids.select("question_id").distinct(), "question_id", "left_semi")


class WrongDigest(ValueError):
    """A pinned file is not the one it is pinned to."""


def _whole(spark: SparkSession, path: str, digest: str | None) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    if digest is not None and text.select(F.sha2(F.encode("value", "utf-8"), 256)).first()[0] != digest:
        raise WrongDigest(path)
    return text


def read_labels(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """(question_id, value) of a file that maps question ids to lists of values; a question without values gives one null."""
    m = _whole(spark, path, digest).select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("question_id", "values"))
    return m.select("question_id", F.explode_outer("values").alias("value"))


def read_split(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    """(split, question_id, seed) of a frozen split's manifest."""
    m = _whole(spark, path, digest).select(F.from_json("value", "struct<seed:bigint,question_ids:map<string,array<string>>>").alias("m"))
    return m.select("m.seed", F.explode("m.question_ids").alias("split", "ids")).select("split", F.explode("ids").alias("question_id"), "seed")


def line_claims(sessions: DataFrame) -> DataFrame:
    """(session_id, line_no, id, text): one claim for each line of a session's text that is not blank."""
    lines = sessions.select("session_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).filter(F.btrim("text") != "")
    return lines.select("session_id", "line_no", F.concat("session_id", F.lit("#L"), F.lpad(F.col("line_no").cast("string"), 3, "0")).alias("id"), "text")


# The fields of an extracted claim.
CLAIM = ("text", "subject", "value")
_FENCE = re.compile(r"\s*```\w*\s*")


def _claims(text: str) -> list[dict] | None:
    body = "\n".join(x for x in text.split("\n") if not _FENCE.fullmatch(x)).strip()
    out, read = [], json.JSONDecoder()
    while body:
        try:
            record, end = read.raw_decode(body)
        except (ValueError, RecursionError):
            return None
        if not isinstance(record, dict) or set(record) - set(CLAIM) or not all(isinstance(record.get(f), str) and record[f].strip() for f in CLAIM):
            return None
        out.append({f: " ".join(record[f].split()) for f in CLAIM})
        body = body[end:].lstrip()
    return out or None


def extracted(c: Column) -> Column:
    """struct<code, claims> of completions that must be a stream of JSON objects with exactly a text, a subject and a value, none
    empty; lines of code fences are passed over. Anything else, and no claim at all, is E_EXTRACTION_FORMAT. Null gives nulls."""

    @F.pandas_udf("code string, claims array<struct<text:string,subject:string,value:string>>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for x in s:
            found = None if x is None else _claims(x)
            rows.append((None if found or x is None else "E_EXTRACTION_FORMAT", found))
        return pd.DataFrame(rows, columns=["code", "claims"])

    return run(c)


def sorted_lines(df: DataFrame, *order: str) -> DataFrame:
    """(value): rows as JSON with their fields by name, nulls included, in a total order of the columns named and then the text."""
    line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.withColumn("_line", line).orderBy(*order, "_line").select(F.col("_line").alias("value"))


def write_lines(df: DataFrame, path: str, *order: str) -> None:
    """Writes ``sorted_lines`` as one text file: for reports, not for tables."""
    sorted_lines(df, *order).coalesce(1).write.mode("overwrite").text(path)


def uuid7(instant: Column | None = None) -> Column:
    """A new UUID of version 7 per row, of an instant (now without one) and random bits."""
    ms = F.unix_millis(F.current_timestamp() if instant is None else instant)
    t = F.lower(F.lpad(F.hex(ms), 12, "0"))
    r = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.pmod(F.conv(F.substring(r, 1, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(t, 1, 8), F.substring(t, 9, 4), F.concat(F.lit("7"), F.substring(r, 2, 3)), F.concat(variant, F.substring(r, 5, 3)), F.substring(r, 18, 12))


def directory_digest(files: DataFrame) -> DataFrame:
    """(key, digest) of files (key, path, content): SHA-256 over the sorted paths and their contents' digests, each on a line."""
    line = F.struct("path", F.concat("path", F.lit("\n"), F.sha2("content", 256), F.lit("\n")).alias("line"))
    g = files.groupBy("key").agg(F.array_sort(F.collect_list(line)).alias("x"))
    return g.select("key", F.sha2(F.encode(F.array_join(F.transform("x", lambda l: l["line"]), ""), "utf-8"), 256).alias("digest"))
