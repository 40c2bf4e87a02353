"""Evaluation of answer sets: corpora and splits, sessions, comparisons between arms, agreement, and what a report needs.

Rows are (question_id, arm, ...). A null verdict or flag is no verdict; ties go by id; empty input gives zeros or no rows.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import squeezed
from .linking import corpus_instant


def ids_by_type(questions: DataFrame) -> DataFrame:
    """(question_type, ids): the sorted distinct ids of each type."""
    return questions.filter("question_type IS NOT NULL").groupBy("question_type").agg(F.array_sort(F.collect_set("question_id")).alias("ids"))


def ground_truth(a: DataFrame, b: DataFrame, expected: DataFrame) -> DataFrame:
    """(check, value): what keeps two copies of a corpus (question_id, question_type) from being the expected one, where expected
    (question_type, n) are its counts: rows and ids over or under, ids of one copy only, and types whose count differs."""
    n = expected.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("want"))  # one row
    size = lambda df, name: df.agg(F.count("*").alias("have")).crossJoin(n).select(F.lit(name).alias("check"), (F.col("have") - F.col("want")).alias("value"))
    ids = lambda df: df.select("question_id").distinct()
    only = lambda x, y, name: ids(x).join(ids(y), "question_id", "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("value"))
    types = a.groupBy("question_type").agg(F.count("*").alias("have")).join(expected, "question_type", "full_outer")
    moved = types.select(F.concat(F.lit("type "), "question_type").alias("check"), (F.coalesce("have", F.lit(0)) - F.coalesce("n", F.lit(0))).alias("value"))
    out = size(a, "rows a").unionByName(size(b, "rows b")).unionByName(size(ids(a), "ids a"))
    out = out.unionByName(only(a, b, "only a")).unionByName(only(b, a, "only b")).unionByName(moved)
    return out.filter("value <> 0")


def seeded_sample(ids: DataFrame, k: int, seed: int, most: int = 1_000_000) -> DataFrame:
    """(question_id) of k ids drawn from the sorted distinct ids with Python's seeded generator, as a frozen split wants it.

    The draw needs the pool's order, so the pool is held on the driver: more than ``most`` ids are refused.
    """
    pool = [r[0] for r in ids.select("question_id").distinct().limit(most + 1).collect()]
    if len(pool) > most:
        raise ValueError(f"a seeded sample of more than {most} ids")
    kind = ids.select("question_id").dtypes[0][1]
    return ids.sparkSession.createDataFrame([(x,) for x in random.Random(seed).sample(sorted(pool), k)], f"question_id {kind}")


def seeded_order(ids: list, seed: int) -> list:
    """A list in the order of Python's seeded shuffle."""
    out = list(ids)
    random.Random(seed).shuffle(out)
    return out


def first_ids(ids: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` ids of a total order."""
    return ids.select("question_id").distinct().orderBy("question_id").limit(limit)


def denominator(questions: DataFrame, excluded: DataFrame, suffix: str = "_abs") -> DataFrame:
    """(question_id, scored): the questions that carry labels, those with the suffix left out; scored ones are not excluded."""
    kept = questions.select("question_id").distinct().filter(~F.endswith("question_id", F.lit(suffix)))
    return kept.join(excluded.select("question_id").distinct().withColumn("_x", F.lit(True)), "question_id", "left").select("question_id", F.col("_x").isNull().alias("scored"))


def keyset_difference(labels: DataFrame, expected: DataFrame) -> DataFrame:
    """(question_id, problem): label keys that nothing asks for (extra), and asked ones without labels (missing)."""
    a, b = labels.select("question_id").distinct(), expected.select("question_id").distinct()
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), "question_id", "full_outer")
    return j.filter("_a IS NULL OR _b IS NULL").select("question_id", F.when(F.col("_b").isNull(), "extra").otherwise("missing").alias("problem"))


TURN = "array<struct<role:string,content:string>>"


def sessions(questions: DataFrame, evidence_only: bool = False) -> DataFrame:
    """(question_id, session_id, ordinal, occurred_at, text) of questions (question_id, answer_session_ids, haystack_session_ids,
    haystack_dates, haystack_sessions), whose arrays belong together by place.

    Sessions come undated first, then by instant, then by id. A turn is one line ``role: text`` with its white space squeezed;
    turns without text are dropped, and so are sessions without turns. A repeated session id keeps its last place; dates may be
    fewer than sessions.
    """
    z = questions.select("question_id", "answer_session_ids", F.posexplode(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions")).alias("i", "z"))
    z = z.select("question_id", "answer_session_ids", "i", F.col("z.haystack_session_ids").alias("session_id"), F.col("z.haystack_dates").alias("date"), F.col("z.haystack_sessions").alias("turns")).filter("session_id IS NOT NULL")
    if evidence_only:
        z = z.filter(F.array_contains("answer_session_ids", F.col("session_id")))
    z = z.groupBy("question_id", "session_id").agg(F.max_by(F.struct("date", "turns"), "i").alias("x"))
    line = lambda t: F.concat(F.coalesce(t["role"], F.lit("?")), F.lit(": "), squeezed(t["content"]))
    lines = F.transform(F.filter("x.turns", lambda t: squeezed(F.coalesce(t["content"], F.lit(""))) != ""), line)
    z = z.select("question_id", "session_id", corpus_instant(F.col("x.date")).alias("occurred_at"), F.array_join(lines, "\n").alias("text")).filter("text <> ''")
    w = Window.partitionBy("question_id").orderBy(F.asc_nulls_first("occurred_at"), "session_id")
    return z.withColumn("ordinal", F.row_number().over(w) - 1)


def vocabulary(mints: DataFrame) -> DataFrame:
    """(scope, session, subject, value, place): the subjects of earlier sessions, in the order in which they first came, with their
    latest value before that session. mints: (scope, session, seq, subject, value), sessions and seq in their order."""
    m = mints.filter("subject IS NOT NULL")
    last = m.groupBy("scope", "subject", "session").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("seq"))
    first = last.groupBy("scope", "subject").agg(F.min("session").alias("since"), F.min(F.struct("session", "seq"))["seq"].alias("born"))
    at = mints.select("scope", "session").distinct()
    seen = at.join(first, "scope").filter("since < session")
    now = seen.join(last.select("scope", "subject", F.col("session").alias("s"), "value"), ["scope", "subject"]).filter("s < session")
    now = now.groupBy("scope", "session", "subject", "since", "born").agg(F.max_by("value", "s").alias("value"))
    w = Window.partitionBy("scope", "session").orderBy("since", "born", "subject")
    return now.withColumn("place", F.row_number().over(w)).select("scope", "session", "subject", "value", "place")


def verdict(output: Column) -> Column:
    """Whether a judge's last line that is not blank says CORRECT or INCORRECT (letter case and a last full stop aside); else null."""
    lines = F.filter(F.transform(F.split(output, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\n\f"))), lambda x: x != "")
    word = F.upper(F.rtrim(F.regexp_replace(F.get(lines, F.size(lines) - 1), r"\.+$", "")))
    return F.when(word == "CORRECT", True).when(word == "INCORRECT", False)


def unfair(arms: DataFrame, n_questions: int) -> DataFrame:
    """(arm, problem) of arms (arm, pins, retriever, n_answers): no pins, or other pins, another retriever or another number of
    answers than the first arm by name has or the questions are."""
    ref = arms.agg(F.min_by(F.struct("pins", "retriever"), "arm").alias("ref"))  # one row
    a = arms.crossJoin(F.broadcast(ref))
    problem = F.when(F.col("pins").isNull(), "no pins").when(~F.col("pins").eqNullSafe(F.col("ref.pins")), "pins").when(~F.col("retriever").eqNullSafe(F.col("ref.retriever")), "retriever").when(F.col("n_answers") != n_questions, "answers")
    return a.select("arm", problem.alias("problem")).filter("problem IS NOT NULL")


def out_of_order(recorded: DataFrame, order: DataFrame) -> DataFrame:
    """(position, problem): why recorded verdicts (arm, question_id, position) are no prefix of the pinned order (same columns):
    a position ``missing`` before the last or beyond the rows, taken ``twice``, or given to ``another`` slot."""
    n = recorded.agg(F.count("*").alias("n"))  # one row
    per = recorded.groupBy("position").agg(F.count("*").alias("k"), F.min(F.struct("arm", "question_id")).alias("got"))
    j = order.crossJoin(F.broadcast(n)).filter("position < n").select("position", F.struct("arm", "question_id").alias("want")).join(per, "position", "left")
    p = F.when(F.col("k").isNull(), "missing").when(F.col("k") > 1, "twice").when(F.col("got") != F.col("want"), "another")
    return j.select("position", p.alias("problem")).filter("problem IS NOT NULL")


def tripwires(perf: DataFrame, reference: str, factor: float, measures: tuple[str, ...] = ("p95_ms", "bytes_per_claim")) -> DataFrame:
    """(arm, measure, value, reference_value) of measures (arm, ...) beyond ``factor`` times the reference arm's."""
    long = perf.select("arm", F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures))).alias("x")).select("arm", "x.*")
    ref = long.filter(F.col("arm") == reference).select("measure", F.col("value").alias("reference_value"))
    return long.filter(F.col("arm") != reference).join(ref, "measure").filter(F.col("value") > factor * F.col("reference_value")).select("arm", "measure", "value", "reference_value")


def adversarial(verdicts: DataFrame, tripwire: float, tier1: float, tier2: float) -> DataFrame:
    """(n, correct_b, correct_c, delta_pp, breached, tier) of verdicts (question_id, b, c): the treatment's lead in percent points."""
    v = verdicts.filter("b IS NOT NULL AND c IS NOT NULL")
    s = v.agg(F.count("*").alias("n"), F.count_if("b").alias("correct_b"), F.count_if("c").alias("correct_c"))
    delta = F.coalesce(F.try_divide(100.0 * (F.col("correct_c") - F.col("correct_b")), F.col("n")), F.lit(0.0))
    s = s.withColumn("delta_pp", F.round(delta, 6))
    return s.withColumns({"breached": F.col("delta_pp") > tripwire, "tier": F.when(F.col("delta_pp") >= tier2, "tier2").when(F.col("delta_pp") >= tier1, "tier1").otherwise("none")})


def context_differences(answers: DataFrame) -> DataFrame:
    """(question_id, winner, only_b, only_c, identical) of discordant questions (question_id, b, c, ids_b, ids_c): the retrieved
    ids of one arm only, in their order."""
    d = answers.filter("b <> c")
    only = lambda x, y: F.filter(x, lambda i: ~F.array_contains(F.coalesce(F.col(y), F.array().cast("array<string>")), i))
    return d.select("question_id", F.when(F.col("c"), "C").otherwise("B").alias("winner"), only("ids_b", "ids_c").alias("only_b"), only("ids_c", "ids_b").alias("only_c"), F.col("ids_b").eqNullSafe(F.col("ids_c")).alias("identical"))


def attribution(rows: DataFrame) -> DataFrame:
    """(missed, within_missed, cross_missed, false_positives, attributable) of rows (label, lineage, control, treatment): an arm's
    deficit over pairs, where the columns name the group that each member has under the labels, its lineage and either arm.

    Pairs are counted from groups, never built: a pair is missed if label and control join it and treatment does not.
    """

    def pairs(*cols: str) -> DataFrame:
        have = rows.filter(" AND ".join(f"{c} IS NOT NULL" for c in cols))
        n = have.groupBy(*cols).agg(F.count("*").alias("n"))
        return n.agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("_".join(cols)))

    wanted = [("label", "control"), ("label", "control", "treatment"), ("label", "control", "lineage"), ("label", "control", "lineage", "treatment"), ("treatment",), ("label", "treatment")]
    x = None
    for cols in wanted:
        x = pairs(*cols) if x is None else x.crossJoin(pairs(*cols))  # one row each
    missed = F.col("label_control") - F.col("label_control_treatment")
    within = F.col("label_control_lineage") - F.col("label_control_lineage_treatment")
    wrong = F.col("treatment") - F.col("label_treatment")
    return x.select(missed.alias("missed"), within.alias("within_missed"), (missed - within).alias("cross_missed"), wrong.alias("false_positives"), ((missed > 0) & (within == 0) & (wrong == 0)).alias("attributable"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(compared, equal_bytes, equal_verdicts, only_a, only_b) of two implementations' results (name, verdict, content)."""
    x, y = a.select("name", F.col("verdict").alias("va"), F.sha2("content", 256).alias("ca")), b.select("name", F.col("verdict").alias("vb"), F.sha2("content", 256).alias("cb"))
    j = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), "name", "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(F.count_if(both).alias("compared"), F.count_if(both & F.col("ca").eqNullSafe(F.col("cb"))).alias("equal_bytes"), F.count_if(both & F.col("va").eqNullSafe(F.col("vb"))).alias("equal_verdicts"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def conflicts(claims: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(claim_id, problem, n) of records (claim_id, content_hash, fields): records of one claim merge if their hashes are equal.
    Different hashes are ``PX_E_5103``; equal ones that disagree on a field of conflicts are ``disagree``. Else n records are one."""
    g = claims.filter("claim_id IS NOT NULL").groupBy("claim_id").agg(F.count("*").alias("n"), (F.min("content_hash") != F.max("content_hash")).alias("apart"), F.count_distinct(F.struct(*fields)).alias("k"))
    return g.select("claim_id", F.when(F.col("apart"), "PX_E_5103").when(F.col("k") > 1, "disagree").alias("problem"), "n")


def clusters(claims: DataFrame, *key: str) -> DataFrame:
    """(id, first) of records (id, seq, key): the record that a store keeps for each, the first by seq of its key. With the id as
    key every record is its own cluster."""
    first = claims.groupBy(*key).agg(F.min(F.struct("seq", "id"))["id"].alias("first"))
    return claims.join(first, list(key)).select("id", "first")


SUPPRESSED = ("superseded", "withdrawn")


def unsuppressed(claims: DataFrame) -> DataFrame:
    """Claims that a reader may surface; a null state is no reason not to."""
    return claims.filter(~F.coalesce("state", F.lit("")).isin(*SUPPRESSED))


def query_instant(c: Column | None = None) -> Column:
    """The instant that a query is resolved at, in whole seconds of UTC; now without one."""
    t = F.date_trunc("second", F.current_timestamp() if c is None else c)
    return F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def claim_bytes(id_: Column, text: Column, metadata: Column) -> Column:
    """Bytes of a claim as canonical JSON with blanks after colons and commas; metadata: its JSON in that form."""
    q = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    return F.octet_length(F.concat(F.lit('{"id": '), q(id_), F.lit(', "metadata": '), metadata, F.lit(', "text": '), q(text), F.lit("}")))
