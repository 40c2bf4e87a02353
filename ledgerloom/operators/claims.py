"""Operators on claims and their events: lifecycle, integrity, diffs, conflict resolution in valid time, lineages.

All are joins and aggregates that combine on the map side, so a claim, subject or package with a third of the rows needs no
task of its own. Nulls: a null key takes no part in joins; order ties go by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import parallelism

STARTERS, TERMINAL = ("create", "publish"), ("supersede", "withdraw")


def bad_target(event_type: Column, has_target: Column) -> Column:
    """Whether an event lacks the target that its type must name, or names one that its type must not."""
    return F.when(event_type.isin(*STARTERS), has_target).otherwise(~has_target)


def lifecycle(events: DataFrame, illegal: Column | None = None) -> DataFrame:
    """(claim_id, final_state, first_illegal, code) of events (claim_id, ms, event_id, event_type), folded in order until one is illegal.

    An event is illegal if it meets the condition ``illegal`` (see ``bad_target``), comes first and starts nothing, starts a claim
    again, or follows a terminal event; code is 5102 for a reaffirmation that meets the condition, else 5101. The fold is
    expressed by minima of (ms, event_id), so it needs no ordered list of a claim's events.
    """
    bad = illegal if illegal is not None else F.lit(False)
    at = events.withColumns({"starts": F.col("event_type").isin(*STARTERS), "ends": F.col("event_type").isin(*TERMINAL), "bad": bad})
    at = at.withColumn("k", F.struct("ms", "event_id", F.when(F.col("bad") & (F.col("event_type") == "reaffirm"), "PX_E_5102").otherwise("PX_E_5101").alias("code")))
    at = at.withColumn("bad", F.coalesce("bad", F.lit(True)) | F.col("event_type").isNull() | ~F.col("event_type").isin("create", "publish", "reaffirm", "revise", "supersede", "withdraw"))
    first = at.groupBy("claim_id").agg(F.min("k").alias("k1"), F.min_by("starts", "k").alias("starts1"), F.min(F.when(F.col("ends"), F.struct("k", "event_type"))).alias("end1"), F.min(F.when(F.col("bad"), F.col("k"))).alias("bad1"))
    later = at.join(first, "claim_id").groupBy("claim_id").agg(
        F.min("k1").alias("k1"),
        F.bool_and("starts1").alias("starts1"),
        F.min("end1").alias("end1"),
        F.min("bad1").alias("bad1"),
        F.min(F.when(F.col("starts") & (F.col("k") > F.col("k1")), F.col("k"))).alias("again"),
        F.min(F.when(F.col("k") > F.col("end1.k"), F.col("k"))).alias("after"),
    )
    wrong = F.least(F.when(~F.col("starts1"), F.col("k1")), "bad1", "again", "after")
    ended = F.col("end1").isNotNull() & (wrong.isNull() | (F.col("end1.k") < wrong))
    state = F.when(wrong.isNull() | (wrong > F.col("k1")), F.when(ended, F.when(F.col("end1.event_type") == "supersede", "superseded").otherwise("withdrawn")).otherwise("active"))
    return later.select("claim_id", state.alias("final_state"), wrong["event_id"].alias("first_illegal"), wrong["code"].alias("code"))


def event_chain(events: DataFrame) -> DataFrame:
    """(claim_id, event_id, problem) of events (claim_id, event_id, event_type, prev_event_id, line): ``no_prev`` (no such
    event of the claim earlier in the log, where a create counts at any line), ``fork`` (two events continue one), and
    ``creates`` per claim without exactly one create."""
    p = events.select("claim_id", F.col("event_id").alias("prev_event_id"), F.col("line").alias("p_line"), (F.col("event_type") == "create").alias("p_create"))
    linked = events.filter("event_type <> 'create'").join(p, ["claim_id", "prev_event_id"], "left")
    lost = linked.filter("p_line IS NULL OR (p_line >= line AND NOT p_create)").select("claim_id", "event_id", F.lit("no_prev").alias("problem"))
    forks = events.filter("prev_event_id IS NOT NULL AND event_type <> 'create'").groupBy("claim_id", "prev_event_id").agg(F.count("*").alias("n")).filter("n > 1").select("claim_id", F.col("prev_event_id").alias("event_id"), F.lit("fork").alias("problem"))
    creates = events.groupBy("claim_id").agg(F.count_if(F.col("event_type") == "create").alias("n")).filter("n <> 1").select("claim_id", F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit("creates").alias("problem"))
    return lost.unionByName(forks).unionByName(creates)


def set_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change): ``added``, ``removed`` or ``changed`` between snapshots with unique keys; equal rows are left out."""
    x = a.select(key, F.lit(True).alias("_a"), F.struct(*fields).alias("_x"))
    y = b.select(key, F.lit(True).alias("_b"), F.struct(*fields).alias("_y"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_x").eqNullSafe(F.col("_y")), "changed")
    return x.join(y, key, "full_outer").select(key, change.alias("change")).filter("change IS NOT NULL")


def field_diff(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, before, after) as text, of keys in both snapshots."""
    y = b.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    cells = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("before"), F.col(f"_{f}").cast("string").alias("after"))) for f in fields)))
    return a.join(y, key).select(key, F.explode(cells).alias("c")).select(key, "c.*")


def timeline_diff(a: DataFrame, b: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """(key, added, removed, reordered) of two logs: items on one side only, and whether the common ones come in another order.

    A log is cut into ranges of its order, each looked at alone; then the ends of neighbouring ranges are compared, so that a log
    with a tenth of all rows is spread over the tasks.
    """
    x = a.select(key, item, F.col(order).alias("_o"))
    y = b.select(key, item, F.col(order).alias("_p"))
    j = x.join(y, [key, item], "full_outer")
    common = j.filter("_o IS NOT NULL AND _p IS NOT NULL").repartitionByRange(parallelism(a.sparkSession), key, "_o", item).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy(key, "_part").orderBy("_o", item)
    at = F.struct("_o", item, "_p")
    runs = common.withColumn("_q", F.lag("_p").over(within)).groupBy(key, "_part").agg(F.bool_or(F.col("_q") > F.col("_p")).alias("turned"), F.min(at).alias("first"), F.max(at).alias("last"))
    logs = runs.groupBy(key).agg(F.bool_or("turned").alias("turned"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("xs"))  # a row per range
    across = F.exists(F.transform("xs", lambda r, i: F.coalesce(F.get("xs", i - 1)["last"]["_p"] > r["first"]["_p"], F.lit(False))), lambda t: t)
    turned = logs.select(key, (F.coalesce("turned", F.lit(False)) | across).alias("reordered"))
    counts = j.groupBy(key).agg(F.count_if(F.col("_o").isNull()).alias("added"), F.count_if(F.col("_p").isNull()).alias("removed"))
    return counts.join(turned, key, "left").select(key, "added", "removed", F.coalesce("reordered", F.lit(False)).alias("reordered"))


def active_at(claims: DataFrame, instant: Column, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Claims whose closed interval holds the instant; a null bound is open."""
    return claims.filter((F.col(start).isNull() | (F.col(start) <= instant)) & (F.col(end).isNull() | (instant <= F.col(end))))


def supersession(claims: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left of active, dangling edges): targets of active claims' ``supersedes`` are dropped in one pass, so a circle
    drops all its claims; a target that was never loaded is dangling. claims, active: (subject, claim_id, supersedes array)."""
    edges = active.select("subject", F.col("claim_id").alias("by"), F.explode("supersedes").alias("claim_id"))
    dangling = edges.join(claims.select("subject", "claim_id"), ["subject", "claim_id"], "left_anti")
    return active.join(edges.select("subject", "claim_id").distinct(), ["subject", "claim_id"], "left_anti"), dangling


def resolve(claims: DataFrame, instant: Column) -> DataFrame:
    """(subject, conflict_class, primary_id, n_surfaced) per subject of claims (subject, claim_id, seq, polarity, created_at,
    valid_from, valid_until, supersedes), at an instant.

    Classes in this order: not_found (none active), none (one active), supersession (one left), contradiction (affirm and
    negate), ambiguity (unknown beside one definite polarity; primary is the first definite), supersession (newest first, then
    smallest id; nothing surfaced if a circle dropped all). A null polarity affirms.
    """
    active = active_at(claims, instant).withColumn("polarity", F.coalesce("polarity", F.lit("affirm")))
    left, _ = supersession(claims, active)
    n_active = active.groupBy("subject").agg(F.count("*").alias("n_active"), F.min("claim_id").alias("only"))
    definite = F.col("polarity").isin("affirm", "negate")
    rest = left.groupBy("subject").agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("polarity") == "affirm").alias("aff"),
        F.bool_or(F.col("polarity") == "negate").alias("neg"),
        F.bool_or(F.col("polarity") == "unknown").alias("unk"),
        F.min_by("claim_id", F.when(definite, F.col("seq"))).alias("first_definite"),
        F.max(F.struct(F.coalesce("created_at", F.lit("")).alias("c"))).alias("newest"),
    )
    newest = left.join(rest.select("subject", "newest"), "subject").filter(F.coalesce("created_at", F.lit("")) == F.col("newest.c")).groupBy("subject").agg(F.min("claim_id").alias("recent"))
    j = claims.select("subject").filter("subject IS NOT NULL").distinct().join(n_active, "subject", "left").join(rest, "subject", "left").join(newest, "subject", "left")
    n = F.coalesce("n", F.lit(0))
    case = reduce(lambda e, x: e.when(*x), [(F.col("n_active") == 1, 1), (n == 1, 2), (F.col("aff") & F.col("neg"), 3), (F.col("unk") & (F.col("aff") | F.col("neg")), 4), (n == 0, 5)], F.when(F.col("n_active").isNull(), 0)).otherwise(6)
    j = j.withColumn("k", case)
    return j.select(
        "subject",
        F.element_at(F.array(*map(F.lit, ("not_found", "none", "supersession", "contradiction", "ambiguity", "supersession", "supersession"))), F.col("k") + 1).alias("conflict_class"),
        F.when(F.col("k") == 1, F.col("only")).when(F.col("k").isin(2, 6), F.col("recent")).when(F.col("k") == 4, F.col("first_definite")).alias("primary_id"),
        F.when(F.col("k").isin(0, 5), 0).when(F.col("k").isin(1, 2), 1).otherwise(n).cast("long").alias("n_surfaced"),
    )


def surfaced(claims: DataFrame, instant: Column) -> DataFrame:
    """(subject, claim_id) that a reader shows at an instant, of claims as for ``resolve``: the primary where the verdict is none
    or supersession, all that is left where it is ambiguity or contradiction. Claims without subject are always shown."""
    verdicts = resolve(claims, instant)
    one = verdicts.filter("conflict_class IN ('none', 'supersession') AND primary_id IS NOT NULL").select("subject", F.col("primary_id").alias("claim_id"))
    left, _ = supersession(claims, active_at(claims, instant))
    every = left.join(verdicts.filter("conflict_class IN ('ambiguity', 'contradiction')").select("subject"), "subject").select("subject", "claim_id")
    return one.unionByName(every).unionByName(claims.filter("subject IS NULL").select("subject", "claim_id"))


def retrieve(ranked: DataFrame, claims: DataFrame, instant: Column, k: int = 10) -> DataFrame:
    """(query_id, claim_id, rank) of the k best claims per query that a reader shows, in the order of ranked (query_id, claim_id,
    rank). Superseded and withdrawn claims are left out before conflicts are resolved; claims as for ``surfaced``, with state."""
    from .evaluation import unsuppressed

    shown = surfaced(unsuppressed(claims), instant).select("claim_id").distinct()
    kept = ranked.join(shown, "claim_id", "left_semi")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "claim_id"))
    return kept.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "claim_id", "rank")


def evidence_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(claim_id, hash_changed, state_changed, tags_added, tags_removed, labels_added, labels_removed) of claims in both packages
    that differ: (claim_id, hash, state, tags, labels) with unique claims. Labels are compared by their keys."""
    none = F.array().cast("array<string>")
    side = lambda df, p: df.select("claim_id", F.col("hash").alias(f"{p}h"), F.col("state").alias(f"{p}s"), F.coalesce("tags", none).alias(f"{p}t"), F.coalesce(F.map_keys("labels"), none).alias(f"{p}l"))
    j = side(a, "a").join(side(b, "b"), "claim_id")
    apart = lambda x, y: F.array_sort(F.array_except(x, y))
    out = j.select("claim_id", (~F.col("ah").eqNullSafe(F.col("bh"))).alias("hash_changed"), (~F.col("as").eqNullSafe(F.col("bs"))).alias("state_changed"), apart("bt", "at").alias("tags_added"), apart("at", "bt").alias("tags_removed"), apart("bl", "al").alias("labels_added"), apart("al", "bl").alias("labels_removed"))
    return out.filter("hash_changed OR state_changed OR size(tags_added) + size(tags_removed) + size(labels_added) + size(labels_removed) > 0")


def timeline_ids(a: DataFrame, b: DataFrame, key: str, item: str, order: str) -> DataFrame:
    """(key, item, change): items ``added`` or ``removed`` between two logs, and all common ones as ``reordered`` where their order
    in the logs is not the same."""
    x, y = a.select(key, item, F.lit(True).alias("_a")), b.select(key, item, F.lit(True).alias("_b"))
    j = x.join(y, [key, item], "full_outer")
    turned = timeline_diff(a, b, key, item, order).filter("reordered").select(key, F.lit(True).alias("_t"))
    j = j.join(turned, key, "left")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_t"), "reordered")
    return j.select(key, item, change.alias("change")).filter("change IS NOT NULL")


def manifest_diff(a: DataFrame, b: DataFrame, left_out: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """(key, field, change) of manifests (key, doc), doc as ``canonical.shape`` gives it: fields added, removed and changed between
    two packages; claims are compared apart, so of them only presence counts. Two packages are equal if no diff has a row."""
    side = lambda df, p: df.select("key", F.explode("doc.fields").alias("field", p)).filter(~F.col("field").isin(*left_out))
    both = a.select("key").join(b.select("key"), "key")
    j = side(a.join(both, "key", "left_semi"), "x").join(side(b.join(both, "key", "left_semi"), "y"), ["key", "field"], "full_outer")
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when((F.col("field") != "claims") & (F.col("x") != F.col("y")), "changed")
    return j.select("key", "field", change.alias("change")).filter("change IS NOT NULL")


def link(records: DataFrame) -> DataFrame:
    """Adds ``minted`` and ``supersedes_seq`` to records (scope, subject, seq, value): a record is a new node iff its value
    differs from the one before it on its subject, and supersedes the node minted before. Without subject nothing is linked."""
    w = Window.partitionBy("scope", "subject").orderBy("seq")
    minted = F.col("subject").isNull() | ~F.col("value").eqNullSafe(F.lag("value").over(w)) | F.lag("seq").over(w).isNull()
    out = records.withColumn("minted", minted)
    before = F.last(F.when(F.col("minted"), F.col("seq")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("supersedes_seq", F.when(F.col("minted") & F.col("subject").isNotNull(), before))
