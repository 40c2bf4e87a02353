"""Queries pN_ of the general data problems, over the tables of claim packages and their provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import digest_key, folded, instant_ms, uuid_key, uuid_text
from ..operators import drift, reconcile, references, replay
from ..operators import hierarchy as hier
from ..session import cut
from ..sources.tables import table


def _event_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "provenance").select(uuid_key("event_id").alias("id"), uuid_key("prev_event_id").alias("parent"), uuid_key("claim_id").alias("block"), "received_at")
    return hier.nodes(p, arrival="received_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    walked = hier.hierarchy(_event_nodes(spark, d))
    case = walked.filter(F.col("in_circle") | ~F.col("root_block").eqNullSafe(F.col("block")))
    return case.select(uuid_text("id").alias("event_id"), uuid_text("root").alias("root_event_id"), "depth")


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    walked = hier.hierarchy(_event_nodes(spark, d), full=True)
    return walked.select(
        uuid_text("id").alias("event_id"),
        uuid_text("root").alias("root_event_id"),
        "depth",
        "on_circle",
        F.transform("path", uuid_text).alias("path"),
        F.col("n_descendants").cast("int").alias("n_descendants"),
        F.transform("descendants", uuid_text).alias("descendants"),
    )


def p1_circles(spark: SparkSession, d: str) -> DataFrame:
    """One row per circle: its back edge and its size."""
    events = _event_nodes(spark, d)
    ring = hier.hierarchy(events).filter("on_circle").groupBy("root").agg(F.count("*").alias("n_members"))
    # the walk of a circle starts at its smallest member, so the link back to that leaves its stored parent
    ring = ring.join(events.select(F.col("id").alias("root"), F.col("parent").alias("back_from")), "root")
    return ring.select(uuid_text("root").alias("smallest_event_id"), "n_members", uuid_text("back_from").alias("back_edge_from"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.registry(table(spark, d, "manifest_raw"))).select("file_name", "field", "change")


def p2_versions(spark: SparkSession, d: str) -> DataFrame:
    r = drift.registry(table(spark, d, "manifest_raw"))
    return r.select("feed", "file_seq", "file_name", F.size("fields").alias("n_fields"), "fingerprint", "version", F.size("steps").alias("n_steps"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    t = drift.consistent_table(table(spark, d, "manifest_raw"))
    return t.withColumns({"package_id": uuid_text(uuid_key("package_id")), "fields": F.to_json("fields", {"ignoreNullFields": "false"}), "changes": F.to_json("changes")})


def _referring(spark: SparkSession, d: str) -> DataFrame:
    """One row (id, arrival, claim_id, target_claim_instance_id, instance) per event, as it first arrived."""
    p = table(spark, d, "provenance").select(
        uuid_key("event_id").alias("id"), "received_at", uuid_key("claim_id").alias("claim_id"), uuid_key("target_claim_instance_id").alias("target"), uuid_key("claim_instance_id").alias("instance")
    )
    one = p.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct(F.col("received_at").isNull(), "received_at", "claim_id", "target", "instance")).alias("r"))
    return one.select("id", F.col("r.received_at").alias("arrival"), "r.claim_id", F.col("r.target").alias("target_claim_instance_id"), "r.instance")


def _orphans(spark: SparkSession, d: str, events: DataFrame) -> DataFrame:
    m = table(spark, d, "manifest").select(uuid_key("claim_id").alias("claim"), "received_at", "deleted_at")
    i = table(spark, d, "provenance").select(uuid_key("claim_instance_id").alias("instance"), "received_at")
    return references.orphans(events, {"claim_id": references.records(m, "claim", "received_at", "deleted_at"), "target_claim_instance_id": references.records(i, "instance", "received_at")})


def _inherited(spark: SparkSession, d: str) -> DataFrame:
    """(id, arrival, field, kind, level): an event inherits from the event that first introduced its target."""
    events = cut(_referring(spark, d))
    introduces = events.filter("instance IS NOT NULL").groupBy("instance").agg(F.min(F.struct("arrival", "id"))["id"].alias("parent"))
    links = events.join(introduces.withColumnRenamed("instance", "target_claim_instance_id"), "target_claim_instance_id").select("id", "parent")
    return references.orphan_rows(events, _orphans(spark, d, events), links)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The direct orphans of the cascade."""
    return _inherited(spark, d).filter("level = 0").select(uuid_text("id").alias("event_id"), "field", "kind")


def p3_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Every orphaned event: level 0 direct, else the steps down from the nearest orphan."""
    reached = _inherited(spark, d).select("id", "level").distinct()
    return reached.select(uuid_text("id").alias("event_id"), "level", F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("orphan"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table and month of arrival: direct ones by field and kind, inherited ones with field and kind ``*``."""
    rows = _inherited(spark, d).select(F.date_format("arrival", "yyyy-MM").alias("period"), F.coalesce("field", F.lit("*")).alias("field"), F.coalesce("kind", F.lit("*")).alias("kind"))
    return rows.groupBy(F.lit("provenance").alias("table_name"), "period", "field", "kind").agg(F.count("*").alias("n_references"))


LIFECYCLE = replay.Machine()


def _claim_changes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "provenance").select(
        uuid_key("event_id").alias("id"),
        uuid_key("claim_id").alias("key"),
        folded("event_type").alias("event_type"),
        instant_ms("timestamp").alias("ms"),
        "received_at",
        uuid_key("package_id").alias("log"),
        F.col("line_no").alias("seq"),
    )
    return replay.changes(p, id="id", key="key", code=LIFECYCLE.code(F.col("event_type")), ms="ms", arrival="received_at", log="log", seq="seq")


def _delivered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "provenance").select(uuid_key("package_id").alias("log"), F.col("line_no").alias("seq"))


def _states(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(replay.mark_held(_claim_changes(spark, d), _delivered(spark, d)), LIFECYCLE, held=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The feed is closed here: changes that were held beyond a gap count too, in their place."""
    reached = _states(spark, d).filter("state > 0").select("key", LIFECYCLE.name(F.col("state")).alias("state"))
    m = table(spark, d, "manifest").select(uuid_key("claim_id").alias("key"), folded("state").alias("said"), "received_at")
    said = m.filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col("received_at").isNull(), "received_at", F.col("said").isNull(), "said"))["said"].alias("said"))
    apart = reached.join(said.filter("said IS NOT NULL"), "key").filter("said <> state")
    return apart.select(uuid_text("key").alias("claim_id"), "state")


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    """Every claim's state after all events, and after those up to the committed watermarks of the package logs."""
    return _states(spark, d).select(uuid_text("key").alias("claim_id"), LIFECYCLE.name(F.col("state")).alias("state"), LIFECYCLE.name(F.col("committed_state")).alias("committed_state"), "n_changes", "n_held")


def p4_watermarks(spark: SparkSession, d: str) -> DataFrame:
    return replay.watermarks(_delivered(spark, d)).select(uuid_text("log").alias("package_id"), "watermark")


def _manifest_rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select(
        uuid_key("claim_id").alias("key"),
        uuid_key("claim_instance_id").alias("claim_instance_id"),
        digest_key("hash").alias("hash"),
        "path",
        folded("state").alias("state"),
        uuid_key("superseded_by_claim_id").alias("superseded_by_claim_id"),
        F.array_sort(F.array_distinct("tags")).alias("tags"),
    )


def _event_rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name).select(
        uuid_key("event_id").alias("key"),
        uuid_key("claim_id").alias("claim_id"),
        folded("event_type").alias("event_type"),
        F.coalesce(instant_ms("timestamp").cast("string"), F.concat(F.lit("?"), F.col("timestamp"))).alias("timestamp"),
        "actor",
        uuid_key("prev_event_id").alias("prev_event_id"),
    )


def _copies(spark: SparkSession, d: str, records: bool) -> DataFrame:
    out = None
    for name, rows in (("manifest", _manifest_rows), ("provenance", _event_rows)):
        left, right = rows(spark, d, name), rows(spark, d, f"{name}_mirror")
        apart = reconcile.reconcile(left, right, "key", left.columns[1:], records)
        part = apart.select(F.lit(name).alias("table_name"), uuid_text("key").alias("key_id"), "field", "diff", "n")
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d, records=True).select("table_name", "key_id", "field", "diff")


def p5_rows(spark: SparkSession, d: str) -> DataFrame:
    """The same with repeated deliveries as rows of their own: how often each key is short on one side, and what differs."""
    return _copies(spark, d, records=False)


QUERIES = {f.__name__: f for f in (p1_found, p1_paths, p1_circles, p2_found, p2_versions, p2_table, p3_found, p3_cascade, p3_report, p4_found, p4_state, p4_watermarks, p5_found, p5_rows)}
