"""References to records that do not exist.

``orphans`` checks each reference of a child table: ``missing`` (no such record), ``late`` (the record arrived after the
child), ``deleted`` (it was deleted by the time the child arrived). ``cascade`` then treats the children of orphaned records
as orphaned too, by semi-joins down the foreign-key graph until nothing is added. The links are doubled from round to round,
so that round k reaches all children up to 2^k levels below an orphan, and the rounds grow with the logarithm of the depth.

Defined cases: a null reference is no reference; a child that meets several kinds gives a row for each; several rows with one
key are one record, whose arrival is the earliest; keys that hold many children need no special case, as the other side of
each join has one row a key and adaptive execution splits a skewed partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def records(df: DataFrame, key: str, arrival: str, deleted: str | None = None) -> DataFrame:
    """(key, arrival, deleted): one row per key, with the earliest arrival and deletion."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(arrival).alias("arrival"), *([F.min(deleted).alias("deleted")] if deleted else []))


def orphans(children: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """(id, arrival, field, kind) of children (id, arrival, a column per field); references: by field, what ``records`` gives."""
    found = None
    for field, parents in references.items():
        p = parents.select(F.col("key").alias(field), F.col("arrival").alias("_there"), *([F.col("deleted").alias("_gone")] if "deleted" in parents.columns else []))
        j = children.select("id", "arrival", field).filter(F.col(field).isNotNull()).join(p, field, "left")
        kinds = [F.when(F.col("_there").isNull(), F.lit("missing")), F.when(F.col("_there") > F.col("arrival"), F.lit("late"))]
        if "_gone" in p.columns:
            kinds.append(F.when(F.col("_gone") <= F.col("arrival"), F.lit("deleted")))
        rows = j.select("id", "arrival", F.lit(field).alias("field"), F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
        found = rows if found is None else found.unionByName(rows)
    return found


def cascade(direct: DataFrame, links: DataFrame) -> DataFrame:
    """(id, level) of all orphans: level 0 for the ids of ``direct``, else the steps to the nearest orphaned ancestor.

    links (id, parent): each record's parent in the foreign-key graph, at most one; circles are allowed. A record that is not
    yet known to be orphaned points to an ancestor, with no orphan before it; where that is an orphan, so is the record, else
    it takes over the ancestor's pointer. What points nowhere is no orphan; once a round settles nothing, only circles are left.
    """
    known = cut(direct.select("id").distinct().withColumn("level", F.lit(0)))
    away = cut(links.filter("parent IS NOT NULL").join(known, "id", "left_anti").select("id", F.col("parent").alias("ptr"), F.lit(1).alias("level")))
    left = away.count()
    while left:
        there = known.select(F.col("id").alias("ptr"), F.col("level").alias("more"), F.lit(None).cast(away.schema["ptr"].dataType).alias("next"), F.lit(True).alias("hit"))
        there = there.unionByName(away.select(F.col("id").alias("ptr"), F.col("level").alias("more"), F.col("ptr").alias("next"), F.lit(False).alias("hit")))
        moved = cut(away.join(there, "ptr").select("id", F.col("next").alias("ptr"), (F.col("level") + F.col("more")).alias("level"), "hit"))
        known = known.unionByName(moved.filter("hit").select("id", "level"))
        away = moved.filter("NOT hit").select("id", "ptr", "level")
        if (now := away.count()) == left:
            break
        left = now
    return known


def orphan_rows(children: DataFrame, direct: DataFrame, links: DataFrame) -> DataFrame:
    """(id, arrival, field, kind, level): the rows of ``direct`` with level 0, and one row per inherited orphan with its level.

    children (id, arrival, ...), direct as ``orphans`` gives it, links as for ``cascade``. Inherited orphans have no field and
    no kind of their own.
    """
    direct = cut(direct)
    reached = cascade(direct, links)
    below = reached.filter("level > 0").join(children.select("id", "arrival"), "id")
    none = F.lit(None).cast("string")
    inherited = below.select("id", "arrival", none.alias("field"), none.alias("kind"), "level")
    mine = direct.join(reached.filter("level = 0"), "id")
    return mine.select("id", "arrival", "field", "kind", "level").unionByName(inherited)
