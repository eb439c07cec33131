"""Trace events, audit rows and as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model


def to_triples(events: DataFrame) -> DataFrame:
    """A triple for each field of an event: one pass that unpivots, no join."""
    k = F.get_json_object("props", "$.k")
    cells = [("event_type", F.col("event_type")), ("agent", F.col("agent").cast("string")), ("timestamp", F.col("ts").cast("string")), ("session", F.col("session")), ("parent_event", F.col("parent").cast("string")), ("field:k", k)]
    rows = events.select(F.concat(F.lit("event:"), F.col("id").cast("string")).alias("subject"), F.explode(F.array(*[F.struct(F.lit(p).alias("predicate"), v.alias("text")) for p, v in cells])).alias("x")).where("x.text is not null")
    return rows.select("subject", F.lit("named").alias("subject_kind"), F.col("x.predicate").alias("predicate"), *model.value("String", str=F.col("x.text")))


def from_triples(triples: DataFrame) -> DataFrame:
    """One row per event again."""
    names = {"event_type": "event_type", "agent": "agent", "timestamp": "timestamp", "session": "session", "parent": "parent_event", "k": "field:k"}
    wanted = triples.where(F.col("predicate").isin(list(names.values())))
    return wanted.groupBy("subject").agg(*[F.max(F.when(F.col("predicate") == p, F.col("str"))).alias(n) for n, p in names.items()])


def as_of(probes: DataFrame, facts: DataFrame) -> DataFrame:
    """probes with action: the newest fact of the agent at or before them. One sort by agent, no range join."""
    both = probes.select("*", F.lit(None).cast("long").alias("fact")).unionByName(facts.select("*", F.col("id").alias("fact")))
    own = Window.partitionBy("agent").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("action", F.last("fact", ignorenulls=True).over(own)).where("fact is null").drop("fact")


def audit_page(rows: DataFrame, limit: int, user: int | None = None, namespace: int | None = None, action: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    for cond in (
        user is not None and F.col("user_id") == user,
        namespace is not None and F.col("namespace") == namespace,
        action is not None and F.col("action") == action,
        since is not None and F.col("timestamp") >= since,
        until is not None and F.col("timestamp") <= until,
    ):
        if cond is not False:
            rows = rows.where(cond)
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)
