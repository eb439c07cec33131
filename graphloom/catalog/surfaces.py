"""Remaining query surfaces (inventory 2.16), ingest and streams (2.1, 2.13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources import tables as t
from ..streaming import events as s
from .joins import H

PATHS = "SELECT p_brand AS base, p_type AS tag, min(p_partkey) AS target FROM part GROUP BY 1, 2"


@query("path_children", PATHS)
def path_children(spark, d):
    own = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    rows = t.table(spark, d, "part").withColumn("n", F.row_number().over(own)).where("n = 1")
    return rows.select(F.col("p_brand").alias("base"), F.col("p_type").alias("tag"), F.col("p_partkey").alias("target"))


@query("anchor_lists", "SELECT DISTINCT p_type AS anchor FROM part WHERE p_brand = 'Brand#13'")
def anchor_lists(spark, d):
    return t.table(spark, d, "part").where("p_brand = 'Brand#13'").select(F.col("p_type").alias("anchor")).distinct().orderBy("anchor")


@query("chain_filter", H + "SELECT hash, seq, type, o_orderstatus AS entry FROM h JOIN orders ON entry_hash = o_orderkey WHERE author = 2 AND seq >= 3 AND seq < 30 AND type = 'Create'")
def chain_filter(spark, d):
    rows = t.headers(spark, d).where("author = 2 and seq >= 3 and seq < 30 and type = 'Create'")
    return rows.join(t.table(spark, d, "orders"), F.col("entry_hash") == F.col("o_orderkey")).select("hash", "seq", "type", F.col("o_orderstatus").alias("entry"))


@query("wal_stats", f"SELECT author, count(*) AS entries, max(seq) AS last FROM ({t.ACTIONS_SQL}) GROUP BY 1")
def wal_stats(spark, d):
    return t.actions(spark, d).groupBy("author").agg(F.count(F.lit(1)).alias("entries"), F.max("seq").alias("last"))


@query("viz_entry", "SELECT event_id, event_type, value FROM events WHERE event_id = 17")
def viz_entry(spark, d):
    return t.table(spark, d, "events").where("event_id = 17").select("event_id", "event_type", "value")


@query("viz_agent", "SELECT event_id, event_type FROM events WHERE user_id = 9")
def viz_agent(spark, d):
    return t.table(spark, d, "events").where("user_id = 9").select("event_id", "event_type")


@query("d3_export")
def d3_export(spark, d):
    nodes = t.table(spark, d, "nation").select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))).alias("line"))
    return nodes.unionByName(t.table(spark, d, "nation").select(F.to_json(F.struct(F.lit("link").alias("kind"), F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"))).alias("line")))


@query("ingest_path")
def ingest_path(spark, d):
    from ..sources import files

    return files.changed(files.listed(t.notes(spark, d).select("path", F.col("text").alias("content"))), None)


@query("stream_triple_added", "SELECT subject, predicate, text FROM (SELECT 'event:' || event_id AS subject, 'event_type' AS predicate, event_type AS text FROM events) WHERE starts_with(subject, 'event:1') AND predicate = 'event_type'")
def stream_triple_added(spark, d):
    return s.drained(s.triple_added(s.event_facts(s.replayed(spark, d)), subject_prefix="event:1", predicate="event_type"), "triple_added")


@query("stream_validation", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def stream_validation(spark, d):
    return s.drained(s.replayed(spark, d).where("event_type <> 'error'").select("event_id", "event_type"), "validation")


@query("stream_agent_activity", "SELECT event_id, user_id FROM events WHERE contains(CAST(user_id AS VARCHAR), '7')")
def stream_agent_activity(spark, d):
    return s.drained(s.replayed(spark, d).where(F.contains(F.col("user_id").cast("string"), F.lit("7"))).select("event_id", "user_id"), "activity")


@query("stream_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    return s.drained(s.windowed(s.replayed(spark, d)), "windows", "complete")


@query("stream_anomaly")
def stream_anomaly(spark, d):
    return s.drained(s.online_anomaly(s.replayed(spark, d)), "anomaly", "append")


@query("wal_verify", f"SELECT author, count(*) AS entries, min(seq) = 1 AND max(seq) = count(*) AND count(DISTINCT seq) = count(*) AS ok FROM ({t.ACTIONS_SQL}) GROUP BY 1")
def wal_verify(spark, d):
    from ..operators import chain

    return chain.verify_log(t.actions(spark, d), "author", "seq")


@query("published_count", "SELECT count(*) AS n FROM lineitem WHERE l_linestatus = 'F'")
def published_count(spark, d):
    return t.table(spark, d, "lineitem").agg(F.count_if(F.col("l_linestatus") == "F").alias("n"))


@query("latest_seq", H + "SELECT author, max(seq) AS seq FROM h GROUP BY 1")
def latest_seq(spark, d):
    return t.headers(spark, d).groupBy("author").agg(F.max("seq").alias("seq"))


@query("last_sync", "SELECT user_id AS peer, max(ts) AS at FROM events GROUP BY 1")
def last_sync(spark, d):
    return t.table(spark, d, "events").groupBy(F.col("user_id").alias("peer")).agg(F.max("ts").alias("at"))


@query("export_turtle_pattern")
def export_turtle_pattern(spark, d):
    from ..operators import graph
    from ..sources import rdf

    return rdf.turtle_blocks(graph.find(t.triples(spark, d, predicate="in_region"), predicate="in_region"))


@query("stream_triple_deleted", "SELECT 'event:' || event_id AS subject, 'event_type' AS predicate, event_type AS text FROM events WHERE event_type = 'error' AND starts_with('event:' || event_id, 'event:2')")
def stream_triple_deleted(spark, d):
    deletes = s.replayed(spark, d).where("event_type = 'error'")
    return s.drained(s.triple_added(s.event_facts(deletes), subject_prefix="event:2"), "triple_deleted")


@query("note_tag_added", "SELECT doc_id, '---\ntags: [' || lang || ', new]\n---\nx' AS content FROM documents")
def note_tag_added(spark, d):
    from ..operators import vault

    notes = t.table(spark, d, "documents").select("doc_id", F.concat(F.lit("---\ntags: ["), "lang", F.lit("]\n---\nx")).alias("content"))
    return notes.select("doc_id", vault.add_tag(F.col("content"), "new").alias("content"))


@query("note_tag_removed", "SELECT doc_id, '---\ntags: [' || lang || ']\n---\nx' AS content FROM documents")
def note_tag_removed(spark, d):
    from ..operators import vault

    notes = t.table(spark, d, "documents").select("doc_id", F.concat(F.lit("---\ntags: ["), "lang", F.lit(", old]\n---\nx")).alias("content"))
    return notes.select("doc_id", vault.remove_tag(F.col("content"), "old").alias("content"))
