"""Window-like operators (inventory 2.5)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import anomaly, dag, risk, vault
from ..registry import query
from ..sources import tables as t

CENTS = "CAST(round(value * 100) AS BIGINT)"


@query(
    "anomaly_zscore",
    f"""SELECT event_id AS id, n, z FROM (SELECT event_id, n, round(abs(c * n - s) / (sqrt(CAST(n * q - s * s AS DOUBLE))), 4) AS z FROM (SELECT event_id, c, count(*) OVER w AS n, CAST(sum(c) OVER w AS BIGINT) AS s, CAST(sum(c * c) OVER w AS BIGINT) AS q
 FROM (SELECT *, {CENTS} AS c FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) WHERE n >= 10 AND n * q - s * s > 0) WHERE z >= 1.9""",
)
def anomaly_zscore(spark, d):
    e = t.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), "ts", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return anomaly.scores(e, 50).where("z >= 1.9").select("id", "n", "z")


@query("chain_last_n", f"SELECT author, hash FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY seq DESC) AS n FROM ({t.ACTIONS_SQL})) WHERE n <= 3")
def chain_last_n(spark, d):
    return dag.last_of_authors(t.actions(spark, d), 3).select("author", "hash")


@query("hash_chain_verify", "SELECT user_id, event_id, lag(sha256(user_id || '|' || event_id || '|' || event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events")
def hash_chain_verify(spark, d):
    from ..operators import chain

    rows = chain.verify_hash_chain(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], ["user_id", "event_id", "event_type"])
    return rows.select("user_id", "event_id", F.col("calc_prev").alias("prev"))


@query("best_per_source", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS best FROM documents GROUP BY 1")
def best_per_source(spark, d):
    return t.table(spark, d, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("best"))


@query("tag_fanout", "SELECT note, tag, peer FROM (SELECT a.doc_id AS note, a.lang AS tag, b.doc_id AS peer, row_number() OVER (PARTITION BY a.doc_id, a.lang ORDER BY b.doc_id) AS n FROM documents a JOIN documents b ON a.lang = b.lang AND a.doc_id <> b.doc_id WHERE b.doc_id < 200) WHERE n <= 6")
def tag_fanout(spark, d):
    return vault.tag_peers(t.table(spark, d, "documents").select(F.col("doc_id").alias("note"), F.col("lang").alias("tag")))


@query(
    "risk_trend",
    """SELECT user_id, CASE WHEN v1 > v2 AND v2 > v3 THEN 'rising' WHEN v1 < v2 AND v2 < v3 THEN 'falling' ELSE 'mixed' END AS trend FROM (SELECT user_id, max(value) FILTER (n = 1) AS v1, max(value) FILTER (n = 2) AS v2, max(value) FILTER (n = 3) AS v3
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY 1) WHERE v3 IS NOT NULL""",
)
def risk_trend(spark, d):
    return risk.trend(t.table(spark, d, "events"), "user_id", ["ts", "event_id"], "value")


@query("observation_buffer", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n, max(ts) OVER () AS newest FROM events) WHERE n <= 100 AND ts >= newest - INTERVAL 10 DAY")
def observation_buffer(spark, d):
    e = t.table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("ts")).scalar()
    own = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.where(F.col("ts") >= newest - F.expr("interval 10 days")).withColumn("n", F.row_number().over(own)).where("n <= 100").select("event_id")


@query("stm_recent", f"SELECT id, attention FROM ({t.MEMORIES_SQL}) WHERE tier = 'stm' ORDER BY created_s DESC, id LIMIT 20")
def stm_recent(spark, d):
    return t.memories(spark, d).where("tier = 'stm'").orderBy(F.desc("created_s"), "id").limit(20).select("id", "attention")


@query("keep_last_n", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def keep_last_n(spark, d):
    return t.table(spark, d, "events").orderBy(F.desc("event_id")).limit(500).select("event_id")


@query("event_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    w = F.window("ts", "1 hour")
    return t.table(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
