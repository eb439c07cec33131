"""Action DAG and time travel (inventory 2.9, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dag
from ..registry import query
from ..sources import tables as t

A = f"a AS MATERIALIZED ({t.ACTIONS_SQL}), e AS MATERIALIZED (SELECT hash AS child, unnest(parents) AS parent FROM a)"
UP = "anc(hash) AS (SELECT {0}::BIGINT UNION SELECT e.parent FROM anc JOIN e ON e.child = anc.hash)"
REPLAY = "SELECT triple_key FROM {0} GROUP BY 1 HAVING arg_max(op, (ts, hash)) = 'insert'"


@query("dag_tips", f"WITH {A} SELECT hash FROM a WHERE hash NOT IN (SELECT parent FROM e)")
def dag_tips(spark, d):
    return dag.tips(t.actions(spark, d))


@query("dag_stats", f"WITH {A} SELECT count(*) AS actions, count(*) FILTER (hash NOT IN (SELECT parent FROM e)) AS tips FROM a")
def dag_stats(spark, d):
    a = t.actions(spark, d)
    tips = dag.tips(a).agg(F.count(F.lit(1)).alias("n"))
    return a.agg(F.count(F.lit(1)).alias("actions")).select("actions", tips.scalar().alias("tips"))


@query("dag_history", f"WITH {A} SELECT hash, op FROM a WHERE triple_key = (SELECT min(triple_key) FROM a) ORDER BY ts DESC, hash DESC LIMIT 20")
def dag_history(spark, d):
    a = t.actions(spark, d)
    return dag.history(a, a.agg(F.min("triple_key")).first()[0], 20).select("hash", "op")


@query("dag_history_by_subject", f"WITH {A} SELECT hash, op FROM a WHERE starts_with(triple_key, '7|') ORDER BY ts DESC, hash DESC LIMIT 50")
def dag_history_by_subject(spark, d):
    return t.actions(spark, d).where(F.col("triple_key").startswith("7|")).orderBy(F.desc("ts"), F.desc("hash")).limit(50).select("hash", "op")


@query("dag_chain", f"WITH {A} SELECT hash, seq FROM a WHERE author = 5 ORDER BY seq DESC LIMIT 10")
def dag_chain(spark, d):
    return dag.last_of_authors(t.actions(spark, d).where("author = 5"), 10).select("hash", "seq")


@query("dag_ancestors", f"WITH RECURSIVE {A}, {UP.format(990)} SELECT hash FROM anc")
def dag_ancestors(spark, d):
    return dag.ancestors(t.actions(spark, d), [990])


@query("dag_at", f"WITH RECURSIVE {A}, {UP.format(990)}, x AS (SELECT * FROM a WHERE hash IN (SELECT hash FROM anc)) " + REPLAY.format("x"))
def dag_at(spark, d):
    return dag.at(t.actions(spark, d), 990)


@query("dag_at_timestamp", f"WITH {A}, x AS (SELECT * FROM a WHERE ts <= (SELECT min(ts) + INTERVAL 5 DAY FROM a)) " + REPLAY.format("x"))
def dag_at_timestamp(spark, d):
    a = t.actions(spark, d)
    until = a.agg(F.min("ts") + F.expr("interval 5 days")).first()[0]
    return dag.at_timestamp(a, until.isoformat(" "))


@query("dag_diff", f"WITH RECURSIVE {A}, {UP.format(990)}, old(hash) AS (SELECT 500::BIGINT UNION SELECT e.parent FROM old JOIN e ON e.child = old.hash) SELECT hash FROM anc WHERE hash NOT IN (SELECT hash FROM old)")
def dag_diff(spark, d):
    return dag.difference(t.actions(spark, d), 500, 990)


@query("dag_missing", f"WITH RECURSIVE {A}, {UP.format(700)} SELECT hash FROM a WHERE hash NOT IN (SELECT hash FROM anc)")
def dag_missing(spark, d):
    return dag.missing(t.actions(spark, d), [700])


@query("dag_prune_last", f"WITH {A}, k AS (SELECT hash FROM a ORDER BY ts DESC, hash DESC LIMIT 100) SELECT hash FROM k UNION SELECT hash FROM a WHERE hash NOT IN (SELECT parent FROM e)")
def dag_prune_last(spark, d):
    return dag.prune(t.actions(spark, d), keep_last=100)


@query("dag_prune_depth", f"WITH RECURSIVE {A}, r(hash, depth) AS (SELECT hash, 0 FROM a WHERE hash NOT IN (SELECT parent FROM e) UNION SELECT e.parent, depth + 1 FROM r JOIN e ON e.child = r.hash WHERE depth < 3) SELECT DISTINCT hash FROM r")
def dag_prune_depth(spark, d):
    return dag.prune(t.actions(spark, d), keep_depth=3)


@query("dag_depth_map", f"WITH RECURSIVE {A}, r(hash, depth) AS (SELECT hash, 0 FROM a WHERE hash NOT IN (SELECT parent FROM e) UNION SELECT e.parent, depth + 1 FROM r JOIN e ON e.child = r.hash WHERE depth < 400) SELECT hash, min(depth) AS depth FROM r GROUP BY 1")
def dag_depth_map(spark, d):
    return dag.depths(t.actions(spark, d))


@query("dag_export_dot", f"WITH {A} SELECT '  \"' || hash || '\" [label=\"' || author || ':' || seq || '\"];' AS line FROM a UNION ALL SELECT '  \"' || child || '\" -> \"' || parent || '\";' FROM e")
def dag_export_dot(spark, d):
    return dag.dot(t.actions(spark, d))


@query("dag_export_mermaid", f"WITH {A} SELECT '  ' || child || ' --> ' || parent AS line FROM e")
def dag_export_mermaid(spark, d):
    return dag.mermaid(t.actions(spark, d))


@query("dag_export_json")
def dag_export_json(spark, d):
    return dag.as_json(t.actions(spark, d))


@query("viz_edges_for_node", f"WITH {A} SELECT child, parent FROM e WHERE child = 60 OR parent = 60")
def viz_edges_for_node(spark, d):
    return dag.edges(t.actions(spark, d)).where("child = 60 or parent = 60")


TIPS = "SELECT hash FROM a WHERE {0} AND hash NOT IN (SELECT parent FROM e JOIN a x ON e.child = x.hash WHERE {1})"


@query("dag_put", f"WITH {A} " + TIPS.format("true", "true"))
def dag_put(spark, d):
    a = t.actions(spark, d)
    return dag.Log(a.where("hash < 500")).put(a.where("hash >= 500")).tips


@query("dag_ingest", f"WITH {A} SELECT 'tip' AS what, hash FROM ({TIPS.format('hash >= 500', 'x.hash >= 500')}) UNION ALL SELECT 'action', hash FROM a")
def dag_ingest(spark, d):
    a = t.actions(spark, d)
    log = dag.Log(a.where("hash >= 500")).ingest(a)
    return log.tips.select(F.lit("tip").alias("what"), "hash").unionByName(log.actions.select(F.lit("action").alias("what"), "hash"))


@query("dag_init", f"WITH {A} SELECT hash FROM a WHERE hash = 0")
def dag_init(spark, d):
    a = t.actions(spark, d)
    return dag.Log.init(a.limit(0), a.where("hash = 0")).tips


@query("dag_sync_response", f"WITH RECURSIVE {A}, {UP.format(700)} SELECT hash, author, seq FROM a WHERE hash NOT IN (SELECT hash FROM anc)")
def dag_sync_response(spark, d):
    return dag.Log(t.actions(spark, d)).respond([700]).select("hash", "author", "seq")
