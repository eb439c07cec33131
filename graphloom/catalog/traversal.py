"""Traversal and iterative operators (inventory 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similarity as sim
from ..operators import traversal as tr
from ..operators import vault
from ..registry import query
from ..sources import tables as t
from .joins import PAIRS, vectors

L = f"l AS ({t.LINKS_SQL})"
BOTH = "u AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l)"


@query("traverse", f"WITH RECURSIVE {L}, r(node) AS (SELECT dst FROM l WHERE src = 2 UNION SELECT l.dst FROM r JOIN l ON l.src = r.node) SELECT node FROM r WHERE node <> 2")
def traverse(spark, d):
    return tr.reachable(t.links(spark, d), [2]).select("node")


@query("traversal_builder", f"WITH RECURSIVE {L}, {BOTH}, r(node, depth) AS (SELECT 2::BIGINT, 0 UNION SELECT u.dst, depth + 1 FROM r JOIN u ON u.src = r.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM r WHERE node <> 2 GROUP BY 1")
def traversal_builder(spark, d):
    return tr.reachable(t.links(spark, d), [2], 2, True)


@query("traverse_bounded", f"WITH RECURSIVE {L}, r(node, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT l.dst, depth + 1 FROM r JOIN l ON l.src = r.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM r WHERE node <> 7 GROUP BY 1")
def traverse_bounded(spark, d):
    return tr.reachable(t.links(spark, d), [7], 3)


@query("ltm_traverse", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst FROM lineitem), r(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM r WHERE node <> 1 GROUP BY 1")
def ltm_traverse(spark, d):
    e = t.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).distinct()
    return tr.reachable(e, [1], 2)


@query("find_related", f"WITH {L}, {BOTH} SELECT dst AS node FROM u WHERE src = 3")
def find_related(spark, d):
    return tr.reachable(t.links(spark, d), [3], 1, True).select("node")


@query("shortest_path", f"WITH RECURSIVE {L}, {BOTH}, r(node, path) AS (SELECT 2::BIGINT, [2::BIGINT] UNION ALL SELECT u.dst, list_append(path, u.dst) FROM r JOIN u ON u.src = r.node WHERE len(path) < 4 AND NOT list_contains(path, u.dst)) SELECT array_to_string(min(path), '>') AS path FROM r WHERE node = 15 AND len(path) = (SELECT min(len(path)) FROM r WHERE node = 15) HAVING min(path) IS NOT NULL")
def shortest_path(spark, d):
    return tr.shortest_path(t.links(spark, d), 2, 15, 3).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("local_graph")
def local_graph(spark, d):
    return vault.local_graph(t.links(spark, d), 2)


@query("causal_chain", f"WITH RECURSIVE e AS ({t.EVENTS_SQL}), r(id, step) AS (SELECT max(id), 0 FROM e UNION ALL SELECT e.parent, step + 1 FROM r JOIN e ON e.id = r.id WHERE e.parent IS NOT NULL AND step < 49) SELECT id, step FROM r")
def causal_chain(spark, d):
    e = t.trace_events(spark, d)
    newest = t.table(spark, d, "events").agg(F.max("event_id")).first()[0]
    return tr.chain_back(e, newest, 50)


OWN = f"o AS (SELECT owner AS src, owned + 1000000 AS dst, quantity / CAST(total AS DOUBLE) AS share FROM ({t.OWNERSHIP_SQL}) WHERE owned <= 100 AND owner <= 30 UNION ALL SELECT owned + 1000000, owner + 2000000, 0.5 FROM ({t.OWNERSHIP_SQL}) WHERE owned <= 100 AND owner BETWEEN 31 AND 50)"


def owned(spark, d):
    o = t.ownership(spark, d).where("owned <= 100")
    down = o.where("owner <= 30").select(F.col("owner").alias("src"), (F.col("owned") + 1_000_000).alias("dst"), (F.col("quantity") / F.col("total")).alias("share"))
    return down.unionByName(o.where("owner between 31 and 50").select((F.col("owned") + 1_000_000).alias("src"), (F.col("owner") + 2_000_000).alias("dst"), F.lit(0.5).alias("share")))


@query("all_paths", f"WITH {OWN} SELECT a.src || '>' || a.dst || '>' || b.dst AS path, round(a.share * b.share, 6) AS product FROM o a JOIN o b ON a.dst = b.src WHERE a.src = 7 AND b.dst = (SELECT min(dst) FROM o WHERE dst > 2000000)")
def all_paths(spark, d):
    e = owned(spark, d)
    end = e.where("dst > 2000000").agg(F.min("dst")).first()[0] or -1
    return tr.simple_paths(e, 7, end).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.round("product", 6).alias("product"))


@query("ownership_tree", f"WITH {OWN}, s AS (SELECT min(dst) AS node FROM o WHERE dst > 2000000), one AS (SELECT DISTINCT src AS node FROM o WHERE dst IN (SELECT node FROM s)), two AS (SELECT DISTINCT src AS node FROM o WHERE dst IN (SELECT node FROM one)) SELECT node, 1 AS depth FROM one UNION SELECT node, 2 FROM two WHERE node NOT IN (SELECT node FROM one)")
def ownership_tree(spark, d):
    e = owned(spark, d)
    end = e.where("dst > 2000000").agg(F.min("dst")).first()[0] or -1
    return tr.reachable(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), [end], 5)


SCC = f"WITH RECURSIVE {L}, s AS (SELECT * FROM l), r(a, b) AS (SELECT src, dst FROM s UNION SELECT r.a, s.dst FROM r JOIN s ON s.src = r.b) SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a IN (SELECT p.a FROM r p JOIN r q ON p.a = q.b AND p.b = q.a WHERE p.a <> p.b) GROUP BY 1"


@query("scc", SCC)
def scc(spark, d):
    return tr.strongly_connected(t.links(spark, d))


SMALL = "l"


@query("components", f"WITH RECURSIVE {L}, u AS (SELECT src, dst FROM {SMALL} UNION SELECT dst, src FROM {SMALL}), r(a, b) AS (SELECT src, dst FROM u UNION SELECT r.a, u.dst FROM r JOIN u ON u.src = r.b), c AS (SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a) SELECT node, component FROM c WHERE component IN (SELECT component FROM c GROUP BY 1 HAVING count(*) > 3)")
def components(spark, d):
    return tr.sized_components(t.links(spark, d))


@query("semantic_clusters", "WITH RECURSIVE " + PAIRS[5:] + ", u AS (SELECT a, b FROM p WHERE cosine >= 0.4 UNION SELECT b, a FROM p WHERE cosine >= 0.4), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS node, least(a, min(b)) AS cluster FROM r GROUP BY a")
def semantic_clusters(spark, d):
    from ..plans.fixpoint import components as join

    pairs = sim.similar_pairs(vectors(spark, d), 0.3999995).select("a", "b", F.round("cosine", 6).alias("c")).where("c >= 0.4")
    return join(pairs.select("a", "b")).select("node", F.col("component").alias("cluster"))


@query("high_risk_networks", f"WITH {L}, {BOTH}, n AS (SELECT doc_id AS id, doc_id % 10 AS score FROM documents), s AS (SELECT id FROM n WHERE score >= 7), e AS (SELECT id AS seed, id AS node FROM s UNION SELECT s.id, u.dst FROM s JOIN u ON u.src = s.id UNION SELECT s.id, v.dst FROM s JOIN u ON u.src = s.id JOIN u v ON v.src = u.dst) SELECT seed, count(*) AS nodes, max(score) AS max_score FROM e JOIN n ON n.id = e.node GROUP BY 1")
def high_risk_networks(spark, d):
    scores = t.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("score"))
    return tr.ego_networks(t.links(spark, d), scores.where("score >= 7"), scores)


@query("links_from", f"SELECT dst AS node FROM ({t.LINKS_SQL}) WHERE src = 3")
def links_from(spark, d):
    return t.links(spark, d).where("src = 3").select(F.col("dst").alias("node"))


@query("links_to", f"SELECT src AS node FROM ({t.LINKS_SQL}) WHERE dst = 22")
def links_to(spark, d):
    return t.links(spark, d).where("dst = 22").select(F.col("src").alias("node"))


@query("entities_by_type", "SELECT 'supplier:' || s_suppkey AS entity FROM supplier")
def entities_by_type(spark, d):
    from ..operators import graph as g

    wanted = {"kind": "Node", "node": "type:Supplier"}
    return g.find(t.triples(spark, d, predicate="rdf:type", obj=wanted), predicate="rdf:type", obj=wanted).select(F.col("subject").alias("entity"))
