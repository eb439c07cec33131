"""Aggregations (inventory 2.4) and sorts with limits (2.6), set operations (2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import allpairs
from ..operators import graph as g
from ..operators import similarity as sim
from ..operators import vault
from ..registry import query
from ..sources import tables as t
from .joins import PAIRS, H, vectors
from .triples import TRIPLES

NODES = "SELECT doc_id AS id FROM documents"
DEGREE = f"""SELECT id, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS id, 0 AS i, 1 AS o FROM ({t.LINKS_SQL}) UNION ALL
 SELECT dst, 1, 0 FROM ({t.LINKS_SQL}) UNION ALL SELECT doc_id, 0, 0 FROM documents) GROUP BY 1"""


def degree(spark, d):
    return vault.degrees(t.table(spark, d, "documents").select(F.col("doc_id").alias("id")), t.links(spark, d))


@query("graph_stats", f"""SELECT count(*) AS triples, count(DISTINCT subject) AS subjects, count(DISTINCT predicate) AS predicates, count(DISTINCT (kind, node, str, "int", dbl)) AS objects FROM ({TRIPLES})""")
def graph_stats(spark, d):
    return g.stats(t.every_triple(spark, d)).drop("bytes")


@query("list_subjects", f"SELECT DISTINCT subject FROM ({TRIPLES}) ORDER BY subject LIMIT 200")
def list_subjects(spark, d):
    return g.list_distinct(t.every_triple(spark, d), "subject", 200)


@query("list_predicates", f"SELECT DISTINCT predicate FROM ({TRIPLES})")
def list_predicates(spark, d):
    return g.list_distinct(t.triples(spark, d), "predicate", 10_000)


@query("list_tags", f"SELECT tag, count(*) AS n FROM (SELECT lang AS tag FROM documents UNION ALL SELECT source FROM documents) WHERE tag <> '' GROUP BY 1")
def list_tags(spark, d):
    return t.notes(spark, d).select(F.explode(F.array("lang", "source")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy("tag")


@query("list_folders", f"SELECT DISTINCT source AS folder FROM documents UNION SELECT DISTINCT source || '/' || lang FROM documents")
def list_folders(spark, d):
    return vault.folders(t.notes(spark, d).select("path"))


@query("type_counts", f"SELECT node AS type, count(*) AS n FROM ({TRIPLES}) WHERE predicate = 'rdf:type' GROUP BY 1")
def type_counts(spark, d):
    return g.find(t.triples(spark, d, predicate="rdf:type"), predicate="rdf:type").groupBy(F.col("node").alias("type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


@query("tag_clusters", "SELECT lang AS tag, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def tag_clusters(spark, d):
    return t.notes(spark, d).groupBy(F.col("lang").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("degrees", DEGREE)
def degrees(spark, d):
    return degree(spark, d)


@query("entry_points", f"SELECT * FROM ({DEGREE}) WHERE n_in + n_out > 0 ORDER BY n_in DESC, n_out DESC, id LIMIT 20")
def entry_points(spark, d):
    return vault.entry_points(degree(spark, d))


#: Notes of which only those of a fourth of the numbers hold links.
FEW = DEGREE.replace(f"({t.LINKS_SQL})", f"(SELECT * FROM ({t.LINKS_SQL}) WHERE src % 4 = 1)")


@query("orphans", f"SELECT * FROM ({FEW}) WHERE n_in = 0 AND n_out = 0")
def orphans(spark, d):
    return vault.orphans(vault.degrees(t.table(spark, d, "documents").select(F.col("doc_id").alias("id")), t.links(spark, d).where("src % 4 = 1")))


@query("graph_view_nodes", f"SELECT id, n_in + n_out AS degree FROM ({DEGREE}) ORDER BY degree DESC, id LIMIT 600")
def graph_view_nodes(spark, d):
    return vault.view_nodes(degree(spark, d))


AUDIT = "SELECT event_id AS id, user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id % 5 END AS namespace, event_type AS action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM events"


def audit(spark, d):
    e = t.table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id") % 5).alias("namespace"), F.col("event_type").alias("action"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


@query("audit_stats", f"SELECT 'action' AS by, action AS key, count(*) AS n FROM ({AUDIT}) GROUP BY 2 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), count(*) FROM ({AUDIT}) GROUP BY 2 UNION ALL SELECT 'namespace', CAST(namespace AS VARCHAR), count(*) FROM ({AUDIT}) WHERE namespace IS NOT NULL GROUP BY 2")
def audit_stats(spark, d):
    cells = [("action", "action"), ("user", "user_id"), ("namespace", "namespace")]
    rows = audit(spark, d).select(F.explode(F.array(*[F.struct(F.lit(n).alias("by"), F.col(c).cast("string").alias("key")) for n, c in cells])).alias("x"))
    return rows.select("x.by", "x.key").where("key is not null").groupBy("by", "key").agg(F.count(F.lit(1)).alias("n"))


@query("audit_query", f"SELECT id, user_id, action, timestamp FROM ({AUDIT}) WHERE namespace = 3 AND action = 'purchase' ORDER BY timestamp DESC, id DESC LIMIT 50")
def audit_query(spark, d):
    from ..operators import traces

    return traces.audit_page(audit(spark, d), 50, namespace=3, action="purchase").select("id", "user_id", "action", "timestamp")


@query("query_events", f"SELECT id, event_type, agent FROM ({t.EVENTS_SQL}) WHERE event_type = 'signup' AND agent <= 30 ORDER BY id LIMIT 100")
def query_events(spark, d):
    from ..operators import traces

    stored = traces.to_triples(t.trace_events(spark, d).where("event_type = 'signup' and agent <= 30"))
    rows = traces.from_triples(stored).where("event_type = 'signup'")
    return rows.select(F.substring_index("subject", ":", -1).cast("long").alias("id"), "event_type", F.col("agent").cast("long").alias("agent")).orderBy("id").limit(100)


@query("viz_stats", "SELECT event_type, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 1")
def viz_stats(spark, d):
    return t.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("note_vectors", "SELECT label AS note, i AS pos, round(avg(CAST(embedding[i + 1] AS DOUBLE)), 6) AS mean FROM (SELECT label, embedding, unnest(range(64)) AS i FROM embeddings) GROUP BY 1, 2")
def note_vectors(spark, d):
    rows = t.table(spark, d, "embeddings").select(F.col("label").alias("note"), F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("note", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("mean_similarity", PAIRS + ", m AS (SELECT a AS note, b AS other, cosine FROM p UNION ALL SELECT b, a, cosine FROM p) SELECT note, round(avg(cosine), 4) + 0.0 AS mean FROM m GROUP BY 1")
def mean_similarity(spark, d):
    return allpairs.mean_cosines(vectors(spark, d), 4).select(F.col("id").alias("note"), (F.round("mean", 4) + 0.0).alias("mean"))


@query("top_k_per_node", PAIRS + ", e AS (SELECT a AS node, a, b, cosine FROM p UNION ALL SELECT b, a, b, cosine FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cosine DESC, a, b) AS n FROM e) SELECT DISTINCT a, b, cosine FROM r WHERE n <= 3")
def top_k_per_node(spark, d):
    found = allpairs.best_partners(vectors(spark, d), vault.BEST)
    return found.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "cosine").distinct()


@query("semantic_edges_cap", PAIRS + f"SELECT a, b, cosine FROM p WHERE NOT EXISTS (SELECT 1 FROM ({t.LINKS_SQL}) l WHERE (l.src, l.dst) IN ((a, b), (b, a))) AND cosine >= 0.3 ORDER BY cosine DESC, a, b LIMIT 1200")
def semantic_edges_cap(spark, d):
    pairs = sim.similar_pairs(vectors(spark, d), 0.2999995).select("a", "b", F.round("cosine", 6).alias("cosine")).where("cosine >= 0.3")
    linked = t.links(spark, d).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.join(linked, ["a", "b"], "left_anti").orderBy(F.desc("cosine"), "a", "b").limit(1200)


@query("consistency_score", "SELECT quality AS verifier, count(*) AS evaluated, sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS score FROM labels GROUP BY 1")
def consistency_score(spark, d):
    n = F.count(F.lit(1))
    return t.table(spark, d, "labels").groupBy(F.col("quality").alias("verifier")).agg(n.alias("evaluated"), (F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)) / n).alias("score"))


@query("batch_verify", "SELECT count(*) FILTER (l.doc_id IS NOT NULL) AS found, count(*) FILTER (l.quality = 1) AS accepted, count(*) FILTER (l.quality = 0) AS rejected, count(*) FILTER (l.doc_id IS NULL) AS not_evaluated FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def batch_verify(spark, d):
    rows = t.table(spark, d, "documents").select("doc_id").join(t.table(spark, d, "labels").withColumn("seen", F.lit(1)), "doc_id", "left")
    return rows.agg(F.count("seen").alias("found"), F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("quality") == 0).alias("rejected"), F.count_if(F.col("seen").isNull()).alias("not_evaluated"))


@query("proof_stats", "SELECT p_brand AS type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS bytes, count(*) FILTER (p_size > 25) AS ok FROM part GROUP BY 1")
def proof_stats(spark, d):
    return t.table(spark, d, "part").groupBy(F.col("p_brand").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("bytes"), F.count_if(F.col("p_size") > 25).alias("ok"))


@query("list_proofs", "SELECT p_partkey AS id, p_brand AS type FROM part WHERE p_brand = 'Brand#13'")
def list_proofs(spark, d):
    return t.table(spark, d, "part").where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("type"))


@query("memory_stats", f"SELECT tier, count(*) AS n, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM ({t.MEMORIES_SQL}) GROUP BY 1")
def memory_stats(spark, d):
    return t.memories(spark, d).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("integration_dump", H + "SELECT count(*) FILTER (state = 'O' AND type = 'Create') AS pending, count(*) FILTER (state = 'O' AND type <> 'Create') AS limbo, count(*) FILTER (state = 'F') AS integrated FROM h")
def integration_dump(spark, d):
    return t.headers(spark, d).agg(F.count_if(F.expr("state = 'O' and type = 'Create'")).alias("pending"), F.count_if(F.expr("state = 'O' and type <> 'Create'")).alias("limbo"), F.count_if(F.expr("state = 'F'")).alias("integrated"))


@query("storage_stats", "SELECT count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS published, max(l_shipdate) AS last_sync, max(l_orderkey) AS latest FROM lineitem")
def storage_stats(spark, d):
    return t.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("published"), F.max("l_shipdate").alias("last_sync"), F.max("l_orderkey").alias("latest"))


@query("receipt_count", "SELECT l_suppkey AS op, count(*) AS receipts FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1")
def receipt_count(spark, d):
    return t.table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_suppkey").alias("op")).agg(F.count(F.lit(1)).alias("receipts"))


# --- risk ------------------------------------------------------------------------------------------

LEVEL = "CASE WHEN {0} >= 9 THEN 'critical' WHEN {0} >= 7 THEN 'high' WHEN {0} >= 5 THEN 'medium' WHEN {0} >= 3 THEN 'low' ELSE 'minimal' END"
FACTOR = "SELECT c_custkey AS entity, CAST(abs(round(c_acctbal * 100)) AS BIGINT) % 11 AS a, c_nationkey % 11 AS b, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 11 END AS f FROM customer"


def factors(spark, d):
    c = t.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("entity"), F.expr("cast(abs(round(c_acctbal * 100)) as bigint) % 11").alias("a"), F.expr("c_nationkey % 11").alias("b"), F.expr("case when c_custkey % 3 <> 0 then c_custkey % 11 end").alias("f"))


RISK = f"SELECT entity, (3 * a + 2 * b + CASE WHEN f IS NULL THEN 0 ELSE 5 * f END) / CAST(5 + CASE WHEN f IS NULL THEN 0 ELSE 5 END AS DOUBLE) AS score FROM ({FACTOR})"


@query("risk_score", f"SELECT entity, round(score, 6) AS score, {LEVEL.format('score')} AS level FROM ({RISK})")
def risk_score(spark, d):
    from ..operators import risk

    return risk.weighted(factors(spark, d), {"a": 3, "b": 2, "f": 5}).select("entity", F.round("score", 6).alias("score"), risk.level(F.col("score")).alias("level"))


@query("ownership_risk", f"SELECT owned, CASE WHEN sum(quantity) * 100 / CAST(max(total) AS DOUBLE) < 90 THEN 7 WHEN count(*) > 5 THEN 6 ELSE 1 END AS risk FROM ({t.OWNERSHIP_SQL}) GROUP BY 1")
def ownership_risk(spark, d):
    from ..operators import risk

    return risk.ownership(t.ownership(spark, d))


@query("compliance_report", "SELECT p_brand AS severity, count(*) AS checks, count(*) FILTER (l_returnflag = 'R') AS alerts, count(DISTINCT l_suppkey) AS entities FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' GROUP BY 1")
def compliance_report(spark, d):
    rows = t.table(spark, d, "lineitem").where("l_shipdate >= timestamp_ntz '1995-01-01 00:00:00' and l_shipdate < timestamp_ntz '1996-01-01 00:00:00'")
    joined = rows.join(t.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("severity")).agg(F.count(F.lit(1)).alias("checks"), F.count_if(F.col("l_returnflag") == "R").alias("alerts"), F.count_distinct("l_suppkey").alias("entities"))


@query("network_stats", f"SELECT (SELECT count(*) FROM documents) AS nodes, (SELECT count(*) FROM ({t.LINKS_SQL})) AS edges, 2.0::DOUBLE * (SELECT count(*) FROM ({t.LINKS_SQL})) / (SELECT count(*) FROM documents) AS average_degree")
def network_stats(spark, d):
    n = t.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("nodes"))
    return t.links(spark, d).agg(F.count(F.lit(1)).alias("edges")).select(n.scalar().alias("nodes"), "edges", (2.0 * F.col("edges") / n.scalar()).alias("average_degree"))


@query("index_stats", "SELECT count(*) AS decisions, count(DISTINCT lang) AS tags, count(DISTINCT source) AS files FROM documents")
def index_stats(spark, d):
    return t.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("decisions"), F.count_distinct("lang").alias("tags"), F.count_distinct("source").alias("files"))


STEPS = "SELECT event_type AS action, CAST(floor(value / 10) AS BIGINT) AS state, lead(CAST(floor(value / 10) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, CAST(round(value * 100) AS BIGINT) AS cents FROM events"


def steps(spark, d):
    from pyspark.sql import Window

    bin_ = F.floor(F.col("value") / 10)
    return t.table(spark, d, "events").select(F.col("event_type").alias("action"), bin_.alias("state"), F.lead(bin_).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"), F.round(F.col("value") * 100).cast("long").alias("cents"))


@query("transition_probs", f"SELECT state, action, next, n / CAST(sum(n) OVER (PARTITION BY state, action) AS DOUBLE) AS prob FROM (SELECT state, action, next, count(*) AS n FROM ({STEPS}) WHERE next IS NOT NULL GROUP BY 1, 2, 3)")
def transition_probs(spark, d):
    from ..operators import learning

    return learning.transitions(steps(spark, d))


@query("predict_next", f"SELECT state, action, arg_max(next, (n, -next)) AS next FROM (SELECT state, action, next, count(*) AS n FROM ({STEPS}) WHERE next IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2")
def predict_next(spark, d):
    from ..operators import learning

    return learning.likeliest(steps(spark, d))


@query("reward_mean", f"SELECT state, action, sum(cents) / CAST(100 * count(*) AS DOUBLE) AS reward FROM ({STEPS}) GROUP BY 1, 2")
def reward_mean(spark, d):
    return steps(spark, d).groupBy("state", "action").agg((F.sum("cents") / (100.0 * F.count(F.lit(1)))).alias("reward"))


@query("success_rate", "SELECT user_id, count(*) FILTER (event_type <> 'error') / CAST(count(*) AS DOUBLE) AS rate FROM events GROUP BY 1")
def success_rate(spark, d):
    return t.table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("event_type") != "error") / F.count(F.lit(1))).alias("rate"))


@query("term_coverage", "SELECT doc_id, (CASE WHEN contains(lower(text), 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'zzzq') THEN 1 ELSE 0 END) / 2.0::DOUBLE AS coverage FROM documents")
def term_coverage(spark, d):
    from ..operators import memory

    return t.table(spark, d, "documents").select("doc_id", memory.coverage(memory.question_terms(F.lit("What of the tion, zzzq and THE tion?")), F.col("text")).alias("coverage"))


# --- sorts with limits -------------------------------------------------------------------------------


def top(name: str, sql: str, table: str, where: str, order: list[str], limit: int, columns: list) -> None:
    @query(name, sql)
    def run(spark, d):
        return t.table(spark, d, table).where(where).orderBy(*[F.expr(o.split()[0]).desc() if o.endswith(" desc") else F.col(o) for o in order]).limit(limit).select(*columns)


top("recent_nodes", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 30", "events", "true", ["ts desc", "event_id desc"], 30, ["event_id", "event_type"])
top("seq_range", "SELECT event_id, user_id FROM events WHERE event_id >= 100 AND event_id < 400 ORDER BY event_id LIMIT 64", "events", "event_id >= 100 and event_id < 400", ["event_id"], 64, ["event_id", "user_id"])
top("decisions_sorted", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 40", "orders", "true", ["o_orderdate desc", "o_orderkey"], 40, ["o_orderkey", "o_orderstatus"])
top("list_approvals", "SELECT event_id, user_id FROM events WHERE event_type = 'signup' ORDER BY event_id DESC LIMIT 64", "events", "event_type = 'signup'", ["event_id desc"], 64, ["event_id", "user_id"])
top("list_git_provenance", "SELECT event_id, value FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 25", "events", "event_type = 'purchase'", ["ts desc", "event_id desc"], 25, ["event_id", "value"])
top("viz_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 10", "events", "true", ["ts desc", "event_id desc"], 10, ["event_id", "ts"])
top("viz_dag", "SELECT event_id, user_id FROM events WHERE lower(event_type) = 'view' AND user_id < 40 ORDER BY event_id LIMIT 100", "events", "lower(event_type) = lower('VIEW') and user_id < 40", ["event_id"], 100, ["event_id", "user_id"])
top("decision_query", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'ing') AND lang = 'en' AND contains(source, '1') ORDER BY doc_id LIMIT 50", "documents", "contains(lower(text), 'ing') and array_size(array_except(array('en'), array(lang, source))) = 0 and contains(source, '1')", ["doc_id"], 50, ["doc_id", "lang"])


@query("or_set_contains", "SELECT DISTINCT c_nationkey AS element FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def or_set_contains(spark, d):
    from ..operators import crdt

    adds = t.table(spark, d, "customer").select(F.col("c_nationkey").alias("element"), F.col("c_custkey").alias("tag"))
    removes = t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("element"), F.col("s_suppkey").alias("tag"))
    return crdt.present(adds, removes.select("tag"))


@query("or_set_merge", "SELECT element, tag FROM (SELECT c_nationkey AS element, c_custkey AS tag FROM customer UNION SELECT s_nationkey, s_suppkey FROM supplier)")
def or_set_merge(spark, d):
    from ..operators import crdt

    return crdt.merge(t.table(spark, d, "customer").select(F.col("c_nationkey").alias("element"), F.col("c_custkey").alias("tag")), t.table(spark, d, "supplier").select(F.col("s_nationkey").alias("element"), F.col("s_suppkey").alias("tag")))


@query("lww_merge", "SELECT user_id AS id, arg_max(event_id, (ts, event_id)) AS winner FROM events GROUP BY 1")
def lww_merge(spark, d):
    from ..operators import crdt

    return crdt.last_write(t.table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("node")))


@query("bloom_missing", "SELECT c_custkey AS hash FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def bloom_missing(spark, d):
    from ..operators import crdt

    theirs = t.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("hash")).distinct()
    own = t.table(spark, d, "customer").select(F.col("c_custkey").alias("hash"))
    return crdt.missing(own, crdt.bloom_filter(theirs, 1 << 20), 1 << 20, theirs)


@query("backlinks", f"SELECT src FROM ({t.LINKS_SQL}) WHERE dst = 8")
def backlinks(spark, d):
    return vault.backlinks(t.links(spark, d), 8)


@query("outgoing", f"SELECT dst FROM ({t.LINKS_SQL}) WHERE src = 5")
def outgoing(spark, d):
    return t.links(spark, d).where("src = 5").select("dst")


@query("unlinked_mentions", f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9])the([^a-z0-9]|$)') AND doc_id NOT IN (SELECT src FROM ({t.LINKS_SQL}) WHERE dst = 5)")
def unlinked_mentions(spark, d):
    docs = t.table(spark, d, "documents").where(F.lower("text").rlike("(^|[^a-z0-9])the([^a-z0-9]|$)")).select("doc_id")
    return docs.join(vault.backlinks(t.links(spark, d), 5).withColumnRenamed("src", "doc_id"), "doc_id", "left_anti")
