"""Scans, pattern queries, filters and stores of triples (inventory 2.1, 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import graph as g
from ..registry import query
from ..sources import rdf
from ..sources import tables as t

TRIPLES = t.triples_sql()
COLS = 'subject, predicate, kind, coalesce(node, str, CAST("int" AS VARCHAR)) AS text, dbl'
SHOWN = ["subject", "predicate", "kind", "coalesce(node, str, cast(`int` as string)) as text", "dbl"]


def shape(name: str, where: str, **bound) -> None:
    @query(name, f"SELECT {COLS} FROM ({TRIPLES}) WHERE {where}")
    def run(spark, d):
        return g.find(t.triples(spark, d, **bound) if bound else t.every_triple(spark, d), **bound).selectExpr(*SHOWN)


shape("scan_triples", "true")
shape("find_any", "true")
shape("find_s", "subject = 'customer:7'", subject="customer:7")
shape("find_p", "predicate = 'has_name'", predicate="has_name")
shape("find_o", "kind = 'Node' AND node = 'nation:3'", obj={"kind": "Node", "node": "nation:3"})
shape("find_sp", "subject = 'customer:7' AND predicate = 'in_nation'", subject="customer:7", predicate="in_nation")
shape("find_po", "predicate = 'size' AND kind = 'Integer' AND \"int\" = 7", predicate="size", obj={"kind": "Integer", "int": 7})
shape("find_so", "subject = 'nation:3' AND kind = 'Node' AND node = 'type:Nation'", subject="nation:3", obj={"kind": "Node", "node": "type:Nation"})
shape("find_spo", "subject = 'nation:3' AND predicate = 'rdf:type' AND kind = 'Node' AND node = 'type:Nation'", subject="nation:3", predicate="rdf:type", obj={"kind": "Node", "node": "type:Nation"})
shape("get_subject", "subject = 'part:11'", subject="part:11")
shape("get_predicate", "predicate = 'segment'", predicate="segment")
shape("get_object", "kind = 'String' AND str = 'BUILDING'", obj={"kind": "String", "str": "BUILDING"})
shape("graphql_triples", "predicate = 'status' AND kind = 'String' AND str = 'F'", predicate="status", obj={"kind": "String", "str": "F"})


@query("pattern_matches", f"SELECT (subject = 'customer:7' AND predicate = 'in_nation') AS matches, count(*) AS n FROM ({TRIPLES}) WHERE subject LIKE 'customer:%' GROUP BY 1")
def pattern_matches(spark, d):
    return t.triples(spark, d).where(F.col("subject").startswith("customer:")).groupBy(g.pattern("customer:7", "in_nation").alias("matches")).agg(F.count(F.lit(1)).alias("n"))


@query("get_contains", f"SELECT count(*) > 0 AS present FROM ({TRIPLES}) WHERE subject = 'region:1' AND predicate = 'rdf:type'")
def get_contains(spark, d):
    rows = t.triples(spark, d, subject="region:1")
    wanted = model.with_id(g.find(rows, "region:1", "rdf:type")).select("triple_id")
    return model.with_id(g.find(rows, "region:1")).join(wanted, "triple_id", "left_semi").agg((F.count(F.lit(1)) > 0).alias("present"))


@query("subjects_with_prefix", f"SELECT DISTINCT subject FROM ({TRIPLES}) WHERE starts_with(subject, 'customer:1')")
def subjects_with_prefix(spark, d):
    return g.subjects_with_prefix(t.triples(spark, d), "customer:1")


ORDERED = 'ORDER BY subject, predicate, CASE kind WHEN \'Node\' THEN 0 WHEN \'String\' THEN 1 WHEN \'Integer\' THEN 2 ELSE 3 END, node NULLS FIRST, "int" NULLS FIRST, dbl NULLS FIRST, str NULLS FIRST'


@query("query_builder", f"SELECT {COLS} FROM ({TRIPLES}) WHERE predicate = 'has_name' {ORDERED} LIMIT 25 OFFSET 10")
def query_builder(spark, d):
    return g.builder(t.triples(spark, d, predicate="has_name"), 10, 25, predicate="has_name")[0].selectExpr(*SHOWN)


@query("query_builder_totals", f"SELECT count(*) AS total_count, count(*) - 10 > 25 AS has_more FROM ({TRIPLES}) WHERE predicate = 'has_name'")
def query_builder_totals(spark, d):
    return g.builder(t.triples(spark, d, predicate="has_name"), 10, 25, predicate="has_name")[1]


@query("query_pattern", f"SELECT {COLS} FROM ({TRIPLES}) WHERE predicate = 'acctbal' AND starts_with(subject, 'supplier:') {ORDERED} LIMIT 10000")
def query_pattern(spark, d):
    rows = g.in_namespace(g.find(t.triples(spark, d, predicate="acctbal"), predicate="acctbal"), "supplier")
    return g.page(rows, ["subject", "predicate", *model.value_order()], 0, 50_000, g.MOST_ROWS).selectExpr(*SHOWN)


@query("host_graph_query", f"SELECT {COLS} FROM ({TRIPLES}) WHERE subject = 'order:1' AND predicate = 'placed_by' {ORDERED} LIMIT 5")
def host_graph_query(spark, d):
    return g.page(g.find(t.triples(spark, d, "order:1", "placed_by"), "order:1", "placed_by"), ["subject", "predicate", *model.value_order()], 0, 5).selectExpr(*SHOWN)


@query("list_triples", f"SELECT {COLS} FROM ({TRIPLES}) WHERE predicate = 'in_nation' {ORDERED} LIMIT 100 OFFSET 20")
def list_triples(spark, d):
    return g.page(g.find(t.triples(spark, d, predicate="in_nation"), predicate="in_nation"), ["subject", "predicate", *model.value_order()], 20).selectExpr(*SHOWN)


@query("namespace_scope", f"SELECT subject, CASE WHEN starts_with(subject, 'nation:') THEN subject ELSE 'nation:' || subject END AS scoped FROM ({TRIPLES}) WHERE predicate = 'has_name' AND (starts_with(subject, 'nation:') OR starts_with(subject, 'region:'))")
def namespace_scope(spark, d):
    rows = g.find(t.triples(spark, d, predicate="has_name"), predicate="has_name")
    both = g.in_namespace(rows, "nation").unionByName(g.in_namespace(rows, "region"))
    return both.select("subject", g.scoped("nation", F.col("subject")).alias("scoped"))


@query("policy_hidden", f"SELECT path FROM ({t.NOTES_SQL}) WHERE NOT (starts_with(path, 'src0/') OR starts_with(path, 'src1/en/'))")
def policy_hidden(spark, d):
    return g.not_hidden(t.notes(spark, d).select("path"), "path", ["src0", "src1\\en"])


@query("semantic_query", f"SELECT {COLS} FROM ({TRIPLES}) WHERE starts_with(subject, 'nation:1') AND predicate = 'in_region' {ORDERED} LIMIT 50")
def semantic_query(spark, d):
    rows = g.find(t.triples(spark, d, predicate="in_region"), predicate="in_region").where(F.col("subject").startswith("nation:1"))
    return g.page(rows, ["subject", "predicate", *model.value_order()], 0, 50).selectExpr(*SHOWN)


NEW = "SELECT 'nation:' || n_nationkey AS subject, 'has_name' AS predicate, n_name AS str FROM nation UNION ALL SELECT 'nation:' || (n_nationkey % 5), 'label', 'n' || (n_nationkey % 5) FROM nation"


@query("insert_batch", f"SELECT DISTINCT subject, predicate, str FROM ({NEW}) n WHERE NOT EXISTS (SELECT 1 FROM ({TRIPLES}) o WHERE o.subject = n.subject AND o.predicate = n.predicate AND o.str = n.str)")
def insert_batch(spark, d):
    nation = t.table(spark, d, "nation")
    names = nation.select(F.expr("'nation:' || n_nationkey").alias("subject"), F.lit("named").alias("subject_kind"), F.lit("has_name").alias("predicate"), *model.value("String", str=F.col("n_name")))
    labels = nation.select(F.expr("'nation:' || n_nationkey % 5").alias("subject"), F.lit("named").alias("subject_kind"), F.lit("label").alias("predicate"), *model.value("String", str=F.expr("'n' || n_nationkey % 5")))
    return g.fresh(t.triples(spark, d), names.unionByName(labels)).select("subject", "predicate", "str")


@query("delete_by_prefix", f"SELECT {COLS} FROM ({TRIPLES}) WHERE NOT starts_with(subject, 'order:')")
def delete_by_prefix(spark, d):
    return g.delete_by_prefix(t.triples(spark, d), "order:").selectExpr(*SHOWN)


@query("delete", f"SELECT {COLS} FROM ({TRIPLES}) WHERE NOT (predicate = 'in_region')")
def delete(spark, d):
    rows = t.triples(spark, d)
    return g.delete(rows, model.with_id(g.find(rows, predicate="in_region"))).selectExpr(*SHOWN)


ESCAPED = "replace(replace(str, '\\', '\\\\'), '\"', '\\\"')"


@query(
    "export_ntriples",
    f"""SELECT '<' || subject || '> <' || predicate || '> ' || CASE kind WHEN 'Node' THEN '<' || node || '>' WHEN 'String' THEN '"' || {ESCAPED} || '"'
 WHEN 'Integer' THEN '"' || "int" || '"^^<http://www.w3.org/2001/XMLSchema#integer>' END || ' .' AS line FROM ({TRIPLES}) WHERE kind <> 'Float'""",
)
def export_ntriples(spark, d):
    return rdf.ntriples_lines(t.triples(spark, d).where("kind <> 'Float'"))


@query("import_ntriples", f"SELECT {COLS} FROM ({TRIPLES}) WHERE kind <> 'Float' AND predicate IN ('in_region', 'size', 'has_name')")
def import_ntriples(spark, d):
    lines = rdf.ntriples_lines(t.triples(spark, d).where("kind <> 'Float' and predicate in ('in_region', 'size', 'has_name')"))
    return rdf.parse_ntriples(lines).selectExpr(*SHOWN)


@query("export_turtle")
def export_turtle(spark, d):
    rows = g.find(t.triples(spark, d)).where("subject like 'nation:%' or subject like 'region:%'")
    return rdf.turtle_blocks(rows)


@query("import_turtle", f"SELECT subject, predicate, kind, node, str FROM ({TRIPLES}) WHERE starts_with(subject, 'nation:') OR starts_with(subject, 'region:')")
def import_turtle(spark, d):
    rows = g.find(t.triples(spark, d)).where("subject like 'nation:%' or subject like 'region:%'")
    return rdf.parse_turtle(rdf.turtle_blocks(rows).select(F.col("block").alias("content"))).select("subject", "predicate", "kind", "node", "str")


@query("namespaces_expand", f"SELECT DISTINCT subject, replace(replace(subject, 'nation:', 'http://x.org/nation/'), 'region:', 'http://x.org/region#') AS iri FROM ({TRIPLES}) WHERE starts_with(subject, 'nation:') OR starts_with(subject, 'region:')")
def namespaces_expand(spark, d):
    rows = t.triples(spark, d).where("subject like 'nation:%' or subject like 'region:%'").select("subject").distinct()
    return rows.select("subject", g.expand(F.col("subject"), {"nation": "http://x.org/nation/", "region": "http://x.org/region#"}).alias("iri"))


@query("namespaces_compact", "SELECT 'http://x.org/nation/' || n_nationkey AS iri, 'nation:' || n_nationkey AS name FROM nation")
def namespaces_compact(spark, d):
    rows = t.table(spark, d, "nation").select(F.expr("'http://x.org/nation/' || n_nationkey").alias("iri"))
    return rows.select("iri", g.compact(F.col("iri"), {"x": "http://x.org/", "nation": "http://x.org/nation/"}).alias("name"))


@query("list_sources", f"SELECT path, md5(text) AS content_hash FROM ({t.NOTES_SQL})")
def list_sources(spark, d):
    notes = t.notes(spark, d)
    facts = notes.select(F.col("path").alias("subject"), F.lit("named").alias("subject_kind"), F.lit("source_hash").alias("predicate"), *model.value("String", str=F.md5("text")))
    return g.find(facts, predicate="source_hash").select(F.col("subject").alias("path"), F.col("str").alias("content_hash"))


@query("reconcile_note_facts", "SELECT 'doc:' || doc_id AS subject, 'lang' AS predicate, lang AS str FROM documents WHERE doc_id % 3 = 0 AND NOT (doc_id % 2 = 0)")
def reconcile_note_facts(spark, d):
    from ..operators import vault

    docs = t.table(spark, d, "documents")
    fact = docs.select(F.col("doc_id").alias("note"), F.expr("'doc:' || doc_id").alias("subject"), F.lit("lang").alias("predicate"), F.col("lang").alias("str"))
    return vault.stale_facts(fact, fact.where("note % 2 = 0"), docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("note"))).select("subject", "predicate", "str")


EVENT_FACTS = """SELECT 'event:' || event_id AS subject, 'event_type' AS predicate, event_type AS text FROM events
 UNION ALL SELECT 'event:' || event_id, 'agent', CAST(user_id AS VARCHAR) FROM events
 UNION ALL SELECT 'event:' || event_id, 'field:k', json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"""


@query("store_events", EVENT_FACTS)
def store_events(spark, d):
    from ..operators import traces

    return traces.to_triples(t.trace_events(spark, d)).where("predicate in ('event_type', 'agent', 'field:k')").select("subject", "predicate", model.value_text().alias("text"))


@query("wal_read_from", f"SELECT author, seq, hash, op FROM ({t.ACTIONS_SQL}) WHERE seq >= 5")
def wal_read_from(spark, d):
    return t.actions(spark, d).where("seq >= 5").select("author", "seq", "hash", "op")


@query("contract_kv_scan", "SELECT 'part/' || p_partkey AS key, p_name AS val FROM part WHERE starts_with('part/' || p_partkey, 'part/1')")
def contract_kv_scan(spark, d):
    kv = t.table(spark, d, "part").select(F.expr("'part/' || p_partkey").alias("key"), F.col("p_name").alias("val"))
    return kv.where(F.col("key").startswith("part/1"))


@query("contract_get_many", "SELECT 'part/' || p_partkey AS key, p_name AS val FROM part WHERE p_partkey IN (3, 5, 8)")
def contract_get_many(spark, d):
    kv = t.table(spark, d, "part").select(F.expr("'part/' || p_partkey").alias("key"), F.col("p_name").alias("val"))
    return kv.where(F.col("key").isin("part/3", "part/5", "part/8"))


@query("host_get", f"SELECT hash, author, seq, type FROM ({t.HEADERS_SQL}) WHERE starts_with(hash, '7-')")
def host_get(spark, d):
    return t.headers(spark, d).where("startswith(hash, '7-')").select("hash", "author", "seq", "type")
