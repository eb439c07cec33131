"""SPARQL queries (inventory 2.2, 2.3, 2.7, 2.15)."""

from __future__ import annotations

from ..plans.sparql import sparql
from ..registry import query
from ..sources import tables as t


def ask(name: str, text: str, sql: str, compat: bool = False) -> None:
    @query(name, sql)
    def run(spark, d):
        return sparql(t.triples(spark, d), text, compat)


C = "'customer:' || c_custkey"
ask("sparql_bgp_join", "SELECT ?c ?name WHERE { ?c <in_nation> ?n . ?n <in_region> <region:1> . ?c <has_name> ?name }", f"SELECT {C} AS c, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
ask("sparql_project", "SELECT ?s WHERE { ?s <segment> ?o }", f"SELECT {C} AS s FROM customer")
ask("sparql_filter", "SELECT ?c ?b WHERE { ?c <segment> 'BUILDING' ; <in_nation> ?n . ?n <has_name> ?b FILTER(?b != 'x') }", f"SELECT {C} AS c, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'")
ask("sparql_cmp", "SELECT ?p ?z WHERE { ?p <size> ?z FILTER(?z >= 25 && ?z < 30.5) }", "SELECT 'part:' || p_partkey AS p, CAST(p_size AS VARCHAR) AS z FROM part WHERE p_size >= 25 AND p_size < 30.5")
ask("sparql_bool", "SELECT ?p ?z WHERE { ?p <size> ?z FILTER(!(?z = 7) && (?z < 9 || ?z > 48)) }", "SELECT 'part:' || p_partkey AS p, CAST(p_size AS VARCHAR) AS z FROM part WHERE p_size <> 7 AND (p_size < 9 OR p_size > 48)")
ask("sparql_bound", "SELECT ?n ?r WHERE { ?n <has_name> ?x OPTIONAL { ?n <in_region> ?r } FILTER(!BOUND(?r)) FILTER(STRSTARTS(STR(?n), 'region:')) }", "SELECT 'region:' || r_regionkey AS n, CAST(NULL AS VARCHAR) AS r FROM region")
ask("sparql_regex", "SELECT ?c WHERE { ?c <segment> ?s FILTER(REGEX(?s, '^b', 'i')) }", f"SELECT {C} AS c FROM customer WHERE regexp_matches(c_mktsegment, '(?i)^b')")
ask("sparql_type_tests", "SELECT ?p ?o WHERE { <nation:3> ?p ?o FILTER(ISIRI(?o) && !ISLITERAL(?o) && !ISBLANK(?o)) }", "SELECT 'rdf:type' AS p, 'type:Nation' AS o UNION ALL SELECT 'in_region', 'region:' || n_regionkey FROM nation WHERE n_nationkey = 3")
ask("sparql_str_functions", "SELECT ?n ?u ?l WHERE { ?n a <type:Nation> ; <has_name> ?x BIND(UCASE(?x) AS ?u) BIND(STRLEN(?x) AS ?l) }", "SELECT 'nation:' || n_nationkey AS n, upper(n_name) AS u, CAST(length(n_name) AS VARCHAR) AS l FROM nation")
ask("sparql_exists", "SELECT ?c WHERE { ?c a <type:Customer> FILTER EXISTS { ?o <placed_by> ?c } }", f"SELECT {C} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
ask("sparql_not_exists", "SELECT ?c WHERE { ?c a <type:Customer> FILTER NOT EXISTS { ?o <placed_by> ?c . ?o <status> 'P' } }", f"SELECT {C} AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
ask("sparql_minus", "SELECT ?n WHERE { ?n a <type:Nation> MINUS { ?n <in_region> <region:1> } }", "SELECT 'nation:' || n_nationkey AS n FROM nation WHERE n_regionkey <> 1")
ask("sparql_join", "SELECT ?s ?n ?name WHERE { { ?s a <type:Supplier> . ?s <in_nation> ?n } { ?n <has_name> ?name } }", "SELECT 'supplier:' || s_suppkey AS s, 'nation:' || n_nationkey AS n, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
ask("sparql_optional", "SELECT ?n ?s WHERE { ?n a <type:Nation> OPTIONAL { ?s <in_nation> ?n . ?s a <type:Supplier> } }", "SELECT 'nation:' || n_nationkey AS n, 'supplier:' || s_suppkey AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
ask("sparql_union", "SELECT ?x WHERE { { ?x a <type:Nation> } UNION { ?x a <type:Region> } UNION { ?x <in_region> <region:1> } }", "SELECT 'nation:' || n_nationkey AS x FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation WHERE n_regionkey = 1")
ask("sparql_values", "SELECT ?n ?name WHERE { VALUES ?n { <nation:1> <nation:4> } ?n <has_name> ?name }", "SELECT 'nation:' || n_nationkey AS n, n_name AS name FROM nation WHERE n_nationkey IN (1, 4)")
ask("sparql_distinct_order", "SELECT DISTINCT ?s WHERE { ?c <segment> ?s } ORDER BY DESC(?s) LIMIT 3 OFFSET 1", "SELECT DISTINCT c_mktsegment AS s FROM customer ORDER BY s DESC LIMIT 3 OFFSET 1")
ask("sparql_group_count", "SELECT ?n (COUNT(?c) AS ?k) WHERE { ?c a <type:Customer> ; <in_nation> ?n } GROUP BY ?n", "SELECT 'nation:' || c_nationkey AS n, count(*) AS k FROM customer GROUP BY 1")
ask("sparql_aggregates", "SELECT ?b (SUM(?z) AS ?t) (MIN(?z) AS ?lo) (MAX(?z) AS ?hi) WHERE { ?p <brand> ?b ; <size> ?z } GROUP BY ?b", "SELECT p_brand AS b, CAST(sum(p_size) AS DOUBLE) AS t, CAST(min(p_size) AS DOUBLE) AS lo, CAST(max(p_size) AS DOUBLE) AS hi FROM part GROUP BY 1")
ask("sparql_ask", "ASK { ?c <segment> 'BUILDING' }", "SELECT count(*) > 0 AS ask FROM customer WHERE c_mktsegment = 'BUILDING'")
ask("sparql_construct", "CONSTRUCT { ?n <hosts> ?s } WHERE { ?s a <type:Supplier> . ?s <in_nation> ?n }", "SELECT DISTINCT 'nation:' || s_nationkey AS subject, 'hosts' AS predicate, 'supplier:' || s_suppkey AS object FROM supplier")
ask("sparql_compat_bgp", "SELECT ?n ?r WHERE { ?n <in_region> ?r . ?r a <type:Region> }", "SELECT 'nation:' || n_nationkey AS n, 'region:' || n_regionkey AS r FROM nation UNION ALL SELECT NULL, 'region:' || r_regionkey FROM region", True)


@query("sparql_describe", f"SELECT subject, predicate, kind, node, str FROM ({t.triples_sql()}) WHERE subject = 'nation:3'")
def sparql_describe(spark, d):
    return sparql(t.triples(spark, d), "DESCRIBE <nation:3>").select("subject", "predicate", "kind", "node", "str")
