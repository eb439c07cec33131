"""Rules, validation and proofs (inventory 2.10, parts of 2.3 and 2.16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..operators import rules as r
from ..registry import query
from ..sources import tables as t
from .triples import TRIPLES

#: A small social graph over customers: who knows, marries and parents whom.
SOCIAL = """SELECT 'c' || c_custkey AS s, 'knows' AS p, 'c' || (c_custkey + 1) AS o FROM customer WHERE c_custkey % 10 < 7 AND c_custkey < 400
 UNION ALL SELECT 'c' || c_custkey, 'married_to', 'c' || (c_custkey + 100) FROM customer WHERE c_custkey % 7 = 0 AND c_custkey < 400
 UNION ALL SELECT 'c' || c_custkey, 'parent_of', 'c' || (c_custkey * 2) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey < 200
 UNION ALL SELECT 'c' || c_custkey, 'parent_of', 'c' || (c_custkey * 2 + 1) FROM customer WHERE c_custkey % 3 = 0 AND c_custkey < 200
 UNION ALL SELECT 'c' || c_custkey, 'type', 't' || (c_custkey % 4) FROM customer WHERE c_custkey < 100
 UNION ALL SELECT 't1', 'subclass_of', 't0' UNION ALL SELECT 't2', 'subclass_of', 't1' UNION ALL SELECT 't3', 'subclass_of', 't2'"""


def social(spark, d):
    return spark.sql(SOCIAL.replace("FROM customer", "FROM {customer}"), customer=t.table(spark, d, "customer"))


@query("validate", f"SELECT accepted, rejection, count(*) AS n FROM (SELECT subject <> coalesce(node, '') AND trim(predicate) <> '' AND trim(subject) <> '' AND NOT regexp_matches(subject, '\\s') AS accepted, CASE WHEN subject = node THEN 'self_reference' ELSE '' END AS rejection FROM (SELECT subject, predicate, node FROM ({TRIPLES}) UNION ALL SELECT 'a' || n_nationkey, 'p', 'a' || (n_nationkey % 3) FROM nation)) GROUP BY 1, 2")
def validate(spark, d):
    odd = t.table(spark, d, "nation").select(F.expr("'a' || n_nationkey").alias("subject"), F.lit("named").alias("subject_kind"), F.lit("p").alias("predicate"), *model.value("Node", node=F.expr("'a' || n_nationkey % 3")))
    rows = r.validate(t.triples(spark, d).unionByName(odd))
    return rows.groupBy("accepted", F.array_join("rejections", ",").alias("rejection")).agg(F.count(F.lit(1)).alias("n"))


@query("integrity_rules", "SELECT 'subject_whitespace' AS rule, count(*) AS n FROM part WHERE regexp_matches(p_name, '\\s') UNION ALL SELECT 'empty_predicate', count(*) FROM part WHERE p_partkey % 5 = 0")
def integrity_rules(spark, d):
    rows = t.table(spark, d, "part").select(F.col("p_name").alias("subject"), F.lit("named").alias("subject_kind"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise("p").alias("predicate"), *model.value("String", str=F.lit("x")))
    return r.validate(rows).select(F.explode("rejections").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("contradictions", "WITH f AS (SELECT c_custkey % 50 AS s, ['is', 'is_not', 'allows', 'forbids', 'knows'][1 + c_custkey % 7 % 5] AS p, c_nationkey AS o FROM customer) SELECT DISTINCT a.s, a.o FROM f a JOIN f b ON a.s = b.s AND a.o = b.o WHERE a.p = 'is' AND b.p = 'is_not' OR a.p = 'allows' AND b.p = 'forbids'")
def contradictions(spark, d):
    f = t.table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("s"), F.expr("array('is', 'is_not', 'allows', 'forbids', 'knows')[cast(c_custkey % 7 % 5 as int)]").alias("p"), F.col("c_nationkey").alias("o"))
    return r.contradictions(f)


@query("temporal_cycle", "WITH b AS (SELECT DISTINCT c_nationkey AS s, c_custkey % 25 AS o FROM customer WHERE c_custkey % 3 = 0) SELECT x.s AS a, x.o AS b FROM b x JOIN b y ON x.s = y.o AND x.o = y.s WHERE x.s < x.o")
def temporal_cycle(spark, d):
    b = t.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").cast("long").alias("s"), (F.col("c_custkey") % 25).alias("o")).distinct()
    return r.temporal_cycles(b).select(F.col("a"), F.col("b"))


@query("disjoint_types", "WITH y AS (SELECT DISTINCT l_partkey AS s, l_returnflag AS t FROM lineitem) SELECT DISTINCT a.s, a.t AS t1, b.t AS t2 FROM y a JOIN y b ON a.s = b.s WHERE a.t = 'A' AND b.t = 'N'")
def disjoint_types(spark, d):
    y = t.table(spark, d, "lineitem").select(F.col("l_partkey").alias("s"), F.col("l_returnflag").alias("t")).distinct()
    return r.disjoint_violations(y, spark.createDataFrame([("A", "N")], "t1 string, t2 string"))


@query(
    "forward_chain",
    f"""WITH RECURSIVE f AS ({SOCIAL}), k(a, c) AS (SELECT s, o FROM f WHERE p = 'knows' UNION SELECT k.a, f.o FROM k JOIN f ON f.s = k.c AND f.p = 'knows'),
 y(x, u) AS (SELECT s, o FROM f WHERE p = 'type' UNION SELECT y.x, f.o FROM y JOIN f ON f.s = y.u AND f.p = 'subclass_of'),
 d AS (SELECT a AS s, 'knows' AS p, c AS o FROM k WHERE a <> c UNION SELECT x, 'type', u FROM y UNION SELECT o, 'married_to', s FROM f WHERE p = 'married_to' UNION SELECT o, 'child_of', s FROM f WHERE p = 'parent_of'
 UNION SELECT a.o, 'sibling_of', b.o FROM f a JOIN f b ON a.s = b.s WHERE a.p = 'parent_of' AND b.p = 'parent_of' AND a.o <> b.o)
 SELECT s, p, o FROM d WHERE (s, p, o) NOT IN (SELECT s, p, o FROM f)""",
)
def forward_chain(spark, d):
    return r.forward_chain(social(spark, d)).select("s", "p", "o")


@query("forward_chain_one_step", f"WITH f AS ({SOCIAL}), d AS (SELECT a.s, 'knows' AS p, b.o FROM f a JOIN f b ON a.o = b.s WHERE a.p = 'knows' AND b.p = 'knows' AND a.s <> b.o) SELECT DISTINCT s, p, o FROM d WHERE (s, p, o) NOT IN (SELECT s, p, o FROM f)")
def forward_chain_one_step(spark, d):
    return r.forward_chain(social(spark, d), r.SEMANTIC[:1], one_step=True).select("s", "p", "o")


@query("semantic_rules", f"WITH f AS ({SOCIAL}) SELECT DISTINCT a.o AS s, b.o FROM f a JOIN f b ON a.s = b.s WHERE a.p = 'parent_of' AND b.p = 'parent_of' AND a.o <> b.o")
def semantic_rules(spark, d):
    return r.matches(social(spark, d), r.SEMANTIC[4]).select("s", "o").distinct()


@query("backward_chain", "SELECT true AS proved, 'knows_transitive' AS rule")
def backward_chain(spark, d):
    return r.prove(social(spark, d), ("c11", "knows", "c15"))


@query("logic_proofs")
def logic_proofs(spark, d):
    return r.forward_chain(social(spark, d).where("p <> 'knows'"))


@query("validate_with_context", f"WITH f AS ({SOCIAL}) SELECT p, count(*) AS n, count(*) FILTER (s = o) AS rejected FROM f GROUP BY 1")
def validate_with_context(spark, d):
    rows = social(spark, d).select(F.col("s").alias("subject"), F.lit("named").alias("subject_kind"), F.col("p").alias("predicate"), *model.value("Node", node=F.col("o")))
    return r.validate(rows).groupBy(F.col("predicate").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("accepted")).alias("rejected"))


@query("validate_triples", f"SELECT count(*) AS n, true AS verdict FROM ({TRIPLES}) WHERE subject LIKE 'nation:%'")
def validate_triples(spark, d):
    rows = r.validate(t.triples(spark, d).where("subject like 'nation:%'"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and("accepted").alias("verdict"))


@query("policy_engine", "SELECT event_id, CASE WHEN value > 90 THEN 'alert' WHEN value BETWEEN 40 AND 60 AND NOT (value < 45) THEN 'watch' ELSE 'log' END AS action FROM events")
def policy_engine(spark, d):
    rules = [(10, ("above", 90.0), "alert"), (5, ("and", ("range", 40.0, 60.0), ("not", ("below", 45.0))), "watch"), (0, ("always",), "log")]
    return r.decide(t.table(spark, d, "events").select("event_id", "value"), rules).select("event_id", "action")


@query("policy_condition", "SELECT event_id FROM events WHERE value < 5 OR value = 50")
def policy_condition(spark, d):
    return t.table(spark, d, "events").where(r.condition(("or", ("below", 5.0), ("equals", 50.0)))).select("event_id")


GOALS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey // 5 * 5 END AS parent, p_size % 4 = 0 AS done, p_size / 50.0::DOUBLE AS progress, p_size % 3 AS priority, p_size % 7 AS deadline FROM part"


def goals(spark, d):
    return t.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 5 != 0, F.expr("p_partkey div 5 * 5")).alias("parent"),
        (F.col("p_size") % 4 == 0).alias("done"),
        (F.col("p_size") / 50.0).alias("progress"),
        (F.col("p_size") % 3).alias("priority"),
        (F.col("p_size") % 7).alias("deadline"),
    )


@query("executable_goals", f"WITH g AS ({GOALS}) SELECT id FROM g WHERE NOT done AND id NOT IN (SELECT parent FROM g WHERE NOT done AND parent IS NOT NULL)")
def executable_goals(spark, d):
    return r.executable_goals(goals(spark, d))


@query("goal_progress", f"WITH g AS ({GOALS}) SELECT parent AS id, round(sum(progress) / count(*), 6) AS progress FROM g WHERE parent IS NOT NULL GROUP BY 1")
def goal_progress(spark, d):
    return r.goal_progress(goals(spark, d)).select("id", F.round("progress", 6).alias("progress"))


@query("goal_conflicts", f"WITH g AS ({GOALS}) SELECT id AS a, b FROM (SELECT id, lead(id) OVER (PARTITION BY priority, deadline ORDER BY id) AS b FROM g WHERE NOT done) WHERE b IS NOT NULL")
def goal_conflicts(spark, d):
    return r.goal_conflicts(goals(spark, d).where("not done"))


#: Goals that depend on others: each on that of a fifth of its number, and on its neighbour below if its size is even.
NEEDS = "SELECT p_partkey AS goal, p_partkey // 5 AS needs FROM part WHERE p_partkey >= 5 UNION SELECT p_partkey, p_partkey - 1 FROM part WHERE p_partkey > 1 AND p_size % 2 = 0"


@query("goal_toposort", f"WITH RECURSIVE e AS ({NEEDS}), r(id, rank) AS (SELECT p_partkey, 0 FROM part UNION SELECT e.goal, rank + 1 FROM r JOIN e ON e.needs = r.id) SELECT id, CAST(max(rank) AS INTEGER) AS rank FROM r GROUP BY 1")
def goal_toposort(spark, d):
    p = t.table(spark, d, "part")
    needs = p.where("p_partkey >= 5").select(F.col("p_partkey").alias("goal"), F.expr("p_partkey div 5").alias("needs"))
    needs = needs.unionByName(p.where("p_partkey > 1 and p_size % 2 = 0").select(F.col("p_partkey").alias("goal"), (F.col("p_partkey") - 1).alias("needs")))
    return r.topological_order(p.select(F.col("p_partkey").alias("id")), needs)


@query("consensus", "SELECT o_custkey AS proposal, count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) AS ratio FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'F') / CAST(count(*) AS DOUBLE) >= 0.5")
def consensus(spark, d):
    n = F.count(F.lit(1))
    return t.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("proposal")).agg((F.count_if(F.col("o_orderstatus") == "F") / n).alias("ratio")).where("ratio >= 0.5")


@query("accepting_rules", "SELECT predicate, CASE predicate WHEN 'owns' THEN 'authority' WHEN 'created_at' THEN 'temporal' WHEN 'core:seq' THEN 'core' ELSE '' END AS sets, count(*) AS n FROM (SELECT ['owns', 'created_at', 'core:seq', 'seq', 'likes'][1 + c_custkey % 5] AS predicate FROM customer) GROUP BY 1, 2")
def accepting_rules(spark, d):
    rows = t.table(spark, d, "customer").select(F.expr("array('owns', 'created_at', 'core:seq', 'seq', 'likes')[cast(c_custkey % 5 as int)]").alias("predicate"))
    return rows.groupBy("predicate", F.array_join(r.accepted_by(), ",").alias("sets")).agg(F.count(F.lit(1)).alias("n"))


@query("check_manifest", "SELECT 'shop' AS namespace, CASE WHEN n_nationkey % 4 = 0 THEN 'shop:p' || n_nationkey % 3 ELSE 'x:p' || n_nationkey % 3 END AS predicate, CASE WHEN n_nationkey % 2 = 1 THEN 'not_required' WHEN n_nationkey % 4 = 0 AND n_nationkey % 3 = 1 THEN 'rule_matched' ELSE 'no_matching_rule' END AS outcome FROM nation")
def check_manifest(spark, d):
    n = t.table(spark, d, "nation")
    asked = n.select(F.lit("shop").alias("namespace"), F.expr("case when n_nationkey % 4 = 0 then 'p' || n_nationkey % 3 else 'x:p' || n_nationkey % 3 end").alias("predicate"), (F.col("n_nationkey") % 2 == 0).alias("require_proof"))
    return r.check_manifest(asked, ["shop:p1"])
