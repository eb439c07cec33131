"""Parsers, operators and sinks on small inputs."""

import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.operators import graph, learning, risk, rules, similarity, traversal, vault
from graphloom.plans import sparql
from graphloom.plans.fixpoint import components
from graphloom.sources import files, rdf


def triples(spark, rows):
    out = []
    for s, p, o in rows:
        kind = "Node" if isinstance(o, str) and ":" in o else {str: "String", int: "Integer", float: "Float", bool: "Boolean"}[type(o)]
        out.append((s, "named", p, kind, o if kind == "Node" else None, o if kind == "String" else None, o if kind == "Integer" else None, o if kind == "Float" else None, o if kind == "Boolean" else None, None, None))
    return spark.createDataFrame(out, model.SCHEMA)


def test_insert_get_delete(spark):
    rows = triples(spark, [("user:alice", "has_name", "Alice"), ("user:alice", "knows", "user:bob"), ("user:bob", "age", 30)])
    assert graph.stats(rows).first()["triples"] == 3
    with pytest.raises(ValueError):
        graph.insert(rows, triples(spark, [("user:alice", "knows", "user:bob")]))
    assert graph.insert_batch(rows, triples(spark, [("a", "b", 1), ("a", "b", 1), ("user:bob", "age", 30)])).count() == 4
    one = model.with_id(rows).first()["triple_id"]
    assert graph.get(rows, one).count() == 1 and graph.delete(rows, graph.get(rows, one)).count() == 2


def test_value_order(spark):
    rows = triples(spark, [("a", "p", x) for x in ("n:1", "b", "a", 7, -3, 2.5, True)])
    got = [model_row["kind"] for model_row in rows.orderBy(*model.value_order()).collect()]
    assert got == ["Node", "String", "String", "Integer", "Integer", "Float", "Boolean"]


def test_ntriples_round_trip(spark, tmp_path):
    rows = triples(spark, [("a:x", "p", 'say "hi"\n\\'), ("a:x", "q", "b:y"), ("a:x", "n", 5), ("a:x", "d", 1.5), ("a:x", "t", True)])
    rdf.write_ntriples(rows, str(tmp_path / "nt"))
    assert sorted(map(str, rdf.read_ntriples(spark, str(tmp_path / "nt")).select(*model.COLUMNS).collect())) == sorted(map(str, rows.select(*model.COLUMNS).collect()))
    lines = spark.createDataFrame([("# note",), ("",), ('<a> <b> "x"@en .',), ('<a> <b> "zz"^^<http://www.w3.org/2001/XMLSchema#integer> .',), ("_:q <b> <c> .",)], "line string")
    assert [r["kind"] for r in rdf.parse_ntriples(lines).orderBy("kind").collect()] == ["LangString", "Node", "String"]
    with pytest.raises(Exception, match="not N-Triples"):
        rdf.parse_ntriples(spark.createDataFrame([("rubbish",)], "line string")).collect()


def test_turtle():
    text = '@prefix e: <http://e/> . @base <http://b/> .\ne:a a e:T ; e:n "x"@en , "y"^^e:d , 3 , 2.5 , true ; <rel> e:b .\n[] e:p _:q . # end'
    got = list(rdf.turtle_rows(text))
    assert got[0] == ("http://e/a", "named", rdf.RDF_TYPE, "http://e/T", None, None, None)
    assert [x[4] for x in got[1:6]] == ["x", "y", "3", "2.5", "true"] and got[6][2] == "http://b/rel" and got[7][1] == "blank" and got[7][3] == "q"
    for bad in ("e:a e:b e:c .", "<a> <b> [ <c> <d> ] .", "<a> <b> <c>"):
        with pytest.raises((ValueError, IndexError)):
            list(rdf.turtle_rows(bad))


def test_sparql_parse_and_errors(spark):
    q = sparql.parse("PREFIX x: <http://x/> SELECT DISTINCT ?a (COUNT(?b) AS ?n) WHERE { ?a x:p ?b , 3 ; a x:T . FILTER(?b > 2 || !BOUND(?a)) } GROUP BY ?a ORDER BY DESC(?n) LIMIT 5 OFFSET 2")
    assert (q.distinct, q.limit, q.offset, q.group, q.order) == (True, 5, 2, ["a"], [("n", True)]) and len([x for x in q.where if x[0] == "triple"]) == 3
    for bad in ("SELECT ?a { ?a ?b }", "FETCH ?a", "SELECT ?a WHERE { ?a ?b ?c } nonsense"):
        with pytest.raises((ValueError, IndexError)):
            sparql.parse(bad)
    rows = triples(spark, [("alice", "age", 25), ("bob", "age", 17), ("carol", "name", "x")])
    got = sparql.sparql(rows, "SELECT ?s WHERE { ?s ?p ?o FILTER(?o > 18) }").collect()
    assert [r["s"] for r in got] == ["alice"]
    with pytest.raises(ValueError):
        sparql.sparql(rows, "SELECT ?s WHERE { ?s ?p ?o FILTER(REGEX(?o, '" + "a" * 300 + "')) }")


def test_traversal(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    assert {(r["node"], r["depth"]) for r in traversal.reachable(e, [1]).collect()} == {(2, 1), (3, 2), (4, 3)}
    assert traversal.shortest_path(e, 1, 4).first()["path"] == [1, 3, 4]
    assert {(r["node"], r["component"]) for r in traversal.strongly_connected(e).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert {r["component"] for r in components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()} == {1, 5}
    paths = traversal.simple_paths(e.withColumn("share", F.lit(0.5)), 1, 4).collect()
    assert [(r["path"], r["product"]) for r in paths] == [([1, 2, 3, 4], 0.125)]


def test_names(spark):
    assert similarity.jaro_winkler_of("john doe", "jon doe") > 0.85 and similarity.jaro_winkler_of("john doe", "jane smith") < 0.6
    row = spark.range(1).select(similarity.normalize_name(F.lit("John Q. Doe, Jr.")).alias("n"), similarity.sound_code(F.lit("Robert")).alias("a"), similarity.sound_code(F.lit("Rupert")).alias("b")).first()
    assert row["n"] == "john q doe jr" and row["a"] == row["b"]


def test_tasks_and_notes(spark):
    lines = [
        "- [x] write it [#A] \U0001f4c5 2024-02-03 \U0001f501 every week", "- [ ] rest \U0001f4c5 2024-13-03", "no task", "TODO call \u23f3 2024-05-06 \U0001f501 every 3 days", "* [/]  two   words", "+ [-]", "- WAITING for it", "IN-PROGRESS x", "- [ ]x", "DONE", "- [ ] [#B] pay \U0001f4c5 2024-01-02 \u23f3 2024-01-01 \U0001f501 year",
    ]
    got = [r["t"] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(vault.parse_task(F.col("l")).alias("t")).collect()]
    assert tuple(got[0]) == ("done", "write it", "high", "2024-02-03", None, "1w")
    assert got[1]["text"] == "rest \U0001f4c5 2024-13-03" and got[8] is None and got[9] is None
    assert tuple(got[3]) == ("todo", "call", "none", None, "2024-05-06", "3d")
    assert [(r["status"], r["text"]) for r in got[4:8]] == [("doing", "two words"), ("canceled", ""), ("todo", "for it"), ("doing", "x")]
    assert tuple(got[10]) == ("todo", "pay", "medium", "2024-01-02", "2024-01-01", "1y")
    assert got[1]["due"] is None and got[2] is None


def test_rules(spark):
    facts = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "d"), ("x", "type", "t"), ("t", "subclass_of", "u")], "s string, p string, o string")
    got = {tuple(r)[:3] for r in rules.forward_chain(facts).collect()}
    assert got == {("a", "knows", "c"), ("b", "knows", "d"), ("a", "knows", "d"), ("x", "type", "u")}
    assert rules.prove(facts, ("a", "knows", "d")).first()["proved"] and not rules.prove(facts, ("d", "knows", "a")).first()["proved"]


def test_risk_and_learning(spark):
    row = risk.weighted(spark.createDataFrame([(8.0, None)], "a double, b double"), {"a": 2, "b": 3}).select("score", risk.level(F.col("score")).alias("l")).first()
    assert row["score"] == 8.0 and row["l"] == "high"
    steps = spark.createDataFrame([("k", 0, 0, "go", 1.0), ("k", 1, 0, "go", 0.0)], "key string, t int, state long, action string, reward double")
    q = learning.q_values(steps, "key", ["t"], 0.5, 0.9).first()["q"]
    assert q == pytest.approx(0.25)


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "id_rsa.md").write_text("secret")
    (tmp_path / "b.bin").write_text("x")
    found = files.listed(files.read_folder(spark, str(tmp_path)))
    assert found.count() == 1 and files.changed(found, found).count() == 0
    rows = spark.createDataFrame([("2024-01-02", "u", "n", "a", "r", "d", "1"), ("2024-01-03", "u", "n", "a", "r", "d", "2")], "timestamp string, user_id string, namespace string, action string, resource string, details string, request_id string")
    files.append_audit(rows, str(tmp_path / "audit"))
    files.append_audit(rows, str(tmp_path / "audit"))
    assert files.read_audit(spark, str(tmp_path / "audit"), 1).first()["timestamp"] == "2024-01-03"
    files.save_snapshot(rows, str(tmp_path / "snap"), 3)
    assert files.load_snapshot(spark, str(tmp_path / "snap"), 3).count() == 2
