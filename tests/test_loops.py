"""Loops to a fixpoint: the way of one task and the way of rounds give the same, and nothing ends early."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import dag, rules, traversal
from graphloom.plans import fixpoint


def graph(spark, n=60, edges=90, seed=4):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, n, (edges, 2))], "src long, dst long")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("way", ["reach", "bounded", "components", "strong"])
def test_both_ways_agree(spark, monkeypatch, way):
    g = graph(spark)
    seeds = spark.createDataFrame([(3,), (5,), (1000,)], "node long")
    run = {
        "reach": lambda: fixpoint.reach(g, seeds),
        "bounded": lambda: fixpoint.reach(g, seeds, 2),
        "components": lambda: fixpoint.components(g.toDF("a", "b")),
        "strong": lambda: traversal.strongly_connected(g),
    }[way]
    small = rows(run())
    monkeypatch.setattr(fixpoint, "SETTLE", 10 if way == "components" else -1)
    assert small and rows(run()) == small


def test_components_of_text_ids(spark):
    g = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("z", "z")], "a string, b string")
    assert rows(fixpoint.components(g)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    assert fixpoint.components(g.limit(0)).count() == 0


def test_chain_of_five_thousand_actions(spark):
    actions = spark.range(5000).select(F.col("id").alias("hash"), F.when(F.col("id") > 0, F.array(F.col("id") - 1)).otherwise(F.array().cast("array<bigint>")).alias("parents"), F.lit(1).alias("author"), F.col("id").alias("seq"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id)").alias("ts"), F.when(F.col("id") % 2 == 0, "insert").otherwise("delete").alias("op"), (F.col("id") - F.col("id") % 2).cast("string").alias("triple_key"))
    assert dag.ancestors(actions, [4999]).count() == 5000
    assert rows(dag.at(actions, 4998)) == [("4998",)]
    assert dag.depths(actions).agg(F.max("depth")).first()[0] == 4999
    assert dag.missing(actions, [4000]).count() == 999


def test_forward_chain_goes_to_the_end(spark):
    facts = spark.createDataFrame([(f"n{i}", "knows", f"n{i + 1}") for i in range(40)] + [("x", "type", "t0")] + [(f"t{i}", "subclass_of", f"t{i + 1}") for i in range(12)], "s string, p string, o string")
    found = rules.forward_chain(facts)
    assert found.where("p = 'knows'").count() == 41 * 40 // 2 - 40
    assert rows(found.where("p = 'type'").select("o")) == sorted((f"t{i}",) for i in range(1, 13))


def test_conditions_as_functions(spark):
    facts = spark.createDataFrame([("a", "p1", "b"), ("a", "q", "c"), ("d", "p2", "d")], "s string, p string, o string")
    rule = rules.Rule("near", [("?x", lambda p: p.startswith("p"), "?y")], ("?y", "near", "?x"), when=lambda t: t["s"] != t["o"])
    assert rows(rules.forward_chain(facts, [rule])) == [("b", "near", "a", "near")]
    same = rules.Rule("loop", [("?x", "?p", "?x")], ("?x", "loops", "?p"))
    assert rows(rules.forward_chain(facts, [same], one_step=True)) == [("d", "loops", "p2", "loop")]


def test_contradictions_of_the_fixed_pairs(spark):
    facts = spark.createDataFrame([("sky", "is", "blue"), ("sky", "is_not", "blue"), ("sky", "has", "blue"), ("sky", "lacks", "blue"), ("cat", "alive", "x"), ("cat", "dead", "y")], "s string, p string, o string")
    assert rows(rules.contradictions(facts)) == [("sky", "blue")]


def test_accepting_rules(spark):
    rows = spark.createDataFrame([("has_role", "admin"), ("has_role", "guest"), ("x:agent", ""), ("before", "")], "predicate string, o string")
    assert [list(r[0]) for r in rows.select(rules.accepted_by(F.col("o"))).collect()] == [["authority"], [], ["core"], ["temporal"]]
