"""The index of vectors: recall, changes, ties, and what is kept."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import vectors as v
from graphloom.operators.similarity import fuzzy_matches, similar_pairs


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<double>")


def test_recall_on_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 3000)] + 0.4 * rng.normal(size=(3000, 24))
    index = v.VectorIndex.build(table(spark, x), 24)
    asked = table(spark, x).where("id % 100 = 0")
    got = {}
    for r in index.search(asked, 5).collect():
        got.setdefault(r["query"], set()).add(r["id"])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 3000, 100):
        s = unit @ unit[q]
        s[q] = -9
        hits += len(got.get(q, set()) & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * 30
    assert index.stats().first()["planes"] > 3


def test_insert_remove_rebuild_save(spark, tmp_path):
    x = np.eye(6) + 0.01
    index = v.VectorIndex.build(table(spark, x[:3]), 6).insert(table(spark, x[3:], 3)).insert(table(spark, x[:1] * 2))
    assert index.stats().first()["vectors"] == 6
    index = index.remove(spark.createDataFrame([(1,)], "id long"))
    assert index.stats().first()["vectors"] == 5 and index.buckets.where("id = 1").count() == 0
    again = index.rebuild()
    again.save(str(tmp_path / "i"))
    loaded = v.VectorIndex.load(spark, str(tmp_path / "i"))
    asked = table(spark, x[2:3], 50)
    assert sorted(map(tuple, loaded.search(asked, 3).collect())) == sorted(map(tuple, again.search(asked, 3).collect()))
    assert loaded.search(asked, 1).first()["id"] == 2
    assert v.VectorIndex.build(table(spark, x).limit(0), 6).search(asked, 3).count() == 0


def test_all_pairs_of_blocks(spark, monkeypatch):
    from graphloom.operators import similarity

    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    rows = table(spark, x).unionByName(spark.createDataFrame([(90, [0.0] * 5), (91, [1.0])], "id long, vec array<double>"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if unit[i] @ unit[j] >= 0.7}
    for block in (2048, 20):
        monkeypatch.setattr(similarity, "BLOCK", block)
        assert {(r["a"], r["b"]) for r in similar_pairs(rows, 0.7).collect()} == want


def test_best_way_of_names(spark, monkeypatch):
    from graphloom.operators import similarity

    names = spark.createDataFrame([("Acme Corp",), ("Corp ACME",), ("Robert",), (None,), ("zzz",)], "name string")
    listed = spark.createDataFrame([("acme corp",), ("Rupert",)], "name string")
    want = [("acme corp", "acme corp"), ("corp acme", "acme corp"), ("robert", "rupert")]
    for most in (20_000, 1):
        monkeypatch.setattr(similarity, "LISTED", most)
        assert sorted((r["name"], r["listed"]) for r in fuzzy_matches(names, listed, 0.84).collect()) == want
    assert fuzzy_matches(names, listed.where(F.lit(False)), 0.5).count() == 0
