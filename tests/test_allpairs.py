"""Means and best partners over all pairs of vectors: against SQL on odd tables, in blocks of any size, without a table of pairs."""

import duckdb
import numpy as np
import pytest

import graphloom.catalog  # noqa: F401  registers the queries
from graphloom import registry
from graphloom.operators import allpairs


def odd(n, copies, nulls=2, width=6):
    """Vectors with exact and near copies, ids of several rows, ids out of order, and null vectors."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[n - copies :] = x[0]
    x[n - copies // 2 :] += 1e-5 * rng.normal(size=(n - (n - copies // 2), width)).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(n) * 3, x)]
    return rows + [(rows[0][0], x[5].tolist()), (rows[7][0], x[7].tolist())] + [(3 * n + i, None) for i in range(nulls)] + [(None, x[1].tolist())]


def sql(name, rows, d):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    if rows:
        con.executemany("INSERT INTO embeddings VALUES (?, ?, 0)", rows)
    con.execute(f"COPY embeddings TO '{d}/embeddings.parquet' (FORMAT parquet)")
    return sorted(map(repr, con.execute(registry.ORACLE_SQL[name]).fetchall()))


def answer(spark, name, d):
    return sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, str(d)).collect())


TABLES = {"copies": odd(90, 30), "few": odd(8, 2)[:2] + [(100, None), (101, None), (102, None)], "one": [(4, [1.0, 2.0])], "one id": [(4, [1.0, 2.0]), (4, [2.0, 1.0])], "none": [], "only null": [(1, None), (2, None)]}


@pytest.mark.parametrize("case", TABLES)
@pytest.mark.parametrize("name", ["mean_similarity", "top_k_per_node"])
def test_whole_tables_against_sql(spark, tmp_path, monkeypatch, name, case):
    want = sql(name, TABLES[case], tmp_path)
    for block, tile in ((4096, 1024), (13, 5)):
        monkeypatch.setattr(allpairs, "BLOCK", block)
        monkeypatch.setattr(allpairs, "TILE", tile)
        assert answer(spark, name, tmp_path) == want


@pytest.mark.parametrize("name", ["mean_similarity", "top_k_per_node"])
def test_no_pairs_are_made(spark, tmp_path, monkeypatch, name):
    """The table of all pairs grows with the square of the rows; 1 GB can't have it."""
    from graphloom.operators import similarity

    want = sql(name, odd(300, 20), tmp_path)

    def refused(*_):
        raise AssertionError("all pairs were asked for")

    monkeypatch.setattr(similarity, "similar_pairs", refused)
    assert answer(spark, name, tmp_path) == want


def test_few_means_meet_every_row(spark, monkeypatch):
    """Only those that the rounding of single cosines could carry over a bound."""
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))], "id long, vec array<double>")
    met, asked = allpairs._met, []
    monkeypatch.setattr(allpairs, "_met", lambda left, *rest: asked.append(sum(len(r["ids"]) // 8 for r in left.collect())) or met(left, *rest))
    assert allpairs.mean_cosines(rows, 4).count() == 3000
    assert len(asked) == 1 and 0 < asked[0] < 120
