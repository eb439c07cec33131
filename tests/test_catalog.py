"""Registered queries against an independent SQL engine on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import graphloom.catalog  # noqa: F401
from graphloom import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = (
    "find_po query_builder_totals insert_batch delete_by_prefix import_ntriples import_turtle policy_hidden sparql_bgp_join sparql_optional sparql_group_count sparql_not_exists "
    "sparql_compat_bgp live_element entry_details link_details integrate_ready resolve_wikilink as_of_action fork_detect graph_stats degrees audit_stats transition_probs top_k_per_node "
    "anomaly_zscore tag_fanout traverse shortest_path scc causal_chain dag_at dag_depth_map forward_chain temporal_cycle recall vector_search agenda wikilinks stream_windows "
    "goal_toposort dag_put dag_ingest components orphans bloom_missing not_exists_cond sparql_minus cosine_pairs sanctions_screen parse_task record_access find_s find_o find_so find_spo "
    "contradictions get_links backlinks semantic_clusters wal_verify receipts_add"
).split()

#: Without rows on the smallest tables.
EMPTY = {"semantic_clusters", "cosine_pairs"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "tolist"):
        return cell(x.tolist())
    return [cell(y) for y in x] if isinstance(x, list) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([cell(v) for v in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) or name in EMPTY
    assert rows(got) == rows(want)


def test_bound_positions_reach_one_scan(spark):
    """A subject's key is a pushed filter of its own table; what can't hold it isn't read."""
    from graphloom.sources import tables

    plan = tables.triples(spark, DATA, subject="customer:7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,7)" in plan and "orders" not in plan
    one = tables.triples(spark, DATA, "nation:3", "rdf:type", {"kind": "Node", "node": "type:Nation"})
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1 and one.count() == 1
    assert tables.triples(spark, DATA, subject="nobody:x").count() == 0 and tables.triples(spark, DATA, subject="customer:07").count() == 0
    assert tables.triples(spark, DATA, obj={"kind": "String", "str": "it's"}).count() == 0
    assert tables.every_triple(spark, DATA).exceptAll(tables.triples(spark, DATA)).count() == 0


def test_entry_imports_without_the_removable_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "graphloom"), tmp_path / "graphloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 200; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}).returncode == 0
