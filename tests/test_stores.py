"""Stores, logs of actions, ingest, notes and proofs of membership."""

import hashlib

import pytest
from pyspark.sql import functions as F

from graphloom import model
from graphloom.operators import chain, dag, vault
from graphloom.sources import files, store
from graphloom.streaming import events

from .test_units import triples


@pytest.mark.parametrize("kind", ["memory", "folder"])
def test_store(spark, tmp_path, kind):
    s = store.open_store(spark, kind, *([str(tmp_path / "s")] if kind == "folder" else []))
    assert s.triples().count() == 0
    rows = triples(spark, [("user:alice", "has_name", "Alice"), ("user:alice", "knows", "user:bob"), ("item:1", "size", 30)])
    assert s.put_batch(rows) == 3 and s.put_batch(rows) == 0
    with pytest.raises(ValueError):
        s.put(triples(spark, [("item:1", "size", 30)]))
    one = model.with_id(triples(spark, [("item:1", "size", 30)])).select("triple_id")
    s.delete(one)
    assert s.triples().count() == 2 and not s.contains(one.first()[0])
    s.put(triples(spark, [("item:1", "size", 30)]))
    s.flush()
    assert s.contains(one.first()[0]) and s.size_bytes() > 0
    s.delete_by_prefix("user:")
    assert [r["subject"] for r in s.triples().collect()] == ["item:1"]
    if kind == "folder":
        s.flush()
        assert [r["subject"] for r in store.FolderStore(spark, str(tmp_path / "s")).triples().collect()] == ["item:1"]


def test_log_of_actions(spark):
    schema = "hash long, parents array<long>"
    of = lambda *rows: spark.createDataFrame(list(rows), schema)
    tips = lambda log: sorted(r["hash"] for r in log.tips.collect())
    log = dag.Log.init(of().limit(0) if False else spark.createDataFrame([], schema), of((1, [])))
    log = log.put(of((2, [1]), (3, [1])))
    assert tips(log) == [2, 3] and tips(log.put(of((4, [2, 3])))) == [4]
    old = log.ingest(of((0, []), (2, [1])))
    assert tips(old) == [2, 3] and old.actions.count() == 4
    assert sorted(r["hash"] for r in log.respond([2]).collect()) == [3] and log.respond([99]).count() == 3
    assert dag.Log.init(log.actions, of((9, []))).actions.count() == 3


def test_merkle_membership(spark):
    leaves = spark.range(11).select(F.col("id").alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    levels = chain.merkle_levels(leaves)
    row = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(11)]
    plain = list(row)
    while len(plain) > 1:
        plain = [hashlib.sha256(bytes.fromhex(plain[i] + plain[i + 1])).hexdigest() if i + 1 < len(plain) else plain[i] for i in range(0, len(plain), 2)]
    root = levels[-1].first()["hash"]
    assert root == plain[0]
    for i in (0, 7, 10):
        proof = chain.merkle_proof(levels, i)
        assert chain.merkle_member(row[i], proof, root) and not chain.merkle_member(row[(i + 1) % 11], proof, root)


def test_note_edits(spark):
    notes = ["---\ntitle: x\ntags: [a, b]\n---\nbody", "---\ntitle: x\n---\nbody", "plain"]
    df = spark.createDataFrame([(n,) for n in notes], "c string")
    assert [r[0] for r in df.select(vault.add_tag(F.col("c"), "New")).collect()] == ["---\ntitle: x\ntags: [a, b, new]\n---\nbody", "---\ntitle: x\ntags: [new]\n---\nbody", "---\ntags: [new]\n---\nplain"]
    assert [r[0] for r in df.select(vault.remove_tag(F.col("c"), "a")).collect()] == ["---\ntitle: x\ntags: [b]\n---\nbody", notes[1], notes[2]]
    assert spark.createDataFrame([("1\n2\n3\n4",)], "c string").select(vault.edit_lines(F.col("c"), 2, 3, "x\ny\nz")).first()[0] == "1\nx\ny\nz\n4"
    assert spark.createDataFrame([("1\n2",)], "c string").select(vault.edit_lines(F.col("c"), 1, 2, "x")).first()[0] == "x"


def test_incremental_ingest(spark, tmp_path):
    folder, state, seen = tmp_path / "notes", str(tmp_path / "state"), []
    folder.mkdir()
    sink = lambda rows: seen.extend(sorted(r["path"].rsplit("/", 1)[1] for r in rows.collect()))
    (folder / "a.md").write_text("one")
    (folder / "id_rsa.md").write_text("no")
    files.ingest_stream(spark, str(folder), state, sink)
    (folder / "b.md").write_text("two")
    files.ingest_stream(spark, str(folder), state, sink)
    assert seen == ["a.md", "b.md"]


def test_regulator_export_and_lists(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-02", "u", "r2"), ("2024-01-01", "v", "r1"), ("2025-01-01", "w", "r3")], "timestamp string, user_id string, request_id string")
    files.export_for_regulator(rows, str(tmp_path / "out"), "2024-01-01", "2025-01-01")
    assert [r["user_id"] for r in spark.read.option("header", "true").csv(str(tmp_path / "out")).collect()] == ["v", "u"]
    (tmp_path / "list.csv").write_text("name,source\nAcme,eu\n ,un\n")
    assert [tuple(r) for r in files.load_list(spark, str(tmp_path / "list.csv")).collect()] == [("Acme", "eu")]


def test_heartbeat_beats(spark, tmp_path):
    import time

    got = []
    query = events.heartbeat(spark, 5).writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda rows, _: got.extend(r["value"] for r in rows.collect())).start()
    until = time.time() + 20
    while not got and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert got and all(v % 5 == 0 for v in got)
