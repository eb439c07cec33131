"""Loops over DataFrames: each round's delta is written to the shared folder, so plans stay short and lost executors cost no more than a file read.

A loop ends when nothing new is found or at a depth that the caller asks for, never silently before.
A graph whose edges are few (SETTLE, counted) is settled by a single task instead of a job a
hop, so a chain of thousands of steps costs one job; a larger one is worked off in rounds of joins.
Both ways give the same rows.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: Edges (two ids each) that one task may hold.
SETTLE = 500_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where it is unset and all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def store(df: DataFrame) -> DataFrame:
    """Write df in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """store(df) and its rows, counted as they are written."""
    seen = Observation()
    kept = store(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return kept, seen.get["n"]


def drop(df: DataFrame) -> None:
    """Delete a table that store() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    base = shared_dir(spark).split("://")[-1].lstrip("/")
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if base in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str], depth: int | None = None) -> DataFrame:
    """All rows reached from seed (in `depth` rounds at most, if given): step(delta, round) gives candidates, an anti join on keys leaves the new ones."""
    delta, n = counted(seed.dropDuplicates(keys))
    seen, turn = delta, 0
    while n and (depth is None or turn < depth):
        turn += 1
        fresh = step(delta, turn).dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")
        delta, n = counted(fresh.select(*seen.columns))
        if n:
            seen = store(seen.unionByName(delta)) if turn % 8 == 0 else seen.unionByName(delta)
    return seen


# --- graphs that one task can hold ----------------------------------------------------------------


def _in_one_task(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    importable(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.coalesce(1).mapInArrow(run, schema)


def _numbered(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct ids of all columns in ascending order, and each column as their numbers (-1: null)."""
    whole = pa.concat_arrays([chunk for col in columns for chunk in col.chunks])
    ids = whole.unique().drop_null().sort()
    spot = pc.index_in(whole, ids).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum([len(c) for c in columns])
    return ids, np.split(spot, ends[:-1])


def _lists(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours in order of src, and where those of each node start."""
    order = np.argsort(src, kind="stable")
    return dst[order], np.searchsorted(src[order], np.arange(n + 1))


def _breadth_first(nxt: np.ndarray, first: np.ndarray, front: np.ndarray, depth: int | None) -> np.ndarray:
    """The distance of each node from the front; -1: out of reach."""
    far = np.full(len(first) - 1, -1, np.int64)
    far[front] = 0
    turn = 0
    while len(front) and (depth is None or turn < depth):
        turn += 1
        lens = first[front + 1] - first[front]
        upto = np.cumsum(lens)
        found = nxt[np.repeat(first[front] - upto + lens, lens) + np.arange(upto[-1])]
        front = np.unique(found[far[found] < 0])
        far[front] = turn
    return far


def reach(edges: DataFrame, seed: DataFrame, depth: int | None = None) -> DataFrame:
    """node, depth (the shortest) of everything that seed(node) reaches over edges(src, dst), the seed itself at 0."""
    kind = dict(edges.dtypes)["src"]
    edges, n = counted(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    seed, m = counted(seed.select(F.col("node").cast(kind).alias("node")).where("node is not null").distinct())
    if n + m <= SETTLE:

        def work(rows: pa.Table) -> pa.Table:
            asked = rows.column("asked").to_numpy()
            ids, (src, dst) = _numbered(rows.column("src"), rows.column("dst"))
            far = _breadth_first(*_lists(src[~asked], dst[~asked], len(ids)), np.unique(src[asked]), depth)
            hit = np.flatnonzero(far >= 0)
            return pa.table({"node": ids.take(pa.array(hit)), "depth": pa.array(far[hit].astype(np.int32))})

        rows = edges.select("src", "dst", F.lit(False).alias("asked")).unionByName(seed.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("asked")))
        return store(_in_one_task(rows, work, f"node {kind}, depth int"))
    grow = lambda delta, turn: delta.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), F.lit(turn).alias("depth"))
    return fixpoint(seed.select("node", F.lit(0).alias("depth")), grow, ["node"], depth)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of an undirected graph edges(a, b).

    Each round every node points to its neighbour of lowest rank (itself if none is lower) and the
    graph is contracted along these pointers: by id first, which settles stars, then by a hash
    anew each round, which shrinks any graph by a fraction in expectation, until one task can hold
    what is left. Joins have plain exchanges on both sides, so adaptive execution can split hubs.
    """
    kind = dict(edges.dtypes)["a"]
    left, n = counted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names: DataFrame | None = None
    turn = 0
    while n > SETTLE:
        rank = F.col if turn == 0 else lambda x, t=turn: F.xxhash64(F.col(x), F.lit(t))
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ends.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b").alias("id"))).alias("low"))
        own = F.struct(rank("a").alias("r"), F.col("a").alias("id"))
        point = store(low.select(F.col("a").alias("node"), F.least(own, "low")["id"].alias("to")))
        half = store(left.join(point.toDF("a", "a2"), "a").select("a2", "b"))
        pairs = half.join(point.toDF("b", "b2"), "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        old, (left, n) = left, counted(pairs.where("a <> b").distinct())
        names = point if names is None else store(names.join(point.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        drop(old)
        drop(half)
        turn += 1
    last = store(_in_one_task(left, _settle, f"node {kind}, component {kind}"))
    if names is None:
        return last
    # a name's end may have no edge left, and contraction need not end at a component's smallest node
    whole = store(names.join(last.toDF("to", "next"), "to", "left").select("node", F.coalesce("next", "to").alias("to")))
    low = store(whole.groupBy("to").agg(F.min("node").alias("component")))
    return whole.join(low, "to").select("node", "component")


def _settle(rows: pa.Table) -> pa.Table:
    """Smallest node of each node's component: labels fall along edges and pointers are halved until nothing moves."""
    ids, (a, b) = _numbered(rows.column("a"), rows.column("b"))
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return pa.table({"node": ids, "component": ids.take(pa.array(label))})


def ranks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, rank (the edges of the longest way to it) over edges(src, dst) without cycles; ValueError if there is one.

    Sources leave the graph, then those that have become sources, and so on; one task does all of it on a graph that it can hold.
    """
    kind = dict(nodes.dtypes)["node"]
    nodes, m = counted(nodes.select("node").distinct())
    edges, n = counted(edges.select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst")).distinct())
    if n + m <= SETTLE:
        rows = edges.unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst")))
        found = store(_in_one_task(rows, _ranks, f"node {kind}, rank int"))
    else:
        found, left, turn = None, nodes, 0
        while not left.isEmpty():
            done = store(left.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(turn).alias("rank")))
            if done.isEmpty():
                found = left.select("node", F.lit(-1).alias("rank"))
                break
            found = done if found is None else found.unionByName(done)
            left = store(left.join(done, "node", "left_anti"))
            edges = store(edges.join(done.select(F.col("node").alias("src")), "src", "left_anti"))
            turn += 1
        if found is None:
            return nodes.select("node", F.lit(0).alias("rank"))
    if not found.where("rank < 0").isEmpty():
        raise ValueError("the graph has a cycle")
    return found


def _ranks(rows: pa.Table) -> pa.Table:
    ids, (src, dst) = _numbered(rows.column("src"), rows.column("dst"))
    src, dst = src[dst >= 0], dst[dst >= 0]
    nxt, first = _lists(src, dst, len(ids))
    open_ = np.bincount(dst, minlength=len(ids))
    rank, front, turn = np.full(len(ids), -1, np.int64), np.flatnonzero(open_ == 0), 0
    while len(front):
        rank[front] = turn
        lens = first[front + 1] - first[front]
        upto = np.cumsum(lens)
        gone = nxt[np.repeat(first[front] - upto + lens, lens) + np.arange(upto[-1])]
        np.subtract.at(open_, gone, 1)
        front = np.unique(gone[open_[gone] == 0])
        turn += 1
    return pa.table({"node": ids, "rank": pa.array(rank.astype(np.int32))})


def strong_components(edges: DataFrame) -> DataFrame | None:
    """node, component (its smallest node) of every node, in one task; None if there are more edges(src, dst) than it may hold."""
    kind = dict(edges.dtypes)["src"]
    edges, n = counted(edges)
    return store(_in_one_task(edges, _strong, f"node {kind}, component {kind}")) if n <= SETTLE else None


def _strong(rows: pa.Table) -> pa.Table:
    """By two depth-first passes: nodes in order of leaving, then backwards from the last."""
    ids, (src, dst) = _numbered(rows.column("src"), rows.column("dst"))
    n = len(ids)
    ahead, back = _lists(src, dst, n), _lists(dst, src, n)
    (nxt, first), order, seen = (x.tolist() for x in ahead), [], bytearray(n)
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = 1
        path = [(root, first[root])]
        while path:
            node, at = path.pop()
            if at == first[node + 1]:
                order.append(node)
                continue
            path.append((node, at + 1))
            if not seen[nxt[at]]:
                seen[nxt[at]] = 1
                path.append((nxt[at], first[nxt[at]]))
    (nxt, first), label = (x.tolist() for x in back), [-1] * n
    for root in reversed(order):
        if label[root] >= 0:
            continue
        own, todo = [root], [root]
        label[root] = root
        while todo:
            node = todo.pop()
            for other in nxt[first[node] : first[node + 1]]:
                if label[other] < 0:
                    label[other] = root
                    own.append(other)
                    todo.append(other)
        least = min(own)
        for node in own:
            label[node] = least
    return pa.table({"node": ids, "component": ids.take(pa.array(label, pa.int64()))})
