"""Graph traversal: reachability, shortest paths, paths with products, ownership trees, components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import components, counted, fixpoint, reach, store, strong_components

HOPS, MOST_HOPS, STEPS = 4, 6, 50


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def reachable(edges: DataFrame, start: list, max_depth: int | None = None, bidirectional: bool = False) -> DataFrame:
    """node, depth (the shortest) of what can be reached from the start nodes, which are left out."""
    kind = dict(edges.dtypes)["src"]
    seed = edges.sparkSession.createDataFrame([(x,) for x in start], f"node {kind}")
    return reach(both_ways(edges) if bidirectional else edges, seed, max_depth).where("depth > 0")


def shortest_path(edges: DataFrame, start, end, max_hops: int = HOPS) -> DataFrame:
    """path (array of nodes) of a shortest undirected path of at most max_hops (six at most); of equal ones the least."""
    both = store(both_ways(edges).distinct())
    kind = dict(edges.dtypes)["src"]
    seed = edges.sparkSession.createDataFrame([(start, [start])], f"node {kind}, path array<{kind}>")
    grow = lambda delta, turn: delta.join(both, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
    return fixpoint(seed, grow, ["node"], min(max_hops, MOST_HOPS)).where(F.col("node") == end).select("path")


def simple_paths(edges: DataFrame, start, end, max_edges: int = MOST_HOPS, share: str = "share") -> DataFrame:
    """path, product of all simple paths of at most max_edges; the product is null if a share is missing."""
    kind = dict(edges.dtypes)["src"]
    rows = edges.sparkSession.createDataFrame([(start, [start], 1.0)], f"node {kind}, path array<{kind}>, product double")
    # every hop reads the edges again; those that don't lead to the end within the hops left are of no use
    edges = store(edges)
    ahead = reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), edges.sparkSession.createDataFrame([(end,)], f"node {kind}"), max_edges - 1)
    edges = store(edges.join(ahead.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst", share))
    found = None
    for _ in range(max_edges):
        rows, n = counted(rows.join(edges, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), (F.col("product") * F.col(share)).alias("product")))
        hit = rows.where(F.col("node") == end).select("path", "product")
        found = hit if found is None else found.unionByName(hit)
        rows = rows.where(F.col("node") != end)
        if not n:
            break
    return found


def chain_back(events: DataFrame, start: int, steps: int = STEPS) -> DataFrame:
    """id, step of an event and its parents, oldest last, at most `steps`."""
    links = events.select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    return reach(links, events.sparkSession.createDataFrame([(start,)], "node long"), steps - 1).select(F.col("node").alias("id"), F.col("depth").alias("step"))


def ego_networks(edges: DataFrame, seeds: DataFrame, scores: DataFrame) -> DataFrame:
    """seed, nodes, max_score of the undirected two-hop surroundings of each seed."""
    both = store(both_ways(edges).distinct())
    one = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"))
    hop = lambda rows: rows.join(both, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"))
    first = store(one.unionByName(hop(one)).distinct())
    every = first.unionByName(hop(first)).distinct()
    return every.join(scores, F.col("node") == F.col("id")).groupBy("seed").agg(F.count(F.lit(1)).alias("nodes"), F.max("score").alias("max_score"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of components of more than one node.

    A graph that one task can't hold is coloured: a node takes the least colour among what reaches it; within a colour, what its root can be reached
    from is a component, and leaves the graph.
    """
    left, done = store(edges.select("src", "dst").where("src <> dst").distinct()), None
    small = strong_components(left)
    if small is not None:
        big = small.groupBy("component").count().where("count > 1").select("component")
        return small.join(big, "component", "left_semi").select("node", "component")
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colour = store(nodes.select("node", F.col("node").alias("colour")))
        while True:
            pulled = left.join(colour, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "colour")
            lower = store(colour.unionByName(pulled).groupBy("node").agg(F.min("colour").alias("colour")))
            if lower.join(colour, ["node", "colour"], "left_anti").isEmpty():
                break
            colour = lower
        same = left.join(colour.toDF("src", "colour"), "src").join(colour.toDF("dst", "colour2"), "dst").where("colour = colour2").select("src", "dst", "colour")
        same = store(same)
        seed = colour.where("node = colour")
        back = lambda delta, turn: delta.join(same, (F.col("node") == F.col("dst")) & (delta["colour"] == same["colour"])).select(F.col("src").alias("node"), delta["colour"])  # noqa: B023, E731
        found = store(fixpoint(seed, back, ["node"]))
        done = found if done is None else done.unionByName(found)
        gone = found.select("node")
        left = store(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti"))
    if done is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    big = done.groupBy("colour").count().where("count > 1").select("colour")
    return done.join(big, "colour", "left_semi").select("node", F.col("colour").alias("component"))


def sized_components(edges: DataFrame, more_than: int = 3) -> DataFrame:
    """node, component of undirected components of more than so many nodes."""
    found = store(components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    big = found.groupBy("component").count().where(F.col("count") > more_than).select("component")
    return found.join(big, "component", "left_semi").select("node", "component")


