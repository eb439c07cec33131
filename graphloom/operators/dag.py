"""The action DAG: tips, history, ancestors, time travel, difference, pruning and export.

actions: hash, parents (array), author, seq, ts, op ('insert' or 'delete'), triple_key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import reach, store


def edges(actions: DataFrame) -> DataFrame:
    return actions.select(F.col("hash").alias("child"), F.explode("parents").alias("parent"))


def tips(actions: DataFrame) -> DataFrame:
    """Actions that are nobody's parent."""
    return actions.join(edges(actions).select(F.col("parent").alias("hash")), "hash", "left_anti").select("hash")


def history(actions: DataFrame, key: str, limit: int) -> DataFrame:
    """The newest actions that touch a triple."""
    return actions.where(F.col("triple_key") == key).orderBy(F.desc("ts"), F.desc("hash")).limit(limit)


def last_of_authors(actions: DataFrame, n: int) -> DataFrame:
    own = Window.partitionBy("author").orderBy(F.desc("seq"))
    return actions.withColumn("n", F.row_number().over(own)).where(F.col("n") <= n).drop("n")


class Log:
    """Actions and their tips, as a node that takes part in the exchange of actions keeps them.

    put() makes actions tips in their parents' place; ingest() takes in history without touching the tips.
    """

    def __init__(self, actions: DataFrame, tip_set: DataFrame | None = None):
        self.actions, self.tips = actions, tips(actions) if tip_set is None else tip_set

    @staticmethod
    def init(actions: DataFrame, genesis: DataFrame) -> Log:
        """A log that begins with the genesis action, or the log as it is if it has actions."""
        return Log(genesis if actions.isEmpty() else actions)

    def _new(self, actions: DataFrame) -> DataFrame:
        return store(actions.select(*self.actions.columns).dropDuplicates(["hash"]).join(self.actions.select("hash"), "hash", "left_anti").select(*self.actions.columns))

    def put(self, actions: DataFrame) -> Log:
        new = self._new(actions)
        heads = self.tips.select("hash").unionByName(new.select("hash")).join(edges(new).select(F.col("parent").alias("hash")), "hash", "left_anti")
        return Log(self.actions.unionByName(new), store(heads.distinct()))

    def ingest(self, actions: DataFrame) -> Log:
        return Log(self.actions.unionByName(self._new(actions)), self.tips)

    def respond(self, remote_tips: list[int]) -> DataFrame:
        """The actions that a peer with these tips lacks; all of ours if we know none of them."""
        return self.actions.join(missing(self.actions, remote_tips), "hash", "left_semi")


def _up(actions: DataFrame) -> DataFrame:
    return edges(actions).select(F.col("child").alias("src"), F.col("parent").alias("dst"))


def ancestors(actions: DataFrame, start: list[int]) -> DataFrame:
    """hash of the given actions and all that they rest on."""
    seed = actions.sparkSession.createDataFrame([(x,) for x in start], "node long")
    return reach(_up(actions), seed).select(F.col("node").alias("hash"))


def replay(actions: DataFrame) -> DataFrame:
    """triple_key of what is there after the actions, in order of (ts, hash): the last action on a triple decides."""
    last = actions.groupBy("triple_key").agg(F.max_by("op", F.struct("ts", "hash")).alias("op"))
    return last.where("op = 'insert'").select("triple_key")


def at(actions: DataFrame, action: int) -> DataFrame:
    """The triples as of an action: only its ancestors count."""
    return replay(actions.join(ancestors(actions, [action]), "hash", "left_semi"))


def at_timestamp(actions: DataFrame, stamp: str) -> DataFrame:
    return replay(actions.where(F.col("ts") <= F.lit(stamp).cast("timestamp_ntz")))


def difference(actions: DataFrame, old: int, new: int) -> DataFrame:
    """Ancestors of new that are none of old's."""
    return ancestors(actions, [new]).join(ancestors(actions, [old]), "hash", "left_anti")


def missing(actions: DataFrame, remote_tips: list[int]) -> DataFrame:
    """Our actions that rest on none of the remote's known tips."""
    return actions.select("hash").join(ancestors(actions, remote_tips), "hash", "left_anti")


def depths(actions: DataFrame) -> DataFrame:
    """hash, depth: the distance from the nearest tip."""
    return reach(_up(actions), tips(actions).select(F.col("hash").alias("node"))).select(F.col("node").alias("hash"), "depth")


def prune(actions: DataFrame, keep_since: str | None = None, keep_last: int | None = None, keep_depth: int | None = None) -> DataFrame:
    """The actions that a policy keeps; tips always stay."""
    if keep_since is not None:
        kept = actions.where(F.col("ts") >= F.lit(keep_since).cast("timestamp_ntz")).select("hash")
    elif keep_last is not None:
        kept = actions.orderBy(F.desc("ts"), F.desc("hash")).limit(keep_last).select("hash")
    elif keep_depth is not None:
        kept = depths(actions).where(F.col("depth") <= keep_depth).select("hash")
    else:
        return actions.select("hash")
    return kept.unionByName(tips(actions)).distinct()


def dot(actions: DataFrame) -> DataFrame:
    """Lines of a DOT graph: a node line for each action, an edge line for each parent."""
    nodes = actions.select(F.format_string('  "%s" [label="%s:%s"];', F.col("hash").cast("string"), F.col("author").cast("string"), F.col("seq").cast("string")).alias("line"))
    return nodes.unionByName(edges(actions).select(F.format_string('  "%s" -> "%s";', F.col("child").cast("string"), F.col("parent").cast("string")).alias("line")))


def mermaid(actions: DataFrame) -> DataFrame:
    return edges(actions).select(F.format_string("  %s --> %s", F.col("child").cast("string"), F.col("parent").cast("string")).alias("line"))


def as_json(actions: DataFrame) -> DataFrame:
    return actions.select(F.to_json(F.struct("hash", "parents", "author", "seq", "op")).alias("line"))
