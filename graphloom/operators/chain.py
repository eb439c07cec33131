"""Source-chain queries: headers (hash, author, seq, type, target, ...) with their entries and operations.

Deleted and updated headers are found by anti joins on the targets; folds over a chain are windows
or max_by. Nothing is ordered that isn't asked to be.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fixpoint import store


def targets(headers: DataFrame, *types: str) -> DataFrame:
    return headers.where(F.col("type").isin(*types) & F.col("target").isNotNull()).select(F.col("target").alias("hash")).distinct()


def live_elements(headers: DataFrame) -> DataFrame:
    """Headers other than deletes that no delete names."""
    return headers.where("type <> 'Delete'").join(targets(headers, "Delete"), "hash", "left_anti")


def live_entries(headers: DataFrame) -> DataFrame:
    """Entries with a header that creates or updates them and isn't deleted."""
    return live_elements(headers).select("entry_hash").distinct()


def element_details(headers: DataFrame) -> DataFrame:
    """hash, valid, updates, deletes of every header that isn't a delete."""
    changes = headers.where("target is not null").groupBy(F.col("target").alias("hash")).agg(F.count_if(F.col("type") == "Update").alias("updates"), F.count_if(F.col("type") == "Delete").alias("deletes"))
    own = headers.where("type <> 'Delete'").select("hash", (F.col("state") == "F").alias("valid"))
    return own.join(changes, "hash", "left").fillna(0, ["updates", "deletes"])


def entry_details(headers: DataFrame) -> DataFrame:
    """entry_hash, creates, updates, deletes, live: by the headers of each entry."""
    gone = targets(headers, "Delete").withColumn("gone", F.lit(1))
    rows = headers.join(gone, "hash", "left")
    out = rows.groupBy("entry_hash").agg(*[F.count_if(F.col("type") == x).alias(x.lower() + "s") for x in ("Create", "Update", "Delete")], F.max((F.col("type") != "Delete") & F.col("gone").isNull()).alias("live"))
    return out


def links(headers: DataFrame, tag_prefix: str = "") -> DataFrame:
    """base, target, tag of links that were created and not deleted; tags by their hexadecimal prefix."""
    made = headers.where("type = 'Create'").select("hash", "base", F.col("author").alias("to"), F.hex("hash").alias("tag"))
    return made.where(F.col("tag").startswith(tag_prefix)).join(targets(headers, "Delete"), "hash", "left_anti")


def link_details(headers: DataFrame) -> DataFrame:
    """Creates and the deletes that name them, as one bag."""
    made = headers.where("type = 'Create'").select("hash", "base")
    gone = headers.where("type = 'Delete'").select(F.col("target").alias("hash"), F.col("hash").alias("by"))
    return made.select("hash", "base", F.lit("create").alias("what")).unionByName(gone.join(made, "hash").select(F.col("by").alias("hash"), "base", F.lit("delete").alias("what")))


def chain_heads(headers: DataFrame) -> DataFrame:
    """author, hash, seq of each chain's newest header: one aggregation, no join."""
    return headers.groupBy("author").agg(F.max_by("hash", "seq").alias("hash"), F.max("seq").alias("seq"))


def dump(headers: DataFrame, entries: DataFrame, author: int) -> DataFrame:
    own = headers.where(F.col("author") == author)
    return own.join(entries, F.col("entry_hash") == F.col("o_orderkey"), "left").select("seq", "hash", "type", "entry_hash", F.col("o_orderstatus").alias("entry_status")).orderBy("seq")


def cap_grants(headers: DataFrame, entries: DataFrame) -> DataFrame:
    """Grants (entries with an access type) whose header was neither updated nor deleted; of an author the most open one counts.

    Fixed values: precedence of access types, unrestricted before assigned before transferable before author.
    """
    live = headers.where("type = 'Create'").join(targets(headers, "Update", "Delete"), "hash", "left_anti")
    rank = F.when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 2).when(F.col("o_orderpriority").startswith("3"), 3)
    grants = live.join(entries, F.col("entry_hash") == F.col("o_orderkey")).withColumn("rank", rank).where("rank is not null")
    return grants.groupBy("author").agg(F.min("rank").alias("access"), F.count(F.lit(1)).alias("grants"))


def integrate_ready(headers: DataFrame) -> DataFrame:
    """Pending operations whose dependency is integrated: a create needs the header before it, if there is one, a change its target."""
    done = headers.where("state = 'F'").select(F.col("hash").alias("need")).distinct().withColumn("done", F.lit(True))
    need = F.when(F.col("type") == "Create", F.col("prev_hash")).otherwise(F.col("target"))
    pending = headers.where("state = 'O'").select("hash", "type", need.alias("need")).join(done, "need", "left")
    return pending.where(F.col("done") | ((F.col("type") == "Create") & F.col("need").isNull())).select("hash", "type")


def activity(headers: DataFrame) -> DataFrame:
    """author, n, fork_at (the first seq seen twice), gap_at (the first seq without its predecessor)."""
    own = Window.partitionBy("author").orderBy("seq", "hash")
    rows = headers.withColumn("before", F.lag("seq").over(own))
    return rows.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("before") == F.col("seq"), F.col("seq"))).alias("fork_at"), F.min(F.when(F.col("before") < F.col("seq") - 1, F.col("seq"))).alias("gap_at"))


def newest_only(old: DataFrame, new: DataFrame, key: str, stamp: str) -> DataFrame:
    """The rows of new with no row of old that has their key and a stamp as new or newer."""
    known = old.groupBy(key).agg(F.max(stamp).alias("_known"))
    return new.join(known, key, "left").where(F.col("_known").isNull() | (F.col("_known") < F.col(stamp))).drop("_known")


def add_receipts(known: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """known and those of new whose key isn't there, each once."""
    return known.unionByName(new.select(*known.columns).dropDuplicates(key).join(known.select(*key), key, "left_anti").select(*known.columns))


def verify_log(entries: DataFrame, author: str, seq: str, first: int = 1) -> DataFrame:
    """author, entries, ok: whether each author's sequence has every number from the first on, once."""
    by = entries.groupBy(author).agg(F.count(F.lit(1)).alias("entries"), F.min(seq).alias("low"), F.max(seq).alias("high"), F.count_distinct(seq).alias("n"))
    return by.select(author, "entries", ((F.col("low") == first) & (F.col("high") - F.col("low") + 1 == F.col("entries")) & (F.col("n") == F.col("entries"))).alias("ok"))


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels of (at, hash) from the leaves(at, hash: hexadecimal) to the root: a node hashes its two children's bytes, an odd last one goes up as it is."""
    levels = [store(leaves.select("at", "hash"))]
    n = levels[0].count()
    while n > 1:
        both = F.sort_array(F.collect_list(F.struct("at", "hash")))
        up = levels[-1].groupBy(F.floor(F.col("at") / 2).cast("long").alias("up")).agg(both.alias("x"))
        joined = F.unhex(F.concat(F.col("x")[0]["hash"], F.get(F.col("x"), 1)["hash"]))
        levels.append(store(up.select(F.col("up").alias("at"), F.when(F.size("x") == 2, F.sha2(joined, 256)).otherwise(F.col("x")[0]["hash"]).alias("hash"))))
        n = -(-n // 2)
    return levels


def merkle_proof(levels: list[DataFrame], at: int) -> list[tuple[str, str]]:
    """(side, hash) of each neighbour on the way from a leaf to the root."""
    out = []
    for level in levels[:-1]:
        row = level.where(F.col("at") == (at ^ 1)).first()
        if row is not None:
            out.append(("left" if at & 1 else "right", row["hash"]))
        at >>= 1
    return out


def merkle_member(leaf: str, proof: list[tuple[str, str]], root: str) -> bool:
    """Whether a leaf's hash and its proof give the root."""
    for side, other in proof:
        pair = other + leaf if side == "left" else leaf + other
        leaf = hashlib.sha256(bytes.fromhex(pair)).hexdigest()
    return leaf == root


def ring(ops: DataFrame, start: int, end: int, loc: str = "loc") -> DataFrame:
    """Operations within a range of the ring; a range over the ring's end is two scans."""
    if start <= end:
        return ops.where(F.col(loc).between(start, end))
    return ops.where(F.col(loc) >= start).unionAll(ops.where(F.col(loc) <= end))


def verify_hash_chain(rows: DataFrame, author: str, order: list[str], content: list[str]) -> DataFrame:
    """hash, prev and ok of each row: the row's own hash, the one before, and whether it repeats the stored ones."""
    own = Window.partitionBy(author).orderBy(*order)
    hashed = rows.withColumn("calc", F.sha2(F.concat_ws("|", *[F.col(x).cast("string") for x in content]), 256))
    return hashed.withColumn("calc_prev", F.lag("calc").over(own))
