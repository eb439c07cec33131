"""Stores of triples behind one interface: in memory, or a folder that lasts.

Every store has put, put_batch, delete, delete_by_prefix, triples, contains, flush and size_bytes; a class of one's
own that has them can be given to open_store() by name. A FolderStore is a log of Parquet segments (rows put
and tombstones, each with the number of its write): writing is appending, so a lost task costs its own
segment, and reading takes the last word on each triple by one aggregation. flush() writes what is there
as one snapshot and forgets the log before it; a snapshot counts only once its marker is written.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import graph


class Store(Protocol):
    def put(self, triple: DataFrame) -> None: ...
    def put_batch(self, new: DataFrame) -> int: ...
    def delete(self, ids: DataFrame) -> None: ...
    def delete_by_prefix(self, prefix: str) -> None: ...
    def triples(self) -> DataFrame: ...
    def contains(self, triple_id: str) -> bool: ...
    def flush(self) -> None: ...
    def size_bytes(self) -> int: ...


class MemoryStore:
    """A DataFrame that each write replaces; nothing is kept beyond the session."""

    def __init__(self, spark: SparkSession):
        self.rows = spark.createDataFrame([], model.SCHEMA)

    def put(self, triple: DataFrame) -> None:
        """Add a triple; ValueError if it is there already."""
        self.rows = graph.insert(self.rows, triple.select(*model.COLUMNS))

    def put_batch(self, new: DataFrame) -> int:
        """Add those of the triples that aren't there; how many these were."""
        fresh = graph.fresh(self.rows, new.select(*model.COLUMNS)).select(*model.COLUMNS)
        n = fresh.count()
        if n:
            self.rows = self.rows.unionByName(fresh)
        return n

    def delete(self, ids: DataFrame) -> None:
        self.rows = graph.delete(self.rows, ids)

    def delete_by_prefix(self, prefix: str) -> None:
        self.rows = graph.delete_by_prefix(self.rows, prefix)

    def triples(self) -> DataFrame:
        return self.rows

    def contains(self, triple_id: str) -> bool:
        return not graph.get(self.triples(), triple_id).isEmpty()

    def flush(self) -> None:
        """Nothing to do: there is no place that lasts."""

    def size_bytes(self) -> int:
        """Bytes of the text of all triples."""
        return graph.stats(self.rows).first()["bytes"] or 0


class FolderStore(MemoryStore):
    """A log of segments and a snapshot in a folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self, kind: str) -> list[int]:
        """Numbers of the segments (log) or snapshots whose writing ended."""
        if not self._fs.exists(self._at("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(""))]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(kind + "-") and self._fs.exists(self._at(f"{n}/_SUCCESS")))

    @property
    def rows(self) -> DataFrame:
        snapshots = self._numbers("snapshot")
        since = snapshots[-1] if snapshots else -1
        log = [n for n in self._numbers("log") if n > since]
        base = self.spark.createDataFrame([], model.SCHEMA) if since < 0 else self.spark.read.schema(model.SCHEMA).parquet(f"{self.path}/snapshot-{since}")
        if not log:
            return base
        parts = model.with_id(base).select(*model.COLUMNS, "triple_id", F.lit(-1).cast("long").alias("write"), F.lit(False).alias("gone"))
        parts = parts.unionByName(self.spark.read.schema(_LOG).parquet(*[f"{self.path}/log-{n}" for n in log]))
        last = parts.groupBy("triple_id").agg(F.max_by(F.struct("gone", *model.COLUMNS), F.struct("write", ~F.col("gone"))).alias("last"))
        return last.where("not last.gone").select(*[F.col(f"last.{x}").alias(x) for x in model.COLUMNS])

    @rows.setter
    def rows(self, value: DataFrame) -> None:
        raise AttributeError("a folder's triples change by put and delete")

    def _append(self, rows: DataFrame) -> None:
        n = max([*self._numbers("log"), *self._numbers("snapshot"), -1]) + 1
        rows.withColumn("write", F.lit(n).cast("long")).select(*_LOG.names).write.mode("overwrite").parquet(f"{self.path}/log-{n}")

    def put(self, triple: DataFrame) -> None:
        if graph.fresh(self.rows, triple.select(*model.COLUMNS)).isEmpty():
            raise ValueError("the triple is there already")
        self.put_batch(triple)

    def put_batch(self, new: DataFrame) -> int:
        fresh = model.with_id(graph.fresh(self.rows, new.select(*model.COLUMNS)).select(*model.COLUMNS)).withColumn("gone", F.lit(False))
        n = fresh.count()
        if n:
            self._append(fresh)
        return n

    def delete(self, ids: DataFrame) -> None:
        gone = model.with_id(self.rows).join(ids.select("triple_id"), "triple_id", "left_semi").withColumn("gone", F.lit(True))
        self._append(gone)

    def delete_by_prefix(self, prefix: str) -> None:
        gone = model.with_id(self.rows).where((F.col("subject_kind") == "named") & F.col("subject").startswith(prefix)).withColumn("gone", F.lit(True))
        self._append(gone)

    def flush(self) -> None:
        """One snapshot of what is there; segments and snapshots before it are deleted once it is whole."""
        old = [*[f"log-{n}" for n in self._numbers("log")], *[f"snapshot-{n}" for n in self._numbers("snapshot")]]
        n = max([*self._numbers("log"), *self._numbers("snapshot"), -1]) + 1
        self.rows.write.mode("overwrite").parquet(f"{self.path}/snapshot-{n}")
        for name in old:
            self._fs.delete(self._at(name), True)

    def size_bytes(self) -> int:
        """Bytes of the folder's files."""
        return int(self._fs.getContentSummary(self._at("")).getLength()) if self._fs.exists(self._at("")) else 0


_LOG = type(model.SCHEMA)(list(model.SCHEMA.fields)).add("triple_id", "string").add("write", "long").add("gone", "boolean")

#: Stores by name; others may be added.
STORES = {"memory": MemoryStore, "folder": FolderStore}


def open_store(spark: SparkSession, kind: str = "folder", *args) -> Store:
    return STORES[kind](spark, *args)
