"""Event streams: replayed sources, subscriptions as stateless filters, windows, online anomalies."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import model
from ..plans.fixpoint import shared_dir

#: Readings kept of each source, and how many make a judgement.
BUFFER, LEAST = 50, 10


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "events*.parquet").parquet(sf_dir) if not _is_folder(spark, f"{sf_dir}/events.parquet") else spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet")


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read what it wrote from the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    if mode == "complete":

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/out")

        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    else:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def event_facts(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("subject"), F.lit("event_type").alias("predicate"), F.col("event_type").alias("text"))


def triple_added(facts: DataFrame, subject: str | None = None, predicate: str | None = None, subject_prefix: str | None = None, predicate_prefix: str | None = None) -> DataFrame:
    """A subscription: facts that pass all the given filters."""
    for column, exact, prefix in (("subject", subject, subject_prefix), ("predicate", predicate, predicate_prefix)):
        if exact is not None:
            facts = facts.where(F.col(column) == exact)
        if prefix is not None:
            facts = facts.where(F.col(column).startswith(prefix))
    return facts


def heartbeat(spark: SparkSession, seconds: int) -> DataFrame:
    """A row every so many seconds, between 5 and 300."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().where(F.col("value") % min(300, max(5, seconds)) == 0)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by type and window of event time; an extension: late rows beyond the watermark are dropped by the stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("event_type", F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def online_anomaly(events: DataFrame, least_z: float = 1.9) -> DataFrame:
    """event_id, z of readings far from their type's last BUFFER readings; state is that buffer and nothing else."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        ids, zs = [], []
        # sums over the buffer about a fixed point near its values, so that squares stay small
        middle = held[0] if held else float(rows["value"].iloc[0])
        total, squares = sum(x - middle for x in held), sum((x - middle) ** 2 for x in held)
        held = deque(held)
        for event, value in zip(rows["event_id"], rows["value"]):
            held.append(float(value))
            total, squares = total + value - middle, squares + (value - middle) ** 2
            if len(held) > BUFFER:
                old = held.popleft() - middle
                total, squares = total - old, squares - old * old
            if len(held) >= LEAST:
                mean = total / len(held)
                spread = max(0.0, squares / len(held) - mean * mean) ** 0.5
                z = abs(value - middle - mean) / max(spread, 1e-5)
                if z >= least_z:
                    ids.append(event)
                    zs.append(z)
        held = list(held)
        state.update((held,))
        yield pd.DataFrame({"event_id": pd.Series(ids, dtype="int64"), "z": pd.Series(zs, dtype="float64")})

    rows = events.select("event_type", "ts", "event_id", "value")
    return rows.groupBy("event_type").applyInPandasWithState(judge, "event_id long, z double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def observation_facts(events: DataFrame) -> DataFrame:
    return events.select(F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("subject"), F.lit("named").alias("subject_kind"), F.lit("value").alias("predicate"), *model.value("Float", dbl=F.col("value")))
