"""File sources and sinks: notes by content hash, audit JSON lines, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is ingested, what never is, and the caps of the operator.
EXTENSIONS = ("md", "markdown", "txt", "org", "rst", "json", "csv", "py", "rs", "js", "ts", "go", "java", "toml", "yaml", "yml", "html")
SECRETS = r"(?i)(^|/)(\.env[^/]*|id_rsa[^/]*|[^/]*\.(pem|key|p12|pfx)|[^/]*(secret|credential|password)[^/]*|\.git/.*|\.ssh/.*)$"
MOST_BYTES, MOST_FILES = 2 << 20, 200_000


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.where(F.col("length") <= MOST_BYTES).select("path", F.decode("content", "UTF-8").alias("content"))


def listed(files: DataFrame) -> DataFrame:
    """path, content, content_hash of files that may be ingested."""
    allowed = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(list(EXTENSIONS))
    return files.where(allowed & ~F.col("path").rlike(SECRETS) & (F.octet_length("content") <= MOST_BYTES)).withColumn("content_hash", F.sha2("content", 256))


def changed(files: DataFrame, known: DataFrame | None) -> DataFrame:
    """The files whose hash isn't known for their path."""
    rows = files.select("path", "content_hash")
    return rows if known is None else rows.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def ingest_stream(spark: SparkSession, path: str, state: str, sink) -> None:
    """Give sink(rows) the files below a folder that no call before has seen; what was seen is kept in the state folder."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(path)
    rows = stream.where(F.col("length") <= MOST_BYTES).select("path", F.decode("content", "UTF-8").alias("content"))
    query = rows.writeStream.option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda batch, _: sink(listed(batch))).start()
    query.awaitTermination()


def export_for_regulator(rows: DataFrame, path: str, since: str, until: str) -> None:
    """An audit log's rows of a period as CSV with a header, in order of time."""
    rows.where((F.col("timestamp") >= since) & (F.col("timestamp") < until)).orderBy("timestamp", "request_id").coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def load_list(spark: SparkSession, path: str) -> DataFrame:
    """name, source of a watch list in CSV files with a header; rows without a name are left out."""
    return spark.read.option("header", "true").schema("name string, source string").csv(path).where("trim(name) <> ''")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str, last: int) -> DataFrame:
    """The newest `last` rows of an audit log."""
    schema = "timestamp string, user_id string, namespace string, action string, resource string, details string, request_id string"
    return spark.read.schema(schema).json(path).orderBy(F.desc("timestamp"), F.desc("request_id")).limit(last)


def save_snapshot(rows: DataFrame, base: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{base}/version={version}")


def load_snapshot(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base}/version={version}")
