"""An approximate index of vectors with a life of its own: built, added to, taken from, rebuilt, kept in a folder.

Vectors are hashed by random hyperplanes into buckets, in TABLES independent tables. A table has as many planes
as leave some ROWS vectors in a bucket, so buckets grow in number with the table, not in size. A query
looks into its own bucket of each table and into those behind its PROBES nearest planes. Buckets hold ids
only: candidates are joined with their vectors once they are distinct, and reranked by exact cosine.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fixpoint import counted, importable, store
from .similarity import cosine

TABLES, ROWS, PROBES, MOST_PLANES = 12, 128, 4, 40


def _keys(vec: Column, normals: np.ndarray, probes: int) -> Column:
    """Buckets of a vector in all tables: its own, and with each of the nearest planes crossed."""
    tables, planes, dim = normals.shape
    flat, weights = normals.reshape(-1, dim), 1 << np.arange(planes, dtype=np.int64)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            if v is None or len(v) != dim:
                out.append([])
                continue
            side = (flat @ np.asarray(v, np.float64)).reshape(tables, planes)
            own = ((side > 0) * weights).sum(1)
            near = np.argsort(np.abs(side), axis=1)[:, : min(probes, planes)]
            every = np.hstack([own[:, None], own[:, None] ^ weights[near]]) if probes else own[:, None]
            out.append((every * tables + np.arange(tables)[:, None]).ravel().tolist())
        return pd.Series(out)

    return run(vec)


class VectorIndex:
    """vectors(id, vec), the planes, and buckets(key, id)."""

    def __init__(self, vectors: DataFrame, normals: np.ndarray, buckets: DataFrame):
        self.vectors, self.normals, self.buckets = vectors, normals, buckets

    @classmethod
    def build(cls, vectors: DataFrame, dim: int, seed: int = 1) -> VectorIndex:
        """Of vectors(id, vec) of length dim; others are left out. Of equal ids the smallest vector stays."""
        importable(vectors.sparkSession)
        own, n = counted(vectors.where((F.size("vec") == dim) & F.col("id").isNotNull()).groupBy("id").agg(F.min("vec").alias("vec")))
        planes = min(MOST_PLANES, max(1, math.ceil(math.log2(max(2, n / ROWS)))))
        normals = np.random.default_rng(seed).normal(size=(TABLES, planes, dim))
        return cls(own, normals, cls._placed(own, normals))

    @staticmethod
    def _placed(vectors: DataFrame, normals: np.ndarray) -> DataFrame:
        return store(vectors.select("id", F.explode(_keys(F.col("vec"), normals, 0)).alias("key")).select("key", "id"))

    def insert(self, vectors: DataFrame) -> VectorIndex:
        """With more vectors; of ids that are there the new vector counts."""
        new = store(vectors.where(F.size("vec") == self.normals.shape[2]).select("id", "vec").dropDuplicates(["id"]))
        kept = self.remove(new.select("id"))
        return VectorIndex(kept.vectors.unionByName(new), self.normals, kept.buckets.unionByName(self._placed(new, self.normals)))

    def remove(self, ids: DataFrame) -> VectorIndex:
        gone = ids.select("id").distinct()
        return VectorIndex(store(self.vectors.join(gone, "id", "left_anti").select("id", "vec")), self.normals, store(self.buckets.join(gone, "id", "left_anti").select("key", "id")))

    def rebuild(self) -> VectorIndex:
        """With as many planes as the vectors that are left need."""
        return VectorIndex.build(self.vectors, self.normals.shape[2])

    def stats(self) -> DataFrame:
        """vectors, buckets, largest (bucket), planes."""
        sizes = self.buckets.groupBy("key").count().agg(F.count(F.lit(1)).alias("buckets"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"))
        return self.vectors.agg(F.count(F.lit(1)).alias("vectors")).crossJoin(sizes).withColumn("planes", F.lit(self.normals.shape[1]))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query, id, score, n: the k best found for queries(id, vec), the query's own id left out, ties to the smaller id."""
        asked = store(queries.select(F.col("id").alias("query"), F.col("vec").alias("qvec")))
        keys = asked.select("query", F.explode(_keys(F.col("qvec"), self.normals, PROBES)).alias("key"))
        pairs = keys.join(self.buckets, "key").where("query <> id").select("query", "id").distinct()
        scored = pairs.join(self.vectors, "id").join(asked, "query").select("query", "id", F.round(cosine(F.col("qvec"), F.col("vec")), 6).alias("score"))
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)

    def save(self, folder: str) -> None:
        spark = self.vectors.sparkSession
        self.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
        self.buckets.write.mode("overwrite").parquet(f"{folder}/buckets")
        spark.createDataFrame([(json.dumps(self.normals.tolist()),)], "normals string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/planes")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> VectorIndex:
        importable(spark)
        normals = np.array(json.loads(spark.read.parquet(f"{folder}/planes").first()[0]))
        return cls(spark.read.parquet(f"{folder}/vectors"), normals, spark.read.parquet(f"{folder}/buckets"))
