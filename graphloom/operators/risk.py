"""Risk scores and ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lower ends of the levels.
LEVELS = ((9, "critical"), (7, "high"), (5, "medium"), (3, "low"))


def weighted(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """rows with score: the weighted mean of the factors that are present."""
    top = sum((F.coalesce(F.col(f) * w, F.lit(0)) for f, w in weights.items()), F.lit(0))
    bottom = sum((F.when(F.col(f).isNotNull(), w).otherwise(0) for f, w in weights.items()), F.lit(0))
    return rows.withColumn("score", top / F.nullif(bottom.cast("double"), F.lit(0.0)))


def level(score: Column) -> Column:
    out = F.lit("minimal")
    for low, name in reversed(LEVELS):
        out = F.when(score >= low, name).otherwise(out)
    return out


def ownership(shares: DataFrame) -> DataFrame:
    """owned, risk: 7 if the shares are more than ten points off a whole, 6 for more than five owners, else 1."""
    rows = shares.groupBy("owned").agg(F.count(F.lit(1)).alias("n"), (F.sum("quantity") * 100 / F.max("total").cast("double")).alias("percent"))
    return rows.select("owned", F.when(F.abs(F.col("percent") - 100) > 10, 7).when(F.col("n") > 5, 6).otherwise(1).alias("risk"))


def trend(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, trend of the last three values: rising, falling or mixed."""
    own = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    ranked = rows.withColumn("n", F.row_number().over(own)).where(F.col("n") <= 3)
    last = ranked.groupBy(key).agg(*[F.max(F.when(F.col("n") == i, F.col(value))).alias(f"v{i}") for i in (1, 2, 3)])
    return last.where("v3 is not null").select(key, F.when((F.col("v1") > F.col("v2")) & (F.col("v2") > F.col("v3")), "rising").when((F.col("v1") < F.col("v2")) & (F.col("v2") < F.col("v3")), "falling").otherwise("mixed").alias("trend"))
