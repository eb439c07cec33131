"""Rolling z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAST = 10


def scores(rows: DataFrame, window: int) -> DataFrame:
    """rows(id, source, ts, cents) with n and z, |value - mean| / deviation over the source's last `window` readings, this one included.

    Sums are of whole hundredths, so the result doesn't depend on the order of addition.
    """
    own = Window.partitionBy("source").orderBy("ts", "id").rowsBetween(-(window - 1), 0)
    c = F.col("cents")
    out = rows.select("*", F.count(F.lit(1)).over(own).alias("n"), F.sum(c).over(own).alias("s"), F.sum(c * c).over(own).alias("q"))
    spread = F.col("n") * F.col("q") - F.col("s") * F.col("s")
    return out.where((F.col("n") >= LEAST) & (spread > 0)).withColumn("z", F.round(F.abs(c * F.col("n") - F.col("s")) / F.sqrt(spread.cast("double")), 4)).drop("s", "q")
