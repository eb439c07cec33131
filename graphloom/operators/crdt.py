"""Replicated sets and registers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def present(adds: DataFrame, removed_tags: DataFrame) -> DataFrame:
    """Elements with an add tag that wasn't removed."""
    return adds.join(removed_tags, "tag", "left_anti").select("element").distinct()


#: Bits that an element sets in a Bloom filter.
HASHES = 5


def _places(bits: int):
    return F.array(*[F.pmod(F.xxhash64("hash", F.lit(i)), F.lit(bits)) for i in range(HASHES)])


def bloom_filter(elements: DataFrame, bits: int) -> DataFrame:
    """bucket, bitmap: a Bloom filter of elements(hash) as bitmaps of 32,768 bits each, all that a peer has to send."""
    places = elements.select(F.explode(_places(bits)).alias("p"))
    return places.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bitmap"))


def missing(own: DataFrame, bloom: DataFrame, bits: int, theirs: DataFrame | None = None) -> DataFrame:
    """hash of our elements that a peer's filter doesn't hold; with theirs, those that it holds falsely, too.

    An element with a bit that isn't set is missing for sure; only the others are compared with theirs.
    """
    asked = own.select("hash").distinct().select("hash", F.explode(_places(bits)).alias("p"))
    at = asked.select("hash", F.bitmap_bucket_number(F.col("p") + 1).alias("bucket"), F.bitmap_bit_position(F.col("p") + 1).alias("at"))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.expr("1") * F.floor(byte / F.pow(F.lit(2), F.col("at") % 8)).cast("int") % 2, F.lit(0))
    seen = at.join(bloom, "bucket", "left").groupBy("hash").agg(F.min(bit).alias("held"))
    if theirs is None:
        return seen.where("held = 0").select("hash")
    return seen.where("held = 0").select("hash").unionByName(seen.where("held = 1").select("hash").join(theirs.select("hash"), "hash", "left_anti"))


def last_write(rows: DataFrame) -> DataFrame:
    """id and the node that wrote last; of equal times the higher node."""
    return rows.groupBy("id").agg(F.max_by("node", F.struct("ts", "node")).alias("winner"))
