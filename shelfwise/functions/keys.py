"""Deterministic pseudo-random keys and dense surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 16       # split points between those that are compared first


def hash_u32(*parts: Column | int | str) -> Column:
    """32-bit key from the md5 of the colon-joined parts: same value in every run and partitioning."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts: Column | int | str) -> Column:
    """The same key scaled to [0, 1)."""
    return hash_u32(*parts).cast("double") / F.lit(4294967296.0)


def _by_sample(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Tag any key with an order-preserving bucket cut at points of a fixed-size sample.

    The sample is the keys whose hash divides by n / (64 * buckets): some 64 per bucket however
    many keys there are, and the same ones whenever the job (or a lost task) is run again.
    """
    every = F.greatest(F.floor(df.agg(F.count("*")).scalar() / F.lit(64 * buckets)), F.lit(1))
    sample = df.select(key).where(F.pmod(F.xxhash64(key), every) == 0)
    ordered = sample.agg(F.array_sort(F.collect_list(key)).alias("k"))
    step = F.greatest(F.floor(F.size("k") / F.lit(buckets)), F.lit(1))
    points = ordered.select(F.struct(F.filter("k", lambda _, i: i % step == 0).alias("every"),
                                     F.filter("k", lambda _, i: i % (step * STEP) == 0).alias("coarse"))).scalar()

    def up_to(splits: Column) -> Column:
        return F.size(F.filter(splits, lambda s: s <= F.col(key)))
    # two steps of some 16 comparisons each find a key's place among 256 points
    fine = up_to(F.slice("_points.every", (F.col("_coarse") - 1) * STEP + 1, STEP))
    return (df.withColumn("_points", points).withColumn("_coarse", up_to(F.col("_points.coarse")))
            .withColumn("_bucket", F.when(F.col("_coarse") == 0, 0).otherwise((F.col("_coarse") - 1) * STEP + fine))
            .drop("_points", "_coarse"))


def dense_index(df: DataFrame, key: str, out: str, *, start: int = 0, buckets: int = 256) -> DataFrame:
    """Number unique keys ``start, start+1, ...`` in key order without a single-task sort.

    Keys fall into order-preserving buckets; each bucket is ranked on its own and shifted by
    the size of the buckets below it (a table of at most ``buckets`` + 1 rows). A null key is no
    key: its rows are left out and shift no other id.
    """
    tagged = _by_sample(df.where(F.col(key).isNotNull()), key, buckets)
    below = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(key))
    return (tagged.withColumn("_rank", rank)
            .join(F.broadcast(offsets), "_bucket")       # at most buckets + 1 rows
            .withColumn(out, (F.col("_rank") - 1 + F.col("_offset") + start).cast("int"))
            .drop("_bucket", "_rank", "_offset"))
