"""Exact order statistics per group that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage

_BINS, _CUTS = 2048, 64
BIN_VALUES = 1 << 20          # most distinct values that one task puts in order


def _holding(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The sub-bins (``_bin``, ``_sub``) that hold a wanted position, with the position their values start at."""
    upto = Window.partitionBy(*keys, "_bin").orderBy("_sub").rowsBetween(Window.unboundedPreceding, 0)
    held = F.filter("_held", lambda q: (q["pos"] >= F.col("_from")) & (q["pos"] < F.col("_end")))
    return (rows.groupBy(*keys, "_bin", "_sub").agg(
                F.sum("_c").alias("_in"), F.count("*").alias("_values"), *[F.first(c).alias(c) for c in ("_n", "_start", "_held")])
            .withColumn("_end", F.col("_start") + F.sum("_in").over(upto)).withColumn("_from", F.col("_end") - F.col("_in"))
            .withColumn("_held", held).where(F.size("_held") > 0)
            .select(*keys, "_bin", "_sub", "_values", "_n", F.col("_from").alias("_start"), "_held"))


def _narrowed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The values of the sub-bins that hold a position, and the size of the largest one."""
    found = stage(_holding(rows, keys), "order-bins")                   # at most a row per group and position
    largest = found.agg(F.coalesce(F.max("_values"), F.lit(0))).first()[0]
    inside = (rows.select(*keys, "_bin", "_sub", "_v", "_c").join(found, [*keys, "_bin", "_sub"])
              .withColumn("_bin", F.concat_ws(".", "_bin", "_sub")).drop("_sub"))
    return inside, largest


def order_statistics(df: DataFrame, by: list[str], value: str,
                     ranks: dict[str, Column], bin_values: int = BIN_VALUES) -> DataFrame:
    """The elements at given 0-based positions of each group's sorted non-null values.

    ``ranks`` maps an output name to an expression over the group size ``_n``, which is kept. Equal values are
    counted first (map side); a histogram of at most 2049 bins per group then shows which bin holds a position. While
    such a bin has more than ``bin_values`` distinct values, as when outliers press all others together, it is cut again
    at its own approximate percentiles, so a round divides it by about 64. Only then are its values put in order.
    """
    keys = by
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")))
    # a monotone scale that keeps long tails from pressing everything else into one bin
    scaled = F.signum("_v") * F.log1p(F.abs("_v"))
    bounds = counted.groupBy(*keys).agg(
        F.min(scaled).alias("_lo"), F.max(scaled).alias("_hi"), F.sum("_c").alias("_n"))
    share = (scaled - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    if by:
        bounded = counted.join(bounds, keys)
    else:                                           # one row of bounds enters as a value, not as a join
        bounded = counted.withColumn("_b", bounds.select(F.struct("*")).scalar()).select("_v", "_c", "_b.*")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("pos")) for name, rank in ranks.items()])
    binned = bounded.select(
        *keys, "_v", "_c", "_n", F.lit("").alias("_bin"), F.lit(0).cast("bigint").alias("_start"), wanted.alias("_held"),
        F.when(F.col("_hi") > F.col("_lo"), F.floor(share * _BINS)).otherwise(0).cast("int").alias("_sub"))
    inside, largest = _narrowed(binned, keys)
    ready = []
    while largest > bin_values:
        inside = stage(inside, "order-values")
        ready.append(inside.where(F.col("_values") <= bin_values))
        heavy = inside.where(F.col("_values") > bin_values)
        steps = F.array(*[F.lit(i / _CUTS) for i in range(1, _CUTS)])
        cuts = heavy.groupBy(*keys, "_bin").agg(F.percentile_approx("_v", steps, F.lit(10_000)).alias("_cuts"))
        cut = heavy.join(cuts, [*keys, "_bin"]).withColumn("_sub", F.size(F.filter("_cuts", lambda c: c <= F.col("_v"))))
        inside, largest = _narrowed(cut, keys)
    for more in ready:
        inside = inside.unionByName(more)
    in_bin = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (inside.withColumn("_upto", F.col("_start") + F.sum("_c").over(in_bin))
              .withColumn("_want", F.explode("_held"))
              .where((F.col("_want.pos") < F.col("_upto")) & (F.col("_want.pos") >= F.col("_upto") - F.col("_c"))))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_want.name") == n, F.col("_v"))).alias(n) for n in ranks], F.max("_n").alias("_n"))


def interpolated(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles (0.5 is the usual median) of each group, exact."""
    ranks: dict[str, Column] = {}
    for name, p in ps.items():
        at = (F.col("_n") - 1).cast("double") * F.lit(p)
        ranks[f"{name}__lo"] = F.floor(at)
        ranks[f"{name}__hi"] = F.ceil(at)
    stats = order_statistics(df, by, value, ranks)
    outs = []
    for name, p in ps.items():
        at = (F.col("_n") - 1).cast("double") * F.lit(p)
        frac = at - F.floor(at)
        outs.append((F.col(f"{name}__lo") + frac * (F.col(f"{name}__hi") - F.col(f"{name}__lo"))).alias(name))
    return stats.select(*by, *outs)


def nearest_rank(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """The element at position ``round((n-1)p)``, halves away from zero."""
    return order_statistics(df, by, value, {
        name: F.floor((F.col("_n") - 1).cast("double") * F.lit(p) + F.lit(0.5)) for name, p in ps.items()}).drop("_n")
