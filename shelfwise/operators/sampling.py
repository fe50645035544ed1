"""Tables that feed a sampled-softmax trainer; every draw is a hash of its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.keys import hash_u32, hash_unit


def popularity_prior(item_index: DataFrame, train_examples: DataFrame) -> DataFrame:
    """log(max(count, 1) / total) for every real item, -inf for the special rows."""
    counts = train_examples.groupBy("anime_idx").agg(F.count("*").alias("count"))
    total = train_examples.agg(F.count("*")).scalar()
    real = F.col("anime_idx") >= 2
    n = F.coalesce("count", F.lit(0)).cast("bigint")
    return (item_index.select("anime_idx").join(counts, "anime_idx", "left")
            .select("anime_idx", n.alias("count"), real.alias("is_candidate"),
                    F.when(real, F.log(F.greatest(n, F.lit(1)) / total))
                    .otherwise(F.lit(float("-inf"))).alias("log_q")))


def keep_user_fraction(examples: DataFrame, fraction: float, seed: int) -> DataFrame:
    """All examples of a hash-chosen share of users."""
    return examples.where(hash_unit(seed, F.col("user_idx")) < fraction)


def cap_per_user(examples: DataFrame, cap: int, seed: int, epoch: int) -> DataFrame:
    """At most ``cap`` examples per user, drawn anew for each epoch."""
    order = Window.partitionBy("user_idx").orderBy(
        hash_u32(seed, epoch, F.col("user_idx"), F.col("anime_idx")), "anime_idx")
    return examples.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).drop("_r")


def _padded(arr: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.get(arr, i), F.lit(0)))


def history_prefix(users: DataFrame, width: int) -> DataFrame:
    """The first ``width`` history entries, padded with 0, and which places are real."""
    n = F.least(F.size("history_ids"), F.lit(width))
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return users.select("user_idx", _padded(F.col("history_ids"), width).alias("ids"),
                        _padded(F.col("history_scores"), width).alias("scores"),
                        F.transform(places, lambda i: i < n).alias("mask"))


def anchor_history(examples: DataFrame, users: DataFrame, length: int, dropout: float, seed: int) -> DataFrame:
    """Per example: a history sample without the example itself, or an empty one for a dropped share.

    A short history is taken whole and padded; a long one is sampled with replacement.
    """
    n = F.size("history_ids")
    key = (F.col("user_idx"), F.col("anime_idx"))
    rows = examples.select("user_idx", "anime_idx").join(users.select("user_idx", "history_ids"), "user_idx")
    places = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(
        n > length, F.floor(hash_unit(seed, *key, i) * n).cast("int")).otherwise(i))
    ids = rows.withColumn("_places", places).withColumn(
        "ids", F.transform("_places", lambda p: F.coalesce(F.get("history_ids", p), F.lit(0))))
    kept = hash_unit(seed, "drop", *key) >= dropout
    real = F.transform("ids", lambda a: (a != F.col("anime_idx")) & (a != 0))
    mask = F.when(kept, real).otherwise(F.transform("ids", lambda _: F.lit(False)))       # one draw a row, not one an entry
    return ids.select("user_idx", "anime_idx", "ids", mask.alias("mask"))


def anchor_hard_negatives(examples: DataFrame, users: DataFrame, m: int, seed: int) -> DataFrame:
    """Per example: ``m`` distinct hard negatives of its user, padded with 0, and which are real."""
    rows = examples.select("user_idx", "anime_idx").join(users.select("user_idx", "hard_neg_ids"), "user_idx")
    keyed = F.array_sort(F.transform("hard_neg_ids", lambda h: F.struct(
        hash_u32(seed, F.col("user_idx"), F.col("anime_idx"), h).alias("k"), h.alias("id"))))
    drawn = rows.withColumn("_drawn", F.slice(keyed, 1, m)["id"]).withColumn("_n", F.size("_drawn"))
    return drawn.select("user_idx", "anime_idx", _padded(F.col("_drawn"), m).alias("hard_neg_ids"),
                        F.transform(F.sequence(F.lit(0), F.lit(m - 1)),
                                    lambda i: i < F.col("_n")).alias("mask"))
