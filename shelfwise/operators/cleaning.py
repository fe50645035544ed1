"""Cleaning and profiling of a rating log (username, anime_id, status, score, order key)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import quantiles
from shelfwise.functions.staging import discard, stage

# Columns dropped from each raw table.
DETAILS_DROP = ["title_japanese", "url", "image_url", "end_date", "year", "season", "producers",
                "explicit_genres", "licensors", "streaming"]
PROFILES_DROP = ["location", "watching", "completed", "on_hold", "dropped", "plan_to_watch"]
RATINGS_DROP = ["is_rewatching", "num_watched_episodes"]
# Columns whose empty value is the text "[]".
LIST_COLUMNS = ["genres", "studios", "themes", "demographics", "producers"]


@dataclass(frozen=True)
class BotRules:
    """Fixed thresholds of the four bot rules."""
    spam_count: int = 2000
    spam_mean: float = 9.0
    const_count: int = 500
    const_std: float = 0.3
    watched_max: int = 5000
    unrated_min_watched: int = 1000


RULE_NAMES = ["spam_pos", "const_rater", "physical", "nan_lister"]


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def known_status(ratings: DataFrame) -> DataFrame:
    return ratings.where(F.col("status") != "unknown")


def drop_orphans(ratings: DataFrame, profiles: DataFrame, details: DataFrame) -> DataFrame:
    """Keep ratings whose user and item both exist. Spark broadcasts the catalogue only while it is small."""
    items = details.select(F.col("mal_id").alias("anime_id"))
    return known_users(ratings.join(items, "anime_id", "left_semi"), profiles)


def known_users(ratings: DataFrame, profiles: DataFrame) -> DataFrame:
    return ratings.join(profiles.select("username"), "username", "left_semi")


def keep_last(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key. A rank with a limit of one, which each task applies before the shuffle.

    A row without an order value comes before all others; equal ones are told apart by the other columns.
    """
    rest = [c for c in log.columns if c not in keys and c != order]
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in rest])
    return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").select(*keys, *rest)


def clean_ratings(ratings: DataFrame, profiles: DataFrame, details: DataFrame) -> DataFrame:
    """The last row of every user and item that exist.

    Items are looked up last: by then a key is one row without its order value, so few bytes are shuffled. An orphan's
    rows are whole keys, so it does not matter when they go. An inner join stays there; a semi join would be moved to
    the widest rows.
    """
    last = keep_last(known_users(known_status(ratings), profiles), ["username", "anime_id"], "ord")
    return last.join(details.select(F.col("mal_id").alias("anime_id")).distinct(), "anime_id")


def snapshot(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.count("*").alias("n_ratings"), F.count_distinct("username").alias("n_users"),
                       F.count_distinct("anime_id").alias("n_items"))


def value_counts(df: DataFrame, *columns: str, out: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(out))


def score_histogram(ratings: DataFrame) -> DataFrame:
    return value_counts(ratings.where("score > 0"), "score").orderBy("score")


def user_stats(ratings: DataFrame) -> DataFrame:
    """Per user: rows, rows not merely planned, rated rows, mean and sample deviation of ratings."""
    rated = F.when(F.col("score") > 0, F.col("score"))
    return ratings.groupBy("username").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") != "plan_to_watch").alias("watched"),
        F.count(rated).alias("rated"), F.avg(rated).alias("mean_score"),
        F.stddev_samp(rated).alias("std_score"))


def bot_rules(stats: DataFrame, rules: BotRules = BotRules()) -> DataFrame:
    """One three-valued flag per rule: a missing deviation leaves the other rules in force."""
    flags = {
        "spam_pos": (F.col("rated") > rules.spam_count) & (F.col("mean_score") > rules.spam_mean),
        "const_rater": (F.col("rated") > rules.const_count) & (F.col("std_score") < rules.const_std),
        "physical": F.col("watched") > rules.watched_max,
        "nan_lister": (F.col("watched") > rules.unrated_min_watched) & F.col("mean_score").isNull(),
    }
    return stats.withColumns(flags).withColumn("flagged", _any(RULE_NAMES))


def _any(names: list[str]) -> Column:
    cond = F.col(names[0])
    for n in names[1:]:
        cond = cond | F.col(n)
    return cond


def rule_contribution(flagged: DataFrame) -> DataFrame:
    """Users caught by each rule, and by that rule alone (an unknown other rule counts as not alone)."""
    aggs = []
    for name in RULE_NAMES:
        alone = F.col(name) & ~_any([n for n in RULE_NAMES if n != name])
        aggs += [F.count_if(name).alias(f"{name}_total"), F.count_if(alone).alias(f"{name}_exclusive")]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_total").alias("total"),
                              F.col(f"{n}_exclusive").alias("exclusive")) for n in RULE_NAMES])
    return flagged.agg(*aggs).select(F.inline(rows))


def top_flagged(flagged: DataFrame, k: int = 20) -> DataFrame:
    return flagged.where("flagged").orderBy(F.desc("watched"), "username").limit(k)


def without_users(ratings: DataFrame, users: DataFrame) -> DataFrame:
    return ratings.join(users.select("username"), "username", "left_anti")


def k_core(pairs: DataFrame, user_min: int = 10, item_min: int = 20, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(users, items) of the largest part in which every user has ``user_min`` pairs and every item ``item_min``.

    Degrees are counted once. A round drops the keys that have fallen below their minimum and takes their pairs
    off the other side's degrees; it reads only the hash buckets that hold a dropped key, and goes on, however many
    rounds that takes, until neither side drops any. Pairs lie in two copies, by user and by item; a round writes
    degrees alone. At most ``buckets`` numbers a round reach the driver.
    """
    sides = {"username": ("anime_id", user_min), "anime_id": ("username", item_min)}

    def bucket(key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")

    by = {key: stage(pairs.select(key, other, bucket(key)).hint("rebalance", "bucket"), f"kcore-by-{key}", partition_by=["bucket"])
          for key, (other, _) in sides.items()}
    degree = {key: stage(value_counts(by[key], key), "kcore-degrees") for key in sides}
    quiet = 0
    while quiet < 2:
        for key, (other, least) in sides.items():
            dropped = stage(degree[key].where(F.col("n") < least).select(key), "kcore-dropped")
            touched = [r[0] for r in dropped.select(bucket(key)).distinct().collect()]
            if not touched:
                quiet += 1
                if quiet >= 2:
                    break
                continue
            quiet = 0
            lost = by[key].where(F.col("bucket").isin(touched)).join(dropped, key, "left_semi").groupBy(other).agg(F.count("*").alias("lost"))
            live = degree[key].where(F.col("n") >= least)
            left = degree[other].join(lost, other, "left").select(other, (F.col("n") - F.coalesce("lost", F.lit(0))).alias("n"))
            old = degree
            degree = {key: stage(live, "kcore-degrees"), other: stage(left, "kcore-degrees")}
            discard(dropped, *old.values())
    discard(*by.values())
    return degree["username"].select("username"), degree["anime_id"].select("anime_id")


def restrict(ratings: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    return ratings.join(items, "anime_id", "left_semi").join(users, "username", "left_semi")


def _empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit("[]")) == "[]"


def missing_percent(df: DataFrame) -> DataFrame:
    """Share of missing values per column; ``[]`` is missing in a list column. One pass, one row per column."""
    def pct(c: str) -> Column:
        gone = _empty(c) if c in LIST_COLUMNS else F.col(c).isNull()
        return F.round(F.avg(gone.cast("int")) * 100, 2)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_pct")) for c in df.columns])
    return df.agg(*[pct(c).alias(c) for c in df.columns]).select(F.inline(rows))


REPORT_METRICS = ["n_users_profiles", "n_users_ratings", "n_anime_details", "n_anime_ratings",
                  "n_ratings", "sparsity", "mean_per_user", "mean_per_anime"]


def _report_side(ratings: DataFrame, profiles: DataFrame, details: DataFrame, side: str) -> DataFrame:
    one = (snapshot(ratings)
           .withColumn("p", profiles.agg(F.count("*")).scalar())
           .withColumn("d", details.agg(F.count("*")).scalar()))
    n, u, i = (F.col(c).cast("double") for c in ("n_ratings", "n_users", "n_items"))
    values = [F.col("p"), u, F.col("d"), i, n, 1 - n / (u * i), n / u, n / i]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias(side))
                     for m, v in zip(REPORT_METRICS, values)])
    return one.select(F.inline(rows))


def before_after(before: tuple, after: tuple) -> DataFrame:
    """Table sizes, sparsity and means before and after cleaning, with the change in percent."""
    b, a = _report_side(*before, "before"), _report_side(*after, "after")
    delta = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100)
    return b.join(a, "metric").withColumn("delta_pct", delta)


def empty_list_audit(details: DataFrame, columns: list[str]) -> DataFrame:
    """Null share and ``[]`` share of each list column, separately."""
    aggs = []
    for c in columns:
        aggs += [(F.avg(F.col(c).isNull().cast("int")) * 100).alias(f"{c}_null"),
                 (F.avg(F.coalesce(F.col(c) == "[]", F.lit(False)).cast("int")) * 100).alias(f"{c}_empty")]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}_null").alias("pct_null"),
                              F.col(f"{c}_empty").alias("pct_empty"),
                              (F.col(f"{c}_null") + F.col(f"{c}_empty")).alias("pct_missing")) for c in columns])
    return details.agg(*aggs).select(F.inline(rows))


def empty_by_type(details: DataFrame, columns: list[str]) -> DataFrame:
    return details.where(F.col("type").isNotNull()).groupBy("type").agg(
        *[F.round(F.avg(_empty(c).cast("int")) * 100, 1).alias(f"{c}_empty") for c in columns],
        F.count("*").alias("n_anime")).orderBy(F.desc("n_anime"), "type")


def empty_vs_full_members(details: DataFrame, columns: list[str]) -> DataFrame:
    """Median members of items with an empty and with a filled list, per list column."""
    long = details.select("members", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _empty(c).alias("is_empty")) for c in columns])).alias("e")
    ).select("members", "e.*")
    med = quantiles.interpolated(long, ["column_name", "is_empty"], "members", {"med": 0.5})
    wide = med.groupBy("column_name").agg(
        F.max(F.when(F.col("is_empty"), F.col("med"))).alias("median_empty"),
        F.max(F.when(~F.col("is_empty"), F.col("med"))).alias("median_full"))
    return wide.withColumn("ratio", F.when(F.col("median_empty") != 0, F.col("median_full") / F.col("median_empty")))


def count_percentiles(stats: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """Nearest-rank percentiles and the maximum of a per-user count, in long form."""
    named = {f"p{p:g}".replace(".", "_"): p / 100 for p in percents}
    wide = quantiles.nearest_rank(stats, [], column, {**named, "max": 1.0})
    rows = F.array(*[F.struct(F.lit(n).alias("stat"), F.col(n).cast("bigint").alias("value"))
                     for n in [*named, "max"]])
    return wide.select(F.inline(rows))


def users_above(stats: DataFrame, column: str, thresholds: list[int]) -> DataFrame:
    aggs = [F.count_if(F.col(column) > t).alias(f"t{t}") for t in thresholds]
    rows = F.array(*[F.struct(F.lit(t).cast("bigint").alias("threshold"), F.col(f"t{t}").alias("n_users"))
                     for t in thresholds])
    return stats.agg(*aggs).select(F.inline(rows))
