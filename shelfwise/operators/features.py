"""Ranking features of (user, candidate) pairs."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import quantiles
from shelfwise.functions.lists import parse_list
from shelfwise.operators import encoding
from shelfwise.operators.vectors import BROADCAST_BYTES, flat_vectors, share_matrix

# Reference year, history cap and the feature order.
REFERENCE_YEAR = 2024
HISTORY_CAP = 256
USER_SHARD = 64
CROSS = ["cos_uv", "pool_rank", "hist_cos_max", "hist_cos_mean", "hist_cos_top5_mean",
         "genre_aff", "theme_aff", "genre_overlap", "score_gap"]
USER = ["u_n_rated", "u_mean_score", "u_std_score", "u_account_age", "support_len"]
ITEM = ["mal_score", "mal_score_missing", "log_scored_by", "log_members", "log_favorites",
        "popularity", "rank", "rank_missing", "episodes", "recency_years"]
CATEGORY = ["type_code", "source_code", "rating_code", "demo_code", "era_code"]
FEATURES = CROSS + USER + ITEM + CATEGORY
_IMPUTED = ["score", "popularity", "rank", "episodes", "year"]


def item_table(item_index: DataFrame, details: DataFrame) -> DataFrame:
    """Catalogue facts of every index row, the special ones included."""
    keep = ["mal_id", "type", "source", "rating", "demographics", "score", "scored_by", "members", "favorites",
            "popularity", "rank", "episodes", "start_date", "genres", "themes"]
    return item_index.join(details.select(*keep), "mal_id", "left")


def cold_policy(items: DataFrame) -> DataFrame:
    """Cold items lose their maturity statistics before anything is imputed."""
    gone = {c: F.when(~F.col("is_cold"), F.col(c)) for c in ("score", "popularity", "rank")}
    zero = {c: F.when(F.col("is_cold"), 0).otherwise(F.col(c)) for c in ("scored_by", "members", "favorites")}
    return items.withColumns({**gone, **zero})


def medians(items: DataFrame, columns: list[str]) -> DataFrame:
    """One row with a struct of exact medians."""
    long = items.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])).alias("e")).select("e.*")
    med = quantiles.interpolated(long, ["name"], "value", {"m": 0.5})
    return med.agg(F.struct(*[F.max(F.when(F.col("name") == c, F.col("m"))).alias(c) for c in columns]).alias("m"))


def numeric_features(items: DataFrame) -> DataFrame:
    """Imputed numbers, their missing flags, log counts and age, after :func:`cold_policy`."""
    dated = items.withColumn("year", encoding.start_year(F.col("start_date")))
    wide = dated.withColumn("_m", medians(dated, _IMPUTED).scalar())

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}"))

    def log_count(c: str) -> Column:
        return F.log1p(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return wide.select(
        "anime_idx", filled("score").alias("mal_score"), F.col("score").isNull().cast("double").alias("mal_score_missing"),
        *[log_count(c).alias(f"log_{c}") for c in ("scored_by", "members", "favorites")],
        filled("popularity").alias("popularity"), filled("rank").alias("rank"),
        F.col("rank").isNull().cast("double").alias("rank_missing"), filled("episodes").alias("episodes"),
        (REFERENCE_YEAR - filled("year")).alias("recency_years"))


def category_codes(items: DataFrame) -> DataFrame:
    """Sorted codes from 1, null 0; demographics are coded on the printed list."""
    df = items.withColumn("demo", F.when(F.col("demographics") != "[]", F.col("demographics")))
    for column in ("type", "source", "rating", "demo"):
        df = encoding.encode(df, column, encoding.vocabulary(df, column), f"{column}_code")
    return df.select("anime_idx", "type_code", "source_code", "rating_code", "demo_code",
                     era_code(F.col("start_date")).alias("era_code"))


def era_code(date: Column) -> Column:
    return encoding.era_bucket(date)


def tag_bits(items: DataFrame) -> DataFrame:
    """Genre and theme 0/1 arrays without the "has any tag" bit."""
    df = items.withColumns({c: parse_list(F.col(c)) for c in ("genres", "themes")})
    df = encoding.multi_hot(df, "genres", "genre_bits", present_bit=False)
    return encoding.multi_hot(df, "themes", "theme_bits", present_bit=False).select("anime_idx", "genre_bits", "theme_bits")


def tag_rows(items: DataFrame) -> DataFrame:
    """(anime_idx, kind, tag) with each tag of an item once."""
    def of_kind(column: str, kind: str) -> Column:
        tags = F.array_distinct(parse_list(F.col(column)))
        return F.transform(tags, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("tag")))
    both = F.concat(of_kind("genres", "genre"), of_kind("themes", "theme"))
    return items.select("anime_idx", F.explode(both).alias("t")).select("anime_idx", "t.*")


def user_stats(users: DataFrame, support: DataFrame) -> DataFrame:
    """Rated count, mean and population deviation of the support scores, and its length; zeros if none."""
    rated = F.when(F.col("score") >= 1, F.col("score"))
    stats = support.groupBy("user_idx").agg(
        F.count(rated).alias("n"), F.avg(rated).alias("mean"), F.stddev_pop(rated).alias("std"), F.count("*").alias("len"))
    zero = F.lit(0.0)
    return users.select("user_idx").join(stats, "user_idx", "left").select(
        "user_idx", F.coalesce(F.col("n").cast("double"), zero).alias("u_n_rated"),
        F.coalesce("mean", zero).alias("u_mean_score"), F.coalesce("std", zero).alias("u_std_score"),
        F.coalesce(F.col("len").cast("double"), zero).alias("support_len"))


def account_age(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Years since joining; unknown stays null."""
    age = (REFERENCE_YEAR - F.col("joined_year")).cast("double")
    return (users.select("user_idx", "username").join(profiles.select("username", age.alias("u_account_age")), "username", "left")
            .select("user_idx", "u_account_age"))


_SIM_SCHEMA = "user_idx int, anime_idx int, hist_cos_max double, hist_cos_mean double, hist_cos_top5_mean double"


def history_similarity(cand: DataFrame, history: DataFrame, items: DataFrame, *, cap: int = HISTORY_CAP,
                       broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Each candidate against the user's first ``cap`` history items: highest, mean and top-5 mean cosine.

    A task gets the candidates and capped histories of 64 users, so pairs exist only inside a
    small matrix product. Ids alone are shuffled while the item matrix is small enough to share;
    otherwise the vectors travel with them. A history item without a vector is passed over, and a
    candidate without one scores zero, whichever way the vectors go.
    """
    shard = F.floor(F.col("user_idx") / USER_SHARD).cast("int").alias("shard")
    known = items.where("vec IS NOT NULL").select("anime_idx")
    left = cand.select(shard, "user_idx", "anime_idx").join(known, "anime_idx", "left_semi")
    right = history.where(F.col("pos") < cap).select(shard, "user_idx", "anime_idx").join(known, "anime_idx", "left_semi")
    items = items.where("vec IS NOT NULL")
    shared = share_matrix(items, broadcast_bytes)
    if shared is None:
        vec = items.select("anime_idx", "vec")
        names = ["anime_idx", "shard", "user_idx", "vec"]         # fresh names keep both sides apart
        left, right = left.join(vec, "anime_idx").toDF(*names), right.join(vec, "anime_idx").toDF(*names)

    def matrix(rows: pa.Table) -> np.ndarray:
        if shared is None:
            return flat_vectors(rows["vec"])
        ids, every = shared.value
        return every[np.searchsorted(ids, rows["anime_idx"].to_numpy())]

    def measure(c: pa.Table, h: pa.Table) -> pa.Table:
        c, h = c.sort_by("user_idx"), h.sort_by("user_idx")
        users, past = c["user_idx"].to_numpy(), h["user_idx"].to_numpy()
        out = np.zeros((3, len(users)))
        cand, hist = (matrix(t) if t.num_rows else None for t in (c, h))
        for user in np.unique(users):
            rows = slice(*np.searchsorted(users, [user, user + 1]))
            seen = slice(*np.searchsorted(past, [user, user + 1]))
            if seen.start < seen.stop:
                sims = cand[rows] @ hist[seen].T
                top = -np.sort(-sims, axis=1)[:, :5]
                out[:, rows] = top[:, 0], sims.mean(axis=1), top.mean(axis=1)
        return pa.table({"user_idx": c["user_idx"], "anime_idx": c["anime_idx"], "hist_cos_max": out[0],
                         "hist_cos_mean": out[1], "hist_cos_top5_mean": out[2]})
    found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(measure, _SIM_SCHEMA)
    blank = cand.join(known, "anime_idx", "left_anti").select(
        "user_idx", "anime_idx", *[F.lit(0.0).alias(c) for c in ("hist_cos_max", "hist_cos_mean", "hist_cos_top5_mean")])
    return found.unionByName(blank)


def user_taste(history: DataFrame, tags: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """Share of a user's capped history that carries each tag."""
    capped = history.where(F.col("pos") < cap).select("user_idx", "anime_idx")
    lens = capped.groupBy("user_idx").agg(F.count("*").alias("_len"))
    counts = capped.join(tags, "anime_idx").groupBy("user_idx", "kind", "tag").agg(F.count("*").alias("_n"))
    return counts.join(lens, "user_idx").select("user_idx", "kind", "tag", (F.col("_n") / F.col("_len")).alias("pref"))


def affinity(cand: DataFrame, taste: DataFrame, tags: DataFrame) -> DataFrame:
    """Genre and theme affinity (sums of taste over the candidate's tags) and how many genres the user knows."""
    pairs = cand.select("user_idx", "anime_idx")
    hits = (pairs.join(tags, "anime_idx").join(taste, ["user_idx", "kind", "tag"])
            .groupBy("user_idx", "anime_idx").agg(
                F.sum(F.when(F.col("kind") == "genre", F.col("pref"))).alias("genre_aff"),
                F.sum(F.when(F.col("kind") == "theme", F.col("pref"))).alias("theme_aff"),
                F.count_if((F.col("kind") == "genre") & (F.col("pref") > 0)).cast("double").alias("genre_overlap")))
    return (pairs.join(hits, ["user_idx", "anime_idx"], "left")
            .na.fill(0.0, ["genre_aff", "theme_aff", "genre_overlap"]))


def score_gap(item_score: Column, user_mean: Column) -> Column:
    return item_score - user_mean


def pool_rank(scored: DataFrame) -> DataFrame:
    """0-based rank of each candidate in its user's pool, cosine first, lower index on ties."""
    order = Window.partitionBy("user_idx").orderBy(F.desc("cos"), "anime_idx")
    return scored.withColumn("pool_rank", F.row_number().over(order) - 1)


def feature_frame(pool: DataFrame, *, sims: DataFrame, aff: DataFrame, stats: DataFrame, ages: DataFrame,
                  numbers: DataFrame, codes: DataFrame) -> DataFrame:
    """The fixed 29 features per (user, candidate)."""
    pair = ["user_idx", "anime_idx"]
    return (pool.select(*pair, F.col("cos").alias("cos_uv"), F.col("pool_rank").cast("double").alias("pool_rank"))
            .join(sims, pair).join(aff, pair)
            .join(stats, "user_idx").join(ages, "user_idx", "left")
            .join(numbers, "anime_idx").join(codes, "anime_idx")
            .withColumn("score_gap", score_gap(F.col("mal_score"), F.col("u_mean_score")))
            .select(*pair, *FEATURES))
