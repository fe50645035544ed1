"""Labelled ranking pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.keys import dense_index

PAIR = ["user_idx", "anime_idx"]
TOP_HISTORY = 64


def grade(score: Column) -> Column:
    return F.when(score >= 10, 4).when(score >= 9, 3).when(score >= 7, 2).otherwise(1)


def steep_grade(score: Column) -> Column:
    return F.when(score >= 10, 5).when(score >= 9, 4).when(score >= 8, 3).when(score >= 7, 2).otherwise(1)


def eval_mask(seen: DataFrame, queries: DataFrame) -> DataFrame:
    """Seen items of the query users except the queries being scored."""
    mine = seen.select(*PAIR).join(queries.select("user_idx"), "user_idx", "left_semi")
    return mine.join(queries.select(*PAIR), PAIR, "left_anti")


def train_mask(support: DataFrame, hard: DataFrame) -> DataFrame:
    return support.select(*PAIR).unionByName(hard.select(*PAIR)).distinct()


def label_train(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """Grade and raw score of candidates that are targets, 0 for the rest."""
    t = targets.select(*PAIR, F.col("score").alias("target_score"), grade(F.col("score")).alias("label"))
    return pool.join(t, PAIR, "left").na.fill(0, ["target_score", "label"])


def keep_positive_groups(pool: DataFrame) -> DataFrame:
    """Drop groups without any positive candidate."""
    good = pool.where("label > 0").select("user_idx").distinct()
    return pool.join(good, "user_idx", "left_semi")


def dropped_groups(pool: DataFrame) -> DataFrame:
    per = pool.groupBy("user_idx").agg(F.max("label").alias("m"))
    return per.agg(F.count("*").alias("n_in"), F.count_if(F.col("m") > 0).alias("n_kept"),
                   F.count_if(F.col("m") <= 0).alias("n_dropped"))


def liked_queries(queries: DataFrame, stats: DataFrame) -> DataFrame:
    """Queries scored above the user's own mean; none for a user without rated support."""
    s = stats.where("u_n_rated > 0").select("user_idx", "u_mean_score")
    return queries.join(s, "user_idx").where("score >= 1 AND score > u_mean_score").select(*PAIR)


def label_eval(pool: DataFrame, queries: DataFrame, liked: DataFrame) -> DataFrame:
    q = queries.select(*PAIR, F.lit(1).alias("label"))
    k = liked.select(*PAIR, F.lit(1).alias("label_liked"))
    return pool.join(q, PAIR, "left").join(k, PAIR, "left").na.fill(0, ["label", "label_liked"])


def query_totals(queries: DataFrame, liked: DataFrame) -> DataFrame:
    """Query and liked-query counts per user, in or out of the pool."""
    r = queries.groupBy("user_idx").agg(F.count("*").alias("r_total"))
    k = liked.groupBy("user_idx").agg(F.count("*").alias("r_liked"))
    return r.join(k, "user_idx", "left").na.fill(0, ["r_liked"])


def relabel(pool: DataFrame, mode: str) -> DataFrame:
    """``default`` keeps the grades, ``steep`` spreads the head, ``liked`` adds one above the user's mean."""
    if mode == "default":
        new = F.col("label")
    elif mode == "steep":
        new = steep_grade(F.col("target_score"))
    elif mode == "liked":
        new = grade(F.col("target_score")) + (F.col("target_score") > F.col("u_mean_score")).cast("int")
    else:
        raise ValueError(f"unknown relabel mode {mode!r}")
    return pool.withColumn("label", F.when(F.col("label") > 0, new).otherwise(0))


def group_ids(pool: DataFrame) -> DataFrame:
    """Dense group ids from 0 in user order."""
    return dense_index(pool.select("user_idx").distinct(), "user_idx", "qid")


def group_side_table(ids: DataFrame, totals: DataFrame, history: DataFrame, cap: int = TOP_HISTORY) -> DataFrame:
    """Per group: id, query counts and the first 64 history items."""
    top = (history.where(F.col("pos") < cap).groupBy("user_idx")
           .agg(F.array_sort(F.collect_list(F.struct("pos", "anime_idx"))).alias("h"))
           .select("user_idx", F.col("h.anime_idx").alias("hist_top64")))
    return (ids.join(totals, "user_idx").join(top, "user_idx", "left")
            .withColumn("hist_top64", F.coalesce("hist_top64", F.array().cast("array<int>"))))


def dataset_meta(pool: DataFrame) -> DataFrame:
    """Groups, drop rate, positive rate and grade counts of a labelled train pool, as (name, value)."""
    d = dropped_groups(pool)
    kept = keep_positive_groups(pool)
    rows = kept.agg(F.count("*").alias("rows"), F.avg((F.col("label") > 0).cast("int")).alias("pos_rate"),
                    *[F.count_if(F.col("label") == g).alias(f"grade_{g}") for g in range(5)])
    one = rows.withColumns({"n_in": d.select("n_in").scalar(), "n_kept": d.select("n_kept").scalar()})
    names = ["n_in", "n_kept", "rows", *[f"grade_{g}" for g in range(5)]]
    pairs = [(n, F.col(n).cast("double")) for n in names]
    pairs += [("drop_rate", F.round(1 - F.col("n_kept") / F.col("n_in"), 4)), ("pos_rate", F.round("pos_rate", 4))]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in pairs])))


def at_depth(pool: DataFrame, k: int) -> DataFrame:
    return pool.where(F.col("pool_rank") < k)
