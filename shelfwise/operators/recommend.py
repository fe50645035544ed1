"""Batch recommendation for a set of users; one user is a one-row input.

A request is described by tables: ``history`` (user_idx, anime_idx, score), ``seen``
(user_idx, anime_idx) and user vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.vectors import dot
from shelfwise.operators import metrics
from shelfwise.operators.splits import POSITIVE_STATUSES
from shelfwise.operators.vectors import SCORE_PLACES, masked_top_k

ADULT_GENRE, ADULT_RATING = "Hentai", "Rx - Hentai"
ANIMELIST_SCHEMA = ("STRUCT<data: ARRAY<STRUCT<node: STRUCT<id: BIGINT, title: STRING>, list_status: STRUCT<"
                    "status: STRING, score: INT, num_episodes_watched: INT, is_rewatching: BOOLEAN, updated_at: STRING, "
                    "start_date: STRING, finish_date: STRING>>>, paging: STRUCT<next: STRING>>")


def stored_history(names: DataFrame, users: DataFrame, split: DataFrame) -> DataFrame:
    """Histories of known usernames; seen is history plus hard negatives."""
    wanted = split.join(names.select("username"), "username", "left_semi").select("username", "user_idx")
    return wanted.join(users, "user_idx").select(
        "username", "user_idx", "history_ids", "history_scores",
        F.array_sort(F.array_union("history_ids", "hard_neg_ids")).alias("seen_ids"))


def list_entries(pages: DataFrame, column: str) -> DataFrame:
    """One row per list entry of nested JSON pages, in page order."""
    parsed = pages.withColumn("_p", F.from_json(column, ANIMELIST_SCHEMA)).drop(column)
    return parsed.withColumn("e", F.explode("_p.data")).drop("_p")


def live_history(pages: DataFrame, column: str, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history, seen) from list pages keyed by username.

    Positives as in training; of repeats the highest score; unknown items are dropped; every known
    item counts as seen whatever its status.
    """
    entries = list_entries(pages, column).select(
        "username", F.col("e.node.id").alias("mal_id"), F.col("e.list_status.status").alias("status"),
        F.coalesce("e.list_status.score", F.lit(0)).alias("score"))
    known = entries.join(items.select("mal_id", "anime_idx"), "mal_id")
    positive = known.where(F.col("status").isin(POSITIVE_STATUSES) & ~F.col("score").between(1, 4))
    best = positive.groupBy("username", "anime_idx").agg(F.max("score").alias("score"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "anime_idx", "score")))
    history = best.groupBy("username").agg(ordered.alias("h")).select(
        "username", F.col("h.anime_idx").alias("history_ids"), F.col("h.score").alias("history_scores"))
    return history, known.select("username", "anime_idx").distinct()


def history_from_ids(requests: DataFrame, ids: str, items: DataFrame) -> DataFrame:
    """Unrated history from a list of natural ids: unknown ids dropped, ascending."""
    long = requests.select("username", F.explode(ids).alias("mal_id")).join(items.select("mal_id", "anime_idx"), "mal_id")
    got = long.groupBy("username").agg(F.array_sort(F.collect_set("anime_idx")).alias("history_ids"))
    none = F.array().cast("array<int>")
    return (requests.select("username").join(got, "username", "left")
            .withColumn("history_ids", F.coalesce("history_ids", none))
            .withColumn("history_scores", F.transform("history_ids", lambda _: F.lit(0))))


def with_exclusions(seen: DataFrame, extra: DataFrame, items: DataFrame) -> DataFrame:
    """Seen plus the (user_idx, mal_id) the caller wants left out."""
    more = extra.join(items.select("mal_id", "anime_idx"), "mal_id").select("user_idx", "anime_idx")
    return seen.select("user_idx", "anime_idx").unionByName(more).distinct()


def is_adult(genres: Column, rating: Column) -> Column:
    return F.coalesce(F.array_contains(genres, ADULT_GENRE), F.lit(False)) | (F.coalesce(rating, F.lit("")) == ADULT_RATING)


def adult_items(items: DataFrame) -> DataFrame:
    return items.where(is_adult(F.col("genres"), F.col("rating"))).select("anime_idx")


def main_list(pool: DataFrame, predictions: DataFrame, alpha: float, top_k: int) -> DataFrame:
    """Re-rank a warm pool by the blend of cosine and prediction; ties to the lower index."""
    scored = pool.join(predictions.select("user_idx", "anime_idx", "pred"), ["user_idx", "anime_idx"])
    if alpha < 1.0:
        scored = metrics.blend(scored, alpha)
    else:
        scored = scored.withColumn("score", F.col("pred"))
    order = Window.partitionBy("user_idx").orderBy(F.desc("score"), "anime_idx")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
            .select("user_idx", "anime_idx", "rank", "score", "cos", "pred"))


def warm_pool(users: DataFrame, items: DataFrame, seen: DataFrame, cold: DataFrame, adult: DataFrame | None,
              k_retrieve: int, top_k: int) -> DataFrame:
    """Warm candidates of depth max(k_retrieve, top_k), adult items left out if given."""
    exclude = cold.select("anime_idx")
    if adult is not None:
        exclude = exclude.unionByName(adult.select("anime_idx"))
    return masked_top_k(users, items, seen, max(k_retrieve, top_k), exclude=exclude)


def cold_list(users: DataFrame, items: DataFrame, seen: DataFrame, cold: DataFrame, k: int,
              adult: DataFrame | None = None) -> DataFrame:
    """Nearest unseen cold items."""
    return masked_top_k(users, items, seen, k, only=cold, exclude=adult)


def similar_pool(requests: DataFrame, users: DataFrame, items: DataFrame, seen: DataFrame, cold: DataFrame, k: int) -> DataFrame:
    """Pool around an anchor item (never itself), with the cosine of user and item.

    ``requests`` is (user_idx, anchor_idx), one per user.
    """
    anchor = (requests.join(items.select(F.col("anime_idx").alias("anchor_idx"), "vec"), "anchor_idx")
              .select("user_idx", "vec"))
    mask = seen.select("user_idx", "anime_idx").unionByName(
        requests.select("user_idx", F.col("anchor_idx").alias("anime_idx"))).distinct()
    near = masked_top_k(anchor, items, mask, k, exclude=cold).withColumnRenamed("cos", "anchor_cos")
    return (near.join(users.select("user_idx", F.col("vec").alias("_u")), "user_idx")
            .join(items.select("anime_idx", F.col("vec").alias("_v")), "anime_idx")
            .withColumn("cos", F.round(dot(F.col("_u"), F.col("_v")), SCORE_PLACES)).drop("_u", "_v"))


ROW_FIELDS = ["mal_id", "title", "type", "year", "mal_score", "popularity", "members", "start_date", "genres", "themes", "studios"]


def enrich(rows: DataFrame, item_index: DataFrame, items: DataFrame) -> DataFrame:
    """Catalogue fields of result rows with the defaults shown to users."""
    none = F.array().cast("array<string>")
    facts = items.select("mal_id", "title", "type", F.year(F.try_to_timestamp("start_date")).alias("year"),
                         F.round("score", 2).alias("mal_score"), "popularity", "members",
                         F.substring("start_date", 1, 10).alias("start_date"), "genres", "themes", "studios")
    return (rows.join(item_index.select("anime_idx", "mal_id"), "anime_idx").join(facts, "mal_id", "left")
            .withColumns({"title": F.coalesce("title", F.lit("?")), "type": F.coalesce("type", F.lit("?")),
                          **{c: F.coalesce(c, none) for c in ("genres", "themes", "studios")}}))


def favourites(history: DataFrame, k: int = 20) -> DataFrame:
    """Up to k items scored above the user's own mean, best first; else the first k of the history.

    ``history`` has user_idx, anime_idx, score and pos.
    """
    rated = F.when(F.col("score") > 0, F.col("score"))
    means = history.groupBy("user_idx").agg(F.avg(rated).alias("_mean"))
    judged = history.join(means, "user_idx").withColumn("_above", F.coalesce(F.col("score") > F.col("_mean"), F.lit(False)))
    some = judged.groupBy("user_idx").agg(F.bool_or("_above").alias("_some"))
    order = Window.partitionBy("user_idx").orderBy(F.desc("score"), "pos")
    return (judged.join(some, "user_idx").where("_above OR NOT _some")
            .withColumn("fav_rank", F.row_number().over(order)).where(F.col("fav_rank") <= k)
            .select("user_idx", "anime_idx", "fav_rank"))


def locate(users: DataFrame, favs: DataFrame, recs: DataFrame, projected: DataFrame, coords: DataFrame) -> DataFrame:
    """Place on the map: centre of the favourites, else of the recommendations, else the projected vector."""
    def centre(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(coords.select("anime_idx", "x", "y"), "anime_idx").groupBy("user_idx").agg(
            F.avg("x").alias(f"{name}_x"), F.avg("y").alias(f"{name}_y"))
    return (users.select("user_idx").join(centre(favs, "f"), "user_idx", "left")
            .join(centre(recs, "r"), "user_idx", "left")
            .join(projected.select("user_idx", F.col("x").alias("p_x"), F.col("y").alias("p_y")), "user_idx", "left")
            .select("user_idx", *[F.round(F.coalesce(f"f_{a}", f"r_{a}", f"p_{a}"), 4).alias(a) for a in ("x", "y")]))


def response_meta(users: DataFrame, history: DataFrame, entries: DataFrame, source: str, alpha: float, k_retrieve: int) -> DataFrame:
    def count(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy("user_idx").agg(F.count("*").alias(out))
    return (users.select("user_idx", "split").join(count(history, "history_count"), "user_idx", "left")
            .join(count(entries, "total_entries"), "user_idx", "left").na.fill(0, ["history_count", "total_entries"])
            .withColumns({"source": F.lit(source), "alpha": F.lit(float(alpha)), "k_retrieve": F.lit(k_retrieve)}))


def history_preview(history: DataFrame, item_index: DataFrame, items: DataFrame, k: int = 5) -> DataFrame:
    """The first k history items with their titles."""
    return enrich(history.where(F.col("pos") < k).select("user_idx", "anime_idx", "score", "pos"), item_index, items)
