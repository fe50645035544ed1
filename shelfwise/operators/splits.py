"""Labels, user splits, leak-free histories and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import quantiles
from shelfwise.functions.keys import dense_index, hash_u32

# Labels and protocol.
SEED = 42
POSITIVE_STATUSES = ["completed", "watching"]
EVAL_MIN_POSITIVES = 11
QUERY_FRACTION = 0.2
HARD_NEGATIVE_CAP = 64


def is_positive() -> Column:
    score = F.col("score").cast("bigint")
    return F.col("status").isin(POSITIVE_STATUSES) & ~score.between(1, 4)


def is_hard_negative() -> Column:
    return (F.col("status") == "dropped") | F.col("score").cast("bigint").between(1, 4)


def label_counts(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("username").agg(F.count_if(is_positive()).alias("n_pos"),
                                           F.count_if(is_hard_negative()).alias("n_hardneg"))


def eligibility(counts: DataFrame, min_positives: int = EVAL_MIN_POSITIVES) -> DataFrame:
    return counts.agg(
        F.count("*").alias("n_users"), F.count_if(F.col("n_pos") == 0).alias("n_zero"),
        F.count_if(F.col("n_pos") >= 1).alias("n_keep"),
        F.count_if(F.col("n_pos") >= min_positives).alias("n_eval"),
        F.sum("n_pos").alias("total_pos"), F.sum("n_hardneg").alias("total_hardneg"))


def assign_split(counts: DataFrame) -> DataFrame:
    """90/5/5 by user hash; users with few positives always train; users with none are dropped."""
    slot = hash_u32(F.col("username"), SEED) % 100
    split = (F.when((F.col("n_pos") < EVAL_MIN_POSITIVES) | (slot < 90), "train")
             .when(slot < 95, "val").otherwise("test"))
    return counts.where("n_pos >= 1").withColumn("split", split)


def index_users(split: DataFrame) -> DataFrame:
    """Dense user index from 0 in username order."""
    return dense_index(split, "username", "user_idx")


def interactions(ratings: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Positives and hard negatives of all users, and every row of validation and test users, by index."""
    labelled = ratings.select("username", F.col("anime_id").alias("mal_id"), F.col("score").cast("int").alias("score"),
                              F.coalesce(is_positive(), F.lit(False)).alias("is_pos"),
                              F.coalesce(is_hard_negative(), F.lit(False)).alias("is_hardneg"))
    # users first: their split decides which rows go on to meet the items, and those carry no name
    return (labelled.join(users.select("username", "user_idx", "split"), "username")
            .where(F.col("is_pos") | F.col("is_hardneg") | (F.col("split") != "train")).drop("username")
            .join(items.select("mal_id", "anime_idx"), "mal_id")
            .select("user_idx", "anime_idx", "is_pos", "is_hardneg", "score", "split"))


def seen_sets(base: DataFrame) -> DataFrame:
    """Every item an evaluation user has listed. At most one entry per catalogue item."""
    return (base.where("split <> 'train'").groupBy("user_idx")
            .agg(F.array_sort(F.collect_set("anime_idx")).alias("seen_ids")))


def cold_queries(base: DataFrame, cold: DataFrame) -> DataFrame:
    """Evaluation users' positives on cold items, in their own splits."""
    return (base.where("is_pos AND split <> 'train'").join(cold.select("anime_idx"), "anime_idx", "left_semi")
            .select("user_idx", "anime_idx", "score", F.concat("split", F.lit("_cold")).alias("split")))


def warm_positives(base: DataFrame, cold: DataFrame) -> DataFrame:
    """Positives on warm items with a random tie key, its rank in the user and the user's warm count."""
    by_user = Window.partitionBy("user_idx")
    tie = hash_u32(SEED, F.col("user_idx"), F.col("anime_idx"))
    return (base.where("is_pos").join(cold.select("anime_idx"), "anime_idx", "left_anti")
            .select("user_idx", "anime_idx", "score", "split", tie.alias("tie"))
            .withColumn("tie_rank", F.row_number().over(by_user.orderBy("tie", "anime_idx")))
            .withColumn("n_warm", F.count("*").over(by_user)))


def mark_queries(warm: DataFrame, fraction: float = QUERY_FRACTION) -> DataFrame:
    """Query rows of evaluation users: min(max(round(f n), 1), n - 1) of lowest tie rank."""
    n_query = F.least(F.greatest(F.round(F.lit(fraction) * F.col("n_warm")), F.lit(1.0)),
                      (F.col("n_warm") - 1).cast("double"))
    return warm.withColumn("is_query", (F.col("split") != "train") & (F.col("tie_rank") <= n_query))


def warm_examples(marked: DataFrame) -> DataFrame:
    """Training: every warm positive. Validation and test: the queries only."""
    return (marked.where(F.col("is_query") | (F.col("split") == "train"))
            .select("user_idx", "anime_idx", "score", "split"))


def history_rows(marked: DataFrame) -> DataFrame:
    """What a user's history may contain: all warm positives but the queries."""
    return marked.where(~F.col("is_query")).select("user_idx", "anime_idx", "score", "tie", "split")


def histories(rows: DataFrame) -> DataFrame:
    """Parallel arrays per user, best score first, ties by tie key. Whole, at most one entry per item."""
    entry = F.struct((-F.col("score")).alias("neg"), "tie", "anime_idx", "score")
    ordered = F.array_sort(F.collect_list(entry))
    return (rows.groupBy("user_idx").agg(ordered.alias("h"))
            .select("user_idx", F.col("h.anime_idx").alias("history_ids"), F.col("h.score").alias("history_scores")))


def ranked_history(rows: DataFrame) -> DataFrame:
    """The history in long form with its 0-based position."""
    order = Window.partitionBy("user_idx").orderBy(F.desc("score"), "tie", "anime_idx")
    return rows.withColumn("pos", F.row_number().over(order) - 1)


def hard_negatives(base: DataFrame, cold: DataFrame, cap: int = HARD_NEGATIVE_CAP) -> DataFrame:
    """Up to ``cap`` distinct warm hard negatives per user, lowest index first."""
    order = Window.partitionBy("user_idx").orderBy("anime_idx")
    first = (base.where("is_hardneg").join(cold.select("anime_idx"), "anime_idx", "left_anti")
             .select("user_idx", "anime_idx").distinct()
             .withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap))
    return first.groupBy("user_idx").agg(F.array_sort(F.collect_list("anime_idx")).alias("hard_neg_ids"))


def wide_users(features: DataFrame, hist: DataFrame, hard: DataFrame) -> DataFrame:
    none = F.array().cast("array<int>")
    return (features.join(hist, "user_idx", "left").join(hard, "user_idx", "left")
            .withColumns({c: F.coalesce(c, none) for c in ("history_ids", "history_scores", "hard_neg_ids")}))


def history_lengths(users: DataFrame) -> DataFrame:
    lens = users.select(F.size("history_ids").alias("len"))
    med = quantiles.interpolated(lens, [], "len", {"m": 0.5}).select("m").scalar()
    return (lens.agg(F.min("len").cast("bigint").alias("min_len"), F.max("len").cast("bigint").alias("max_len"),
                     F.count_if(F.col("len") == 0).alias("n_empty"))
            .withColumn("median_len", F.floor(med)))


def item_index(items: DataFrame, cold: DataFrame) -> DataFrame:
    """Dense index with natural key (-1 for the two special rows) and a cold flag."""
    spark = items.sparkSession
    special = spark.range(2).select(F.col("id").cast("int").alias("anime_idx"), F.lit(-1).cast("bigint").alias("mal_id"))
    flags = cold.select("anime_idx", F.lit(True).alias("is_cold"))
    return (items.select("anime_idx", "mal_id").unionByName(special).join(flags, "anime_idx", "left")
            .withColumn("is_cold", F.coalesce("is_cold", F.lit(False))))


def evaluation_export(examples: DataFrame, final_exam: bool = False) -> DataFrame:
    """Evaluation queries by split; the final-exam split is withheld unless asked for."""
    splits = ["val", "test", "val_cold"] + (["test_cold"] if final_exam else [])
    return examples.where(F.col("split").isin(splits)).select("split", "user_idx", "anime_idx", "score")


def eligible_train_users(users: DataFrame, min_history: int = 5) -> DataFrame:
    """Training users with a history long enough to cut."""
    return users.where((F.col("split") == "train") & (F.size("history_ids") >= min_history))


def sample_train_users(users: DataFrame, n: int, min_history: int = 5) -> DataFrame:
    """At most ``n`` eligible training users, the ones of smallest hash."""
    return eligible_train_users(users, min_history).orderBy(hash_u32(SEED, F.col("user_idx")), "user_idx").limit(n)


def support_target(users: DataFrame, fraction: float = QUERY_FRACTION) -> DataFrame:
    """Split each history into support and target by hash, both in their original order.

    Works inside the arrays, so it needs no shuffle.
    """
    n = F.size("history_ids")
    n_target = F.least(F.greatest(F.round(n * F.lit(fraction)).cast("int"), F.lit(1)), n - 1)
    keyed = F.array_sort(F.transform("history_ids", lambda a, i: F.struct(
        hash_u32(SEED, F.col("user_idx"), a).alias("key"), i.alias("at"))))
    chosen = users.where(n >= 2).withColumn("_target", F.slice(keyed, 1, n_target)["at"])

    def side(col: str, target: bool) -> Column:
        return F.filter(col, lambda _, i: F.array_contains("_target", i) == F.lit(target))
    return chosen.select("user_idx", side("history_ids", False).alias("support_ids"),
                         side("history_scores", False).alias("support_scores"),
                         side("history_ids", True).alias("target_ids"),
                         side("history_scores", True).alias("target_scores"))
