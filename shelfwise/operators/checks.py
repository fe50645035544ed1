"""Integrity checks; each returns one row (check, violations)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row(df: DataFrame, name: str, violations: Column) -> DataFrame:
    return df.agg(F.coalesce(violations.cast("bigint"), F.lit(0)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def count_where(df: DataFrame, name: str, bad: Column) -> DataFrame:
    return _row(df, name, F.count_if(bad))


def row_count(df: DataFrame, name: str, expected: Column) -> DataFrame:
    return _row(df.withColumn("_e", expected), name, F.abs(F.count("*") - F.coalesce(F.max("_e"), F.lit(0))))


def in_range(df: DataFrame, column: str, size: int) -> DataFrame:
    c = F.col(column)
    return count_where(df, f"{column} in range", c.isNull() | (c < 0) | (c >= size))


def binary_width(df: DataFrame, column: str, width: int) -> DataFrame:
    return count_where(df, f"{column} width and values", (F.size(column) != width) | F.exists(column, lambda x: ~x.isin(0, 1)))


def unique_key(df: DataFrame, key: str, first: int) -> DataFrame:
    """Repeated keys plus keys outside first .. first + n - 1."""
    per = df.groupBy(key).agg(F.count("*").alias("n"))
    size = df.agg(F.count("*")).scalar()
    return _row(per.withColumn("_n", size), f"{key} unique and dense",
                F.count_if(F.col("n") > 1) + F.count_if((F.col(key) < first) | (F.col(key) >= F.col("_n") + first)))


def aligned(df: DataFrame, a: str, b: str) -> DataFrame:
    return count_where(df, f"{a} aligned with {b}", F.size(a) != F.size(b))


def descending(df: DataFrame, column: str) -> DataFrame:
    n = F.size(column)
    rises = F.zip_with(F.slice(column, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(column, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda a, b: a < b)
    return count_where(df, f"{column} descending", F.exists(rises, lambda x: x))


def disjoint(rows: DataFrame, forbidden: DataFrame, keys: list[str], name: str) -> DataFrame:
    return _row(rows.join(forbidden.select(*keys), keys, "left_semi"), name, F.count("*"))


def subset(rows: DataFrame, allowed: DataFrame, keys: list[str], name: str) -> DataFrame:
    return _row(rows.join(allowed.select(*keys), keys, "left_anti"), name, F.count("*"))


def cold_examples(examples: DataFrame, cold: DataFrame, users: DataFrame) -> DataFrame:
    """Cold examples lie in the cold set and in their user's own split."""
    rows = examples.where("split IN ('val_cold', 'test_cold')")
    wrong = (rows.join(users.select("user_idx", F.col("split").alias("own")), "user_idx", "left")
             .where(F.col("own").isNull() | (F.col("split") != F.concat("own", F.lit("_cold")))))
    return together(subset(rows, cold, ["anime_idx"], "cold examples in cold set"), _row(wrong, "cold examples in own split", F.count("*")))


def seen_covers(seen: DataFrame, history: DataFrame, queries: DataFrame) -> DataFrame:
    pair = ["user_idx", "anime_idx"]
    return subset(history.select(*pair).unionByName(queries.select(*pair)), seen, pair, "seen covers history and queries")


def leak(examples: DataFrame, history: DataFrame) -> DataFrame:
    return disjoint(examples, history, ["user_idx", "anime_idx"], "evaluation example in history")


def prior_sums(prior: DataFrame, cold: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Probabilities of seen items sum to 1; real items are finite; cold items have no count."""
    total = F.sum(F.when(F.col("count") > 0, F.exp("log_q")))
    p = F.col("log_q")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    return together(_row(prior, "prior sums to one", F.when(F.abs(total - 1) <= tolerance, 0).otherwise(1)),
                    count_where(prior.where("anime_idx >= 2"), "prior finite", ~finite),
                    count_where(prior.join(cold.select("anime_idx"), "anime_idx", "left_semi"), "cold count zero", F.col("count") != 0))


def dense_groups(rows: DataFrame, qid: str = "qid") -> DataFrame:
    """Ids missing below the largest one, and negative ones."""
    ids = rows.select(qid).distinct()
    return _row(ids, f"{qid} dense", F.max(qid) + 1 - F.count("*") + 2 * F.count_if(F.col(qid) < 0))


def cold_policy(numbers: DataFrame, cold: DataFrame) -> DataFrame:
    """Cold rows: missing flags set, log counts zero, one imputed value each."""
    c = numbers.join(cold.select("anime_idx"), "anime_idx", "left_semi")
    flags = (F.col("mal_score_missing") != 1) | (F.col("rank_missing") != 1)
    logs = (F.col("log_scored_by") != 0) | (F.col("log_members") != 0) | (F.col("log_favorites") != 0)
    spread = sum((F.when(F.max(x) != F.min(x), 1).otherwise(0) for x in ("mal_score", "popularity", "rank")), F.lit(0))
    return together(count_where(c, "cold missing flags", flags), count_where(c, "cold log counts", logs), _row(c, "cold imputed alike", spread))


def pool_clean(pool: DataFrame, mask: DataFrame, queries: DataFrame) -> DataFrame:
    """No masked and no special candidate; label 1 exactly for queries."""
    pair = ["user_idx", "anime_idx"]
    hits = pool.select(*pair, "label").join(queries.select(*pair, F.lit(1).alias("q")), pair, "left")
    return together(disjoint(pool, mask, pair, "masked candidate in pool"),
                    count_where(pool, "special item in pool", F.col("anime_idx") < 2),
                    count_where(hits, "label equals membership", F.col("label") != F.coalesce("q", F.lit(0))))


def pool_sorted(pool: DataFrame, side: DataFrame, queries: DataFrame) -> DataFrame:
    """Cosine does not rise along a pool; r_total counts all queries."""
    prev = F.lag("cos").over(Window.partitionBy("user_idx").orderBy("pool_rank"))
    rises = pool.select("cos", prev.alias("prev"))
    n = queries.groupBy("user_idx").agg(F.count("*").alias("n"))
    both = side.join(n, "user_idx", "full")
    return together(count_where(rises, "pool sorted by cosine", F.col("cos") > F.col("prev")),
                    count_where(both, "r_total counts queries", F.coalesce("r_total", F.lit(0)) != F.coalesce("n", F.lit(0))))


def train_pool(pool: DataFrame, users: DataFrame, relabelled: DataFrame) -> DataFrame:
    """Only training users; labels equal recomputed ones; a positive in every group."""
    pair = ["user_idx", "anime_idx"]
    other = pool.join(relabelled.select(*pair, F.col("label").alias("again")), pair, "left")
    groups = pool.groupBy("user_idx").agg(F.max("label").alias("m"))
    return together(subset(pool.select("user_idx").distinct(), users.where("split = 'train'"), ["user_idx"], "pool of training users"),
                    count_where(other, "labels recomputed", ~F.col("label").eqNullSafe(F.col("again"))),
                    count_where(groups, "positive in every group", F.col("m") <= 0))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return _row(left.join(right, key, "left_anti").unionByName(right.join(left, key, "left_anti")), f"same {key} on both sides", F.count("*"))


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and sum of row hashes: the same in any order, and sensitive to repeated rows."""
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("hash_sum"))


def same_fingerprint(stored: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """1 if the fingerprint kept with a derived table is not that of the source now."""
    now = fingerprint(source)
    pair = now.withColumns({"n": stored.select("n_rows").scalar(), "h": stored.select("hash_sum").scalar()})
    return count_where(pair, name, ~(F.col("n_rows").eqNullSafe(F.col("n")) & F.col("hash_sum").eqNullSafe(F.col("h"))))


def vectors_close(a: DataFrame, b: DataFrame, key: str, tolerance: float) -> DataFrame:
    """Rows whose vectors differ by more than the tolerance anywhere, or exist on one side only."""
    both = a.select(key, F.col("vec").alias("va")).join(b.select(key, F.col("vec").alias("vb")), key, "full")
    diff = F.array_max(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)))
    return count_where(both, "vectors close", F.coalesce(diff, F.lit(float("inf"))) > tolerance)
