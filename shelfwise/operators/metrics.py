"""Blending, ranking metrics and model selection.

A pool row has user_idx, anime_idx, pool_rank, cos, pred and label; ``side`` has the totals per user.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cut-offs, blend weights, selection metrics, gate tolerance.
KS = [10, 50, 100, 200]
ALPHAS = [0.0, 0.25, 0.4, 0.5, 0.6, 0.75, 1.0]
SELECTION = ["recall@10", "recall@100", "ndcg@10", "ndcg@100"]
GATE_TOLERANCE = 2e-3


def rank_norm(value: str, by: list[str]) -> Column:
    """Rank scaled to [0, 1] within a group, higher value nearer 1, ties in pool order."""
    group = Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(value, "pool_rank")) - 1
    return rank / F.greatest(F.count("*").over(group) - 1, F.lit(1))


def with_rank_norms(pool: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = by or ["user_idx"]
    return pool.withColumn("rn_cos", rank_norm("cos", keys)).withColumn("rn_pred", rank_norm("pred", keys))


def blend_score(alpha: Column) -> Column:
    """(1 - a) rn(cos) + a rn(pred); a = 0 is the cosine itself."""
    return F.when(alpha == 0.0, F.col("cos")).otherwise((1 - alpha) * F.col("rn_cos") + alpha * F.col("rn_pred"))


def blend(pool: DataFrame, alpha: float) -> DataFrame:
    return with_rank_norms(pool).withColumn("score", blend_score(F.lit(float(alpha))))


def rank_pool(scored: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """0-based position by score, best first, ties in pool order."""
    order = Window.partitionBy(*(by or []), "user_idx").orderBy(F.desc(score), "pool_rank")
    return scored.withColumn("at", F.row_number().over(order) - 1)


def _ideal(relevant: Column, k: int) -> Column:
    """Ideal DCG of ``relevant`` hits within k, from the running sum of discounts."""
    sums = list(accumulate(1 / math.log2(r + 2) for r in range(k)))
    return F.element_at(F.array(*[F.lit(s) for s in sums]), F.least(relevant, F.lit(k)).cast("int"))


def _per_user(ranked: DataFrame, side: DataFrame, ks: list[int], by: list[str], label: str, total: str) -> DataFrame:
    aggs = []
    for k in ks:
        hit = F.when(F.col("at") < k, F.col(label)).otherwise(0)
        aggs += [F.sum(hit).alias(f"h{k}"), F.sum(hit / F.log2(F.col("at") + 2)).alias(f"d{k}")]
    sums = ranked.groupBy(*by, "user_idx").agg(*aggs)
    joined = sums.join(side.select("user_idx", F.col(total).alias("R")), "user_idx").where("R > 0")
    return joined.select(*by, "user_idx", "R", *[f"h{k}" for k in ks],
                         *[(F.col(f"h{k}") / F.col("R")).alias(f"recall{k}") for k in ks],
                         *[(F.col(f"d{k}") / _ideal(F.col("R"), k)).alias(f"ndcg{k}") for k in ks])


def evaluate(ranked: DataFrame, side: DataFrame, ks: list[int], *, by: list[str] | None = None,
             pooled: bool = False, liked: bool = False) -> DataFrame:
    """(by, metric, value): mean recall@k and ndcg@k over users with queries, and ``n_users``.

    ``pooled`` adds hit rates over all pairs, ``liked`` the same means over users with liked queries.
    """
    by = by or []
    out = _means(_per_user(ranked, side, ks, by, "label", "r_total"), ks, by, "", pooled)
    if liked:
        out = out.unionByName(_means(_per_user(ranked, side, ks, by, "label_liked", "r_liked"), ks, by, "liked_", False))
    return out


def _means(per: DataFrame, ks: list[int], by: list[str], prefix: str, pooled: bool) -> DataFrame:
    named = {f"{prefix}{m}@{k}": F.avg(f"{m}{k}") for m in ("recall", "ndcg") for k in ks}
    named["n_users_liked" if prefix else "n_users"] = F.count("*").cast("double")
    if pooled:
        named |= {f"hitrate@{k}": F.sum(f"h{k}") / F.sum("R") for k in ks}
        named["n_pairs"] = F.sum("R").cast("double")
    wide = per.groupBy(*by).agg(*[v.alias(f"m{i}") for i, v in enumerate(named.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(named)])
    return wide.select(*by, F.inline(rows))


def sweep(pool: DataFrame, side: DataFrame, ks: list[int], alphas: list[float] = ALPHAS, *, liked: bool = False) -> DataFrame:
    """Metrics of every blend weight. Each pool row is repeated once per weight."""
    wide = with_rank_norms(pool).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    scored = wide.withColumn("score", blend_score(F.col("alpha")))
    return evaluate(rank_pool(scored, "score", ["alpha"]), side, ks, by=["alpha"], liked=liked)


def best_alpha(swept: DataFrame, metric: str = "ndcg@10") -> DataFrame:
    """The weight above 0 of best metric, the smallest on ties."""
    return (swept.where((F.col("metric") == metric) & (F.col("alpha") > 0))
            .orderBy(F.desc("value"), "alpha").limit(1).select("alpha", "value"))


def pareto_pick(results: DataFrame, base: DataFrame, key: str, metrics: list[str], lead: str, fallback: str) -> DataFrame:
    """Best ``lead`` among configurations no worse than the baseline everywhere and better on ``lead``.

    Without one, the best among those that keep the ``fallback`` metric.
    """
    both = results.join(base.select("metric", F.col("value").alias("base")), "metric").where(F.col("metric").isin(metrics))
    no_worse = F.col("value") >= F.col("base") - 1e-9

    def at(metric: str, cond: Column) -> Column:
        return F.coalesce(F.bool_or((F.col("metric") == metric) & cond), F.lit(False))
    judged = both.groupBy(key).agg(
        (F.bool_and(no_worse) & at(lead, F.col("value") > F.col("base"))).alias("pareto"),
        at(fallback, no_worse).alias("keeps"), F.max(F.when(F.col("metric") == lead, F.col("value"))).alias("lead_value"))
    return (judged.where("pareto OR keeps").orderBy(F.desc("pareto"), F.desc("lead_value"), key).limit(1)
            .select(key, "pareto", "lead_value"))


def baseline_gate(metrics: DataFrame, reference: DataFrame, tolerance: float = GATE_TOLERANCE) -> DataFrame:
    """Measured against published values: recall within the tolerance, user counts equal."""
    both = reference.select("metric", F.col("value").alias("expected")).join(metrics, "metric", "left")
    diff = F.abs(F.col("value") - F.col("expected"))
    ok = F.when(F.col("metric").startswith("n_users"), diff == 0).otherwise(diff <= tolerance)
    return both.select("metric", "value", "expected", diff.alias("diff"), F.coalesce(ok, F.lit(False)).alias("ok"))


def report(results: DataFrame, base: DataFrame, depth_metric: str) -> DataFrame:
    """Chosen against baseline metrics with deltas, and the baseline recall at pool depth as ceiling."""
    ceiling = base.where(F.col("metric") == depth_metric).select("value").scalar()
    return (results.join(base.select("metric", F.col("value").alias("baseline")), "metric")
            .select("metric", "value", "baseline", (F.col("value") - F.col("baseline")).alias("delta"))
            .withColumn("pool_ceiling", ceiling))


def leaderboard(runs: DataFrame, key: list[str], priority: str, sort_by: str) -> DataFrame:
    """One row per run, the one of lowest ``priority``, best first, unmeasured runs last."""
    order = Window.partitionBy(*key).orderBy(priority)
    return (runs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
            .orderBy(F.desc_nulls_last(sort_by), *key))


def pivot_metrics(long: DataFrame, by: list[str], names: dict[str, str]) -> DataFrame:
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(out) for m, out in names.items()])


def cold_leaderboard(full: DataFrame, cold_only: DataFrame, by: list[str], k: int) -> DataFrame:
    """Whole-catalogue cold metrics beside those with cold candidates only."""
    a = pivot_metrics(full, by, {f"recall@{k}": "cold_recall", f"hitrate@{k}": "cold_hit", "ndcg@10": "cold_ndcg10",
                                 f"liked_recall@{k}": "cold_liked_recall", "n_users": "cold_n_users", "n_pairs": "cold_n_pairs"})
    b = pivot_metrics(cold_only, by, {f"recall@{k}": "cold_only_recall"})
    return a.join(b, by).orderBy(F.desc_nulls_last("cold_recall"), *by)
