"""Hand-computed cases and brute-force twins of the operators."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage
from shelfwise.functions import staging
from shelfwise.operators import atlas, browse, checks, cleaning, encoding, estimators, features, labels, layout, metrics, ranker, recommend, sampling, splits, tuning, vectors
from shelfwise.plans import log_queries, world


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# -- cleaning ------------------------------------------------------------------------
def test_keep_last_of_a_hot_key(spark):
    log = spark.range(5000).select(F.lit("u").alias("username"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(1).alias("anime_id"),
                                   F.col("id").alias("score"), F.col("id").alias("ord"))
    got = {r.anime_id: r.score for r in cleaning.keep_last(log, ["username", "anime_id"], "ord").collect()}
    assert len(got) == 1001 and got[1] == 4999


def test_bot_rules_at_full_thresholds(spark):
    stats = spark.createDataFrame(
        [("spam", 2500, 2500, 2500, 9.5, 1.0), ("const", 600, 600, 501, 5.0, 0.1), ("huge", 6000, 5001, 10, 5.0, 2.0),
         ("silent", 1500, 1001, 0, None, None), ("one", 1600, 5002, 1, 5.0, None), ("ok", 50, 40, 30, 7.0, 1.5)],
        "username string, n long, watched long, rated long, mean_score double, std_score double")
    flagged = cleaning.bot_rules(stats)
    assert rows(flagged.where("flagged"), "username") == [("const",), ("huge",), ("one",), ("silent",), ("spam",)]
    contribution = {r.rule: (r.total, r.exclusive) for r in cleaning.rule_contribution(flagged).collect()}
    assert contribution == {"spam_pos": (1, 1), "const_rater": (1, 1), "physical": (2, 2), "nan_lister": (1, 1)}


def brute_core(pairs, user_min, item_min):
    pairs = set(pairs)
    while True:
        by_user = {u: sum(1 for p in pairs if p[0] == u) for u, _ in pairs}
        kept = {p for p in pairs if by_user[p[0]] >= user_min}
        by_item = {i: sum(1 for p in kept if p[1] == i) for _, i in kept}
        kept = {p for p in kept if by_item[p[1]] >= item_min}
        if len(kept) == len(pairs):
            return {u for u, _ in kept}, {i for _, i in kept}
        pairs = kept


def test_k_core_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    pairs = {(f"u{int(a)}", int(b)) for a, b in zip(rng.zipf(1.6, 900) % 60, rng.integers(0, 25, 900))}
    users, items = cleaning.k_core(spark.createDataFrame(list(pairs), "username string, anime_id long"), 4, 5)
    want_users, want_items = brute_core(pairs, 4, 5)
    assert {r.username for r in users.collect()} == want_users and {r.anime_id for r in items.collect()} == want_items
    assert want_users


def test_k_core_peels_to_the_end(spark):
    # a chain: every round takes one end off; beside it a square that stays
    pairs = {(f"u{i:02}", j) for i in range(14) for j in (i, i + 1)} | {(u, i) for u in "ab" for i in (100, 101)}
    users, items = cleaning.k_core(spark.createDataFrame(list(pairs), "username string, anime_id long"), 2, 2, buckets=8)
    assert ({r.username for r in users.collect()}, {r.anime_id for r in items.collect()}) == ({"a", "b"}, {100, 101})


def test_k_core_round_reads_the_buckets_of_dropped_keys(spark, monkeypatch):
    written = []

    def noted(df, name, **options):
        out = stage(df, name, **options)
        written.append((name, out.count()))
        return out
    monkeypatch.setattr(cleaning, "stage", noted)
    pairs = [(f"u{i}", j) for i in range(40) for j in range(30)] + [("x", 1), ("y", 2)]
    cleaning.k_core(spark.createDataFrame(pairs, "username string, anime_id long"), 2, 2)
    assert [n for name, n in written if name.startswith("kcore-by")] == [1202, 1202]       # pairs are written once
    assert [n for name, n in written if name == "kcore-dropped"] == [2, 0, 0]


def test_k_core_can_vanish(spark):
    users, items = cleaning.k_core(spark.createDataFrame([("a", 1)], "username string, anime_id long"))
    assert users.count() == 0 and items.count() == 0


# -- encoding and splits ------------------------------------------------------------------
@pytest.mark.parametrize("year,era,cohort", [(1980, 1, 0), (1989, 1, 0), (1990, 2, 0), (2012, 4, 0), (2013, 4, 1), (2018, 5, 2), (2022, 5, 4), (None, 0, 4)])
def test_buckets(spark, year, era, cohort):
    df = spark.createDataFrame([(year,)], "y int").select(
        encoding.bucketize(F.col("y"), encoding.ERA_EDGES).alias("era"), encoding.cohort(F.col("y")).alias("cohort"))
    assert tuple(df.first()) == (era, cohort)


def test_episode_bucket_edges(spark):
    eps = [-1, 0, 1, 2, 3, 6, 7, 52, 53, None]
    df = spark.createDataFrame([(i, e) for i, e in enumerate(eps)], "i int, e int")
    got = [r.b for r in df.select("i", encoding.episode_bucket(F.col("e")).alias("b")).orderBy("i").collect()]
    assert got == [0, 1, 1, 2, 3, 3, 4, 6, 7, 0]


def test_join_year_formats(spark):
    df = spark.createDataFrame([("Dec 1, 2018",), ("2011-05-06T00:00:00+00:00",), ("soon",), (None,)], "t string")
    assert [r.y for r in df.select(encoding.joined_year(F.col("t")).alias("y")).collect()] == [2018, 2011, None, None]


def test_labels_are_disjoint(spark):
    cases = [(s, n) for s in ("completed", "watching", "dropped", "plan_to_watch") for n in range(11)]
    df = spark.createDataFrame(cases, "status string, score int").select("*", splits.is_positive().alias("p"), splits.is_hard_negative().alias("h"))
    for r in df.collect():
        assert r.p == (r.status in ("completed", "watching") and r.score not in (1, 2, 3, 4))
        assert r.h == (r.status == "dropped" or r.score in (1, 2, 3, 4))
        assert not (r.p and r.h)


def test_support_target_partition(spark):
    users = spark.createDataFrame([(7, list(range(100, 123)), list(range(23))), (8, [5], [9])], "user_idx int, history_ids array<int>, history_scores array<int>")
    got = splits.support_target(users).collect()
    assert len(got) == 1
    r = got[0]
    assert len(r.target_ids) == 5 and sorted(r.support_ids + r.target_ids) == list(range(100, 123))
    assert r.support_ids == sorted(r.support_ids) and [i - 100 for i in r.target_ids] == r.target_scores


def test_history_prefix_and_hard_negative_masks(spark):
    users = spark.createDataFrame([(0, [2, 3, 4, 5], [10, 9, 8, 7], [8, 9]), (1, [6, 7], [5, 0], [2]), (2, [], [], [])],
                                  "user_idx int, history_ids array<int>, history_scores array<int>, hard_neg_ids array<int>")
    got = {r.user_idx: r for r in sampling.history_prefix(users, 2).collect()}
    assert got[0].ids == [2, 3] and got[1].scores == [5, 0] and got[2].ids == [0, 0] and got[2].mask == [False, False]
    ex = spark.createDataFrame([(0, 2), (1, 6), (2, 3)], "user_idx int, anime_idx int")
    hn = {r.user_idx: r for r in sampling.anchor_hard_negatives(ex, users, 2, 1).collect()}
    assert [hn[u].mask for u in (0, 1, 2)] == [[True, True], [True, False], [False, False]]
    ah = {r.user_idx: r for r in sampling.anchor_history(ex, users, 3, 0.0, 1).collect()}
    assert ah[1].ids == [6, 7, 0] and ah[1].mask == [False, True, False]


# -- retrieval --------------------------------------------------------------------------------
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_top_k_equals_brute_force(spark, limit):
    rng = np.random.default_rng(0)
    vecs = rng.integers(-3, 4, (60, 4)).astype(float)                      # many equal scores
    users = rng.integers(-3, 4, (9, 4)).astype(float)
    mask = {u: set(int(x) for x in rng.integers(0, 60, 12)) for u in range(9)}
    mask[8] = set(range(60)) - {5, 6}                                       # nearly exhausted
    cold = {10, 11, 12}
    item_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "anime_idx int, vec array<double>")
    user_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "user_idx int, vec array<double>")
    mask_df = spark.createDataFrame([(u, i) for u in mask for i in mask[u]], "user_idx int, anime_idx int")
    cold_df = spark.createDataFrame([(i,) for i in cold], "anime_idx int")
    got = vectors.masked_top_k(user_df, item_df, mask_df, 7, exclude=cold_df, broadcast_bytes=limit, user_block=4, item_block=16)
    want = []
    for u in range(9):
        ok = [i for i in range(2, 60) if i not in mask[u] and i not in cold]
        ok.sort(key=lambda i: (-float(users[u] @ vecs[i]), i))
        want += [(u, i, r) for r, i in enumerate(ok[:7])]
    assert rows(got, "user_idx", "anime_idx", "pool_rank") == sorted(want)


def _clustered(rng, n, d=16, groups=12):
    centres = rng.normal(size=(groups, d)) * 3
    return centres[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.05


def test_pieces_that_cannot_beat_the_kth_score_are_left_out():
    rng = np.random.default_rng(11)
    items, users = _clustered(rng, 4000), _clustered(np.random.default_rng(12), 300)
    masks = [rng.integers(0, 4000, int(n)).astype(np.int32) for n in rng.integers(0, 50, 300)]
    state = vectors.Running(10)
    state.add_users(np.arange(300), users, masks)
    near = np.argsort(-(items @ users.mean(axis=0)), kind="stable")
    for i in range(0, 4000, 50):
        state.see(near[i:i + 50], items[near[i:i + 50]])
    got = {}
    for b in state.out():
        for u, i in zip(b["user_idx"].to_pylist(), b["anime_idx"].to_pylist()):
            got.setdefault(u, []).append(i)
    for u in range(300):
        scores = np.round(items @ users[u], 6)
        scores[masks[u]] = -np.inf
        assert got[u] == np.lexsort((np.arange(4000), -scores))[:10].tolist()
    assert state.scored < 0.9 * 300 * 4000


def test_scores_closer_than_single_precision_keep_their_order():
    rng = np.random.default_rng(17)
    base = rng.normal(size=16) * 100
    items = base + rng.normal(size=(3000, 16)) * 1e-5
    users = np.vstack([base, rng.normal(size=(9, 16)), np.full((1, 16), 1e25), np.zeros((1, 16))])
    state = vectors.Running(10)
    state.add_users(np.arange(12), users, [np.array([5, 7], np.int32)] * 12)
    for i in range(0, 3000, 700):
        state.see(np.arange(i, min(i + 700, 3000)), items[i:i + 700])
    got = {}
    for b in state.out():
        for u, i in zip(b["user_idx"].to_pylist(), b["anime_idx"].to_pylist()):
            got.setdefault(u, []).append(i)
    for u in (*range(10), 11):
        scores = np.round(items @ users[u], 6)
        scores[[5, 7]] = -np.inf
        assert got[u] == np.lexsort((np.arange(3000), -scores))[:10].tolist()
    assert len(got[10]) == 10


def test_a_mask_meets_one_of_equal_ids():
    """Also where a cut between pieces parts them."""
    n = vectors.SCORE_ITEMS + 50
    ids = np.sort(np.append(np.arange(n - 1), vectors.SCORE_ITEMS - 1))
    items = np.column_stack([np.arange(n, 0, -1), np.ones(n)]) / n
    state = vectors.Running(n)
    state.add_users(np.arange(2), np.ones((2, 2)), [np.array([3, vectors.SCORE_ITEMS - 1], np.int32), np.zeros(0, np.int32)])
    state.see(ids, items)
    got = [b.to_pandas() for b in state.out()][0]
    mine = got[got["user_idx"] == 0]["anime_idx"].tolist()
    assert mine == sorted(set(ids.tolist()) - {3}) and (got["user_idx"] == 1).sum() == n


def test_blocks_grow_with_the_users(spark):
    """Items are sent once per block, so the blocks must not become more with the users."""
    rng = np.random.default_rng(19)
    items, users = _clustered(rng, 200), _clustered(rng, 1000)
    item_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "anime_idx int, vec array<double>")
    user_df = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(users)], "user_idx int, vec array<double>")
    none = spark.createDataFrame([], "user_idx int, anime_idx int")
    best = vectors._by_blocks(user_df, item_df, none, 5, 4, 50, 1)
    assert best.rdd.getNumPartitions() <= 2 * vectors.BLOCKS
    assert best.count() == 5000


def test_blocks_are_as_many_as_send_least():
    """Items are sent once per block, users and lists once per lane; memory bounds a block."""
    def sent(n_users, n_items, k, block):
        blocks = -(-n_users // block)
        return blocks * n_items * 512 + max(1, min(vectors.LANES, -(-12 // blocks))) * n_users * (512 + 20 * k)
    graph = vectors.block_size(1_200_000, 1_200_000, 64, 15, 12, 4096, 1)
    assert sent(1_200_000, 1_200_000, 15, graph) <= 0.3 * sent(1_200_000, 1_200_000, 15, 32768)
    pools = vectors.block_size(56_000, 1_200_000, 64, 200, 12, 4096)
    assert sent(56_000, 1_200_000, 200, pools) <= 0.6 * sent(56_000, 1_200_000, 200, 7000)
    assert vectors.block_size(10 ** 8, 10 ** 7, 64, 200, 12, 4096) * (512 + 200 * 24) <= vectors.BLOCK_BYTES


def test_users_of_one_small_file_meet_a_shared_matrix_in_many_tasks(spark, tmp_path):
    rng = np.random.default_rng(23)
    item_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(_clustered(rng, 50))], "anime_idx int, vec array<double>")
    path = str(tmp_path / "users")
    spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(_clustered(rng, 200))], "user_idx int, vec array<double>").coalesce(1).write.parquet(path)
    none = spark.createDataFrame([], "user_idx int, anime_idx int")
    best = vectors._by_broadcast(spark.read.parquet(path), vectors.share_matrix(item_df), none, 3)
    assert best.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert best.count() == 600


def test_a_file_of_repeated_vectors_is_not_taken_for_a_small_table(spark):
    """60 MB of rows in a small file would go whole through the driver."""
    n = 120_000
    rows_ = spark.range(n).select(F.col("id").cast("int").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i * (F.col("id") % 2000)).cast("double")).alias("vec"))
    before = spark.conf.get(staging.FACTOR)
    try:
        spark.conf.unset(staging.FACTOR)
        staging.plan_by_rows(spark)
        small = staging.stage(rows_, "repeated")
        other = spark.range(n).select((F.col("id") * 3).cast("int").alias("k"), F.rand(1).alias("x"))
        plan = other.repartition(8, "k").join(small, "k", "left")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" not in plan
    finally:
        spark.conf.set(staging.FACTOR, before)


def test_content_features_are_not_sent_whole(spark):
    """An array counts as one number in Spark's sizes, so a table of long arrays passes for a small one."""
    items = spark.range(3000).select(F.col("id").cast("int").alias("k"), F.array_repeat(F.col("id") % 2, 400).alias("x"))
    learned = spark.range(0, 3000, 2).select(F.col("id").cast("int").alias("k"), F.array(F.rand(1)).alias("vec"))
    known = estimators._known(items, learned, "k", "x")
    assert "Broadcast" not in known._jdf.queryExecution().sparkPlan().toString()
    assert known.count() == 1500 and known.columns == ["x", "vec"]


def test_blocked_top_k_equals_the_shared_one_and_sends_few_rows(spark):
    rng = np.random.default_rng(13)
    items = _clustered(rng, 5000)
    items[100:200] = items[0]                                     # ties
    items[4000:] *= np.linspace(0.1, 1, 1000)[:, None]            # lengths differ
    users = np.vstack([_clustered(rng, 400), np.zeros((3, 16))])
    uid = [7 * u + 1_000_000 for u in range(len(users))]          # ids with gaps
    item_df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "anime_idx int, vec array<double>")
    user_df = spark.createDataFrame([(u, v.tolist()) for u, v in zip(uid, users)], "user_idx int, vec array<double>")
    mask_df = spark.createDataFrame([(uid[u], int(i)) for u in range(0, 400, 3) for i in rng.integers(0, 5000, 40)], "user_idx int, anime_idx int")
    want = rows(vectors.masked_top_k(user_df, item_df, mask_df, 20), "user_idx", "anime_idx", "cos", "pool_rank")
    got = vectors.masked_top_k(user_df, item_df, mask_df, 20, broadcast_bytes=0, user_block=64, item_block=300, lanes=3)
    assert rows(got, "user_idx", "anime_idx", "cos", "pool_rank") == want
    sent = vectors._by_blocks(user_df, item_df.where("anime_idx >= 2"), mask_df, 20, 64, 300, 3)
    assert sent.groupBy("user_idx").count().agg({"count": "max"}).first()[0] <= 3 * 20


def test_top_k_without_items(spark):
    u = spark.createDataFrame([(0, [1.0])], "user_idx int, vec array<double>")
    i = spark.createDataFrame([(0, [1.0])], "anime_idx int, vec array<double>")
    m = spark.createDataFrame([], "user_idx int, anime_idx int")
    assert vectors.masked_top_k(u, i, m, 3).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_history_similarity(spark, limit):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(30, 3))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "anime_idx int, vec array<double>")
    hist = {0: [3, 4, 5, 6, 7, 8, 9], 1: [2], 70: []}
    cand = [(u, c) for u in hist for c in (20, 21)]
    h = spark.createDataFrame([(u, a, p) for u in hist for p, a in enumerate(hist[u])], "user_idx int, anime_idx int, pos int")
    got = features.history_similarity(spark.createDataFrame(cand, "user_idx int, anime_idx int"), h, items, cap=6, broadcast_bytes=limit)
    for r in got.collect():
        s = sorted((float(v[r.anime_idx] @ v[a]) for a in hist[r.user_idx][:6]), reverse=True) or [0.0]
        assert np.allclose([r.hist_cos_max, r.hist_cos_mean, r.hist_cos_top5_mean], [s[0], np.mean(s), np.mean(s[:5])])
    assert got.count() == 6


def test_cold_feature_policy(spark):
    items = spark.createDataFrame([(2, False, 8.0, 10, 5, 100, 50, 7, 12, "2010-01-01"), (3, True, 9.0, 1, 1, 999, 999, 9, None, "2024-01-01"),
                                   (4, False, 6.0, 30, 15, 10, 5, 1, 24, None)],
                                  "anime_idx int, is_cold boolean, score double, popularity long, rank long, scored_by long, members long, favorites long, episodes int, start_date string")
    got = {r.anime_idx: r for r in features.numeric_features(features.cold_policy(items)).collect()}
    cold = got[3]
    assert (cold.mal_score, cold.mal_score_missing, cold.rank, cold.rank_missing, cold.popularity) == (7.0, 1.0, 10.0, 1.0, 20.0)
    assert (cold.log_members, cold.log_scored_by, cold.log_favorites, cold.episodes) == (0.0, 0.0, 0.0, 18.0)
    assert got[4].recency_years == 2024 - 2017.0


# -- labels and metrics ---------------------------------------------------------------------------
def pool(spark, groups):
    data = [(u, 10 * u + r, r, 1.0 - r / 10, 0.1 * r, lab, lk) for u, labs in groups.items() for r, (lab, lk) in enumerate(labs)]
    return spark.createDataFrame(data, "user_idx int, anime_idx int, pool_rank int, cos double, pred double, label int, label_liked int")


def values(df):
    return {r.metric: r.value for r in df.collect()}


def test_recall_and_ndcg_by_hand(spark):
    p = pool(spark, {0: [(1, 0), (0, 0), (0, 0), (1, 0), (0, 0)]})
    side = spark.createDataFrame([(0, 4, 0)], "user_idx int, r_total long, r_liked long")
    m = values(metrics.evaluate(metrics.rank_pool(p, "cos"), side, [1, 4]))
    assert [m["recall@1"], m["recall@4"]] == [0.25, 0.5] and m["ndcg@1"] == 1.0
    ideal = sum(1 / math.log2(i + 2) for i in range(4))
    assert math.isclose(m["ndcg@4"], (1 + 1 / math.log2(5)) / ideal)


def test_ideal_is_cut_at_k(spark):
    p = pool(spark, {0: [(1, 0), (1, 0), (1, 0), (0, 0)]})
    side = spark.createDataFrame([(0, 8, 0)], "user_idx int, r_total long, r_liked long")
    m = values(metrics.evaluate(metrics.rank_pool(p, "cos"), side, [3]))
    assert math.isclose(m["ndcg@3"], 1.0) and math.isclose(m["recall@3"], 0.375)


def test_pooled_and_liked(spark):
    p = pool(spark, {0: [(1, 0), (1, 1), (1, 0), (0, 0)], 1: [(0, 0)]})
    side = spark.createDataFrame([(0, 3, 2), (1, 1, 0)], "user_idx int, r_total long, r_liked long")
    m = values(metrics.evaluate(metrics.rank_pool(p, "cos"), side, [1, 2, 3], pooled=True, liked=True))
    assert m["hitrate@1"] == 1 / 4 and m["n_pairs"] == 4 and m["n_users"] == 2
    assert [m[f"liked_recall@{k}"] for k in (1, 2, 3)] == [0, 0.5, 0.5] and m["n_users_liked"] == 1


def test_liked_needs_rated_support(spark):
    q = spark.createDataFrame([(0, 1, 10), (0, 2, 5), (0, 3, 7), (0, 4, 0), (1, 1, 8), (1, 2, 7), (2, 1, 9)], "user_idx int, anime_idx int, score int")
    users = spark.createDataFrame([(0,), (1,), (2,)], "user_idx int")
    support = spark.createDataFrame([(0, 8, 6), (0, 9, 4), (1, 8, 9), (1, 9, 9), (2, 8, 0)], "user_idx int, anime_idx int, score int")
    stats = features.user_stats(users, support)
    assert rows(labels.liked_queries(q, stats), "user_idx", "anime_idx") == [(0, 1), (0, 3)]


def test_rank_norm_and_blend_ends(spark):
    p = pool(spark, {0: [(0, 0)] * 5})
    n = metrics.with_rank_norms(p).orderBy("pool_rank").collect()
    assert [r.rn_cos for r in n] == [1.0, 0.75, 0.5, 0.25, 0.0] and [r.rn_pred for r in n] == [0.0, 0.25, 0.5, 0.75, 1.0]
    by_cos = [r.pool_rank for r in metrics.rank_pool(metrics.blend(p, 0.0), "score").orderBy("at").collect()]
    by_pred = [r.pool_rank for r in metrics.rank_pool(metrics.blend(p, 1.0), "score").orderBy("at").collect()]
    assert by_cos == [0, 1, 2, 3, 4] and by_pred == [4, 3, 2, 1, 0]


def test_queries_are_never_masked(spark):
    seen = spark.createDataFrame([(0, 2), (0, 3)], "user_idx int, anime_idx int")
    q = spark.createDataFrame([(0, 3)], "user_idx int, anime_idx int")
    assert rows(labels.eval_mask(seen, q), "anime_idx") == [(2,)]


def test_relabel_modes(spark):
    p = spark.createDataFrame([(0, 10, 4, 7.0), (0, 8, 2, 9.0), (0, 0, 0, 5.0)], "user_idx int, target_score int, label int, u_mean_score double")
    assert [r.label for r in labels.relabel(p, "steep").collect()] == [5, 3, 0]
    assert [r.label for r in labels.relabel(p, "liked").collect()] == [5, 2, 0]
    with pytest.raises(ValueError):
        labels.relabel(p, "other")


# -- lists shown to users -----------------------------------------------------------------------------
def test_sorts_keep_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(0, 1, None, 5, "2001"), (0, 2, 7.0, None, None), (0, 3, 9.0, 2, "1999")],
                               "u int, rank int, mal_score double, popularity int, start_date string")

    def order(by, asc):
        return [r.rank for r in browse.sorted_rows(df, ["u"], by, asc).orderBy("position").collect()]
    assert order("score", False) == [3, 2, 1] and order("score", True) == [2, 3, 1]
    assert order("popularity", False) == [3, 1, 2] and order("popularity", True) == [1, 3, 2]
    assert order("date", False) == [1, 3, 2] and order("date", True) == [3, 1, 2]
    assert order("relevance", False) == [1, 2, 3] and order("relevance", True) == [3, 2, 1]


def test_filters(spark):
    df = spark.createDataFrame([(1, ["a", "b"], [], ["s"], "TV", 7.0), (2, ["a"], [], [], "TV", None)],
                               "id int, genres array<string>, themes array<string>, studios array<string>, type string, mal_score double")

    def ids(**kw):
        return [r.id for r in df.where(browse.matches(browse.Filters(**kw))).collect()]
    assert ids() == [1, 2] and ids(genres=["a", "b"]) == [1] and ids(studios=["s", "t"]) == [1]
    assert ids(min_score=1.0) == [1] and ids(types=["Movie"]) == []


def test_favourites_fall_back_to_the_first_items(spark):
    h = spark.createDataFrame([(0, 1, 9, 0), (0, 2, 5, 1), (1, 3, 7, 0), (1, 4, 7, 1), (2, 5, 0, 0)], "user_idx int, anime_idx int, score int, pos int")
    assert rows(recommend.favourites(h), "user_idx", "anime_idx") == [(0, 1), (1, 3), (1, 4), (2, 5)]


# -- map -----------------------------------------------------------------------------------------------
def test_smoothing_keeps_mass_and_mirrors(spark):
    n, sigma = 6, 1.0
    cells = spark.createDataFrame([(0, 0, 0, 4), (0, 5, 2, 1)], "label int, ix int, iy int, n long")
    got = {(r.ix, r.iy): r.d for r in atlas.smooth(cells, n, sigma, ["label"]).collect()}
    assert math.isclose(sum(got.values()), 5.0, abs_tol=1e-9)
    k = atlas.gaussian_kernel(sigma)
    r = len(k) // 2

    def spread(src):
        out = np.zeros(n)
        for o, w in zip(range(-r, r + 1), k):
            t = (src + o) % (2 * n)
            out[2 * n - 1 - t if t >= n else t] += w
        return out
    want = 4 * np.outer(spread(0), spread(0)) + np.outer(spread(5), spread(2))
    assert all(math.isclose(got.get((i, j), 0.0), want[i, j], abs_tol=1e-9) for i in range(n) for j in range(n))


def test_unique_names(spark):
    df = spark.createDataFrame([(0, "x", 5), (1, "x", 9), (2, "y", 1)], "label int, name string, size int")
    assert rows(atlas.unique_names(df, [F.desc("size"), "label"]), "label", "name") == [(0, "x (2)"), (1, "x"), (2, "y")]


def test_borders_mark_both_sides(spark):
    cells = [(i, j, 1 if i < 2 else 2) for i in range(4) for j in range(4)]
    df = spark.createDataFrame(cells, "ix int, iy int, field int")
    assert rows(atlas.borders(df, 4), "ix", "iy") == [(i, j) for i in (1, 2) for j in range(4)]
    lone = spark.createDataFrame([(0, 0, 1)], "ix int, iy int, field int")
    assert rows(atlas.borders(lone, 4), "ix", "iy") == [(0, 0), (0, 1), (1, 0)]


def test_biome_takes_the_first_listed_tag(spark):
    df = spark.createDataFrame([(1, ["Comedy", "Space"], ["Mecha"]), (2, ["Nothing"], [])], "anime_idx int, genres array<string>, themes array<string>")
    assert rows(atlas.biome(df), "anime_idx", "biome") == [(1, 0), (2, -1)]


# -- checks and estimators -----------------------------------------------------------------------------------
def test_fingerprint_sees_repeats_not_order(spark):
    a = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    kept = checks.fingerprint(a)
    assert checks.same_fingerprint(kept, a.orderBy(F.desc("id")).repartition(5), "c").first().violations == 0
    assert checks.same_fingerprint(kept, a.unionByName(a.where("id < 2")), "c").first().violations == 1


def test_factorisation_beats_chance(spark):
    data = [(u, i, 10) for u in range(40) for i in range(20) if (u % 2) == (i % 2) and (u * 7 + i * 3) % 5]
    held = [(u, i) for u in range(40) for i in range(20) if (u % 2) == (i % 2) and not (u * 7 + i * 3) % 5]
    users, items = estimators.learn_vectors(spark.createDataFrame(data, "user_idx int, anime_idx int, score int"), rank=4, iterations=6)
    u = {r.user_idx: np.array(r.vec) for r in users.collect()}
    v = {r.anime_idx: np.array(r.vec) for r in items.collect()}
    same = np.mean([u[a] @ v[b] for a, b in held])
    other = np.mean([u[a] @ v[b] for a in u for b in v if (a % 2) != (b % 2)])
    assert same > other + 0.3


def test_knob_grid_counts_equal_settings_once(spark):
    grid = estimators.knob_grid(spark, {"k": [4, 8], "use_text": [True, False], "text_dim": [32, 64]}, {"use_text": ["text_dim"]})
    assert grid.count() == 6 and grid.where("NOT use_text AND text_dim IS NOT NULL").count() == 0
    pick = [r.run_name for r in estimators.random_settings(grid, 3, 1).collect()]
    assert len(set(pick)) == 3 and pick == [r.run_name for r in estimators.random_settings(grid, 3, 1).collect()]


@pytest.mark.parametrize("n,fraction", [(40, 0.05), (40, 0.2), (40, 0.5), (3, 0.9)])
def test_cold_items_cut_inside_a_hot_date(spark, n, fraction):
    dates = ["2020-01-01" if i % 3 else f"20{10 + i % 13}-05-0{1 + i % 9}" for i in range(n)]
    dates[1] = None
    items = spark.createDataFrame([(i + 2, i, d) for i, d in enumerate(dates)], "anime_idx int, mal_id long, start_date string")
    newest = sorted(((d, i + 2) for i, d in enumerate(dates) if d), key=lambda t: (t[0], -t[1]), reverse=True)
    want = sorted((i,) for _, i in newest[:math.ceil(fraction * n)])
    assert rows(encoding.cold_items(items, fraction), "anime_idx") == want


def test_keep_last_with_nulls_and_ties(spark):
    log = spark.createDataFrame([("u", 1, "a", None), ("u", 1, "b", None), ("v", 1, "c", None), ("v", 1, "d", 3), ("w", 2, "e", 5), ("w", 2, "f", 5)],
                                "user string, item int, value string, at int")
    assert rows(cleaning.keep_last(log, ["user", "item"], "at"), "user", "item", "value") == [("u", 1, "b"), ("v", 1, "d"), ("w", 2, "f")]


def test_dense_index_leaves_out_nulls_and_spreads_outliers(spark):
    from shelfwise.functions.keys import dense_index
    for kind in ("bigint", "string"):
        ids = spark.createDataFrame([(1,), (None,), (5,)], "k bigint").select(F.col("k").cast(kind))
        assert sorted((r.k, r.i) for r in dense_index(ids, "k", "i").collect()) == [(ids.first().k, 0), (type(ids.first().k)(5), 1)]
    far = spark.range(3000).unionByName(spark.createDataFrame([(10 ** 15,)], "id bigint"))
    assert [r.i for r in dense_index(far, "id", "i", start=2).orderBy("id").collect()] == list(range(2, 3003))


def test_similarity_is_one_answer_without_some_vectors(spark):
    items = spark.createDataFrame([(i, [float(i == 2), float(i != 2), 1.0]) for i in (2, 3, 4, 6)], "anime_idx int, vec array<double>")
    cand = spark.createDataFrame([(0, 2), (0, 5), (0, 6)], "user_idx int, anime_idx int")
    past = spark.createDataFrame([(0, 3, 0), (0, 5, 1), (0, 4, 2)], "user_idx int, anime_idx int, pos int")
    got = [sorted(map(tuple, features.history_similarity(cand, past, items, broadcast_bytes=b).collect())) for b in (1 << 20, 0)]
    assert got[0] == got[1] == [(0, 2, 1.0, 1.0, 1.0), (0, 5, 0.0, 0.0, 0.0), (0, 6, 2.0, 2.0, 2.0)]


def test_repeated_cluster_names_are_numbered_and_noise_has_none(spark):
    df = spark.createDataFrame(
        [(k, lab, f"t{k}", ["war"], ["sea"], ["old"], k, k, "war") for k, lab in enumerate([0, 0, 1, 1, 2, -1])]
        + [(6, 3, "t6", ["sun"], ["sky"], [], 6, 6, "sun")],
        "anime_idx int, label int, title string, genres array<string>, themes array<string>, demographics array<string>, "
        "popularity int, mal_id int, primary_genre string")
    same = [(0, "{}"), (1, "{} (2)"), (2, "{} (3)")]
    for name in (atlas.name_lift, atlas.name_tfidf, atlas.name_demographic):
        got = dict(rows(name(df), "label", "name"))
        assert set(got) == {0, 1, 2, 3} and [(k, got[k]) for k in (0, 1, 2)] == [(k, t.format(got[0])) for k, t in same], name
        assert got[3] != got[0] and "(" not in got[3]
    titles = atlas.name_exemplar(df.withColumn("title", F.lit("one title")))
    assert rows(titles, "label", "name") == [(0, "one title"), (1, "one title (2)"), (2, "one title (3)"), (3, "one title (4)")]


def test_noise_is_neither_anchor_nor_site(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (0, 2.0, 4.0), (1, 9.0, 9.0), (-1, 5.0, 5.0)], "label int, x double, y double")
    assert rows(atlas.label_anchors(pts), "label", "cx", "cy") == [(0, 1.0, 2.0), (1, 9.0, 9.0)]
    anchors = spark.createDataFrame([(0, 0.0, 0.0), (1, 9.0, 9.0), (-1, 5.0, 5.0)], "label int, cx double, cy double")
    cells = spark.createDataFrame([(0, 0, 0.0), (5, 5, 3.0), (2, 2, 2.0)], "ix int, iy int, total double")
    frame = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0)], "x0 double, y0 double, wx double, wy double")
    assert rows(atlas.voronoi(cells, anchors, frame), "ix", "iy", "label") == [(2, 2, 0), (5, 5, 1)]


def test_a_hidden_point_is_not_picked(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0, 900_000), (2, 0.001, 0.0, 10), (3, 0.0005, 0.0, 950_000)],
                                "mal_id int, x double, y double, popularity int")
    recs = spark.createDataFrame([(3,)], "mal_id int")
    drawn = atlas.in_view(pts, recs, 0.0, 0.0, 1.0, 1.0, 1.2)
    assert rows(atlas.nearest_point(drawn, 0.0, 0.0, 400.0), "mal_id") == [(3,)]
    assert rows(atlas.nearest_point(drawn.where("NOT is_rec"), 0.0, 0.0, 400.0), "mal_id") == [(2,)]


def test_diagonal_mixture_is_expectation_maximisation(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0, 0, 0], [2, 0, 1], [0, 2.5, 1]])
    x = np.concatenate([c + rng.normal(size=(150, 3)) * s for c, s in zip(centres, ([1, .3, .5], [.4, 1, .2], [1, 1, .1]))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(5)
    got, trace = estimators.diagonal_mixture(df, "id", "vec", 3, tolerance=1e-5)
    assert len(trace) > 5 and all(b >= a - 1e-9 for a, b in zip(trace, trace[1:]))      # the likelihood never falls
    start = {r.id: r.label for r in estimators.kmeans(df, "id", ["vec"], 3)[0].collect()}
    shares = np.eye(3)[[start[i] for i in range(len(x))]]
    plain = []
    for _ in trace:
        n = shares.sum(axis=0)
        mean = shares.T @ x / n[:, None]
        var = np.stack([(shares[:, [j]] * (x - mean[j]) ** 2).sum(axis=0) / n[j] for j in range(3)]) + 1e-6
        density = np.stack([n[j] / len(x) * np.prod(np.exp(-(x - mean[j]) ** 2 / 2 / var[j]) / np.sqrt(2 * np.pi * var[j]), axis=1)
                            for j in range(3)], axis=1)
        plain.append(np.log(density.sum(axis=1)).mean())
        shares = density / density.sum(axis=1, keepdims=True)
    assert np.allclose(trace, plain, atol=1e-8)
    rows_of = {r.id: r for r in got.collect()}
    found = np.array([rows_of[i].shares for i in range(len(x))])
    assert len(trace) < 100 and len(rows_of) == len(x) and np.allclose(found, shares, atol=1e-6)
    assert all(r.label == int(np.argmax(r.shares)) for r in rows_of.values())


def test_content_vectors_reach_cold_items(spark):
    """Two tastes, told by a feature: cold items rank by it, better than any order that forgets the user."""
    rng = np.random.default_rng(2)
    data = [(u, 2 + i, 9) for u in range(60) for i in range(30) if (u % 2 == i % 2) and rng.random() < .6]
    users, items = estimators.learn_vectors(spark.createDataFrame(data, "user_idx int, anime_idx int, score int"), rank=6, iterations=6)
    feats = spark.createDataFrame([(2 + i, [float(i % 2), float(i % 2 == 0), float(rng.random() < .5)]) for i in range(40)], "anime_idx int, x array<double>")
    model = estimators.fit_content(feats, items, "anime_idx", "x", ridge=0.1)
    got = {r.anime_idx: np.array(r.vec) for r in model.vectors(feats, "anime_idx", "x").collect()}
    assert set(got) == set(range(2, 42))
    known = {r.anime_idx: np.array(r.vec) for r in items.collect()}
    x = np.array([[i % 2, i % 2 == 0, 0, 1] for i in range(30)], float)
    x[:, 2] = [r.x[2] for r in feats.orderBy("anime_idx").limit(30).collect()]
    y = np.stack([known[2 + i] for i in range(30)])
    assert np.allclose(model.coefficients, np.linalg.solve(x.T @ x + np.diag([.1, .1, .1, 1e-9]), x.T @ y), atol=1e-6)
    cold = list(range(32, 42))
    hits = [sum((c - 2) % 2 == r.user_idx % 2 for c in sorted(cold, key=lambda c: -got[c] @ np.array(r.vec))[:5]) for r in users.collect()]
    assert np.mean(hits) / 5 > 0.9                                  # any fixed order reaches .5


def test_content_vectors_tell_items_by_their_studio(spark):
    """items that differ in nothing but their studio."""
    rng = np.random.default_rng(5)
    items = spark.createDataFrame([(2 + i, ["g"], [], ["x" if i % 2 else "y"], "2001-02-03") for i in range(24)],
                                  "anime_idx int, genres array<string>, themes array<string>, studios array<string>, start_date string")
    likes = [(u, 2 + i, 9, "train") for u in range(40) for i in range(20) if u % 2 == i % 2 and rng.random() < .7]
    examples = spark.createDataFrame(likes, "user_idx int, anime_idx int, score int, split string")
    got = {r.anime_idx: np.array(r.vec) for r in log_queries.est_1_content(SimpleNamespace(items=items, examples=examples)).collect()}
    assert len(got) == 24
    assert min(got[22] @ got[2 + i] for i in range(0, 20, 2)) > max(got[22] @ got[2 + i] for i in range(1, 20, 2)) + 0.1     # 22 and 23 are in no example


def _planted_pools(spark, users, seed):
    """Pools in which the cosine is noise; what is relevant is a mix of a feature and its fit to the user."""
    rng = np.random.default_rng(seed)
    data = []
    for u in range(users):
        for i in range(30):
            cos, a, b = rng.random(3)
            taste = 2 * (u % 2) - 1
            odds = 1 / (1 + np.exp(-(6 * a + 4 * taste * (b - .5) - 6)))
            data.append((u, i, float(cos), float(a), float(taste * b), None if rng.random() < .1 else float(rng.random()), int(rng.random() < odds) * int(rng.integers(1, 4))))
    return spark.createDataFrame(data, "user_idx int, anime_idx int, cos double, a double, b double, gap double, label int")


def _ndcg(rows, score, k=10):
    out = []
    for u in {r.user_idx for r in rows}:
        mine = sorted((r for r in rows if r.user_idx == u), key=lambda r: (-score(r), r.anime_idx))
        hit = [float(r.label > 0) for r in mine]
        ideal = sum(1 / np.log2(j + 2) for j in range(min(k, int(sum(hit)))))
        if ideal:
            out.append(sum(h / np.log2(j + 2) for j, h in enumerate(hit[:k])) / ideal)
    return np.mean(out)


def test_listwise_ranker_beats_the_cosine(spark):
    names = ["cos", "a", "b", "gap"]
    model = ranker.fit(_planted_pools(spark, 160, 1).repartition(6), names, trees=12)
    held = _planted_pools(spark, 60, 2)
    rows_ = held.collect()
    pred = {(r.user_idx, r.anime_idx): r.pred for r in model.score(held, ["user_idx", "anime_idx"]).collect()}
    assert len(pred) == len(rows_)
    ranked, plain = _ndcg(rows_, lambda r: pred[r.user_idx, r.anime_idx]), _ndcg(rows_, lambda r: r.cos)
    assert ranked > plain + 0.15
    gains = dict(zip(names, model.importances()))
    assert gains["a"] > gains["b"] > max(gains["cos"], gains["gap"]) and abs(sum(gains.values()) - 1) < 1e-9


def test_listwise_gradients_and_splits(spark):
    labels, scores = np.array([0, 3, 1, 0]), np.array([.4, -.2, .4, .1])
    pull, curve = ranker.lambdas(labels, scores)
    place = [0, 3, 1, 2]                                             # a tie stands in pool order
    ideal = 7 / np.log2(2) + 1 / np.log2(3)
    want, bend = np.zeros(4), np.zeros(4)
    for i in range(4):
        for j in range(4):
            if labels[i] > labels[j]:
                p = 1 / (1 + np.exp(scores[i] - scores[j]))
                w = abs(2.0 ** labels[i] - 2.0 ** labels[j]) * abs(1 / np.log2(place[i] + 2) - 1 / np.log2(place[j] + 2)) / ideal
                want[i] += p * w
                want[j] -= p * w
                bend[[i, j]] += p * (1 - p) * w
    assert np.allclose(pull, want) and np.allclose(curve, bend)
    assert not ranker.lambdas(np.array([2, 2]), np.zeros(2))[0].any()
    # the first tree's root against all cuts of all features
    df = _planted_pools(spark, 40, 3)
    names = ["cos", "a", "b", "gap"]
    model = ranker.fit(df.repartition(5), names, trees=1, depth=1)
    rows_ = sorted(df.collect())
    x = np.array([[np.nan if v is None else v for v in (r.cos, r.a, r.b, r.gap)] for r in rows_])
    got = [ranker.lambdas(np.array([r.label for r in rows_ if r.user_idx == u]), np.zeros(30)) for u in range(40)]
    g, h = np.concatenate(got, axis=1)
    codes = model.codes(x)
    best = max((g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1), f, c, g[m].sum() / (h[m].sum() + 1), g[~m].sum() / (h[~m].sum() + 1))
               for f in range(4) for c in range(64) for m in [codes[:, f] <= c] if h[m].sum() > 1e-3 and h[~m].sum() > 1e-3)
    tree = model.trees[0]
    assert (tree.features[0], tree.cuts[0]) == best[1:3] and np.allclose(tree.values, 0.2 * np.array(best[3:]))
    none = ranker.fit(df.where("label > 9"), names, trees=2)
    assert {r.pred for r in none.score(df, ["user_idx", "anime_idx"]).collect()} == {0.0}


def test_layout_is_the_graphs_leading_eigenvectors(spark):
    """A rolled-up sheet: the layout keeps neighbours that the principal components lay on top of others."""
    rng = np.random.default_rng(4)
    n = 300
    t, h = 1.5 * np.pi * (1 + 2 * rng.random(n)), rng.random(n)
    sheet = np.column_stack([t * np.cos(t), t * np.sin(t), 8 * h])
    # distances of the sheet as inner products of unit vectors
    centre = np.column_stack([np.exp(-((sheet - c) ** 2).sum(axis=1) / 12) for c in sheet[::3]])
    items = spark.createDataFrame([(2 + i, v.tolist()) for i, v in enumerate(centre)], "anime_idx int, vec array<double>").repartition(3)
    links = stage(layout.neighbour_graph(items, 6), "test-links")
    a = np.zeros((n, n))
    for r in links.collect():
        a[r.src - 2, r.dst - 2] = r.w
    assert np.allclose(a, a.T) and (a > 0).sum(axis=1).min() >= 6 and not a.diagonal().any()
    d = a.sum(axis=1)
    true = np.linalg.eigvalsh((np.eye(n) + a / np.sqrt(np.outer(d, d))) / 2)[::-1][:3]
    found, values = layout.eigenvectors(links, 3, steps=4, rounds=12, tolerance=1e-4)
    x = np.array([r.x for r in found.orderBy("id").collect()])
    assert np.allclose(x.T @ x, np.eye(3), atol=1e-6) and np.abs(values - true).max() < 5e-3
    places = layout.spectral_layout(links, steps=4, rounds=12)
    flat = estimators.project(items, "anime_idx", "vec").withColumns({c: F.col(c) * 10 for c in "xy"})
    share, plain = (layout.kept_neighbours(links, p, 10).first().share for p in (places, flat))
    assert places.count() == n and share > plain


def test_ranker_sweep_fits_each_setting_once(spark, tmp_path, monkeypatch):
    names, board = ["cos", "a", "b", "gap"], str(tmp_path / "board")
    train, held = _planted_pools(spark, 60, 1), _planted_pools(spark, 30, 2).withColumn("pool_rank", F.col("anime_idx"))
    held = stage(held.withColumn("label", (F.col("label") > 0).cast("int")), "held")
    side = held.groupBy("user_idx").agg(F.sum("label").alias("r_total"))
    grid = estimators.knob_grid(spark, {"trees": [1, 4], "depth": [2], "rate": [0.3]}, {})
    fits, boost = [], ranker.boost
    monkeypatch.setattr(ranker, "boost", lambda data, **s: fits.append(s["trees"]) or boost(data, **s))
    one = grid.where("trees = 1")
    first = tuning.ranker_sweep(train, held, side, names, one.unionByName(one), board, ks=[10])
    assert first.count() == 3 and fits == [1]                           # a setting twice is one run
    both = tuning.ranker_sweep(train, held, side, names, grid, board, ks=[10])
    assert fits == [1, 4] and both.select("run_name").distinct().count() == 2
    again = tuning.ranker_sweep(train, held, side, names, grid, board, ks=[10])
    assert fits == [1, 4] and again.count() == 6
    value = {r.trees: r.value for r in again.where("metric = 'ndcg@10'").collect()}
    model = ranker.fit(train, names, trees=4, depth=2, rate=0.3)
    pred = {(r.user_idx, r.anime_idx): r.pred for r in model.score(held, ["user_idx", "anime_idx"]).collect()}
    assert abs(value[4] - _ndcg(held.collect(), lambda r: pred[r.user_idx, r.anime_idx])) < 1e-9


def test_equal_scores_with_higher_ids_are_not_listed_again(monkeypatch):
    """of items with the k-th score only lower ids may change a list."""
    merged = []
    merge = vectors.Running._merge
    monkeypatch.setattr(vectors.Running, "_merge", lambda self, c: (merged.append(sum(len(n[0]) for n in c["new"])), merge(self, c)))
    state = vectors.Running(3)
    state.add_users(np.arange(2), np.ones((2, 1)), [np.array([11], np.int32), np.zeros(0, np.int32)])
    for at in (10, 20, 30, 0):
        state.see(np.arange(at, at + 10), np.ones((10, 1)))
    got = [b.to_pydict() for b in state.out()][0]
    assert got == {"user_idx": [0] * 3 + [1] * 3, "anime_idx": [0, 1, 2] * 2, "cos": [1.0] * 6}
    assert sum(merged) <= 19 + 20


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _first_join(df) -> str:
    return next(line for line in _plan(df).splitlines() if "Join " in line)


def test_attention_sends_vectors_once(spark):
    """largest logits are joined to rows without vectors; repeated rows of either side count."""
    q = F.array(*[F.lit(float(x)) for x in (1.0, -2.0)])
    hist = spark.createDataFrame([(0, 2), (0, 3), (0, 3), (1, 3), (1, 4), (2, None)], "user_idx int, anime_idx int")
    items = spark.createDataFrame([(2, [1.0, 0.5]), (3, [0.0, 2.0]), (4, [3.0, 1.0]), (4, [1.0, 1.0])], "anime_idx int, vec array<double>")
    df = vectors.pool_attention(hist, items, 2, q)
    assert "anime_idx" in _first_join(df)
    vecs = {2: [[1.0, 0.5]], 3: [[0.0, 2.0]], 4: [[3.0, 1.0], [1.0, 1.0]]}
    got = {r.user_idx: r.vec for r in df.collect()}
    assert set(got) == {0, 1}
    for user, ids in ((0, [2, 3, 3]), (1, [3, 4])):
        v = np.array([x for i in ids for x in vecs[i]])
        w = np.exp(v @ [1.0, -2.0] / np.sqrt(2))
        assert np.allclose(got[user], (w[:, None] * v).sum(axis=0) / w.sum())


def test_a_dropped_history_is_drawn_once_a_row(spark):
    """the draw is no part of what is done per entry."""
    users = spark.createDataFrame([(0, [2, 3, 4])], "user_idx int, history_ids array<int>")
    ex = spark.createDataFrame([(0, 3)], "user_idx int, anime_idx int")
    df = sampling.anchor_history(ex, users, 4, 0.5, 1)
    assert not any("drop" in part[:200] and "md5" in part[:200] for part in _plan(df).split("transform(ids")[1:])
    masks = [sampling.anchor_history(ex, users, 4, share, 1).first().mask for share in (0.0, 1.0)]
    assert masks == [[True, False, True, False], [False] * 4]


def test_items_are_looked_up_when_a_key_is_one_row(spark):
    """the log meets the catalogue after its last rows are found; repeated items do not repeat them."""
    log = spark.createDataFrame([("a", 1, "dropped", 1, 1), ("a", 1, "watching", 5, 2), ("a", 9, "watching", 5, 1), ("b", 1, "watching", 5, 1),
                                 ("c", 1, "unknown", 5, 1), (None, 1, "watching", 5, 1), ("a", None, "watching", 5, 1)],
                                "username string, anime_id long, status string, score int, ord int")
    names = spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "username string")
    known = spark.createDataFrame([(1,), (1,), (2,), (None,)], "mal_id long")
    df = cleaning.clean_ratings(log, names, known)
    assert rows(df, "username", "anime_id", "status", "score") == [("a", 1, "watching", 5)]
    lines = _plan(df).splitlines()
    assert min(i for i, x in enumerate(lines) if "Join " in x) < min(i for i, x in enumerate(lines) if "Window" in x)


def test_rows_that_do_not_count_never_meet_the_items(spark):
    """users are joined first."""
    log = spark.createDataFrame([("a", 5, "watching", 9), ("a", 5, "plan_to_watch", 0), ("b", 6, "plan_to_watch", 0), ("c", 5, "watching", 9)],
                                "username string, anime_id long, status string, score int")
    items = spark.createDataFrame([(5, 2), (6, 3)], "mal_id long, anime_idx int")
    users = spark.createDataFrame([("a", 0, "train"), ("b", 1, "val")], "username string, user_idx int, split string")
    df = splits.interactions(log, items, users)
    assert df.columns == ["user_idx", "anime_idx", "is_pos", "is_hardneg", "score", "split"]
    assert rows(df, "user_idx", "anime_idx", "score", "split") == [(0, 2, 9, "train"), (1, 3, 0, "val")]
    assert "mal_id" in _first_join(df)


def test_dense_index_compares_a_key_with_few_points(spark):
    """a slice of the split points, not all 256."""
    from shelfwise.functions.keys import dense_index
    df = dense_index(spark.range(6000).select((F.col("id") * 7 % 6007).alias("k")), "k", "i")
    want = {k: i for i, k in enumerate(sorted(i * 7 % 6007 for i in range(6000)))}
    assert {r.k: r.i for r in df.collect()} == want
    assert "slice(" in _plan(df)


def test_ranker_is_fitted_on_every_eligible_user(spark, monkeypatch):
    """F16, F17, F18: no bound on the users of the training features."""
    monkeypatch.setattr(world, "FIT_USERS", 3, raising=False)
    w = world.World(spark, "/root/testdata/sf0.001")
    users = w.train_split.select("user_idx").distinct().count()
    assert users > 3 and w.train_features.select("user_idx").distinct().count() == users


def test_only_groups_that_pull_are_packed(spark):
    """gradients of many groups at once; a group of equal labels counts for the bins alone."""
    names = ["cos", "a", "b", "gap"]
    df = stage(_planted_pools(spark, 30, 6).withColumn("label", F.when(F.col("user_idx") % 3 == 0, 2).otherwise(F.col("label"))), "even-pools")
    uneven = df.groupBy("user_idx").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").count()
    data = ranker.prepare(df, names)
    assert 0 < data.packed.count() == uneven <= 20
    assert np.allclose(data.edges[0], np.unique(df.approxQuantile(["cos"], [i / 64 for i in range(1, 64)], 0.002)[0]))
    rng = np.random.default_rng(7)
    sizes = np.array([5, 0, 30, 1, 12])
    labels, scores = rng.integers(0, 4, sizes.sum()), np.round(rng.standard_normal(sizes.sum()), 1)
    ends = np.cumsum(sizes)
    alone = np.concatenate([ranker.lambdas(labels[e - n:e], scores[e - n:e]) for n, e in zip(sizes, ends)], axis=1)
    assert np.allclose(ranker.lambdas(labels, scores, sizes), alone)


def test_pieces_that_lie_together_are_left_out(monkeypatch):
    """nearest places meet few pieces, in any order of the users, with ties by index."""
    monkeypatch.setattr(vectors, "SCORE_ITEMS", 128)
    monkeypatch.setattr(vectors, "SCORE_ROWS", 64)
    rng = np.random.default_rng(29)
    xy = np.round(rng.standard_normal((12000, 2)), 2)                       # places that occur twice
    ids = np.arange(5, 12005)
    items, asked = np.column_stack([xy, -(xy ** 2).sum(axis=1) / 2]), rng.choice(12000, 1500, replace=False)
    users = np.column_stack([xy[asked], np.ones(1500)])
    alike = np.concatenate(list(vectors.near_parts(users, vectors.SCORE_ROWS)))
    assert sorted(alike) == list(range(1500))
    state = vectors.Running(6)
    state.add_users(alike, users[alike], [ids[[asked[u]]] for u in alike])
    state.add_all(vectors.near_pieces(ids, items))
    got = {}
    for batch in state.out():
        for u, i, s in zip(*batch.to_pydict().values()):
            got.setdefault(u, []).append((i, s))
    scores = np.round(np.einsum("ud,id->ui", users, items), 6) + 0.0
    scores[np.arange(1500), asked] = -np.inf
    for u in range(0, 1500, 7):
        order = np.lexsort((ids, -scores[u]))[:6]
        assert [i for i, _ in got[u]] == ids[order].tolist() and np.allclose([s for _, s in got[u]], scores[u, order])
    assert state.scored < 0.5 * 1500 * 12000


def test_few_places_of_any_shape():
    rng = np.random.default_rng(31)
    for shape in ((3, 5), (4, 16), (7, 8), (1, 1)):
        for share in (0.0, 0.1, 1.0):
            over = rng.random(shape) < share
            assert vectors.few_places(over).tolist() == np.flatnonzero(over).tolist()


def test_blocks_are_dealt_in_several_waves():
    """F9, F10, F11, F3, F8: blocks are not of one size, so as many as cores leave most cores waiting for the largest."""
    assert 780_000 / vectors.block_size(780_000, 1_140_000, 64, 200, 12, 4096) > 35
    graph = -(-1_200_000 // vectors.block_size(1_200_000, 1_200_000, 64, 15, 12, 4096, 1))
    assert graph * vectors.lane_count(graph, 1_200_000, 15, 12) >= 36
    assert vectors.lane_count(2, 600_000, 200, 8) == 4                      # long lists cost more than waiting
    assert vectors.lane_count(100, 600_000, 15, 8) == 1
