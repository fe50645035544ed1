"""Feature encoding, splits and histories, and sampling tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import encoding as en
from shelfwise.operators import sampling as sm
from shelfwise.operators import splits as sp
from shelfwise.plans.oracle_views import u32
from shelfwise.plans.registry import query


# -- encoding ---------------------------------------------------------------------
@query("fea_1", "SELECT mal_id, genres, themes, studios, demographics FROM items")
def fea_1(w):
    return en.with_lists(w.details).select("mal_id", "genres", "themes", "studios", "demographics")


@query("fea_2", "SELECT mal_id, anime_idx FROM items")
def fea_2(w):
    return en.index_items(w.details).select("mal_id", "anime_idx")


@query("fea_3", "SELECT d.mal_id, coalesce(c.code, 0) AS source_id FROM details d LEFT JOIN source_codes c ON d.source = c.value")
def fea_3(w):
    return en.encode(w.details, "source", en.vocabulary(w.details, "source"), "source_id").select("mal_id", "source_id")


@query("fea_4", "SELECT d.mal_id, coalesce(c.code, 0) AS demo_id FROM items d LEFT JOIN demo_codes c ON d.demographics[1] = c.value")
def fea_4(w):
    return en.encode_first_tag(w.items, "demographics", "demo_id").select("mal_id", "demo_id")


@query("fea_5", "SELECT anime_idx, genres_multihot FROM item_feats")
def fea_5(w):
    return en.multi_hot(w.items, "genres", "genres_multihot").select("anime_idx", "genres_multihot")


@query("fea_6", "SELECT anime_idx, studio_ids FROM item_feats")
def fea_6(w):
    return en.multi_ids(w.items, "studios", "studio_ids").select("anime_idx", "studio_ids")


@query("fea_7", "SELECT anime_idx, startyear_bucket, episodes_bucket FROM item_feats")
def fea_7(w):
    return w.items.select("anime_idx", en.era_bucket(F.col("start_date")).alias("startyear_bucket"),
                          en.episode_bucket(F.col("episodes")).alias("episodes_bucket"))


_FEATS = ", ".join(en.ITEM_FEATURES)


@query("fea_8", f"""SELECT {_FEATS} FROM item_feats UNION ALL
SELECT i, 0, 0, 0, 0, 0, 0, [CAST(0 AS TINYINT) FOR t IN range(g)],
       [CAST(0 AS TINYINT) FOR t IN range(h)], [0] FROM (SELECT CAST(unnest([0, 1]) AS INTEGER) AS i), (SELECT len(tags) + 1 AS g FROM genre_tags), (SELECT len(tags) + 1 AS h FROM theme_tags)""")
def fea_8(w):
    return en.with_special_rows(en.item_features(w.items))


@query("fea_9", "SELECT anime_idx, mal_id, start_date FROM cold")
def fea_9(w):
    return en.cold_items(w.items)


@query("fea_10", """SELECT feature, actual, CAST(expected AS BIGINT) AS expected, actual = expected AS ok FROM (
SELECT unnest(['genres_multihot', 'themes_multihot', 'type_id', 'rating_id']) AS feature, unnest([a, b, c, d]::BIGINT[]) AS actual, unnest([9, 4, 7, 4]) AS expected FROM (
SELECT max(len(genres_multihot)) AS a, max(len(themes_multihot)) AS b, max(type_id) + 1 AS c, max(rating_id) + 1 AS d FROM item_feats))""")
def fea_10(w):
    return en.size_drift(en.item_features(w.items), {"genres_multihot": 9, "themes_multihot": 4, "type_id": 7, "rating_id": 4})


@query("fea_11", "SELECT username, gender_id FROM profile_codes")
def fea_11(w):
    return en.encode(w.profiles, "gender", en.vocabulary(w.profiles, "gender"), "gender_id").select("username", "gender_id")


@query("fea_12", "SELECT username, joined_bucket FROM profile_codes")
def fea_12(w):
    """Cohort from the printed join date."""
    text = F.concat(F.lit("Dec 1, "), F.col("joined_year").cast("string"))
    return w.profiles.select("username", en.cohort(en.joined_year(text)).alias("joined_bucket"))


@query("fea_13", "SELECT user_idx, split, gender_id, joined_bucket FROM user_feats")
def fea_13(w):
    return en.user_features(w.split, w.encoded_profiles)


@query("fea_14", """SELECT 'gender_id' AS feature, gender_id AS code, count(*) AS n FROM user_feats GROUP BY gender_id
UNION ALL SELECT 'joined_bucket', joined_bucket, count(*) FROM user_feats GROUP BY joined_bucket""")
def fea_14(w):
    feats = en.user_features(w.split, w.encoded_profiles)
    long = feats.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("code"))
                                            for c in ("gender_id", "joined_bucket")])).alias("e")).select("e.*")
    return long.groupBy("feature", "code").agg(F.count("*").alias("n"))


@query("fea_15", "SELECT doc_id, coalesce(length(trim(text)), 0) < 50 OR coalesce(lower(trim(text)) IN ('no synopsis yet', 'tba'), false) AS low_info FROM documents")
def fea_15(w):
    return w.table("documents").select("doc_id", en.low_information(F.col("text"), ["No synopsis yet", "TBA"]).alias("low_info"))


@query("fea_16", """SELECT c_name AS username, CASE WHEN c_mktsegment = 'BUILDING' THEN (SELECT code FROM gender_codes WHERE gender = 'Female') ELSE 0 END AS gender_id,
CASE WHEN c_custkey % 3 = 0 THEN 4 WHEN 2010 + c_custkey % 9 <= 2012 THEN 0 WHEN 2010 + c_custkey % 9 <= 2016 THEN 1 ELSE 2 END AS joined_bucket FROM customer""")
def fea_16(w):
    """New profiles against stored codes: a value never seen before gets 0."""
    new = w.table("customer").select(
        F.col("c_name").alias("username"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Female").otherwise("Undisclosed").alias("gender"),
        F.when(F.col("c_custkey") % 3 != 0, 2010 + F.col("c_custkey") % 9).cast("int").alias("joined_year"))
    return en.encode_profiles(new, en.vocabulary(w.profiles, "gender"))


@query("fea_17", """SELECT 'type' AS feature, value, code FROM type_codes UNION ALL SELECT 'source', value, code FROM source_codes
UNION ALL SELECT 'rating', value, code FROM rating_codes UNION ALL SELECT 'demographics', value, code FROM demo_codes
UNION ALL SELECT 'genres', unnest(tags), CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) FROM genre_tags
UNION ALL SELECT 'themes', unnest(tags), CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) FROM theme_tags
UNION ALL SELECT 'studios', unnest(tags), CAST(generate_subscripts(tags, 1) + 1 AS INTEGER) FROM studio_tags
UNION ALL SELECT 'gender', gender, code FROM gender_codes""")
def fea_17(w):
    return en.vocabulary_spec(w.items, w.profiles)


# -- splits and histories ------------------------------------------------------------
@query("spl_1", """SELECT username, anime_id, status IN ('completed', 'watching') AND NOT (score BETWEEN 1 AND 4) AS is_pos,
status = 'dropped' OR score BETWEEN 1 AND 4 AS is_hardneg FROM cleaned""")
def spl_1(w):
    return w.cleaned.select("username", "anime_id", sp.is_positive().alias("is_pos"), sp.is_hard_negative().alias("is_hardneg"))


@query("spl_2", "SELECT username, n_pos, n_hardneg FROM counts")
def spl_2(w):
    return sp.label_counts(w.cleaned)


@query("spl_3", """SELECT count(*) AS n_users, count(*) FILTER (WHERE n_pos = 0) AS n_zero, count(*) FILTER (WHERE n_pos >= 1) AS n_keep,
count(*) FILTER (WHERE n_pos >= 11) AS n_eval, sum(n_pos)::BIGINT AS total_pos, sum(n_hardneg)::BIGINT AS total_hardneg FROM counts""")
def spl_3(w):
    return sp.eligibility(w.counts)


@query("spl_4", "SELECT username, n_pos, n_hardneg, split FROM split")
def spl_4(w):
    return sp.assign_split(w.counts)


@query("spl_5", "SELECT username, user_idx FROM split")
def spl_5(w):
    return sp.index_users(sp.assign_split(w.counts)).select("username", "user_idx")


@query("spl_6", "SELECT user_idx, anime_idx, is_pos, is_hardneg, score, split FROM base")
def spl_6(w):
    return sp.interactions(w.cleaned, w.items, w.split)


@query("spl_7", "SELECT user_idx, list(anime_idx ORDER BY anime_idx) AS seen_ids FROM seen GROUP BY user_idx")
def spl_7(w):
    return sp.seen_sets(w.base)


@query("spl_8", "SELECT user_idx, anime_idx, score, split FROM examples WHERE split IN ('val_cold', 'test_cold')")
def spl_8(w):
    return sp.cold_queries(w.base, w.cold)


@query("spl_9", "SELECT user_idx, anime_idx, tie, CAST(tie_rank AS INTEGER) AS tie_rank, n_warm FROM warm")
def spl_9(w):
    return sp.warm_positives(w.base, w.cold).select("user_idx", "anime_idx", "tie", "tie_rank", "n_warm")


@query("spl_10", "SELECT user_idx, anime_idx, is_query FROM marked")
def spl_10(w):
    return sp.mark_queries(sp.warm_positives(w.base, w.cold)).select("user_idx", "anime_idx", "is_query")


@query("spl_11", "SELECT user_idx, anime_idx, score, split FROM examples WHERE split IN ('train', 'val', 'test')")
def spl_11(w):
    return sp.warm_examples(w.marked)


@query("spl_12", "SELECT user_idx, history_ids, history_scores FROM hist")
def spl_12(w):
    return sp.histories(w.history_rows)


@query("spl_13", "SELECT user_idx, hard_neg_ids FROM hardneg")
def spl_13(w):
    return sp.hard_negatives(w.base, w.cold)


@query("spl_14", "SELECT user_idx, split, gender_id, joined_bucket, history_ids, history_scores, hard_neg_ids FROM users")
def spl_14(w):
    return sp.wide_users(en.user_features(w.split, w.encoded_profiles), sp.histories(w.history_rows),
                         sp.hard_negatives(w.base, w.cold))


@query("spl_15", """SELECT min(len(history_ids)) AS min_len, max(len(history_ids)) AS max_len, count(*) FILTER (WHERE len(history_ids) = 0) AS n_empty,
CAST(floor(median(len(history_ids))) AS BIGINT) AS median_len FROM users""")
def spl_15(w):
    return sp.history_lengths(w.users)


@query("spl_16", "SELECT anime_idx, mal_id, is_cold FROM item_index")
def spl_16(w):
    return sp.item_index(w.items, w.cold)


@query("spl_17", "SELECT split, count(*) AS n_queries, count(DISTINCT user_idx) AS n_users FROM examples WHERE split IN ('val', 'test', 'val_cold') GROUP BY split")
def spl_17(w):
    return sp.evaluation_export(w.examples).groupBy("split").agg(
        F.count("*").alias("n_queries"), F.count_distinct("user_idx").alias("n_users"))


_SAMPLE_USERS = f"SELECT user_idx FROM users WHERE split = 'train' AND len(history_ids) >= 5 ORDER BY {u32(chr(39) + '42:' + chr(39) + ' || user_idx')}, user_idx LIMIT 300"


@query("spl_18", _SAMPLE_USERS)
def spl_18(w):
    return sp.sample_train_users(w.users, 300).select("user_idx")


_KEYED = f"""SELECT user_idx, anime_idx, score, pos, n, row_number() OVER (PARTITION BY user_idx ORDER BY k, pos) AS r FROM (
SELECT user_idx, anime_idx, score, pos, count(*) OVER (PARTITION BY user_idx) AS n, {u32("'42:' || user_idx || ':' || anime_idx")} AS k
FROM hrows WHERE split = 'train') WHERE n >= 2"""


@query("spl_19", f"""SELECT user_idx, list(anime_idx ORDER BY pos) FILTER (WHERE r > t) AS support_ids, list(score ORDER BY pos) FILTER (WHERE r > t) AS support_scores,
list(anime_idx ORDER BY pos) FILTER (WHERE r <= t) AS target_ids, list(score ORDER BY pos) FILTER (WHERE r <= t) AS target_scores
FROM (SELECT *, least(greatest(round(0.2::DOUBLE * n), 1), n - 1) AS t FROM ({_KEYED})) GROUP BY user_idx""")
def spl_19(w):
    return sp.support_target(w.users.where("split = 'train'"))


# -- sampling -----------------------------------------------------------------------
@query("smp_1", """SELECT i.anime_idx, coalesce(c.n, 0) AS count, i.anime_idx >= 2 AS is_candidate,
CASE WHEN i.anime_idx < 2 THEN '-Infinity'::DOUBLE ELSE round(ln(greatest(coalesce(c.n, 0), 1)::DOUBLE / (SELECT count(*) FROM examples WHERE split = 'train')), 6) END AS log_q
FROM item_index i LEFT JOIN (SELECT anime_idx, count(*) AS n FROM examples WHERE split = 'train' GROUP BY anime_idx) c ON i.anime_idx = c.anime_idx""")
def smp_1(w):
    prior = sm.popularity_prior(w.item_index, w.examples.where("split = 'train'"))
    return prior.withColumn("log_q", F.when(F.col("is_candidate"), F.round("log_q", 6)).otherwise(F.col("log_q")))


@query("smp_2", f"SELECT user_idx, anime_idx, score FROM examples WHERE split = 'train' AND {u32(chr(39) + '12345:' + chr(39) + ' || user_idx')} / 4294967296.0::DOUBLE < 0.15")
def smp_2(w):
    return sm.keep_user_fraction(w.examples.where("split = 'train'"), 0.15, 12345).drop("split")


@query("smp_3", f"""SELECT user_idx, anime_idx, score FROM examples WHERE split = 'train'
QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY {u32("'42:3:' || user_idx || ':' || anime_idx")}, anime_idx) <= 4""")
def smp_3(w):
    return sm.cap_per_user(w.examples.where("split = 'train'"), 4, 42, 3).drop("split")


@query("smp_4", """SELECT user_idx, [coalesce(history_ids[i + 1], 0) FOR i IN range(8)] AS ids, [coalesce(history_scores[i + 1], 0) FOR i IN range(8)] AS scores,
[i < len(history_ids) FOR i IN range(8)] AS mask FROM users""")
def smp_4(w):
    return sm.history_prefix(w.users, 8)


_TRAIN_ROWS = "SELECT e.user_idx, e.anime_idx, u.history_ids, u.hard_neg_ids FROM examples e JOIN users u ON e.user_idx = u.user_idx WHERE e.split = 'train'"
_PLACE = u32("'7:' || user_idx || ':' || anime_idx || ':' || i")


@query("smp_5", f"""SELECT user_idx, anime_idx, ids, [kept AND a <> anime_idx AND a <> 0 FOR a IN ids] AS mask FROM (
SELECT user_idx, anime_idx, {u32("'7:drop:' || user_idx || ':' || anime_idx")} / 4294967296.0::DOUBLE >= 0.2 AS kept,
[coalesce(history_ids[CASE WHEN len(history_ids) > 6 THEN CAST(floor({_PLACE} / 4294967296.0::DOUBLE * len(history_ids)) AS INTEGER) ELSE i END + 1], 0) FOR i IN range(6)] AS ids
FROM ({_TRAIN_ROWS}))""")
def smp_5(w):
    return sm.anchor_history(w.examples.where("split = 'train'"), w.users, 6, 0.2, 7)


@query("smp_6", f"""SELECT user_idx, anime_idx, [coalesce(d[i + 1], 0) FOR i IN range(3)] AS hard_neg_ids, [i < len(hard_neg_ids) FOR i IN range(3)] AS mask FROM (
SELECT *, [x.id FOR x IN list_sort([{{'k': {u32("'7:' || user_idx || ':' || anime_idx || ':' || h")}, 'id': h}} FOR h IN hard_neg_ids])] AS d FROM ({_TRAIN_ROWS}))""")
def smp_6(w):
    return sm.anchor_hard_negatives(w.examples.where("split = 'train'"), w.users, 3, 7)
