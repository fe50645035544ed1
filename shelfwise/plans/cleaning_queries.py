"""Sources and sinks, cleaning and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.functions.staging import stage_root
from shelfwise.operators import cleaning as cl
from shelfwise.operators import splits as sp
from shelfwise.plans.registry import query
from shelfwise.sources import files

LISTS = ["genres", "studios", "themes", "demographics"]


def _scratch(w, name: str) -> str:
    return f"{stage_root(w.spark)}/{name}-{uuid.uuid4().hex}"


# -- sources and sinks -----------------------------------------------------------
@query("src_1", "SELECT mal_id, title, genres, concat('About \"', title, '\"', chr(10), 'Type: ', type) AS synopsis FROM details")
def src_1(w):
    """Catalogue CSV with quoted multi-line text, written and read back."""
    path = _scratch(w, "catalogue-csv")
    text = F.concat(F.lit('About "'), "title", F.lit('"\nType: '), "type")
    files.write_csv(w.details.select("mal_id", "title", "genres", text.alias("synopsis")), path)
    return files.read_catalogue_csv(w.spark, path, "mal_id BIGINT, title STRING, genres STRING, synopsis STRING")


@query("src_2", "SELECT username, anime_id, status, score FROM ratings_raw WHERE score > 0")
def src_2(w):
    """Rating log as splittable CSV with a fixed schema."""
    path = _scratch(w, "ratings-csv")
    files.write_csv(w.ratings.drop("ord"), path)
    return files.read_ratings_csv(w.spark, path).where("score > 0")


@query("src_3", "SELECT mal_id, type, members FROM details")
def src_3(w):
    return files.columns(w.details, ["mal_id", "type", "members"])


@query("src_4", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 45")
def src_4(w):
    return files.scan_parquet(w.spark, f"{w.sf_dir}/lineitem.parquet", F.col("l_quantity") >= 45,
                              ["l_orderkey", "l_partkey", "l_quantity"])


@query("src_5", "SELECT user_idx, anime_idx, score, split FROM examples WHERE split = 'val'")
def src_5(w):
    path = _scratch(w, "examples")
    files.write_partitioned(w.examples, path, ["split"])
    return files.read_partitioned(w.spark, path, w.examples.schema).where("split = 'val'")


@query("src_6", "SELECT mal_id, title, members, genres[1] AS first_genre, len(genres) AS n_genres FROM items")
def src_6(w):
    """Gzipped JSON lines, one nested object per item."""
    path = _scratch(w, "details-jsonl")
    nested = w.items.select("mal_id", "title", F.struct("members", "favorites").alias("stats"),
                            F.transform("genres", lambda g: F.struct(g.alias("name"))).alias("genres"))
    files.write_json_lines(nested, path)
    schema = "mal_id BIGINT, title STRING, stats STRUCT<members: BIGINT, favorites: BIGINT>, genres ARRAY<STRUCT<name: STRING>>"
    back = files.read_json_lines(w.spark, path, schema)
    return back.select("mal_id", "title", "stats.members", F.get("genres.name", F.lit(0)).alias("first_genre"),
                       F.size("genres").cast("bigint").alias("n_genres"))


@query("src_7", "SELECT username, anime_id, status, score FROM ratings_raw")
def src_7(w):
    """A directory of appended CSV files read as one log."""
    path = _scratch(w, "log-csv")
    log = w.ratings.drop("ord")
    for even in (0, 1):
        files.append_csv(log.where(F.col("anime_id") % 2 == even), path)
    return files.read_ratings_csv(w.spark, path)


@query("src_8", "SELECT username, status, count(*) AS n FROM clean GROUP BY username, status")
def src_8(w):
    path = _scratch(w, "clean-csv")
    files.write_csv(w.clean.select("username", "anime_id", "status", "score"), path)
    return files.read_ratings_csv(w.spark, path).groupBy("username", "status").agg(F.count("*").alias("n"))


@query("src_9", "SELECT user_idx, history_ids, history_scores FROM hist")
def src_9(w):
    path = _scratch(w, "hist-parquet")
    files.write_parquet(sp.histories(w.history_rows), path)
    return w.spark.read.parquet(path)


@query("src_10", "SELECT i.anime_idx, [round(CAST(x AS DOUBLE), 6) FOR x IN e.embedding] AS vec FROM items i JOIN embeddings e ON i.mal_id % (SELECT count(*) FROM embeddings) = e.vec_id")
def src_10(w):
    from shelfwise.functions.vectors import rounded
    from shelfwise.sources import adapters
    vec = adapters.item_vectors(w.spark, w.sf_dir, w.items)
    path = _scratch(w, "vectors")
    files.write_parquet(files.vector_table(vec, "anime_idx", "vec"), path)
    return w.spark.read.parquet(path).select("anime_idx", rounded(F.col("vec").cast("array<double>")).alias("vec"))


@query("src_11", """SELECT 'num_items' AS name, CAST(count(*) + 2 AS VARCHAR) AS value FROM items
UNION ALL SELECT 'num_users', CAST(count(*) AS VARCHAR) FROM split
UNION ALL SELECT 'n_cold', CAST(count(*) AS VARCHAR) FROM cold
UNION ALL SELECT 'seed', '42' UNION ALL SELECT 'hard_neg_cap', '64'
UNION ALL SELECT 'eval_min_positives', '11' UNION ALL SELECT 'eval_query_frac', '0.2'""")
def src_11(w):
    """Build facts and protocol settings as a (name, value) side table, through JSON."""
    path = _scratch(w, "spec")
    facts = {"num_items": w.items.agg(F.count("*") + 2).scalar(), "num_users": w.split.agg(F.count("*")).scalar(),
             "n_cold": w.cold.agg(F.count("*")).scalar(), "seed": F.lit(sp.SEED),
             "hard_neg_cap": F.lit(sp.HARD_NEGATIVE_CAP), "eval_min_positives": F.lit(sp.EVAL_MIN_POSITIVES),
             "eval_query_frac": F.lit(sp.QUERY_FRACTION)}
    files.write_json(files.facts_table(w.spark, facts), path)
    return w.spark.read.schema("name STRING, value STRING").json(path)


@query("src_12", """SELECT label, to_json({'mal_id': list(mal_id ORDER BY mal_id), 'title': list(title ORDER BY mal_id)}) AS payload
FROM (SELECT type AS label, mal_id, title FROM details) GROUP BY label""")
def src_12(w):
    """Column-oriented JSON payload per type: parallel arrays in key order."""
    return files.columnar_payload(w.details.withColumnRenamed("type", "label"), ["label"], "mal_id", ["title"])


# -- cleaning ---------------------------------------------------------------------
@query("cln_1", "SELECT mal_id, title, type FROM details")
def cln_1(w):
    wide = w.details.select("mal_id", "title", "type", F.lit("x").alias("url"), F.lit("y").alias("season"))
    return cl.drop_columns(wide, cl.DETAILS_DROP)


@query("cln_2", "SELECT username, anime_id, status, score FROM ratings_raw WHERE status <> 'unknown'")
def cln_2(w):
    return cl.known_status(w.ratings).drop("ord")


@query("cln_3", "SELECT username, anime_id, status, score FROM ratings_raw WHERE username IN (SELECT username FROM profiles) AND anime_id IN (SELECT mal_id FROM details)")
def cln_3(w):
    return cl.drop_orphans(w.ratings, w.profiles, w.details).select("username", "anime_id", "status", "score")


@query("cln_4", "SELECT username, anime_id, status, score FROM ratings_raw QUALIFY row_number() OVER (PARTITION BY username, anime_id ORDER BY seq DESC) = 1")
def cln_4(w):
    return cl.keep_last(w.ratings, ["username", "anime_id"], "ord")


@query("cln_5", "SELECT count(*) AS n_ratings, count(DISTINCT username) AS n_users, count(DISTINCT anime_id) AS n_items FROM ratings_raw")
def cln_5(w):
    return cl.snapshot(w.ratings)


@query("cln_6", "SELECT status, count(*) AS n FROM ratings_raw GROUP BY status")
def cln_6(w):
    return cl.value_counts(w.ratings, "status")


@query("cln_7", "SELECT score, count(*) AS n FROM ratings_raw WHERE score > 0 GROUP BY score ORDER BY score")
def cln_7(w):
    return cl.score_histogram(w.ratings)


@query("cln_8", """SELECT 'user' AS side, username AS key, count(*) AS n FROM ratings_raw GROUP BY username
UNION ALL SELECT 'item', CAST(anime_id AS VARCHAR), count(*) FROM ratings_raw GROUP BY anime_id""")
def cln_8(w):
    users = cl.value_counts(w.ratings, "username").select(F.lit("user").alias("side"), F.col("username").alias("key"), "n")
    items = cl.value_counts(w.ratings, "anime_id").select(
        F.lit("item").alias("side"), F.col("anime_id").cast("string").alias("key"), "n")
    return users.unionByName(items)


def _rounded_stats(df):
    return df.withColumns({c: F.round(c, 6) for c in ("mean_score", "std_score")})


@query("cln_9", "SELECT username, n, watched, rated, round(mean_score, 6) AS mean_score, round(std_score, 6) AS std_score FROM stats")
def cln_9(w):
    return _rounded_stats(w.stats)


@query("cln_10", "SELECT username, spam_pos, const_rater, physical, nan_lister, flagged FROM flagged_low")
def cln_10(w):
    return w.flagged_low.select("username", *cl.RULE_NAMES, "flagged")


@query("cln_11", """SELECT 'spam_pos' AS rule, count(*) FILTER (WHERE spam_pos) AS total, count(*) FILTER (WHERE spam_pos AND NOT (const_rater OR physical OR nan_lister)) AS exclusive FROM flagged_low
UNION ALL SELECT 'const_rater', count(*) FILTER (WHERE const_rater), count(*) FILTER (WHERE const_rater AND NOT (spam_pos OR physical OR nan_lister)) FROM flagged_low
UNION ALL SELECT 'physical', count(*) FILTER (WHERE physical), count(*) FILTER (WHERE physical AND NOT (spam_pos OR const_rater OR nan_lister)) FROM flagged_low
UNION ALL SELECT 'nan_lister', count(*) FILTER (WHERE nan_lister), count(*) FILTER (WHERE nan_lister AND NOT (spam_pos OR const_rater OR physical)) FROM flagged_low""")
def cln_11(w):
    return cl.rule_contribution(w.flagged_low)


@query("cln_12", "SELECT username, n, watched, rated FROM flagged_low WHERE flagged ORDER BY watched DESC, username LIMIT 20")
def cln_12(w):
    return cl.top_flagged(w.flagged_low).select("username", "n", "watched", "rated")


@query("cln_13", "SELECT username, anime_id FROM clean WHERE username NOT IN (SELECT username FROM flagged WHERE flagged)")
def cln_13(w):
    return cl.without_users(w.clean, w.flagged.where("flagged")).select("username", "anime_id")


@query("cln_14", "SELECT 'user' AS side, username AS key FROM kcore UNION SELECT 'item', CAST(anime_id AS VARCHAR) FROM kcore")
def cln_14(w):
    users, items = cl.k_core(cl.without_users(w.clean, w.flagged.where("flagged")))
    return users.select(F.lit("user").alias("side"), F.col("username").alias("key")).unionByName(
        items.select(F.lit("item").alias("side"), F.col("anime_id").cast("string").alias("key")))


@query("cln_15", """SELECT 'ratings' AS tbl, count(*) AS n FROM cleaned
UNION ALL SELECT 'details', count(*) FROM details WHERE mal_id IN (SELECT anime_id FROM kcore)
UNION ALL SELECT 'profiles', count(*) FROM profiles WHERE username IN (SELECT username FROM kcore)""")
def cln_15(w):
    users, items = w.core
    kept = {"ratings": cl.restrict(w.clean, users, items),
            "details": w.details.join(items, w.details.mal_id == items.anime_id, "left_semi"),
            "profiles": w.profiles.join(users, "username", "left_semi")}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tbl"), "n") for t, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_DETAIL_COLUMNS = ["mal_id", "title", "type", "source", "score", "scored_by", "rank", "members", "favorites", "popularity",
                   "episodes", "start_date", "genres", "themes", "studios", "demographics", "rating"]


@query("cln_16", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL{' OR ' + c + chr(61) + chr(39) + '[]' + chr(39) if c in LISTS else ''} THEN 1 ELSE 0 END) * 100, 2) AS missing_pct FROM details"
    for c in _DETAIL_COLUMNS))
def cln_16(w):
    return cl.missing_percent(w.details)


@query("cln_17", """SELECT metric, round(b, 6) AS before, round(a, 6) AS after, round(CASE WHEN b <> 0 THEN (a - b) / b * 100 END, 6) AS delta_pct FROM (
  SELECT unnest(['n_users_profiles','n_users_ratings','n_anime_details','n_anime_ratings','n_ratings','sparsity','mean_per_user','mean_per_anime']) AS metric,
         unnest([p, u, d, i, n, 1 - n / (u * i), n / u, n / i]::DOUBLE[]) AS b FROM (
    SELECT count(*)::DOUBLE AS n, count(DISTINCT username)::DOUBLE AS u, count(DISTINCT anime_id)::DOUBLE AS i,
           (SELECT count(*) FROM profiles)::DOUBLE AS p, (SELECT count(*) FROM details)::DOUBLE AS d FROM ratings_raw)) JOIN (
  SELECT unnest(['n_users_profiles','n_users_ratings','n_anime_details','n_anime_ratings','n_ratings','sparsity','mean_per_user','mean_per_anime']) AS metric,
         unnest([p, u, d, i, n, 1 - n / (u * i), n / u, n / i]::DOUBLE[]) AS a FROM (
    SELECT count(*)::DOUBLE AS n, count(DISTINCT username)::DOUBLE AS u, count(DISTINCT anime_id)::DOUBLE AS i,
           (SELECT count(*) FROM profiles WHERE username IN (SELECT username FROM kcore))::DOUBLE AS p,
           (SELECT count(*) FROM details WHERE mal_id IN (SELECT anime_id FROM kcore))::DOUBLE AS d FROM cleaned)) USING (metric)""")
def cln_17(w):
    users, items = w.core
    kept = w.profiles.join(users, "username", "left_semi"), w.details.join(items, w.details.mal_id == items.anime_id, "left_semi")
    report = cl.before_after((w.ratings, w.profiles, w.details), (w.cleaned, *kept))
    return report.select("metric", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta_pct")])


@query("cln_18", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 6) AS pct_null, "
    f"round(avg(CASE WHEN {c} = '[]' THEN 1 ELSE 0 END) * 100, 6) AS pct_empty, "
    f"round(avg(CASE WHEN {c} IS NULL OR {c} = '[]' THEN 1 ELSE 0 END) * 100, 6) AS pct_missing FROM details" for c in LISTS))
def cln_18(w):
    return cl.empty_list_audit(w.details, LISTS).select(
        "column_name", *[F.round(c, 6).alias(c) for c in ("pct_null", "pct_empty", "pct_missing")])


@query("cln_19", "SELECT type, " + ", ".join(
    f"round(avg(CASE WHEN {c} IS NULL OR {c} = '[]' THEN 1 ELSE 0 END) * 100, 1) AS {c}_empty" for c in LISTS)
    + ", count(*) AS n_anime FROM details GROUP BY type")
def cln_19(w):
    return cl.empty_by_type(w.details, LISTS)


@query("cln_20", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, e AS median_empty, f AS median_full, round(CASE WHEN e <> 0 THEN f / e END, 6) AS ratio FROM "
    f"(SELECT median(members) FILTER (WHERE {c} = '[]') AS e, median(members) FILTER (WHERE {c} <> '[]') AS f FROM details)" for c in LISTS))
def cln_20(w):
    return cl.empty_vs_full_members(w.details, LISTS).withColumn("ratio", F.round("ratio", 6))


_PCTS = [50, 90, 95, 99, 99.5, 99.9, 99.99]


@query("cln_21", "SELECT * FROM (WITH r AS (SELECT watched, row_number() OVER (ORDER BY watched) - 1 AS rk, count(*) OVER () AS n FROM stats) " + " UNION ALL ".join(
    f"SELECT '{name}' AS stat, watched AS value FROM r WHERE rk = floor((n - 1) * {p}::DOUBLE + 0.5)"
    for name, p in [(f"p{p:g}".replace(".", "_"), p / 100) for p in _PCTS] + [("max", 1.0)]) + ")")
def cln_21(w):
    return cl.count_percentiles(w.stats, "watched", _PCTS)


@query("cln_22", "SELECT t AS threshold, count(*) FILTER (WHERE watched > t) AS n_users FROM (SELECT CAST(unnest([10, 20, 30, 40, 50]) AS BIGINT) AS t), stats GROUP BY t")
def cln_22(w):
    return cl.users_above(w.stats, "watched", [10, 20, 30, 40, 50])


@query("cln_23", """SELECT unnest(['spam_pos','const_rater','physical','nan_lister']) AS rule, unnest([a, b, c, d]) AS total FROM (
SELECT count(*) FILTER (WHERE spam_pos) AS a, count(*) FILTER (WHERE const_rater) AS b, count(*) FILTER (WHERE physical) AS c, count(*) FILTER (WHERE nan_lister) AS d
FROM flagged WHERE NOT coalesce(flagged, false))""")
def cln_23(w):
    kept = cl.without_users(w.clean, w.flagged.where("flagged"))
    return cl.rule_contribution(cl.bot_rules(cl.user_stats(kept), cl.BotRules())).select("rule", "total")


@query("cln_24", "SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def cln_24(w):
    """Latest crawl record per natural key, by ingest sequence."""
    return cl.keep_last(w.table("events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")
