"""Recommendation and browsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import browse as br
from shelfwise.operators import recommend as re_
from shelfwise.operators import vectors as ve
from shelfwise.plans.oracle_views import _pool
from shelfwise.plans.registry import query
from shelfwise.plans.world import POOL

D = 64
_FACTS = "mal_id, title, type, year, mal_score, popularity, members, start_date, genres, themes, studios"


# -- recommendation -------------------------------------------------------------------
@query("rec_1", """SELECT s.username, s.user_idx, u.history_ids, u.history_scores, list_sort(list_distinct(list_concat(u.history_ids, u.hard_neg_ids))) AS seen_ids
FROM users u JOIN (SELECT username, user_idx FROM split) s ON u.user_idx = s.user_idx""")
def rec_1(w):
    return re_.stored_history(w.profiles, w.users, w.split)


def animelist_pages(w):
    """The cleaned log as nested list pages, one page per user and status, with some ids outside the catalogue."""
    node = F.struct(F.when(F.col("anime_id") % 29 == 0, F.col("anime_id") + 100000000).otherwise(F.col("anime_id")).alias("id"),
                    F.lit("t").alias("title"))
    entry = F.struct(node.alias("node"), F.struct("status", "score").alias("list_status"))
    pages = w.clean.groupBy("username", "status").agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("page"))
    return pages.select("username", "page")


_LIVE = "SELECT c.username, i.anime_idx, c.status, c.score FROM clean c JOIN items i ON c.anime_id = i.mal_id WHERE c.anime_id % 29 <> 0"


_POS = "FILTER (WHERE status IN ('completed', 'watching') AND NOT (score BETWEEN 1 AND 4))"


@query("rec_2", f"""SELECT username, coalesce(list(anime_idx ORDER BY score DESC, anime_idx) {_POS}, []) AS history_ids,
coalesce(list(score ORDER BY score DESC, anime_idx) {_POS}, []) AS history_scores, list(DISTINCT anime_idx ORDER BY anime_idx) AS seen_ids FROM ({_LIVE}) GROUP BY username""")
def rec_2(w):
    """History and seen set of a list as it comes; a user without positives has an empty history."""
    history, seen = re_.live_history(animelist_pages(w), "page", w.items)
    every = seen.groupBy("username").agg(F.array_sort(F.collect_set("anime_idx")).alias("seen_ids"))
    out = every.join(history, "username", "left")
    return out.select("username", *[F.coalesce(c, F.array().cast(dict(history.dtypes)[c])).alias(c) for c in ("history_ids", "history_scores")], "seen_ids")




@query("rec_3", """SELECT r.username, coalesce(list(DISTINCT i.anime_idx ORDER BY i.anime_idx) FILTER (WHERE i.anime_idx IS NOT NULL), []::INTEGER[]) AS history_ids,
[0 FOR x IN coalesce(list(DISTINCT i.anime_idx ORDER BY i.anime_idx) FILTER (WHERE i.anime_idx IS NOT NULL), []::INTEGER[])] AS history_scores
FROM (SELECT c_name AS username, unnest([(c_custkey * 7 + k * 131) % 2500 FOR k IN range(c_custkey % 4 + 1)]) AS id FROM customer) r LEFT JOIN items i ON r.id = i.mal_id GROUP BY r.username""")
def rec_3(w):
    ids = F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 4).cast("int")), lambda k: (F.col("c_custkey") * 7 + k * 131) % 2500)
    return re_.history_from_ids(w.table("customer").select(F.col("c_name").alias("username"), ids.alias("ids")), "ids", w.items)


@query("rec_4", "SELECT user_idx, anime_idx, cos, CAST(pool_rank AS INTEGER) AS pool_rank FROM (" + _pool(
    "SELECT 0 AS user_idx, [0.125::DOUBLE FOR x IN range(64)] AS vec", "(SELECT 0 AS user_idx, 0 AS anime_idx WHERE false)", 20) + ")")
def rec_4(w):
    """A guest has no history, so the default vector asks."""
    guest = w.spark.range(1).select(F.col("id").cast("int").alias("user_idx"))
    vec = ve.or_default(guest, w.uvec.where("user_idx < 0"), F.array_repeat(F.lit(0.125), D))
    return ve.masked_top_k(vec, w.ivec, w.seen_rows.where("user_idx < 0"), 20)


_EXTRA = "SELECT user_idx, (user_idx * 13) % 2100 AS mal_id FROM evalu"


@query("rec_5", f"SELECT user_idx, anime_idx FROM seen UNION SELECT e.user_idx, i.anime_idx FROM ({_EXTRA}) e JOIN items i ON e.mal_id = i.mal_id")
def rec_5(w):
    extra = w.eval_users.select("user_idx", ((F.col("user_idx") * 13) % 2100).cast("bigint").alias("mal_id"))
    return re_.with_exclusions(w.seen_rows, extra, w.items)


@query("rec_6", "SELECT anime_idx FROM adult")
def rec_6(w):
    return re_.adult_items(w.items)


@query("rec_7", "SELECT user_idx, anime_idx, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, cos, pred FROM mainl")
def rec_7(w):
    return re_.main_list(w.warm_pool.drop("pred"), w.warm_pool, 0.6, 20).withColumn("score", F.round("score", 6))


@query("rec_7_ranked")
def rec_7_ranked(w):
    """The main list as served: warm pool, 29 features, fitted ranker, blend with the cosine."""
    pool = w.warm_pool.drop("pred")
    return re_.main_list(pool, w.ranked(pool), 0.6, 20).withColumns({c: F.round(c, 6) for c in ("score", "pred")})


@query("rec_8", "SELECT user_idx, anime_idx, cos, CAST(pool_rank AS INTEGER) AS pool_rank FROM coldl")
def rec_8(w):
    return re_.cold_list(w.uvec, w.ivec, w.seen_rows, w.cold, 10, w.adult)


_ANCHOR = "SELECT user_idx, CAST(2 + (user_idx * 17) % 1900 AS INTEGER) AS anchor_idx FROM evalu"


@query("rec_9", f"""SELECT p.user_idx, p.anime_idx, p.cos AS anchor_cos, CAST(p.pool_rank AS INTEGER) AS pool_rank, round(list_inner_product(u.vec, i.vec), 6) + 0.0 AS cos FROM (
{_pool(f"SELECT a.user_idx, v.vec FROM ({_ANCHOR}) a JOIN ivec v ON a.anchor_idx = v.anime_idx",
       f"(SELECT user_idx, anime_idx FROM seen UNION SELECT user_idx, anchor_idx FROM ({_ANCHOR}))", 15,
       "SELECT anime_idx, vec FROM ivec WHERE anime_idx NOT IN (SELECT anime_idx FROM cold)")}) p
JOIN uvec u ON p.user_idx = u.user_idx JOIN ivec i ON p.anime_idx = i.anime_idx""")
def rec_9(w):
    asked = w.eval_users.select("user_idx", (2 + (F.col("user_idx") * 17) % 1900).cast("int").alias("anchor_idx"))
    return re_.similar_pool(asked, w.uvec, w.ivec, w.seen_rows, w.cold, 15)


@query("rec_10", f"SELECT user_idx, anime_idx, section, rank, {_FACTS} FROM results")
def rec_10(w):
    return w.results


_FAVS = """SELECT user_idx, anime_idx, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, pos) AS INTEGER) AS fav_rank FROM (
SELECT *, max(above) OVER (PARTITION BY user_idx) AS any_above FROM (SELECT *, coalesce((score > avg(CASE WHEN score > 0 THEN score END) OVER (PARTITION BY user_idx))::INT, 0) AS above FROM ehist))
WHERE above = 1 OR any_above = 0 QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, pos) <= 20"""


@query("rec_11", _FAVS)
def rec_11(w):
    return re_.favourites(w.eval_history)


@query("rec_12", f"""SELECT u.user_idx, round(coalesce(f.x, r.x, u.vec[1]), 4) AS x, round(coalesce(f.y, r.y, u.vec[2]), 4) AS y FROM uvec u
LEFT JOIN (SELECT v.user_idx, avg(c.x) AS x, avg(c.y) AS y FROM ({_FAVS}) v JOIN coords c ON v.anime_idx = c.anime_idx GROUP BY v.user_idx) f ON u.user_idx = f.user_idx
LEFT JOIN (SELECT m.user_idx, avg(c.x) AS x, avg(c.y) AS y FROM mainl m JOIN coords c ON m.anime_idx = c.anime_idx GROUP BY m.user_idx) r ON u.user_idx = r.user_idx""")
def rec_12(w):
    projected = w.uvec.select("user_idx", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))
    return re_.locate(w.eval_users, re_.favourites(w.eval_history), w.main, projected, w.coords)


@query("rec_13", """SELECT e.user_idx, e.split, coalesce(h.n, 0) AS history_count, coalesce(s.n, 0) AS total_entries, 'dataset' AS source, 0.6::DOUBLE AS alpha, 200 AS k_retrieve
FROM evalu e LEFT JOIN (SELECT user_idx, count(*) AS n FROM ehist GROUP BY user_idx) h ON e.user_idx = h.user_idx
LEFT JOIN (SELECT user_idx, count(*) AS n FROM seen GROUP BY user_idx) s ON e.user_idx = s.user_idx""")
def rec_13(w):
    return re_.response_meta(w.split.where("split <> 'train'"), w.eval_history, w.seen_rows, "dataset", 0.6, POOL)


@query("rec_14", f"SELECT h.user_idx, h.anime_idx, h.score, h.pos, {_FACTS} FROM ehist h JOIN facts f ON h.anime_idx = f.anime_idx WHERE h.pos < 5")
def rec_14(w):
    return re_.history_preview(w.eval_history, w.item_index, w.items)


# -- browsing ----------------------------------------------------------------------------
_FACETS = """SELECT DISTINCT user_idx, facet, value FROM (
SELECT user_idx, 'genres' AS facet, unnest(genres) AS value FROM results UNION ALL SELECT user_idx, 'themes', unnest(themes) FROM results
UNION ALL SELECT user_idx, 'studios', unnest(studios) FROM results UNION ALL SELECT user_idx, 'types', type FROM results WHERE type NOT IN ('', '?'))"""


@query("brw_1", _FACETS)
def brw_1(w):
    return br.facet_values(w.results, ["user_idx"])


@query("brw_2", f"""SELECT s.user_idx, s.facet, s.value FROM (SELECT user_idx, unnest(['genres', 'genres', 'studios', 'types']) AS facet, unnest(['red', 'nothing', 'Brand#3', 'PROMO']) AS value FROM evalu) s
JOIN ({_FACETS}) f ON s.user_idx = f.user_idx AND s.facet = f.facet AND s.value = f.value""")
def brw_2(w):
    chosen = [("genres", "red"), ("genres", "nothing"), ("studios", "Brand#3"), ("types", "PROMO")]
    selected = w.eval_users.select("user_idx", F.inline(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.lit(v).alias("value")) for f, v in chosen])))
    return br.keep_present(selected, br.facet_values(w.results, ["user_idx"]), ["user_idx"])


_FILTERS = br.Filters(genres=["hot", "widget"], studios=["Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6", "Brand#7", "Brand#8", "Brand#9", "Brand#10"],
                      types=["PROMO", "SMALL", "LARGE", "ECONOMY"], min_score=5.5)
_LOOSE = br.Filters(themes=["Compact"], min_score=6.0)
_WHERE = f"""list_has_all(genres, ['hot', 'widget']) AND list_has_any(studios, {_FILTERS.studios!r}) AND type IN ('PROMO', 'SMALL', 'LARGE', 'ECONOMY') AND mal_score >= 5.5"""


@query("brw_3", f"""SELECT user_idx, section, rank, mal_id, 'tight' AS kind FROM results WHERE {_WHERE}
UNION ALL SELECT user_idx, section, rank, mal_id, 'loose' FROM results WHERE list_has_all(themes, ['Compact']) AND mal_score >= 6.0""")
def brw_3(w):
    pick = ["user_idx", "section", "rank", "mal_id"]
    tight = w.results.where(br.matches(_FILTERS)).select(*pick, F.lit("tight").alias("kind"))
    return tight.unionByName(w.results.where(br.matches(_LOOSE)).select(*pick, F.lit("loose").alias("kind")))


_SORTS = {("relevance", False): "rank ASC", ("relevance", True): "rank DESC", ("score", False): "mal_score DESC NULLS LAST, rank",
          ("score", True): "mal_score ASC NULLS LAST, rank", ("popularity", False): "popularity ASC NULLS LAST, rank",
          ("popularity", True): "popularity DESC NULLS LAST, rank", ("date", False): "start_date DESC NULLS LAST, rank",
          ("date", True): "start_date ASC NULLS LAST, rank"}


@query("brw_4", " UNION ALL ".join(
    f"SELECT user_idx, section, mal_id, '{s}_{'asc' if a else 'desc'}' AS sorting, CAST(row_number() OVER (PARTITION BY user_idx, section ORDER BY {o}) AS INTEGER) AS position FROM results"
    for (s, a), o in _SORTS.items()))
def brw_4(w):
    parts = [br.sorted_rows(w.results, ["user_idx", "section"], s, a)
             .select("user_idx", "section", "mal_id", F.lit(f"{s}_{'asc' if a else 'desc'}").alias("sorting"), "position") for s, a in _SORTS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("brw_5", """SELECT user_idx, section, mal_id, CAST(p AS INTEGER) AS position FROM (
SELECT *, row_number() OVER (PARTITION BY user_idx, section ORDER BY mal_score DESC NULLS LAST, rank) AS p FROM results) WHERE p <= CASE WHEN section = 'main' THEN 8 ELSE 4 END""")
def brw_5(w):
    rows = br.sorted_rows(w.results, ["user_idx", "section"], "score", False)
    return br.cut(rows, 8, 4).select("user_idx", "section", "mal_id", "position")


@query("brw_6", "SELECT user_idx, section, count(*) AS n FROM results WHERE list_has_all(themes, ['Compact']) AND mal_score >= 6.0 GROUP BY user_idx, section")
def brw_6(w):
    return br.section_counts(w.results.where(br.matches(_LOOSE)), ["user_idx"])


@query("brw_7", """SELECT d.mal_id, d.title, d.mal_id IN (SELECT mal_id FROM items) AS in_corpus FROM (SELECT * FROM details WHERE contains(lower(title), 'hot gear') ORDER BY popularity, mal_id LIMIT 12) d""")
def brw_7(w):
    return br.search_titles(w.details, "Hot Gear", 12, w.items).select("mal_id", "title", "in_corpus")


@query("brw_8", f"SELECT value, value IN ('Brand#12', 'Brand#21') AS selected FROM (SELECT DISTINCT value FROM ({_FACETS}) WHERE facet = 'studios') WHERE contains(lower(value), 'brand#2') OR contains(lower(value), 'brand#2')")
def brw_8(w):
    values = br.facet_values(w.results, ["user_idx"]).where("facet = 'studios'").select("value").distinct()
    return br.facet_options(values, ["Brand#12", "Brand#21"], "BRAND#2")


@query("brw_9", """SELECT r.user_idx, r.section, r.mal_id, CASE WHEN r.mal_id % 5 = 0 THEN NULL WHEN r.mal_id % 2 = 0 THEN 9.5 ELSE r.mal_score END AS mal_score,
CASE WHEN r.mal_id % 2 = 0 AND r.mal_id % 4 <> 0 THEN r.mal_id * 10 ELSE r.members END AS members FROM results r""")
def brw_9(w):
    """Fresh values for even items and every fifth one; a NaN must not shine through."""
    fresh = w.items.where("mal_id % 2 = 0 OR mal_id % 5 = 0").select(
        "mal_id", F.when(F.col("mal_id") % 5 == 0, F.lit(float("nan"))).otherwise(9.5).alias("score"),
        F.when((F.col("mal_id") % 2 == 0) & (F.col("mal_id") % 4 != 0), F.col("mal_id") * 10).alias("members"))
    return br.overlay_fresh(w.results, fresh).select("user_idx", "section", "mal_id", "mal_score", "members")


@query("brw_10", """SELECT mal_id, title, coalesce(mal_score, CASE WHEN e THEN 7.5 END) AS score, CASE WHEN e THEN rank END AS rank, CASE WHEN e THEN 1 ELSE popularity END AS popularity,
type, coalesce(year, CASE WHEN e THEN 1999 END) AS year, CASE WHEN e THEN episodes END AS episodes, CASE WHEN e AND mal_id % 3 = 0 THEN ['new'] ELSE genres END AS tags,
array_to_string(CASE WHEN e THEN ['S1', 'S2'] ELSE studios END, ', ') AS studios FROM (
SELECT mal_id, title, type, round(score, 2) AS mal_score, popularity, start_year AS year, genres, studios, rank, episodes, mal_id % 2 = 0 AS e FROM items)""")
def brw_10(w):
    own = w.items.select("mal_id", "title", "type", F.round("score", 2).alias("mal_score"), "popularity",
                         F.year(F.try_to_timestamp("start_date")).alias("year"), "genres", "studios")
    more = w.items.where("mal_id % 2 = 0").select(
        "mal_id", F.lit(7.5).alias("score"), "rank", F.lit(1).cast("bigint").alias("popularity"), F.lit("X").alias("type"), F.lit(1999).alias("year"),
        "episodes", F.when(F.col("mal_id") % 3 == 0, F.array(F.lit("new"))).otherwise(F.array().cast("array<string>")).alias("genres"),
        F.array(F.lit("S1"), F.lit("S2")).alias("studios"))
    return br.merge_detail(own, more)
