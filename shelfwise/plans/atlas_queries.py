"""Catalogue map."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import atlas as at
from shelfwise.operators import vectors as ve
from shelfwise.plans.oracle_views import _pool, top_tags
from shelfwise.plans.registry import query


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


@query("map_1", "SELECT anime_idx, mal_id, title, type, genres, themes, popularity, is_cold, primary_genre, start_year FROM mbase")
def map_1(w):
    return at.base_table(w.item_index, w.details)


@query("map_2", """SELECT 'n_items' AS name, count(*) AS value FROM mbase UNION ALL SELECT 'n_cold', count(*) FROM mbase WHERE is_cold
UNION ALL SELECT 'n_warm', count(*) FROM mbase WHERE NOT is_cold UNION ALL SELECT 'n_with_genre', count(*) FROM mbase WHERE primary_genre <> 'Unknown'
UNION ALL SELECT * FROM (SELECT 'genre:' || primary_genre, count(*) FROM mbase GROUP BY primary_genre ORDER BY count(*) DESC, primary_genre LIMIT 10)""")
def map_2(w):
    return at.base_summary(w.map_base)


def _named(view: str, k: int = 2) -> str:
    return f"SELECT g.label, coalesce(t.name, g.fallback) AS name FROM mgenre g LEFT JOIN ({top_tags(view, k)}) t ON g.label = t.label"


def _unique(names: str, order: str) -> str:
    return f"""SELECT label, CASE WHEN nth = 1 THEN name ELSE name || ' (' || nth || ')' END AS name FROM (
SELECT *, row_number() OVER (PARTITION BY name ORDER BY {order}) AS nth FROM ({names}))"""


@query("map_3", _named("mlogodds"))
def map_3(w):
    return at.name_log_odds(w.clustered)


@query("map_4", _unique(_named("mlift"), "label"))
def map_4(w):
    return at.name_lift(w.clustered)


@query("map_5", _unique(top_tags("mtfidf", 2), "label"))
def map_5(w):
    return at.name_tfidf(w.clustered)


@query("map_6", _unique("SELECT label, CASE WHEN length(title) <= 10 THEN title ELSE substr(title, 1, 8) || '…' END AS name FROM mpopular", "label"))
def map_6(w):
    return at.name_exemplar(w.clustered, limit=10)


_DEMO = "SELECT label, demo FROM (SELECT label, demo, count(*) AS c FROM (SELECT label, unnest(demographics) AS demo FROM mbase) GROUP BY label, demo) QUALIFY row_number() OVER (PARTITION BY label ORDER BY c DESC, demo) = 1"
_TLIFT = """(SELECT label, tag, round((c / n) / (g / (SELECT count(*) FROM mbase)), 9) AS score FROM (
SELECT t.label, t.tag, count(*) AS c, any_value(g.g) AS g, any_value(s.n) AS n FROM (SELECT anime_idx, label, unnest(list_distinct(themes)) AS tag FROM mbase) t
JOIN (SELECT tag, count(*) AS g FROM (SELECT unnest(list_distinct(themes)) AS tag FROM mbase) GROUP BY tag) g ON t.tag = g.tag
JOIN (SELECT label, count(*) AS n FROM mbase GROUP BY label) s ON t.label = s.label GROUP BY t.label, t.tag) WHERE c / n >= 0.12)"""


@query("map_7", _unique(f"SELECT n.label, CASE WHEN d.demo IS NULL THEN n.name ELSE d.demo || ' · ' || n.name END AS name FROM ({_named(_TLIFT, 1)}) n LEFT JOIN ({_DEMO}) d ON n.label = d.label", "label"))
def map_7(w):
    return at.name_demographic(w.clustered)


@query("map_8", f"""SELECT t.label, t.name || chr(10) || CASE WHEN length(p.title) <= 22 THEN p.title ELSE substr(p.title, 1, 20) || '…' END AS name
FROM ({_unique(top_tags('mtfidf', 2), 'label')}) t JOIN mpopular p ON t.label = p.label""")
def map_8(w):
    return at.name_hybrid(w.clustered)


@query("map_9", _unique("SELECT label, CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS name, n FROM (SELECT label, count(*) AS n FROM mbase GROUP BY label)", "n DESC, label"))
def map_9(w):
    names = at.cluster_sizes(w.clustered).withColumn("name", F.when(F.col("label") % 2 == 0, "even").otherwise("odd"))
    return at.unique_names(names, [F.desc("n"), "label"]).select("label", "name")


_TABLE = f"""SELECT s.label, u.name, s.size, e.examples FROM (SELECT label, count(*) AS size FROM mbase GROUP BY label) s
JOIN ({_unique(f"SELECT n.*, s.n FROM ({_named('mlogodds')}) n JOIN (SELECT label, count(*) AS n FROM mbase GROUP BY label) s ON n.label = s.label", "n DESC, label")}) u ON s.label = u.label
JOIN (SELECT label, string_agg(title, ' · ' ORDER BY popularity, mal_id) AS examples FROM (SELECT * FROM mbase QUALIFY row_number() OVER (PARTITION BY label ORDER BY popularity, mal_id) <= 3) GROUP BY label) e ON s.label = e.label"""


@query("map_10", _TABLE)
def map_10(w):
    return at.cluster_table(w.clustered, at.name_log_odds(w.clustered))


@query("map_11", "SELECT mal_id, title, round(x, 6) AS x, round(y, 6) AS y, label, popularity, is_cold FROM mpoints")
def map_11(w):
    return at.points(w.coords, w.map_base, w.clusters).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query("map_11_layout")
def map_11_layout(w):
    """The points table on the places of the neighbour graph."""
    return at.points(w.layout, w.map_base, w.clusters).withColumns({c: F.round(c, 4) for c in ("x", "y")})


@query("map_12", "SELECT label, round(cx, 6) AS cx, round(cy, 6) AS cy FROM manchors")
def map_12(w):
    return at.label_anchors(w.points).withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


@query("map_13", "SELECT label, count(*) AS n FROM mpoints GROUP BY label ORDER BY n DESC, label LIMIT 4")
def map_13(w):
    return at.largest_labels(w.points, 4)


@query("map_14", "SELECT label, ix, iy, d AS n FROM mcells")
def map_14(w):
    return at.histogram(w.points, w.BINS, ["label"])


@query("map_15", "SELECT label, ix, iy, round(d, 6) AS d FROM mdens")
def map_15(w):
    cells = at.histogram(w.points, w.BINS, ["label"])
    return at.smooth(cells, w.BINS, w.SIGMA, ["label"]).withColumn("d", F.round("d", 6))


@query("map_16", "SELECT ix, iy, round(total, 9) AS total, label FROM mdom")
def map_16(w):
    return at.dominant(w.density).withColumn("total", F.round("total", 9))


@query("map_17", "SELECT ix, iy, round(pow(least(total / (SELECT quantile_cont(total, 0.99) FROM mdom), 1.0), 0.5) * 0.7::DOUBLE, 6) AS opacity FROM mdom")
def map_17(w):
    return at.opacity(w.cells).select("ix", "iy", F.round("opacity", 6).alias("opacity"))


@query("map_18", "SELECT ix, iy, field FROM mland")
def map_18(w):
    return at.land(w.cells).select("ix", "iy", "field")


@query("map_19", f"""SELECT * FROM (WITH g AS (SELECT CAST(a.i AS INTEGER) AS ix, CAST(b.j AS INTEGER) AS iy, coalesce(l.field, 0) AS field FROM range(32) a(i) CROSS JOIN range(32) b(j)
LEFT JOIN mland l ON l.ix = a.i AND l.iy = b.j)
SELECT DISTINCT g.ix, g.iy, g.field FROM g JOIN g n ON abs(g.ix - n.ix) + abs(g.iy - n.iy) = 1 AND g.field <> n.field)""")
def map_19(w):
    return at.borders(at.land(w.cells), w.BINS)


@query("map_20", """SELECT lattice, hx, hy, sum(c)::BIGINT AS n, arg_max(label, {'c': c, 'n': -label}) AS label FROM (SELECT lattice, hx, hy, label, count(*) AS c FROM (
SELECT label, CASE WHEN da < db THEN 0 ELSE 1 END AS lattice, CASE WHEN da < db THEN floor(fx + 0.5) ELSE floor(fx) END::BIGINT AS hx, CASE WHEN da < db THEN floor(fy + 0.5) ELSE floor(fy) END::BIGINT AS hy FROM (
SELECT *, pow(fx - floor(fx + 0.5), 2) + 3 * pow(fy - floor(fy + 0.5), 2) AS da, pow(fx - floor(fx) - 0.5, 2) + 3 * pow(fy - floor(fy) - 0.5, 2) AS db FROM (
SELECT label, (x - (SELECT min(x) FROM mpoints)) / ((SELECT max(x) - min(x) FROM mpoints) / 14) AS fx, (y - (SELECT min(y) FROM mpoints)) / ((SELECT max(y) - min(y) FROM mpoints) / 8) AS fy FROM mpoints)))
GROUP BY ALL) GROUP BY lattice, hx, hy""")
def map_20(w):
    return at.hexagons(w.points, 14)


@query("map_21", """SELECT ix, iy, label FROM (SELECT c.ix, c.iy, a.label, row_number() OVER (PARTITION BY c.ix, c.iy
ORDER BY round(sqrt((x0 + (c.ix + 0.5::DOUBLE) * wx - a.cx) ** 2 + (y0 + (c.iy + 0.5::DOUBLE) * wy - a.cy) ** 2), 9), a.label) AS r
FROM mdom c, manchors a, mframe WHERE c.total > (SELECT quantile_cont(total, 0.30) FROM mdom)) WHERE r = 1""")
def map_21(w):
    return at.voronoi(w.cells, w.anchors, at.grid_frame(w.points, w.BINS))


_PRIORITY = ["Large", "ring", "gear", "Compact", "hot"]


@query("map_22", f"""SELECT anime_idx, coalesce(list_position({_PRIORITY!r}, tag), 0) - 1 AS biome, tag FROM (
SELECT anime_idx, list_filter({_PRIORITY!r}, lambda t: list_contains(list_concat(genres, themes), t))[1] AS tag FROM mbase)""")
def map_22(w):
    return at.biome(w.map_base, _PRIORITY)


@query("map_23", """SELECT mal_id, round(atan2(y - cy, x - cx), 6) AS angle, round(sqrt((x - cx) ** 2 + (y - cy) ** 2) / max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) OVER (), 6) AS radius
FROM mpoints, (SELECT avg(x) AS cx, avg(y) AS cy FROM mpoints)""")
def map_23(w):
    return _round(at.polar(w.points), "angle", "radius")


@query("map_24", """SELECT anime_idx, round(least(sum(p * ((label * 37) % 11) / 10), 1), 6) AS r, round(least(sum(p * ((label * 53) % 11) / 10), 1), 6) AS g, round(least(sum(p * ((label * 71) % 11) / 10), 1), 6) AS b FROM (
SELECT anime_idx, label - 1 AS label, v * v / sum(v * v) OVER (PARTITION BY anime_idx) AS p FROM (SELECT anime_idx, unnest(vec[1:10]) AS v, generate_subscripts(vec[1:10], 1) AS label FROM ivec)) GROUP BY anime_idx""")
def map_24(w):
    """Shares from ten squared components, colours from a rule."""
    first = F.slice("vec", 1, 10)
    total = F.aggregate(first, F.lit(0.0), lambda s, x: s + x * x)
    shares = w.ivec.where("anime_idx >= 2").select("anime_idx", F.posexplode(F.transform(first, lambda x: x * x / total)).alias("label", "p"))
    labels = w.ivec.where("label IS NOT NULL").select("label").distinct()
    palette = labels.select("label", *[((F.col("label") * k % 11) / 10).alias(c) for c, k in (("r", 37), ("g", 53), ("b", 71))])
    return at.soft_colours(shares, palette).withColumns({c: F.round(c, 6) for c in ("r", "g", "b")})


@query("map_24_soft")
def map_24_soft(w):
    """Colours by the shares of the fitted mixture."""
    shares = w.mixture.select("anime_idx", F.posexplode("shares").alias("label", "p"))
    palette = w.spark.range(w.SOFT).select(F.col("id").cast("int").alias("label"),
                                           *[((F.col("id") * k % 11) / 10).alias(c) for c, k in (("r", 37), ("g", 53), ("b", 71))])
    return at.soft_colours(shares, palette).withColumns({c: F.round(c, 6) for c in ("r", "g", "b")})


@query("map_25", f"""SELECT c.anime_idx, round(c.x, 6) AS x, round(c.y, 6) AS y, b.title, coalesce(k.label, -1) AS label,
coalesce(n.name, 'noise') AS cluster FROM coords c LEFT JOIN mbase b ON c.anime_idx = b.anime_idx LEFT JOIN ivec k ON c.anime_idx = k.anime_idx LEFT JOIN ({_named('mlogodds')}) n ON k.label = n.label""")
def map_25(w):
    frame = at.plot_frame(w.coords, w.map_base, w.clusters, at.name_log_odds(w.clustered))
    return _round(frame.select("anime_idx", "x", "y", "title", "label", "cluster"), "x", "y")


@query("map_26", "SELECT label, round(cx, 6) AS cx, round(cy, 6) AS cy, round(radius, 6) AS radius FROM mradius")
def map_26(w):
    return at.cluster_radius(w.points, w.anchors).withColumns({c: F.round(c, 6) for c in ("cx", "cy", "radius")})


_RECS = "SELECT DISTINCT i.mal_id FROM mainl m JOIN items i ON m.anime_idx = i.anime_idx WHERE m.rank <= 3"


_DRAWN = f"""SELECT mal_id, mal_id IN ({_RECS}) AS is_rec, x, y FROM mpoints WHERE x BETWEEN -0.2 AND 0.2 AND y BETWEEN -0.15 AND 0.15
AND (popularity < 3000 + least(1, (1.25::DOUBLE - 1.2) / 2.8) * 997000.0 OR mal_id IN ({_RECS}))"""


def _drawn(w):
    """Points drawn in the view that map_27 and map_29 share."""
    recs = w.results.where("section = 'main' AND rank <= 3").select("mal_id").distinct()
    return at.in_view(w.points, recs, 0.0, 0.0, 0.4, 0.3, 1.25)


@query("map_27", f"SELECT mal_id, is_rec FROM ({_DRAWN})")
def map_27(w):
    return _drawn(w).select("mal_id", "is_rec")


@query("map_28", """SELECT r.label, round(least((radius * 300 - 60) / 30, 1), 6) AS alpha FROM mradius r JOIN (SELECT label, count(*) AS size FROM mpoints GROUP BY label) s ON r.label = s.label
WHERE radius * 300 > 60 AND abs(cx - 0.05::DOUBLE) <= 0.2::DOUBLE * 0.6 AND abs(cy) <= 0.2::DOUBLE * 0.6 ORDER BY size DESC, r.label LIMIT 12""")
def map_28(w):
    sized = at.cluster_radius(w.points, w.anchors).join(at.cluster_sizes(w.points).withColumnRenamed("n", "size"), "label")
    return at.visible_labels(sized, 0.05, 0.0, 0.2, 0.2, 300.0).select("label", F.round("alpha", 6).alias("alpha"))


@query("map_29", f"SELECT mal_id, round(sqrt((x - 0.01) ** 2 + (y - 0.02) ** 2) * 400, 6) AS px FROM ({_DRAWN}) WHERE sqrt((x - 0.01) ** 2 + (y - 0.02) ** 2) * 400 < 8 ORDER BY px, mal_id LIMIT 1")
def map_29(w):
    return at.nearest_point(_drawn(w), 0.01, 0.02, 400.0).select("mal_id", F.round("px", 6).alias("px"))


_NEAR = _pool("SELECT * FROM uvec", "ehist", 5, "SELECT anime_idx, vec FROM ivec WHERE anime_idx IN (SELECT anime_idx FROM coords)")


@query("map_30", f"""SELECT 'user' AS kind, user_idx, CAST(user_idx AS VARCHAR) AS label, -1 AS anime_idx, round(vec[1], 6) + 0.0 AS x, round(vec[2], 6) + 0.0 AS y FROM uvec
UNION ALL SELECT 'neighbor', n.user_idx, b.title, n.anime_idx, round(c.x, 6) + 0.0, round(c.y, 6) + 0.0 FROM ({_NEAR}) n JOIN coords c ON n.anime_idx = c.anime_idx JOIN mbase b ON n.anime_idx = b.anime_idx""")
def map_30(w):
    users = w.uvec.select("user_idx", F.get("vec", F.lit(0)).alias("x"), F.get("vec", F.lit(1)).alias("y"))
    near = ve.nearest_allowed(w.uvec, w.ivec, w.coords, w.eval_history, 5)
    return _round(at.overlay(users, near, w.coords, w.map_base), "x", "y")


_ONE = "(SELECT min(user_idx) FROM mainl)"


@query("map_31", f"""SELECT p.mal_id, r.rank AS rec_rank FROM mpoints p LEFT JOIN (SELECT i.mal_id, CAST(m.rank AS INTEGER) AS rank FROM mainl m JOIN items i ON m.anime_idx = i.anime_idx
WHERE m.user_idx = {_ONE} AND m.rank <= 10) r ON p.mal_id = r.mal_id""")
def map_31(w):
    """The first user's ten best on the map."""
    first = w.results.agg(F.min("user_idx")).scalar()
    recs = w.results.where((F.col("section") == "main") & (F.col("user_idx") == first))
    return at.highlight(w.points, recs, 10).select("mal_id", "rec_rank")
