"""The 2-D catalogue map: base table, cluster names, density grid, labels and picks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import quantiles
from shelfwise.functions.lists import bound, parse_list
from shelfwise.operators.recommend import is_adult

# Name separators and cuts, grid, level of detail, the priority order of tags.
SEP = "·"
UNKNOWN_POPULARITY = 999999
GRID_PAD = 0.5
DENSITY_PLACES = 12
LABEL_MIN_PX, LABEL_FADE_PX, LABEL_LIMIT, PICK_PX = 60.0, 30.0, 12, 8.0
BIOME_PRIORITY = [
    "Mecha", "Space", "Music", "Idols (Female)", "Idols (Male)", "Mahou Shoujo", "Isekai", "Harem",
    "CGDCT", "Iyashikei", "Military", "Historical", "Martial Arts", "Racing", "Vampire", "Parody",
    "Psychological", "Detective", "Samurai", "Team Sports", "Gore",
    "Boys Love", "Girls Love", "Avant Garde", "Sports", "Horror", "Mystery", "Ecchi", "Supernatural",
    "Romance", "Sci-Fi", "Fantasy", "Adventure", "Drama", "Slice of Life", "Action", "Comedy",
]


def base_table(item_index: DataFrame, details: DataFrame, extra: bool = False) -> DataFrame:
    """Indexed real items that may be shown, with parsed tags, first genre and start year."""
    joined = item_index.where("mal_id <> -1").join(details, "mal_id", "left")
    lists = joined.withColumns({c: parse_list(F.col(c)) for c in ("genres", "themes", "demographics", "studios")})
    safe = lists.where(~is_adult(F.col("genres"), F.col("rating")))
    keep = ["anime_idx", "mal_id", "title", "type", "genres", "themes", "popularity", "is_cold",
            F.coalesce(F.get("genres", F.lit(0)), F.lit("Unknown")).alias("primary_genre"),
            F.year(F.try_to_timestamp("start_date")).alias("start_year")]
    return safe.select(*keep, *(["demographics", "studios", "source"] if extra else []))


def base_summary(base: DataFrame, top: int = 10) -> DataFrame:
    """Cold and warm counts, genre coverage, and the most common first genres, as (name, value)."""
    one = base.agg(F.count("*").alias("n_items"), F.count_if("is_cold").alias("n_cold"), F.count_if(~F.col("is_cold")).alias("n_warm"),
                   F.count_if(F.col("primary_genre") != "Unknown").alias("n_with_genre"))
    totals = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in one.columns])))
    genres = (base.groupBy("primary_genre").agg(F.count("*").alias("value")).orderBy(F.desc("value"), "primary_genre").limit(top)
              .select(F.concat(F.lit("genre:"), "primary_genre").alias("name"), "value"))
    return totals.unionByName(genres)


# -- cluster names -------------------------------------------------------------------
# ``items`` is the base table with a cluster ``label``; -1 is noise and gets no name.

def _tags(items: DataFrame, columns: list[str]) -> DataFrame:
    every = F.array_distinct(F.concat(*[F.col(c) for c in columns]))
    return items.select("label", F.explode(every).alias("tag"))


def _counts(items: DataFrame, columns: list[str]) -> DataFrame:
    """(label, tag, c, g, n): tag count in the cluster and overall, and the cluster's size."""
    tags = _tags(items, columns)
    local = tags.where("label <> -1").groupBy("label", "tag").agg(F.count("*").alias("c"))
    overall = tags.groupBy("tag").agg(F.count("*").alias("g"))
    return local.join(overall, "tag").join(cluster_sizes(items), "label")


def cluster_sizes(items: DataFrame) -> DataFrame:
    return items.where("label <> -1").groupBy("label").agg(F.count("*").alias("n"))


def _top(scored: DataFrame, k: int) -> DataFrame:
    """Name from the k best tags, higher tag first on equal scores."""
    order = Window.partitionBy("label").orderBy(F.desc("score"), F.desc("tag"))
    best = scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    ordered = F.array_sort(F.collect_list(F.struct("r", "tag")))
    return best.groupBy("label").agg(ordered.alias("b")).select("label", F.array_join("b.tag", SEP).alias("name"))


def _common_genre(items: DataFrame) -> DataFrame:
    counts = items.where("label <> -1").groupBy("label", "primary_genre").agg(F.count("*").alias("c"))
    order = Window.partitionBy("label").orderBy(F.desc("c"), "primary_genre")
    return (counts.withColumn("r", F.row_number().over(order)).where("r = 1")
            .select("label", F.col("primary_genre").alias("fallback")))


def _or_genre(items: DataFrame, names: DataFrame) -> DataFrame:
    return (_common_genre(items).join(names, "label", "left")
            .select("label", F.coalesce("name", "fallback").alias("name")))


def name_log_odds(items: DataFrame, prior: float = 100.0, min_share: float = 0.05, min_count: int = 3) -> DataFrame:
    """Two most distinctive tags by the z-score of the log-odds ratio under a Dirichlet prior."""
    counts = _counts(items, ["genres", "themes"])
    total = _tags(items, ["genres", "themes"]).agg(F.count("*")).scalar()
    in_cluster = _tags(items, ["genres", "themes"]).where("label <> -1").groupBy("label").agg(F.count("*").alias("ni"))
    c = (counts.join(in_cluster, "label").where(F.col("c") >= min_count).where(F.col("c") / F.col("n") >= min_share)
         .withColumn("total", total.cast("double")).withColumn("a", F.col("g") / F.col("total") * F.lit(prior)))
    yi, yr = F.col("c"), F.col("g") - F.col("c")

    def log_odds(y: Column, n: Column) -> Column:
        return F.log(y + F.col("a")) - F.log(n + F.lit(prior) - y - F.col("a"))
    delta = log_odds(yi, F.col("ni")) - log_odds(yr, F.col("total") - F.col("ni"))
    z = delta / F.sqrt(1 / (yi + F.col("a")) + 1 / (yr + F.col("a")))
    return _or_genre(items, _top(c.withColumn("score", F.round(z, 9)), 2))


def _lift(items: DataFrame, columns: list[str], min_share: float) -> DataFrame:
    n_items = items.agg(F.count("*")).scalar()
    share = F.col("c") / F.col("n")
    return (_counts(items, columns).withColumn("_n_items", n_items).where(share >= min_share)
            .withColumn("score", F.round(share / (F.col("g") / F.col("_n_items")), 9)))


def name_lift(items: DataFrame, min_share: float = 0.15) -> DataFrame:
    """Two tags of highest lift among those of enough share; repeats are numbered by label."""
    return unique_names(_or_genre(items, _top(_lift(items, ["genres", "themes"], min_share), 2)), ["label"])


def name_tfidf(items: DataFrame, min_share: float = 0.10) -> DataFrame:
    """Two tags of highest share times ln((K + 1) / (df + 1)) + 1, df counting clusters of enough share; repeats are numbered."""
    counts = _counts(items, ["genres", "themes"]).withColumn("tf", F.col("c") / F.col("n"))
    df = counts.where(F.col("tf") >= min_share).groupBy("tag").agg(F.count("*").alias("df"))
    k = cluster_sizes(items).agg(F.count("*")).scalar()
    idf = F.log((F.col("_k") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    scored = counts.join(df, "tag", "left").withColumn("_k", k).withColumn("score", F.round(F.col("tf") * idf, 9))
    names = _top(scored, 2)
    named = cluster_sizes(items).join(names, "label", "left").select("label", F.coalesce("name", F.lit("?")).alias("name"))
    return unique_names(named, ["label"])


def _shortened(title: Column, limit: int) -> Column:
    cut = F.concat(F.substring(title, 1, limit - 2), F.lit("…"))
    return F.when(F.length(title) <= limit, title).otherwise(cut)


def _most_popular(items: DataFrame) -> DataFrame:
    best = F.min_by(F.col("title"), F.struct(F.coalesce("popularity", F.lit(UNKNOWN_POPULARITY)).alias("p"), F.col("mal_id")))
    return items.where("label <> -1").groupBy("label").agg(best.alias("title"))


def name_exemplar(items: DataFrame, limit: int = 26) -> DataFrame:
    return unique_names(_most_popular(items).select("label", _shortened(F.col("title"), limit).alias("name")), ["label"])


def name_demographic(items: DataFrame, min_share: float = 0.12) -> DataFrame:
    """Most common demographic and theme of highest lift."""
    counts = (items.where("label <> -1").select("label", F.explode("demographics").alias("demo"))
              .groupBy("label", "demo").agg(F.count("*").alias("c")))
    order = Window.partitionBy("label").orderBy(F.desc("c"), "demo")
    demo = counts.withColumn("r", F.row_number().over(order)).where("r = 1").select("label", "demo")
    theme = _or_genre(items, _top(_lift(items, ["themes"], min_share), 1))
    named = F.when(F.col("demo").isNull(), F.col("name")).otherwise(F.concat("demo", F.lit(" · "), "name"))
    return unique_names(theme.join(demo, "label", "left").select("label", named.alias("name")), ["label"])


def name_hybrid(items: DataFrame, limit: int = 22) -> DataFrame:
    """Tf-idf name and, on a second line, the most popular title."""
    tags = name_tfidf(items)
    titles = _most_popular(items).select("label", _shortened(F.col("title"), limit).alias("t"))
    return tags.join(titles, "label").select("label", F.concat("name", F.lit("\n"), "t").alias("name"))


def unique_names(names: DataFrame, order: list[str | Column]) -> DataFrame:
    """Number repeats of a name, in the given order: ``x``, ``x (2)``, ``x (3)``."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy(*order))
    return (names.withColumn("_nth", nth)
            .withColumn("name", F.when(F.col("_nth") == 1, F.col("name")).otherwise(
                F.concat("name", F.lit(" ("), F.col("_nth").cast("string"), F.lit(")")))).drop("_nth"))


def cluster_table(items: DataFrame, names: DataFrame, examples: int = 3) -> DataFrame:
    """(label, name, size, examples): unique names, larger clusters first, most popular titles."""
    order = Window.partitionBy("label").orderBy(F.coalesce("popularity", F.lit(UNKNOWN_POPULARITY)), "mal_id")
    first = items.select("label", "title", F.row_number().over(order).alias("r")).where(F.col("r") <= examples)
    titles = (first.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("r", "title"))).alias("t"))
              .select("label", F.array_join("t.title", " · ").alias("examples")))
    sizes = items.groupBy("label").agg(F.count("*").alias("size"))
    named = (sizes.join(names, "label", "left")
             .withColumn("name", F.when(F.col("label") == -1, "noise").otherwise(F.coalesce("name", F.lit("?")))))
    return unique_names(named, [F.desc("size"), "label"]).join(titles, "label")


# -- points and labels --------------------------------------------------------------------
def points(coords: DataFrame, base: DataFrame, clusters: DataFrame) -> DataFrame:
    return (coords.join(base, "anime_idx").join(clusters, "anime_idx")
            .select("mal_id", F.coalesce("title", F.col("mal_id").cast("string")).alias("title"), "x", "y", "label",
                    F.coalesce(F.col("popularity").cast("int"), F.lit(UNKNOWN_POPULARITY)).alias("popularity"), "is_cold"))


def label_anchors(pts: DataFrame) -> DataFrame:
    """Exact median place of each cluster; noise has none."""
    long = pts.where("label <> -1").select("label", F.explode(F.array(*[
        F.struct(F.lit(a).alias("axis"), F.col(a).alias("v")) for a in ("x", "y")])).alias("e")).select("label", "e.*")
    med = quantiles.interpolated(long, ["label", "axis"], "v", {"m": 0.5})
    return med.groupBy("label").agg(F.max(F.when(F.col("axis") == "x", F.col("m"))).alias("cx"),
                                    F.max(F.when(F.col("axis") == "y", F.col("m"))).alias("cy"))


def largest_labels(pts: DataFrame, n: int) -> DataFrame:
    return cluster_sizes(pts).orderBy(F.desc("n"), "label").limit(n)


def plot_frame(coords: DataFrame, base: DataFrame, clusters: DataFrame, names: DataFrame) -> DataFrame:
    """Everything a plot needs per point; unclustered points are noise."""
    return (coords.join(base, "anime_idx", "left").join(clusters, "anime_idx", "left")
            .withColumn("label", F.coalesce("label", F.lit(-1)))
            .join(names.select("label", F.col("name").alias("cluster")), "label", "left")
            .withColumn("cluster", F.coalesce("cluster", F.lit("noise"))))


# -- density grid ----------------------------------------------------------------------------
def grid_frame(pts: DataFrame, bins: int, pad: float = GRID_PAD) -> DataFrame:
    """One row: origin and cell size of the padded grid."""
    def width(c: str) -> Column:
        return (F.max(c) - F.min(c) + 2 * pad) / bins
    return pts.agg((F.min("x") - pad).alias("x0"), (F.min("y") - pad).alias("y0"), width("x").alias("wx"), width("y").alias("wy"))


def histogram(pts: DataFrame, bins: int, by: list[str]) -> DataFrame:
    """Point counts per grid cell (ix, iy) and ``by``; the top edge belongs to the last cell."""
    frame = grid_frame(pts, bins)
    framed = pts.withColumn("_f", frame.select(F.struct("*")).scalar())

    def cell(axis: str) -> Column:
        return F.least(F.floor((F.col(axis) - F.col(f"_f.{axis}0")) / F.col(f"_f.w{axis}")), F.lit(bins - 1)).cast("int")
    return (framed.select(*by, cell("x").alias("ix"), cell("y").alias("iy"))
            .groupBy(*by, "ix", "iy").agg(F.count("*").alias("n")))


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised weights for offsets -r..r, r = floor(4 sigma + 0.5)."""
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def _spread(cells: DataFrame, axis: str, bins: int, sigma: float, by: list[str], value: str) -> DataFrame:
    kernel = gaussian_kernel(sigma)
    r = len(kernel) // 2
    steps = F.explode(F.array(*[F.struct(F.lit(o - r).alias("o"), F.lit(w).alias("w")) for o, w in enumerate(kernel)]))
    moved = cells.withColumn("_k", steps)
    wrapped = F.pmod(F.col(axis) + F.col("_k.o"), F.lit(2 * bins))
    folded = F.when(wrapped >= bins, 2 * bins - 1 - wrapped).otherwise(wrapped)
    other = "iy" if axis == "ix" else "ix"
    return (moved.select(*by, folded.cast("int").alias(axis), other, (F.col(value) * F.col("_k.w")).alias("_d"))
            .groupBy(*by, "ix", "iy").agg(F.sum("_d").alias("d")))


def smooth(cells: DataFrame, bins: int, sigma: float, by: list[str]) -> DataFrame:
    """Gaussian-smoothed density, mirrored at the edges, one axis after the other.

    Values are rounded to 12 places so that equal densities compare equal in any order of addition.
    """
    once = _spread(cells.withColumnRenamed("n", "d"), "ix", bins, sigma, by, "d")
    return _spread(once, "iy", bins, sigma, by, "d").withColumn("d", F.round("d", DENSITY_PLACES)).where("d > 0")


def dominant(density: DataFrame) -> DataFrame:
    """Total density and strongest cluster per cell, lower label on ties."""
    return density.groupBy("ix", "iy").agg(
        F.round(F.sum("d"), DENSITY_PLACES).alias("total"),
        F.max_by("label", F.struct(F.col("d"), (-F.col("label")).alias("neg"))).alias("label"))


def opacity(cells: DataFrame, gamma: float = 0.5, scale: float = 0.7) -> DataFrame:
    """Cell opacity: density over its 99th percentile, clipped, to the power gamma."""
    hi = quantiles.interpolated(cells, [], "total", {"hi": 0.99})
    return cells.withColumn("opacity", F.pow(F.least(F.col("total") / hi.scalar(), F.lit(1.0)), gamma) * scale)


def land(cells: DataFrame, p: float = 0.40) -> DataFrame:
    """Field value per cell: label + 1 above the density percentile, else 0 for sea."""
    cut = quantiles.interpolated(cells, [], "total", {"cut": p})
    return cells.withColumn("field", F.when(F.col("total") > cut.scalar(), F.col("label") + 1).otherwise(0))


def borders(field: DataFrame, bins: int) -> DataFrame:
    """Cells that differ from a 4-neighbour, on both sides of the line; absent cells are sea.

    Every land cell tells itself and its neighbours, so one shuffle does it.
    """
    steps = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]
    told = (field.where("field > 0").withColumn("_s", F.explode(F.array(*[
        F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps])))
        .select((F.col("ix") + F.col("_s.dx")).alias("ix"), (F.col("iy") + F.col("_s.dy")).alias("iy"), "field",
                ((F.col("_s.dx") == 0) & (F.col("_s.dy") == 0)).alias("own"))
        .where(F.col("ix").between(0, bins - 1) & F.col("iy").between(0, bins - 1)))
    inside = (F.lit(4) - (F.col("ix") == 0).cast("int") - (F.col("ix") == bins - 1).cast("int")
              - (F.col("iy") == 0).cast("int") - (F.col("iy") == bins - 1).cast("int"))
    other = F.when(~F.col("own"), F.col("field"))
    near = told.groupBy("ix", "iy").agg(
        F.coalesce(F.max(F.when(F.col("own"), F.col("field"))), F.lit(0)).alias("field"),
        F.min(other).alias("lo"), F.max(other).alias("hi"), F.count(other).alias("k"))
    edge = ((F.col("field") == 0) | (F.col("k") < inside) | (F.col("lo") != F.col("field")) | (F.col("hi") != F.col("field")))
    return near.where(F.coalesce(edge, F.lit(True))).select("ix", "iy", "field")


def hexagons(pts: DataFrame, gridsize: int) -> DataFrame:
    """Hexagonal bins (two interleaved lattices) with size and commonest cluster, lower label on ties."""
    ny = int(gridsize / math.sqrt(3))
    frame = pts.agg(F.min("x").alias("x0"), F.min("y").alias("y0"),
                    ((F.max("x") - F.min("x")) / gridsize).alias("sx"), ((F.max("y") - F.min("y")) / ny).alias("sy"))
    framed = pts.withColumn("_f", frame.select(F.struct("*")).scalar())
    fx = (F.col("x") - F.col("_f.x0")) / F.col("_f.sx")
    fy = (F.col("y") - F.col("_f.y0")) / F.col("_f.sy")
    placed = framed.select("label", fx.alias("fx"), fy.alias("fy")).withColumns({
        "ax": F.floor(F.col("fx") + 0.5), "ay": F.floor(F.col("fy") + 0.5), "bx": F.floor("fx"), "by": F.floor("fy")})
    da = F.pow(F.col("fx") - F.col("ax"), 2) + 3 * F.pow(F.col("fy") - F.col("ay"), 2)
    db = F.pow(F.col("fx") - F.col("bx") - 0.5, 2) + 3 * F.pow(F.col("fy") - F.col("by") - 0.5, 2)
    first = da < db
    cells = placed.select("label", F.when(first, 0).otherwise(1).alias("lattice"),
                          F.when(first, F.col("ax")).otherwise(F.col("bx")).alias("hx"),
                          F.when(first, F.col("ay")).otherwise(F.col("by")).alias("hy"))
    counts = cells.where("label <> -1").groupBy("lattice", "hx", "hy", "label").agg(F.count("*").alias("c"))
    return counts.groupBy("lattice", "hx", "hy").agg(
        F.sum("c").alias("n"), F.max_by("label", F.struct(F.col("c"), (-F.col("label")).alias("neg"))).alias("label"))


def voronoi(cells: DataFrame, anchors: DataFrame, frame: DataFrame, p: float = 0.30) -> DataFrame:
    """Nearest cluster anchor of each dense grid cell's centre; noise is no site.

    The anchors, one per cluster, travel with each row as an array.
    """
    cut = quantiles.interpolated(cells, [], "total", {"cut": p})
    sites = F.array_sort(F.collect_list(F.struct("label", "cx", "cy")))
    wide = (cells.where(F.col("total") > cut.scalar()).withColumn("_f", frame.select(F.struct("*")).scalar())
            .withColumn("_sites", anchors.where("label <> -1").agg(sites).scalar())
            .withColumn("_x", F.col("_f.x0") + (F.col("ix") + 0.5) * F.col("_f.wx"))
            .withColumn("_y", F.col("_f.y0") + (F.col("iy") + 0.5) * F.col("_f.wy")))
    nearest = F.array_min(F.transform("_sites", lambda s: F.struct(
        F.round(F.hypot(F.col("_x") - s["cx"], F.col("_y") - s["cy"]), 9).alias("d"), s["label"].alias("label"))))
    return wide.select("ix", "iy", nearest["label"].alias("label"))


def biome(base: DataFrame, priority: list[str] = BIOME_PRIORITY) -> DataFrame:
    """Position of the first listed tag an item has, -1 if none."""
    order = F.array(*[F.lit(t) for t in priority])
    hits = bound(F.concat("genres", "themes"), lambda tags: F.filter(order, lambda t: F.array_contains(tags, t)))
    first = F.get(hits, F.lit(0))
    return base.select("anime_idx", F.coalesce(F.array_position(order, first) - 1, F.lit(-1)).cast("int").alias("biome"), first.alias("tag"))


def polar(pts: DataFrame, key: str = "mal_id") -> DataFrame:
    """Angle around the centre of all points and distance as a share of the largest."""
    centre = pts.agg(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y"))).scalar()
    out = pts.withColumn("_c", centre).select(
        key, F.atan2(F.col("y") - F.col("_c.y"), F.col("x") - F.col("_c.x")).alias("angle"),
        F.hypot(F.col("x") - F.col("_c.x"), F.col("y") - F.col("_c.y")).alias("_r"))
    return out.withColumn("radius", F.col("_r") / out.agg(F.max("_r")).scalar()).drop("_r")


def soft_colours(shares: DataFrame, palette: DataFrame) -> DataFrame:
    """Colour of each item: cluster colours weighted by the item's shares, clipped to [0, 1]."""
    def channel(c: str) -> Column:
        return F.greatest(F.least(F.sum(F.col("p") * F.col(c)), F.lit(1.0)), F.lit(0.0)).alias(c)
    return shares.join(palette, "label").groupBy("anime_idx").agg(*[channel(c) for c in ("r", "g", "b")])


# -- viewing -----------------------------------------------------------------------------------
def cluster_radius(pts: DataFrame, anchors: DataFrame, share: float = 0.8) -> DataFrame:
    """The distance at place floor(0.8 n) of a cluster's sorted distances to its anchor."""
    far = pts.join(anchors, "label").select("label", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")).alias("d"))
    at = F.least(F.floor(F.col("_n") * F.lit(share)), F.col("_n") - 1)
    got = quantiles.order_statistics(far, ["label"], "d", {"radius": at}).drop("_n")
    return anchors.join(got, "label", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))


def popularity_limit(zoom: float) -> float:
    """Points below this popularity rank are drawn; all of them from zoom 4."""
    return 3000.0 if zoom <= 1.2 else 3000.0 + min(1.0, (zoom - 1.2) / 2.8) * 997000.0


def in_view(pts: DataFrame, recs: DataFrame, cx: float, cy: float, width: float, height: float, zoom: float) -> DataFrame:
    """Points of a viewport at a level of detail; recommended ones are always kept."""
    seen = F.col("x").between(cx - width / 2, cx + width / 2) & F.col("y").between(cy - height / 2, cy + height / 2)
    flagged = pts.where(seen).join(recs.select("mal_id", F.lit(True).alias("is_rec")), "mal_id", "left")
    flagged = flagged.withColumn("is_rec", F.coalesce("is_rec", F.lit(False)))
    return flagged.where((F.col("popularity") < popularity_limit(zoom)) | F.col("is_rec"))


def preview_points(pts: DataFrame, limit: int = 5000) -> DataFrame:
    return pts.where(F.col("popularity") < limit)


def visible_labels(clusters: DataFrame, cx: float, cy: float, width: float, height: float, scale: float) -> DataFrame:
    """Labels of clusters large enough on screen and inside the view padded by a tenth, the 12 largest."""
    px = F.col("radius") * F.lit(scale)
    near = (F.abs(F.col("cx") - cx) <= width * 0.6) & (F.abs(F.col("cy") - cy) <= height * 0.6)
    alpha = F.least((px - LABEL_MIN_PX) / LABEL_FADE_PX, F.lit(1.0))
    return (clusters.where((px > LABEL_MIN_PX) & near).withColumn("alpha", alpha)
            .orderBy(F.desc("size"), "label").limit(LABEL_LIMIT))


def nearest_point(pts: DataFrame, x: float, y: float, scale: float, limit_px: float = PICK_PX) -> DataFrame:
    """The point nearest to a place, if closer than 8 pixels; ``pts`` are the drawn ones (see ``in_view``)."""
    px = F.hypot(F.col("x") - x, F.col("y") - y) * scale
    return pts.withColumn("px", px).where(F.col("px") < limit_px).orderBy("px", "mal_id").limit(1)


def overlay(users: DataFrame, neighbours: DataFrame, coords: DataFrame, base: DataFrame) -> DataFrame:
    """User points and their neighbours in one table."""
    own = users.select(F.lit("user").alias("kind"), "user_idx", F.col("user_idx").cast("string").alias("label"),
                       F.lit(-1).alias("anime_idx"), "x", "y")
    near = (neighbours.join(coords, "anime_idx").join(base.select("anime_idx", "title"), "anime_idx", "left")
            .select(F.lit("neighbor").alias("kind"), "user_idx", F.coalesce("title", F.col("anime_idx").cast("string")).alias("label"),
                    "anime_idx", "x", "y"))
    return own.unionByName(near)


def highlight(pts: DataFrame, recs: DataFrame, top: int) -> DataFrame:
    """Points with the rank of the first ``top`` main recommendations (mal_id, rank), null elsewhere."""
    ranks = recs.where(F.col("rank") <= top).select("mal_id", F.col("rank").alias("rec_rank"))
    return pts.join(ranks, "mal_id", "left")
