"""Crawl logs and semi-structured records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.recommend import list_entries

# Patterns, labels and statuses of the crawled pages and records.
PROFILE_LINK = r'href="/profile/([^"/]+)"'
SIDEBAR = r'<span class="user-status-title[^"]*">{label}</span><span class="user-status-data[^"]*">([^<]+)</span>'
STATS_BLOCK = r'(?s)class="stats anime"(.*?)class="stats manga"'
DAYS = r'Days:\s*</span>\s*([\d.,]+)'
MEAN_SCORE = r'Mean Score:\s*</span>\s*<span[^>]*>([\d.,]+)</span>'
FAVOURITES_BLOCK = r'(?s)id="anime_favorites"(.*?)(?:id="\w+_favorites"|class="updates|$)'
FAVOURITE_LINK = r'href="https://myanimelist\.net/anime/(\d+)/'
COUNT_LABELS = {"watching": "Watching", "completed": "Completed", "on_hold": "On-Hold", "dropped": "Dropped",
                "plan_to_watch": "Plan to Watch", "total_entries": "Total Entries", "rewatched": "Rewatched",
                "episodes_watched": "Episodes"}
STATISTICS = ["days_watched", "mean_score", *COUNT_LABELS]
BLACKLIST = ["http_403", "http_404", "empty"]
MAX_FAVOURITES = 20
MEDIA_LABELS = {"tv": "TV", "movie": "Movie", "ova": "OVA", "ona": "ONA", "special": "Special", "tv_special": "TV Special",
                "music": "Music", "cm": "CM", "pv": "PV"}


def link_targets(pages: DataFrame, html: str, pattern: str = PROFILE_LINK, keep: list[str] | None = None) -> DataFrame:
    """Distinct URL-decoded link targets per page; text that does not decode stays as it is."""
    raw = F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))))
    found = pages.select(*(keep or []), raw.alias("raw"))
    return found.select(*(keep or []), url_decoded("raw").alias("name")).distinct()


def url_decoded(column: str) -> Column:
    """Percent-decoded text, or the text itself; a plus sign is no blank here."""
    return F.coalesce(F.try_url_decode(F.replace(column, F.lit("+"), F.lit("%2B"))), column)


def first_seen(names: DataFrame, order: str) -> DataFrame:
    """Registry with one row per name whatever its case: the spelling and time first seen."""
    return names.groupBy(F.lower("name").alias("key")).agg(
        F.min_by("name", F.struct(order, "name")).alias("name"), F.min(order).alias("discovered_at"))


def pending(users: DataFrame, status: str, limit: int | None = None, needs_ok: str | None = None) -> DataFrame:
    """Users without a status, oldest discovery first; optionally only after another crawl went well."""
    queue = users.where(F.col(status).isNull())
    if needs_ok:
        queue = queue.where(F.col(needs_ok) == "ok")
    queue = queue.orderBy("discovered_at", "username")
    return queue.limit(limit) if limit else queue


def requeue_errors(users: DataFrame, status: str) -> DataFrame:
    return users.withColumn(status, F.when(F.coalesce(F.col(status), F.lit("")) != "error", F.col(status)))


def status_counts(users: DataFrame, *statuses: str) -> DataFrame:
    cols = [F.coalesce(F.col(s), F.lit("pending")).alias(s) for s in statuses]
    return users.select(*cols).groupBy(*statuses).agg(F.count("*").alias("n"))


def blacklisted(users: DataFrame, status: str) -> DataFrame:
    return users.where(F.col(status).isin(BLACKLIST)).agg(F.count("*").alias("n"))


def flatten_animelist(pages: DataFrame, column: str) -> DataFrame:
    """List pages to rating rows with the defaults of a missing field."""
    ls = "e.list_status"
    return list_entries(pages, column).select(
        "username", F.col("e.node.id").alias("anime_id"), F.coalesce(f"{ls}.status", F.lit("")).alias("status"),
        F.coalesce(f"{ls}.score", F.lit(0)).alias("score"),
        F.coalesce(f"{ls}.num_episodes_watched", F.lit(0)).alias("num_episodes_watched"),
        F.coalesce(F.col(f"{ls}.is_rewatching"), F.lit(False)).cast("int").alias("is_rewatching"),
        *[F.coalesce(f"{ls}.{c}", F.lit("")).alias(c) for c in ("updated_at", "start_date", "finish_date")])


PROFILE_SCHEMA = ("STRUCT<gender: STRING, birthday: STRING, location: STRING, joined: STRING, favorites: STRUCT<anime: ARRAY<STRUCT<mal_id: BIGINT>>>, "
                  "statistics: STRUCT<anime: STRUCT<" + ", ".join(f"{s}: STRING" for s in STATISTICS) + ">>>")


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def flatten_profile(records: DataFrame, column: str) -> DataFrame:
    """Profile JSON to one row; dates cut to ten characters, favourites joined by blanks."""
    p = records.withColumn("_p", F.from_json(column, PROFILE_SCHEMA))
    ids = F.transform(F.coalesce(F.col("_p.favorites.anime.mal_id"), F.array().cast("array<bigint>")), lambda i: i.cast("string"))
    return p.select("username", _blank(F.col("_p.gender")).alias("gender"), F.substring(_blank(F.col("_p.birthday")), 1, 10).alias("birthday"),
                    _blank(F.col("_p.location")).alias("location"), F.substring(_blank(F.col("_p.joined")), 1, 10).alias("joined"),
                    F.array_join(ids, " ").alias("favorites_anime"),
                    *[_blank(F.col(f"_p.statistics.anime.{s}")).alias(s) for s in STATISTICS], F.lit("jikan").alias("source"))


def _no_commas(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit(""))


def profile_from_html(pages: DataFrame, html: str) -> DataFrame:
    """Profile page to the same row as :func:`flatten_profile`; absent fields are empty."""
    def side(label: str) -> Column:
        return F.trim(F.regexp_extract(html, SIDEBAR.format(label=label), 1))

    def count(label: str) -> Column:
        linked = F.regexp_extract("_block", rf">\Q{label}\E</a>\s*<span[^>]*>([\d.,]+)</span>", 1)
        plain = F.regexp_extract("_block", rf"\Q{label}\E</span>\s*<span[^>]*>([\d.,]+)</span>", 1)
        return _no_commas(F.when(linked != "", linked).otherwise(plain))
    cut = pages.withColumns({"_block": F.regexp_extract(html, STATS_BLOCK, 1), "_favs": F.regexp_extract(html, FAVOURITES_BLOCK, 1)})
    favs = F.array_distinct(F.regexp_extract_all("_favs", F.lit(FAVOURITE_LINK), F.lit(1)))
    joined = side("Joined")
    iso = F.coalesce(F.date_format(F.try_to_date(joined, "MMM d, yyyy"), "yyyy-MM-dd"), joined)
    return cut.select("username", side("Gender").alias("gender"), side("Birthday").alias("birthday"), side("Location").alias("location"),
                      iso.alias("joined"), F.array_join(favs, " ").alias("favorites_anime"),
                      _no_commas(F.regexp_extract("_block", DAYS, 1)).alias("days_watched"),
                      F.regexp_extract("_block", MEAN_SCORE, 1).alias("mean_score"),
                      *[count(label).alias(name) for name, label in COUNT_LABELS.items()], F.lit("html").alias("source"))


def media_label(media: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in MEDIA_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, media), F.upper(F.nullif(media, F.lit(""))))


def _leading_year(date: Column) -> Column:
    return F.regexp_extract(_blank(date), r"^(\d{4})", 1).try_cast("int")


_TAGS = "ARRAY<STRUCT<name: STRING>>"
DETAIL_SCHEMA = ("STRUCT<id: BIGINT, title: STRING, alternative_titles: STRUCT<en: STRING>, main_picture: STRUCT<large: STRING, medium: STRING>, "
                 "mean: DOUBLE, rank: BIGINT, popularity: BIGINT, media_type: STRING, start_season: STRUCT<year: INT>, start_date: STRING, "
                 f"num_episodes: INT, status: STRING, genres: {_TAGS}, studios: {_TAGS}, synopsis: STRING>")
SECOND_SCHEMA = ("STRUCT<mal_id: BIGINT, title_english: STRING, images: STRUCT<jpg: STRUCT<large_image_url: STRING, image_url: STRING>>, rank: BIGINT, "
                 f"popularity: BIGINT, episodes: INT, status: STRING, genres: {_TAGS}, themes: {_TAGS}, demographics: {_TAGS}, studios: {_TAGS}, "
                 "synopsis: STRING, type: STRING, year: INT, aired: STRUCT<prop: STRUCT<`from`: STRUCT<year: INT>>>>")
_NO_TEXT = "array<string>"


def _names(c: str) -> Column:
    return F.coalesce(F.col(f"{c}.name"), F.array().cast(_NO_TEXT))


def _given(c: Column) -> Column:
    """Empty text is no value."""
    return F.nullif(c, F.lit(""))


def normalise_detail(records: DataFrame, column: str) -> DataFrame:
    """Item record of the main source: labels, year from season or date, status in title case."""
    d = records.select(F.from_json(column, DETAIL_SCHEMA).alias("d"))
    zero_null = F.when(F.col("d.num_episodes") != 0, F.col("d.num_episodes"))
    season = F.when(F.col("d.start_season.year") != 0, F.col("d.start_season.year"))
    return d.select(
        F.col("d.id").alias("mal_id"), F.coalesce(_given(F.col("d.title")), F.lit("?")).alias("title"),
        _given(F.col("d.alternative_titles.en")).alias("title_english"),
        F.coalesce(_given(F.col("d.main_picture.large")), F.col("d.main_picture.medium")).alias("image_url"),
        F.col("d.mean").alias("score"), F.col("d.rank").alias("rank"), F.col("d.popularity").alias("popularity"),
        media_label(F.col("d.media_type")).alias("type"), F.coalesce(season, _leading_year(F.col("d.start_date"))).alias("year"),
        zero_null.alias("episodes"), F.initcap(F.replace(_given(F.col("d.status")), F.lit("_"), F.lit(" "))).alias("status"),
        _names("d.genres").alias("genres"), _names("d.studios").alias("studios"), _given(F.col("d.synopsis")).alias("synopsis"))


def normalise_second(records: DataFrame, column: str) -> DataFrame:
    """Item record of the second source: genres, themes and demographics become one tag list."""
    d = records.select(F.from_json(column, SECOND_SCHEMA).alias("d"))
    return d.select(
        F.col("d.mal_id").alias("mal_id"), F.col("d.title_english").alias("title_english"),
        F.coalesce(_given(F.col("d.images.jpg.large_image_url")), _given(F.col("d.images.jpg.image_url"))).alias("image_url"),
        F.col("d.rank").alias("rank"), F.col("d.popularity").alias("popularity"), F.col("d.episodes").alias("episodes"),
        F.col("d.status").alias("status"), F.concat(_names("d.genres"), _names("d.themes"), _names("d.demographics")).alias("genres"),
        _names("d.studios").alias("studios"), F.col("d.synopsis").alias("synopsis"), F.col("d.type").alias("type"),
        F.coalesce(F.nullif(F.col("d.year"), F.lit(0)), F.col("d.aired.prop.from.year")).alias("year"))


def lookup(requested: DataFrame, stored: DataFrame, fields: list[str]) -> DataFrame:
    """Every requested id once, with the stored fields or nulls."""
    return requested.select("mal_id").distinct().join(stored.select("mal_id", *fields), "mal_id", "left")


SEARCH_SCHEMA = ("STRUCT<id: BIGINT, title: STRING, alternative_titles: STRUCT<en: STRING>, media_type: STRING, start_date: STRING, mean: DOUBLE, "
                 "main_picture: STRUCT<medium: STRING, large: STRING>>")


def search_results(nodes: DataFrame, column: str, known: DataFrame) -> DataFrame:
    n = nodes.select(F.from_json(column, SEARCH_SCHEMA).alias("n"))
    flat = n.select(
        F.col("n.id").alias("mal_id"), F.coalesce(_given(F.col("n.title")), F.lit("?")).alias("title"),
        _given(F.col("n.alternative_titles.en")).alias("title_english"), media_label(F.col("n.media_type")).alias("type"),
        _leading_year(F.col("n.start_date")).alias("year"), F.col("n.mean").alias("mal_score"),
        F.coalesce(_given(F.col("n.main_picture.medium")), F.col("n.main_picture.large")).alias("image_url"))
    flags = known.select("mal_id", F.lit(True).alias("in_corpus"))
    return flat.join(flags, "mal_id", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))


def latest_state(log: DataFrame, key: str, seq: str, fields: list[str]) -> DataFrame:
    """Newest record per key (insert or replace); a task passes on one record per key.

    A record without a sequence value is the oldest; equal ones are told apart by the fields.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(seq), *[F.desc(c) for c in fields])
    return log.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").select(key, *fields)


def split_favourites(profiles: DataFrame, column: str) -> DataFrame:
    """One row per favourite id with a flag on lists longer than the site allows."""
    ids = F.filter(F.split(column, " "), lambda s: s != "")
    return profiles.select("username", (F.size(ids) > MAX_FAVOURITES).alias("too_many"), F.explode(ids).alias("id")).select(
        "username", F.col("id").cast("bigint").alias("anime_id"), "too_many")
