"""Item and user feature encoding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions import quantiles
from shelfwise.functions.keys import dense_index
from shelfwise.functions.lists import bound, parse_list

# Reserved item ids, bin edges, defaults.
PAD, OOV, FIRST_REAL = 0, 1, 2
ERA_EDGES = [1989, 1999, 2009, 2017]                 # <=1989, 1990-99, 2000-09, 2010-17, 2018+
EPISODE_EDGES = [1, 2, 6, 13, 26, 52]                # 0-1, 2, 3-6, 7-13, 14-26, 27-52, 53+
COHORT_EDGES = [2012, 2016, 2019, 2021]              # <=2012, 2013-16, 2017-19, 2020-21, 2022+
NEWEST_COHORT = 4
STUDIO_MIN_COUNT = 10
COLD_FRACTION = 0.05
MIN_TEXT = 50
LIST_FIELDS = ["genres", "themes", "studios", "demographics"]


def with_lists(details: DataFrame) -> DataFrame:
    """Replace the printed lists by arrays."""
    return details.withColumns({c: parse_list(F.col(c)) for c in LIST_FIELDS})


def start_year(date: Column) -> Column:
    return F.year(F.try_to_timestamp(date))


def index_items(details: DataFrame) -> DataFrame:
    """Dense item index from 2 in ``mal_id`` order (0 and 1 are the pad and unknown items)."""
    return dense_index(details, "mal_id", "anime_idx", start=FIRST_REAL)


def vocabulary(df: DataFrame, column: str, start: int = 1) -> DataFrame:
    """(value, code) over the sorted distinct values of a dictionary-sized column."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return values.withColumn("code", (F.row_number().over(Window.orderBy("value")) + start - 1).cast("int"))


def encode(df: DataFrame, column: str, vocab: DataFrame, out: str) -> DataFrame:
    """Code of each value; null or unseen gives 0.

    The dictionary comes in as one map value, so rows are not shuffled by a column that may be
    null, or the same, in a third of them.
    """
    codes = vocab.agg(F.map_from_entries(F.collect_list(F.struct("value", "code")))).scalar()
    return (df.withColumn("_codes", codes)
            .withColumn(out, F.coalesce(F.try_element_at("_codes", F.col(column)), F.lit(0))).drop("_codes"))


def encode_first_tag(df: DataFrame, column: str, out: str) -> DataFrame:
    """Code of the first tag of a list; an empty list gives 0."""
    first = df.withColumn("_first", F.get(column, F.lit(0)))
    return encode(first, "_first", vocabulary(first, "_first"), out).drop("_first")


def tag_vocabulary(df: DataFrame, column: str, min_count: int = 1) -> DataFrame:
    """One row: the sorted array of tags used at least ``min_count`` times."""
    counts = df.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count).agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def multi_hot(df: DataFrame, column: str, out: str, present_bit: bool = True) -> DataFrame:
    """0/1 array over the sorted tag vocabulary, with a trailing "has any tag" bit if asked."""
    wide = df.withColumn("_tags", tag_vocabulary(df, column).scalar())
    bits = bound(F.col(column), lambda held: F.transform("_tags", lambda t: F.array_contains(held, t).cast("tinyint")))
    if present_bit:
        bits = F.concat(bits, F.array((F.size(column) > 0).cast("tinyint")))
    return wide.withColumn(out, bits).drop("_tags")


def multi_ids(df: DataFrame, column: str, out: str, min_count: int = STUDIO_MIN_COUNT) -> DataFrame:
    """Sorted distinct ids of a list: 2.. for frequent tags, 1 for rare ones, [0] for an empty list."""
    wide = df.withColumn("_tags", tag_vocabulary(df, column, min_count).scalar())
    ids = F.transform(column, lambda t: F.greatest(F.array_position("_tags", t) + 1, F.lit(1)).cast("int"))
    return wide.withColumn(out, F.when(F.size(column) == 0, F.array(F.lit(0)))
                           .otherwise(F.array_sort(F.array_distinct(ids)))).drop("_tags")


def bucketize(value: Column, edges: list[int], first: int = 1, floor: int | None = None) -> Column:
    """Right-closed bins numbered from ``first``; null, or below ``floor``, gives 0."""
    case = F.when(value.isNull(), 0)
    if floor is not None:
        case = case.when(value < floor, 0)
    for i, edge in enumerate(edges):
        case = case.when(value <= edge, first + i)
    return case.otherwise(first + len(edges)).cast("int")


def era_bucket(date: Column) -> Column:
    return bucketize(start_year(date), ERA_EDGES)


def episode_bucket(episodes: Column) -> Column:
    return bucketize(episodes, EPISODE_EDGES, floor=0)


ITEM_FEATURES = ["anime_idx", "type_id", "source_id", "rating_id", "demographics_id", "startyear_bucket",
                 "episodes_bucket", "genres_multihot", "themes_multihot", "studio_ids"]


def item_features(items: DataFrame) -> DataFrame:
    """All encoded features of the indexed items, lists already parsed."""
    df = items
    for column in ("type", "source", "rating"):
        df = encode(df, column, vocabulary(items, column), f"{column}_id")
    df = encode_first_tag(df, "demographics", "demographics_id")
    df = df.withColumns({"startyear_bucket": era_bucket(F.col("start_date")),
                         "episodes_bucket": episode_bucket(F.col("episodes"))})
    df = multi_hot(multi_hot(df, "genres", "genres_multihot"), "themes", "themes_multihot")
    return multi_ids(df, "studios", "studio_ids").select(*ITEM_FEATURES)


def with_special_rows(features: DataFrame) -> DataFrame:
    """Add the neutral pad and unknown rows: zero codes, zero vectors of the same width, studio [0]."""
    widths = features.agg(F.max(F.size("genres_multihot")).alias("g"), F.max(F.size("themes_multihot")).alias("t"))
    zeros = {c: F.lit(0) for c in ITEM_FEATURES[1:7]}
    special = (widths.withColumn("anime_idx", F.explode(F.array(F.lit(PAD), F.lit(OOV))))
               .withColumns(zeros)
               .withColumn("genres_multihot", F.array_repeat(F.lit(0).cast("tinyint"), F.col("g")))
               .withColumn("themes_multihot", F.array_repeat(F.lit(0).cast("tinyint"), F.col("t")))
               .withColumn("studio_ids", F.array(F.lit(0))))
    return features.unionByName(special.select(*ITEM_FEATURES))


def cold_items(items: DataFrame, fraction: float = COLD_FRACTION) -> DataFrame:
    """The newest ``ceil(fraction * n)`` dated items, ties by index.

    Counts per date place the cut; within the cut's own date the last index that still fits is
    an order statistic, so no date is sorted in one task.
    """
    dated = items.withColumn("_at", F.try_to_timestamp("start_date")).where(F.col("_at").isNotNull())
    newer = Window.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)
    dates = (dated.groupBy("_at").agg(F.count("*").alias("_here"))
             .withColumn("_newer", F.coalesce(F.sum("_here").over(newer), F.lit(0)))
             .withColumn("_limit", F.ceil(items.agg(F.count("*")).scalar() * F.lit(fraction)))
             .where("_newer < _limit"))
    reached = dated.join(dates, "_at")
    whole = reached.where("_newer + _here <= _limit")
    cut = reached.where("_newer + _here > _limit")
    room = dates.where("_newer + _here > _limit").agg(F.max(F.col("_limit") - F.col("_newer"))).scalar()
    last = quantiles.order_statistics(cut, [], "anime_idx", {"last": room - 1}).select("last").scalar()
    cut = cut.where(F.col("anime_idx") <= last)
    keep = ["anime_idx", "mal_id", "start_date"]
    return whole.select(*keep).unionByName(cut.select(*keep))


def size_drift(features: DataFrame, expected: dict[str, int]) -> DataFrame:
    """Actual against expected widths and code counts."""
    actual = features.agg(*[F.max(F.size(c)).alias(c) if c.endswith("multihot") else (F.max(c) + 1).alias(c)
                            for c in expected])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("actual"),
                              F.lit(n).cast("bigint").alias("expected")) for c, n in expected.items()])
    return actual.select(F.inline(rows)).withColumn("ok", F.col("actual") == F.col("expected"))


def joined_year(text: Column) -> Column:
    """Year of ``Dec 1, 2018`` or of an ISO date; anything else is null."""
    return F.year(F.coalesce(F.try_to_date(text, "MMM d, yyyy"),
                             F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")))


def cohort(year: Column) -> Column:
    """Join cohort 0..4; an unknown year counts as the newest."""
    return F.when(year.isNull(), NEWEST_COHORT).otherwise(bucketize(year, COHORT_EDGES, first=0)).cast("int")


def encode_profiles(profiles: DataFrame, genders: DataFrame | None = None) -> DataFrame:
    """(username, gender_id, joined_bucket); pass stored ``genders`` codes to encode unseen profiles."""
    vocab = vocabulary(profiles, "gender") if genders is None else genders
    return (encode(profiles, "gender", vocab, "gender_id")
            .select("username", "gender_id", cohort(F.col("joined_year")).alias("joined_bucket")))


def user_features(split: DataFrame, encoded: DataFrame) -> DataFrame:
    """Features of indexed users; a user without a profile gets the defaults."""
    return (split.select("username", "user_idx", "split").join(encoded, "username", "left")
            .select("user_idx", "split", F.coalesce("gender_id", F.lit(0)).alias("gender_id"),
                    F.coalesce("joined_bucket", F.lit(NEWEST_COHORT)).alias("joined_bucket")))


def low_information(text: Column, placeholders: list[str]) -> Column:
    """Missing, shorter than 50 characters, or a known placeholder."""
    short = F.coalesce(F.length(F.trim(text)), F.lit(0)) < MIN_TEXT
    return short | F.coalesce(F.lower(F.trim(text)).isin([p.lower() for p in placeholders]), F.lit(False))


def vocabulary_spec(items: DataFrame, profiles: DataFrame) -> DataFrame:
    """Long table (feature, value, code) of every dictionary."""
    parts = [vocabulary(items, c).select(F.lit(c).alias("feature"), "value", "code")
             for c in ("type", "source", "rating")]
    first = items.withColumn("_first", F.get("demographics", F.lit(0)))
    parts.append(vocabulary(first, "_first").select(F.lit("demographics").alias("feature"), "value", "code"))
    for column, start, least in (("genres", 0, 1), ("themes", 0, 1), ("studios", 2, STUDIO_MIN_COUNT)):
        tags = tag_vocabulary(items, column, least).select(F.posexplode("tags").alias("code", "value"))
        parts.append(tags.select(F.lit(column).alias("feature"), "value", (F.col("code") + start).alias("code")))
    parts.append(vocabulary(profiles, "gender").select(F.lit("gender").alias("feature"), "value", "code"))
    return reduce(DataFrame.unionByName, parts)
