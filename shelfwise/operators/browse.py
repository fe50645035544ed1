"""Facets, filters, sorts and cuts over recommended lists (section is ``main`` or ``cold``)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FACETS = ["genres", "themes", "studios"]


@dataclass(frozen=True)
class Filters:
    genres: list[str] = field(default_factory=list)
    themes: list[str] = field(default_factory=list)
    studios: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    min_score: float = 0.0


def facet_values(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct facet values of both sections; unknown types are dropped. Sorted by code point."""
    parts = [F.transform(c, _as_value(c)) for c in FACETS]
    types = F.when(F.col("type").isNotNull() & ~F.col("type").isin("", "?"),
                   F.array(F.struct(F.lit("types").alias("facet"), F.col("type").alias("value"))))
    none = F.array().cast("array<struct<facet:string,value:string>>")
    every = F.concat(*parts, F.coalesce(types, none))
    return rows.select(*by, F.explode(every).alias("f")).select(*by, "f.*").distinct().orderBy(*by, "facet", "value")


def _as_value(facet: str):
    return lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value"))


def keep_present(selected: DataFrame, facets: DataFrame, by: list[str]) -> DataFrame:
    """Selected (facet, value) pairs that the new result set still has."""
    return selected.join(facets, [*by, "facet", "value"], "left_semi")


def _lits(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def matches(f: Filters) -> Column:
    """All genres, all themes, any studio, one of the types, and a known score of at least the minimum."""
    cond = F.lit(True)
    for column, wanted in (("genres", f.genres), ("themes", f.themes)):
        if wanted:
            cond &= F.coalesce(F.size(F.array_except(_lits(wanted), F.col(column))) == 0, F.lit(False))
    if f.studios:
        cond &= F.coalesce(F.arrays_overlap("studios", _lits(f.studios)), F.lit(False))
    if f.types:
        cond &= F.coalesce(F.col("type").isin(f.types), F.lit(False))
    if f.min_score > 0:
        cond &= F.coalesce(F.col("mal_score") >= f.min_score, F.lit(False))
    return cond


def sort_keys(sort_by: str, ascending: bool) -> list[Column]:
    """Order columns. Missing values are last both ways; popularity is a rank, so its direction is reversed."""
    if sort_by == "relevance":
        return [F.desc("rank") if ascending else F.asc("rank")]
    column = {"score": "mal_score", "popularity": "popularity", "date": "start_date"}[sort_by]
    up = ascending != (sort_by == "popularity")
    return [F.asc_nulls_last(column) if up else F.desc_nulls_last(column), F.asc("rank")]


def sorted_rows(rows: DataFrame, by: list[str], sort_by: str, ascending: bool) -> DataFrame:
    """Position of every row in its list under the chosen order; equal values keep their relevance order."""
    order = Window.partitionBy(*by).orderBy(*sort_keys(sort_by, ascending))
    return rows.withColumn("position", F.row_number().over(order))


def cut(rows: DataFrame, main_k: int, cold_k: int) -> DataFrame:
    limit = F.when(F.col("section") == "main", main_k).otherwise(cold_k)
    return rows.where(F.col("position") <= limit)


def section_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "section").agg(F.count("*").alias("n"))


def search_titles(items: DataFrame, text: str, limit: int, known: DataFrame) -> DataFrame:
    """Case-insensitive substring hits, most popular first, flagged if the model knows the item."""
    hits = items.where(F.contains(F.lower("title"), F.lit(text.lower()))).orderBy("popularity", "mal_id").limit(limit)
    flags = known.select("mal_id", F.lit(True).alias("in_corpus"))
    return hits.join(flags, "mal_id", "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))


def facet_options(facets: DataFrame, selected: list[str], text: str) -> DataFrame:
    """Options containing the typed text, the selected ones first."""
    chosen = F.col("value").isin(selected) if selected else F.lit(False)
    return (facets.where(F.contains(F.lower("value"), F.lit(text.lower()))).withColumn("selected", chosen)
            .orderBy(F.desc("selected"), "value"))


def _finite(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def overlay_fresh(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh score and member counts over the stored ones; a value that is not a number becomes null."""
    f = fresh.select("mal_id", F.col("score").alias("_score"), F.col("members").alias("_members"))
    return (rows.join(f, "mal_id", "left")
            .withColumn("mal_score", _finite(F.coalesce("_score", "mal_score").cast("double")))
            .withColumn("members", _finite(F.coalesce(F.col("_members"), F.col("members")).cast("double")).cast("bigint"))
            .drop("_score", "_members"))


def merge_detail(rows: DataFrame, enriched: DataFrame) -> DataFrame:
    """Detail view: the list's own score, type and year first, the enriched record for the rest; a filled list wins."""
    e = enriched.select("mal_id", *[F.col(c).alias(f"e_{c}") for c in
                                    ("score", "rank", "popularity", "type", "year", "episodes", "genres", "studios")])
    own_type = F.when(~F.col("type").isin("", "?"), F.col("type"))
    return rows.join(e, "mal_id", "left").select(
        "mal_id", "title", F.coalesce("mal_score", "e_score").alias("score"), F.col("e_rank").alias("rank"),
        F.coalesce("e_popularity", "popularity").alias("popularity"), F.coalesce(own_type, F.col("e_type")).alias("type"),
        F.coalesce("year", "e_year").alias("year"), F.col("e_episodes").alias("episodes"),
        F.when(F.size("e_genres") > 0, F.col("e_genres")).otherwise(F.col("genres")).alias("tags"),
        F.array_join(F.when(F.size("e_studios") > 0, F.col("e_studios")).otherwise(F.col("studios")), ", ").alias("studios"))
