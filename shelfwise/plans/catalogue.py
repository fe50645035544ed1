"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans import atlas_queries, cleaning_queries, feature_queries, log_queries, ranking_queries, recommend_queries  # noqa: F401
from shelfwise.plans.registry import ORACLE, QUERIES  # noqa: F401
from shelfwise.plans.world import World


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten unseen warm items for every validation and test user, with catalogue fields."""
    return World.of(spark, sf_dir).results.where("section = 'main' AND rank <= 10")
