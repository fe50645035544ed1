"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATINGS_SCHEMA = "username STRING, anime_id BIGINT, status STRING, score INT"


def read_catalogue_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Small CSV whose quoted fields may span lines and hold doubled quotes."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def read_ratings_csv(spark: SparkSession, path: str, schema: str = RATINGS_SCHEMA) -> DataFrame:
    """Large splittable CSV, file or directory of appended files; the schema is given, never inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Only some columns; the scan reads no others."""
    return df.select(*names)


def scan_parquet(spark: SparkSession, path: str, where: Column, names: list[str]) -> DataFrame:
    """Filtered Parquet scan; filter and columns reach the row groups."""
    return spark.read.parquet(path).where(where).select(*names)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder per value; rows are brought together first, large folders stay split over several tasks."""
    df.hint("rebalance", *by).write.option("compression", "zstd").partitionBy(*by).parquet(path)


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("compression", "gzip").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def vector_table(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(index, vector) in single precision, laid out by index range."""
    return df.select(key, F.col(vec).cast("array<float>").alias(vec)).repartitionByRange(key).sortWithinPartitions(key)


def facts_table(spark: SparkSession, facts: dict[str, Column]) -> DataFrame:
    """Named scalars as (name, value) text rows."""
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in facts.items()])
    return spark.range(1).select(F.inline(rows))


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.json(path)


def columnar_payload(df: DataFrame, by: list[str], key: str, fields: list[str]) -> DataFrame:
    """JSON object of parallel arrays per group, in key order. A payload is one value, so a group must fit one row."""
    ordered = F.array_sort(F.collect_list(F.struct(key, *fields)))
    grouped = df.groupBy(*by).agg(ordered.alias("_rows"))
    arrays = F.struct(*[F.col(f"_rows.{c}").alias(c) for c in [key, *fields]])
    return grouped.select(*by, F.to_json(arrays).alias("payload"))
