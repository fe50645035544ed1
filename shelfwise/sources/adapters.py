"""Views that read the benchmark tables as a rating log, a catalogue and user profiles.

The SQL is valid in Spark and in DuckDB and is shared with the correctness oracle.
``ord`` orders the log; it is a column list and not a number, so no global sort is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_ORDER = ["o_orderdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
             "l_quantity", "l_extendedprice"]

RATINGS = f"""
SELECT concat('u', lpad(CAST(o.o_custkey AS STRING), 6, '0')) AS username,
       l.l_partkey AS anime_id,
       CASE WHEN l.l_tax >= 0.075 THEN 'unknown'
            WHEN l.l_returnflag = 'A' THEN 'completed'
            WHEN l.l_returnflag = 'N' AND l.l_linestatus = 'F' THEN 'watching'
            WHEN l.l_returnflag = 'N' THEN 'plan_to_watch'
            WHEN l.l_linestatus = 'F' THEN 'on_hold'
            ELSE 'dropped' END AS status,
       CASE WHEN l.l_discount < 0.015 OR (l.l_returnflag = 'N' AND l.l_linestatus = 'O') THEN 0
            ELSE CAST(ceil(l.l_quantity / 5) AS INT) END AS score,
       {', '.join(LOG_ORDER)}
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

DETAILS = """
SELECT p_partkey AS mal_id,
       concat(p_name, ' ', CAST(p_partkey AS STRING)) AS title,
       p_type AS type,
       CASE WHEN p_partkey % 4 = 0 THEN 'Original' WHEN p_partkey % 4 = 1 THEN 'Manga' WHEN p_partkey % 4 = 2 THEN 'Game' ELSE NULL END AS source,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(500 + p_partkey * 37 % 480 AS DOUBLE) / 100 END AS score,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE (p_partkey * 613) % 50021 END AS scored_by,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 1 + (p_partkey * 271) % 20011 END AS rank,
       (p_partkey * 7919) % 100003 AS members,
       (p_partkey * 7919) % 100003 % 5003 AS favorites,
       1 + (p_partkey * 104729) % 30011 AS popularity,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS episodes,
       CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE concat(CAST(1975 + p_partkey * 31 % 51 AS STRING), '-', lpad(CAST(1 + p_partkey % 12 AS STRING), 2, '0'), '-15T00:00:00+00:00') END AS start_date,
       CASE WHEN p_partkey % 7 = 0 THEN '[]' ELSE concat('[''', replace(p_name, ' ', ''', '''), ''']') END AS genres,
       CASE WHEN p_size >= 40 THEN '["Collector''s", ''Large'']' WHEN p_size % 3 = 0 THEN '[''Compact'']' ELSE '[]' END AS themes,
       CASE WHEN p_size % 10 = 0 THEN '[]' ELSE concat('[''', p_brand, ''']') END AS studios,
       CASE WHEN p_partkey % 5 = 0 THEN '[''Trade'']' WHEN p_partkey % 11 = 0 THEN '[''Retail'']' ELSE '[]' END AS demographics,
       CASE WHEN p_size = 50 THEN 'Rx - Hentai' WHEN p_size > 30 THEN 'R' ELSE 'PG' END AS rating
FROM part
"""

PROFILES = """
SELECT concat('u', lpad(CAST(c_custkey AS STRING), 6, '0')) AS username,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Female' WHEN 'MACHINERY' THEN 'Male' WHEN 'AUTOMOBILE' THEN 'Non-Binary' ELSE NULL END AS gender,
       CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(2008 + c_custkey % 17 AS INT) END AS joined_year
FROM customer WHERE c_custkey % 97 <> 0
"""

# Base tables each adapter reads.
_READS = {"ratings": ["lineitem", "orders"], "details": ["part"], "profiles": ["customer"]}
_TEXT = {"ratings": RATINGS, "details": DETAILS, "profiles": PROFILES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _adapted(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    sources = {t: table(spark, sf_dir, t) for t in _READS[which]}
    text = _TEXT[which]
    for t in sources:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **sources)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _adapted(spark, sf_dir, "ratings")
    return log.select("username", "anime_id", "status", F.col("score").cast("int").alias("score"),
                      F.struct(*LOG_ORDER).alias("ord"))


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapted(spark, sf_dir, "details")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapted(spark, sf_dir, "profiles")


def item_vectors(spark: SparkSession, sf_dir: str, items: DataFrame) -> DataFrame:
    """One 64-d vector per indexed item (items share vectors by ``mal_id % n``)."""
    emb = table(spark, sf_dir, "embeddings")
    n = emb.agg(F.count("*")).scalar()
    return (items.select("anime_idx", "mal_id", F.pmod(F.col("mal_id"), n).alias("vec_id"))
            .join(emb.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"), "vec_id")
            .select("anime_idx", "mal_id", "vec", "label"))
