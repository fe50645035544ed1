"""Documents to packed training windows: quality, boilerplate lines, near duplicates, benchmark leaks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; ``run`` writes every
result as Parquet below the shared folder and hands the reread table on. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage_root
from shelfwise.llm import decontaminate, line_dedup, packing, quality, simhash
from shelfwise.llm.common import table
from shelfwise.llm.queries import TOKENIZER


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a tenth of their source's pages repeat; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    size = F.when(F.col("n_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked SimHash fingerprints."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage like a test item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 ids."""
    return packing.pack_documents(docs, TOKENIZER, 0)


STAGES = [("quality classifier", keep_good), ("line dedup", drop_boilerplate), ("near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_leaks), ("packing", pack)]

#: SQL has no tokenizer, alignment, classifier or XXH64
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{stage_root(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
