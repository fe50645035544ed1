"""Sweeps of the ranker's settings: fits run beside each other, a board of results can be taken up again."""

from __future__ import annotations

import hashlib
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.staging import discard
from shelfwise.operators import metrics, ranker

KNOBS = {"trees": "int", "depth": "int", "rate": "double"}
BOARD = "run_name string, " + ", ".join(f"{k} {t}" for k, t in KNOBS.items()) + ", metric string, value double"


def read_board(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all finished runs; an empty board if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return spark.createDataFrame([], BOARD)
    return spark.read.schema(BOARD).parquet(f"{path}/*")


def ranker_sweep(train: DataFrame, held: DataFrame, side: DataFrame, names: list[str], settings: DataFrame, board: str, *,
                 ks: list[int], at_once: int = 4) -> DataFrame:
    """The board (run_name, settings, metric, value) after every setting has been fitted on ``train`` and judged on ``held``.

    Metrics are recall and NDCG at ``ks`` of the held pools in the ranker's order; ``held`` has features, ``label`` and
    ``pool_rank``, ``side`` the totals per user. Runs on the board are not fitted again, whatever their order, and a run
    writes its own folder, so a sweep that was cut off goes on where it stopped. Features are binned once for all fits;
    ``at_once`` of them share the cluster. A board belongs to one pair of tables: a new one needs a new path.
    """
    spark = train.sparkSession
    done = read_board(spark, board).select("run_name").distinct()
    rows = settings.select("run_name", *KNOBS).join(done, "run_name", "left_anti").distinct().orderBy("run_name").collect()      # a handful of settings
    if rows:
        data = ranker.prepare(train, names)

        @inheritable_thread_target(spark)
        def run(row) -> None:
            chosen = {k: row[k] for k in KNOBS}
            pred = ranker.boost(data, **chosen).score(held, ["user_idx", "anime_idx"])
            ranked = metrics.rank_pool(held.select("user_idx", "anime_idx", "pool_rank", "label").join(pred, ["user_idx", "anime_idx"]), "pred")
            found = metrics.evaluate(ranked, side, ks).select(
                F.lit(row["run_name"]).alias("run_name"), *[F.lit(v).cast(KNOBS[k]).alias(k) for k, v in chosen.items()], "metric", "value")
            folder = hashlib.sha256(row["run_name"].encode()).hexdigest()[:16]
            found.coalesce(1).write.mode("overwrite").parquet(f"{board}/{folder}")          # a few rows
        with ThreadPoolExecutor(at_once) as pool:
            list(pool.map(run, rows))
        discard(data.packed)
    return read_board(spark, board)
