"""Structured Streaming over appended crawl logs.

Readers watch a folder of JSON files. State lives in tables under a target folder, and every
batch writes where its id says, so a batch that runs again after a failure changes nothing.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from shelfwise.operators import cleaning, crawl_log


def read_log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _disk_state(spark: SparkSession):
    """State of queries started here is kept on the executors' disks, its changes in the checkpoint folder."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _finish(query) -> list[dict]:
    """Wait for the end; for every batch, the rows in its state and those its watermark came too late for."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return [{"batch": p["batchId"], "state_rows": sum(o["numRowsTotal"] for o in p["stateOperators"]),
             "late_rows": sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])} for p in query.recentProgress]


def run_append(stream: DataFrame, out: str, checkpoint: str) -> list[dict]:
    """Process what is there and append it to a Parquet table, exactly once."""
    with _disk_state(stream.sparkSession):
        return _finish(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
                       .outputMode("append").trigger(availableNow=True).start())


def run_batches(stream: DataFrame, step, checkpoint: str, mode: str = "append") -> list[dict]:
    with _disk_state(stream.sparkSession):
        return _finish(stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
                       .outputMode(mode).trigger(availableNow=True).start())


def name_sightings(pages: DataFrame, pattern: str) -> DataFrame:
    """(ts, key) of every name linked from a page, in lower case."""
    raw = F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)))
    return pages.select("ts", raw.alias("raw")).select("ts", F.lower(crawl_log.url_decoded("raw")).alias("key"))


def _first_arrival(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The earliest time of a name that has no state; its state then lives for the horizon given with the rows."""
    if state.hasTimedOut:
        state.remove()
        return
    first, last, horizon = None, None, 0
    for rows in batches:
        first = rows["ts"].min() if first is None else min(first, rows["ts"].min())
        last = rows["ts"].max() if last is None else max(last, rows["ts"].max())
        horizon = int(rows["horizon"].iloc[0])
    if not state.exists:
        yield pd.DataFrame({"key": [key[0]], "ts": [first]})
    state.update((True,))
    # a timeout may not lie before the watermark
    state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + horizon)


def fresh_names(sightings: DataFrame, horizon_minutes: int = 60) -> DataFrame:
    """(key, ts) of names not sighted within the horizon, at their earliest time in the batch.

    The state holds the names of the last ``horizon_minutes`` of event time, whatever the stream has seen before; a name
    that comes again after it has been forgotten is passed on again, for :class:`NameRegistry` to recognise.
    """
    timed = sightings.withColumn("ts", F.coalesce("ts", F.timestamp_seconds(F.lit(0)))).withColumn("horizon", F.lit(horizon_minutes * 60_000))
    return timed.withWatermark("ts", f"{horizon_minutes} minutes").groupBy("key").applyInPandasWithState(
        _first_arrival, "key string, ts timestamp", "seen boolean", "update", GroupStateTimeout.EventTimeTimeout)


def names_per_interval(firsts: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, n_new): names by the event-time window of their first sighting.

    A window takes names that come up to ``late`` behind the newest one and leaves the state then; what comes
    later still is dropped from the counts, and its number is reported by :func:`run_batches`.
    """
    return (firsts.withWatermark("first_ts", late).groupBy(F.window("first_ts", width).alias("w"))
            .agg(F.count("*").alias("n_new")).select(F.col("w.start").alias("start"), "n_new"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _names(spark: SparkSession, folder: str) -> list[str]:
    if not _exists(spark, folder):
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def _last_finished(spark: SparkSession, folder: str) -> int:
    """Highest batch id under ``folder`` whose write has finished, -1 if none."""
    return max((int(n) for n in _names(spark, folder) if _exists(spark, f"{folder}/{n}/_SUCCESS")), default=-1)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class NameRegistry:
    """First sighting of every name, one folder per batch, in hash buckets: a batch reads the buckets of its names."""

    SCHEMA = "key STRING, first_ts TIMESTAMP, batch BIGINT, bucket INT"

    def __init__(self, spark: SparkSession, target: str, buckets: int = 256):
        self.spark, self.target, self.buckets = spark, target, buckets

    def before(self, batch_id: int) -> DataFrame | None:
        if batch_id == 0 or not _exists(self.spark, self.target):
            return None
        return self.table().where(F.col("batch") < batch_id)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        fresh = batch.groupBy("key").agg(F.min("ts").alias("first_ts")).withColumn("bucket", bucket).persist()
        known = self.before(batch_id)
        out = fresh
        if known is not None:
            touched = [r[0] for r in fresh.select("bucket").distinct().collect()]           # at most ``buckets`` numbers
            out = fresh.join(known.where(F.col("bucket").isin(touched)).select("key"), "key", "left_anti")
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.target}/batch={batch_id}")
        fresh.unpersist()

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.target)

    def stream(self) -> DataFrame:
        """First sightings as they are written, for :func:`names_per_interval`."""
        return self.spark.readStream.schema(self.SCHEMA).parquet(self.target)


class IntervalBoard:
    """The last count of every window that a stream in update mode has reported."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target

    def show(self, counts: DataFrame, batch_id: int) -> None:
        counts.write.mode("overwrite").parquet(f"{self.target}/batch={batch_id}")

    def table(self) -> DataFrame:
        rows = self.spark.read.schema("start TIMESTAMP, n_new BIGINT, batch BIGINT").parquet(self.target)
        return rows.groupBy("start").agg(F.max_by("n_new", "batch").alias("n_new"))


class KeepLastTable:
    """A table with the newest row per key, as a log-structured merge of sorted-out runs.

    A batch writes its own newest rows as a run of level 0, so bytes written follow the batch. ``fan`` runs of a level
    are merged into one of the next, so a row is rewritten once a level. The manifest of a batch lists the live runs and
    is the switch: readers follow the last finished one, and a batch at or below it is ignored. Runs and manifests that
    neither it nor the one before names are deleted, so a reader has until the next batch.
    """

    def __init__(self, spark: SparkSession, target: str, keys: list[str], order: str, schema: str, fan: int = 4):
        self.spark, self.target, self.keys, self.order, self.fan = spark, target, keys, order, fan
        self.schema = schema

    def runs(self, batch_id: int | None = None) -> tuple[int, list[tuple[str, int]]]:
        """(last batch, its live runs with their levels): some ``fan`` a level."""
        last = _last_finished(self.spark, f"{self.target}/manifest") if batch_id is None else batch_id
        if last < 0 or not _exists(self.spark, f"{self.target}/manifest/{last}"):
            return -1, []
        rows = self.spark.read.schema("run STRING, level INT").json(f"{self.target}/manifest/{last}").collect()
        return last, [(r["run"], r["level"]) for r in rows]

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        # a row without an order value is the oldest; equal ones are told apart by the other columns
        newest = F.max(F.struct(F.col(self.order).alias("_at"), F.struct(*rest).alias("_n"))).alias("_last")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_last._n.*")

    def _read(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.target}/data/{r}" for r in runs])

    def _write(self, rows: DataFrame, run: str) -> None:
        self._newest(rows).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.target}/data/{run}")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        last, live = self.runs()
        if batch_id <= last:
            return
        self._write(batch, f"{batch_id}-0")
        live = [*live, (f"{batch_id}-0", 0)]
        level = 0
        while len(full := [r for r, at in live if at == level]) >= self.fan:
            self._write(self._read(full), f"{batch_id}-{level + 1}")
            live = [(r, at) for r, at in live if at != level] + [(f"{batch_id}-{level + 1}", level + 1)]
            level += 1
        self.spark.createDataFrame(live, "run STRING, level INT").coalesce(1).write.mode("overwrite").json(
            f"{self.target}/manifest/{batch_id}")
        self._clean(last, {r for r, _ in live})

    def _clean(self, before: int, live: set[str]) -> None:
        keep = live | {r for r, _ in self.runs(before)[1]}
        for folder, wanted in (("data", keep.__contains__), ("manifest", lambda name: int(name) >= before)):
            for name in _names(self.spark, f"{self.target}/{folder}"):
                if not wanted(name):
                    _delete(self.spark, f"{self.target}/{folder}/{name}")

    def table(self) -> DataFrame:
        return self._newest(self._read([r for r, _ in self.runs()[1]]))


class StatusBoard:
    """Live counts per status: each batch of the running totals replaces the last one."""

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target

    def show(self, totals: DataFrame, batch_id: int) -> None:
        totals.write.mode("overwrite").parquet(f"{self.target}/{batch_id}")

    def table(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.target}/{_last_finished(self.spark, self.target)}")


def live_status(log: DataFrame) -> DataFrame:
    return crawl_log.status_counts(log, "status")


class Gate:
    """Lets stream rows pass whose key is eligible when their batch comes.

    The keys' states come with the stream, or from any other that merges into ``states``: a batch first brings its own
    states in, then is joined with the newest ones, so a key admitted between two files passes from then on. A batch
    that runs again finds the states it saw, as long as it is the last one that was merged.
    """

    def __init__(self, states: KeepLastTable, key: str, out: str, eligible, columns: list[str]):
        self.states, self.key, self.out, self.eligible, self.columns = states, key, out, eligible, columns

    def step(self, batch: DataFrame, batch_id: int) -> None:
        self.states.merge(batch.select(*self.states.keys, self.states.order, *self._rest()), batch_id)
        admitted = self.states.table().where(self.eligible).select(self.key)
        batch.join(admitted, self.key, "left_semi").select(*self.columns).write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")

    def _rest(self) -> list[str]:
        names = [c.strip().split()[0] for c in self.states.schema.split(",")]
        return [c for c in names if c not in (*self.states.keys, self.states.order)]


def batch_twin(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What :class:`KeepLastTable` must equal: keep-last over the whole log (the order column kept)."""
    rest = [c for c in log.columns if c not in keys]
    ordered = log.withColumn("_o", F.col(order))
    return cleaning.keep_last(ordered.select(*keys, *rest, "_o"), keys, "_o")
