"""Learned parts, on MLlib or as sums that Spark adds up. These are other algorithms than a two-tower net, LambdaRank or a neural projection;
their quality is not comparable with published numbers of those."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.keys import hash_u32
from shelfwise.functions.staging import stage, stage_root
from shelfwise.functions.vectors import unit
from shelfwise.operators import ranker
from shelfwise.operators.features import FEATURES

SEED = 42


def learn_vectors(positives: DataFrame, rank: int = 32, iterations: int = 8, reg: float = 0.05, alpha: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(user vectors, item vectors) of unit length, from implicit-feedback factorisation."""
    spark = positives.sparkSession
    spark.sparkContext.setCheckpointDir(stage_root(spark))       # ALS cuts its lineage every ten rounds
    als = ALS(rank=rank, maxIter=iterations, regParam=reg, alpha=alpha, implicitPrefs=True, seed=SEED,
              userCol="user_idx", itemCol="anime_idx", ratingCol="weight")
    weighted = positives.select("user_idx", "anime_idx", F.greatest(F.col("score") / 10.0, F.lit(0.5)).alias("weight"))
    model = als.fit(weighted)

    def factors(df: DataFrame, key: str) -> DataFrame:
        return df.select(F.col("id").alias(key), unit(F.col("features").cast("array<double>")).alias("vec"))
    return factors(model.userFactors, "user_idx"), factors(model.itemFactors, "anime_idx")


@dataclass(frozen=True)
class ContentModel:
    """Ridge regression from an item's feature array (and a constant) to its learned vector."""

    coefficients: np.ndarray

    def vectors(self, items: DataFrame, key: str, column: str) -> DataFrame:
        """(key, vec) of unit length for every item with features, cold ones too; an item that gets no direction is left out."""
        weights = self.coefficients

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x = np.column_stack([_matrix(batch.column("x")), np.ones(batch.num_rows)])
                    yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(list(x @ weights), pa.list_(pa.float64()))], [key, "raw"])
        rows = items.select(key, F.col(column).cast("array<double>").alias("x"))
        raw = rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, raw array<double>")
        return raw.where(F.exists("raw", lambda x: x != 0)).select(key, unit(F.col("raw")).alias("vec"))


def _known(items: DataFrame, learned: DataFrame, key: str, column: str) -> DataFrame:
    """(x, vec) of the items that have both. Spark takes an array for one number, so it would send such a table whole."""
    return (items.select(key, F.col(column).cast("array<double>").alias("x")).hint("merge")
            .join(learned.select(key, "vec"), key).select("x", "vec"))


def fit_content(items: DataFrame, learned: DataFrame, key: str, column: str, ridge: float = 1.0) -> ContentModel:
    """Fit on the items that have a learned vector ``vec``, so that those without one get theirs from what they are.

    Tasks add up products of features and vectors; the sums, as large as features x (features + dimensions), are
    solved on the driver.
    """
    def sums(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.column_stack([_matrix(batch.column("x")), np.ones(batch.num_rows)])
                one = x.T @ np.column_stack([x, _matrix(batch.column("vec"))])
                total = one if total is None else total + one
        if total is not None:
            row, col = np.divmod(np.arange(total.size), total.shape[1])
            yield pa.RecordBatch.from_pydict({"row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32()), "s": pa.array(total.ravel())})
    got = _known(items, learned, key, column).mapInArrow(sums, "row int, col int, s double").groupBy("row", "col").agg(F.sum("s").alias("s")).toPandas()
    both = np.zeros((got["row"].max() + 1, got["col"].max() + 1))
    both[got["row"], got["col"]] = got["s"]
    p = len(both)
    penalty = ridge * np.eye(p)
    penalty[-1, -1] = 1e-9                                          # the constant is free
    return ContentModel(np.linalg.solve(both[:, :p] + penalty, both[:, p:]))


def fit_ranker(frame: DataFrame, trees: int = 20, depth: int = 3) -> ranker.Ranker:
    """Listwise boosted trees on graded labels (column ``label``)."""
    return ranker.fit(frame, FEATURES, trees=trees, depth=depth)


def score_ranker(model: ranker.Ranker, frame: DataFrame) -> DataFrame:
    return model.score(frame, ["user_idx", "anime_idx"])


def importances(spark, model: ranker.Ranker) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(FEATURES, model.importances())]
    return spark.createDataFrame(rows, "feature string, importance double")


def _with_vector(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    v = F.col(columns[0]) if len(columns) == 1 else F.array(*columns)
    return df.select(key, array_to_vector(v.cast("array<double>")).alias("_v"))


def kmeans(df: DataFrame, key: str, columns: list[str], k: int = 28):
    """(labels, model) of k-means over an array column or several number columns."""
    ready = _with_vector(df, key, columns)
    model = KMeans(k=k, seed=SEED, featuresCol="_v", predictionCol="label").fit(ready)
    return model.transform(ready).select(key, "label"), model


@dataclass(frozen=True)
class Mixture:
    """Gaussians with a variance per dimension: ``weights`` (k), ``means`` and ``variances`` (k, d)."""

    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray

    def joint(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, a row per vector and a column per component."""
        scale = 1 / self.variances
        square = (x * x) @ scale.T - 2 * x @ (self.means * scale).T + (self.means ** 2 * scale).sum(axis=1)
        return np.log(self.weights) - 0.5 * (square + np.log(2 * np.pi * self.variances).sum(axis=1))

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each component is responsible for each vector, and every vector's log-likelihood."""
        joint = self.joint(x)
        top = joint.max(axis=1, keepdims=True)
        likelihood = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        return np.exp(joint - likelihood[:, None]), likelihood


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _sums(mixture_of) -> Callable:
    """Per task: weighted sums of the vectors and their squares, a row per component and dimension."""
    def run(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            shares, likelihood = mixture_of(batch, x)
            one = np.stack([np.repeat(shares.sum(axis=0)[:, None], x.shape[1], axis=1), shares.T @ x, shares.T @ (x * x)])
            total = (one, likelihood.sum()) if total is None else (total[0] + one, total[1] + likelihood.sum())
        if total is not None:
            k, d = total[0].shape[1:]
            part, dim = np.divmod(np.arange(k * d), d)
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "dim": pa.array(dim, pa.int32()),
                                              **{f"s{i}": pa.array(total[0][i].ravel()) for i in range(3)},
                                              "likelihood": pa.array(np.where(np.arange(k * d) == 0, total[1], 0.0))})
    return run


def _maximised(rows: DataFrame, mixture_of, k: int, floor: float) -> tuple[Mixture, float]:
    """The mixture that fits the sums best, and the mean log-likelihood of the one they were weighted by."""
    summed = rows.mapInArrow(_sums(mixture_of), "part int, dim int, s0 double, s1 double, s2 double, likelihood double")
    got = summed.groupBy("part", "dim").agg(*[F.sum(c).alias(c) for c in ("s0", "s1", "s2", "likelihood")]).collect()      # k x d rows
    d = 1 + max(r.dim for r in got)
    s = np.zeros((3, k, d))
    for r in got:
        s[:, r.part, r.dim] = r.s0, r.s1, r.s2
    n = s[0, :, 0].sum()
    held = np.maximum(s[0], 1e-12)
    means = s[1] / held
    variances = np.maximum(s[2] / held - means ** 2, 0) + floor
    return Mixture(np.maximum(s[0, :, 0], 1e-12) / n, means, variances), float(sum(r.likelihood for r in got) / n)


def diagonal_mixture(df: DataFrame, key: str, column: str, k: int, rounds: int = 100, tolerance: float = 1e-3,
                     floor: float = 1e-6) -> tuple[DataFrame, list[float]]:
    """(key, label, shares) of a mixture of ``k`` Gaussians without covariances, and the mean log-likelihood of every round.

    Expectation-maximisation from k-means labels. A round is one pass: tasks weigh their vectors with the parameters of
    the round before, and send a sum per component and dimension; what reaches the driver is as large as the parameters.
    It ends when the likelihood grows by less than ``tolerance``. ``floor`` is added to every variance.
    """
    labels, _ = kmeans(df, key, [column], k)
    start = stage(df.select(key, F.col(column).cast("array<double>").alias("v")).join(labels, key), "mixture-start")

    def hard(batch, x):
        return np.eye(k)[batch.column("label").to_numpy()], np.zeros(len(x))
    mixture, _ = _maximised(start, hard, k, floor)
    trace: list[float] = []
    for _ in range(rounds):
        better, likelihood = _maximised(start, lambda batch, x, m=mixture: m.shares(x), k, floor)
        trace.append(likelihood)
        if len(trace) > 1 and trace[-1] - trace[-2] < tolerance:
            break
        mixture = better

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                shares, _ = mixture.shares(_matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(shares.argmax(axis=1), pa.int32()),
                                                  pa.array(list(shares), pa.list_(pa.float64()))], [key, "label", "shares"])
    kind = dict(start.dtypes)[key]
    return stage(start.select(key, "v").mapInArrow(assign, f"{key} {kind}, label int, shares array<double>"), "mixture"), trace


def project(df: DataFrame, key: str, column: str, dims: int = 2) -> DataFrame:
    """Coordinates on the first principal components."""
    ready = _with_vector(df, key, [column])
    xy = vector_to_array(F.col("_xy"))
    out = PCA(k=dims, inputCol="_v", outputCol="_xy").fit(ready).transform(ready)
    return out.select(key, xy[0].alias("x"), xy[1].alias("y"))


def knob_grid(spark, knobs: dict[str, list], depends: dict[str, list[str]]) -> DataFrame:
    """All settings of the knobs; a knob whose switch is off is null, and settings that become equal count once."""
    grid = spark.range(1)
    for name, values in knobs.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    for switch, dependents in depends.items():
        grid = grid.withColumns({d: F.when(F.col(switch), F.col(d)) for d in dependents})
    named = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in sorted(knobs)]
    return grid.drop("id").distinct().withColumn("run_name", F.concat_ws(",", *named))


def random_settings(grid: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded draw of settings without repeats."""
    return grid.orderBy(hash_u32(seed, F.col("run_name")), "run_name").limit(n)


def kmeans_sweep(df: DataFrame, column: str, settings: DataFrame) -> DataFrame:
    """One k-means fit per setting (columns ``run_name``, ``k``, ``dims``: leading components used, null for all) with its
    cost. A fit is a cluster job; the loop only starts them."""
    rows = []
    for s in settings.select("run_name", "k", "dims").collect():          # a handful of settings
        used = df if s["dims"] is None else df.withColumn(column, F.slice(column, 1, s["dims"]))
        _, model = kmeans(used, "anime_idx", [column], s["k"])
        rows.append((s["run_name"], s["k"], float(model.summary.trainingCost)))
    return df.sparkSession.createDataFrame(rows, "run_name string, k int, cost double")
