"""A listwise ranker: boosted trees on LambdaRank gradients, with histograms summed by Spark.

A query group (a user's pool) is one row of binned features, so gradients need no shuffle. A level of a tree is one pass:
tasks add up gradients per node, feature and bin, Spark sums those, and the driver, which sees nodes x features x bins
numbers, chooses the splits. A lost executor costs its share of one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.staging import discard, stage

BINS = 64                  # of known values; bin 0 holds missing ones
SLICE_GROUPS = 256         # groups whose features are unpacked at once inside a task
PAIRS = 1 << 20            # pairs of candidates that are weighed at once
L2 = 1.0


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: node i has children 2i+1 and 2i+2, a row goes left if its bin is at most the cut."""

    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def node(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Position of each row among the nodes of a level."""
        at = np.zeros(len(codes), np.int64)
        for level in range(depth):
            right = np.zeros(len(codes), bool)
            for j in range(1 << level):             # a column at a time, which is faster than to look up each row's
                i = j + (1 << level) - 1
                right |= (codes[:, self.features[i]] > self.cuts[i]) & (at == j)
            at = 2 * at + right
        return at


@dataclass(frozen=True)
class Ranker:
    """``edges`` (ascending, per feature), the trees, and the gain that each feature brought."""

    names: list[str]
    edges: list[np.ndarray]
    depth: int
    trees: list[Tree] = field(default_factory=list)
    gains: np.ndarray | None = None

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """The features of a batch; null is NaN."""
        return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in self.names])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Bins of a feature matrix; missing values (NaN) get bin 0, which goes left everywhere."""
        out = np.empty(x.shape, np.uint8, order="F")
        for f, edges in enumerate(self.edges):
            out[:, f] = np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(edges, x[:, f]))
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes))
        for tree in self.trees:
            out += tree.values[tree.node(codes, self.depth)]
        return out

    def score(self, frame: DataFrame, key: list[str]) -> DataFrame:
        """(key, pred) of every row of a feature frame."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.array(self.scores(self.codes(self.matrix(batch))))], [*key, "pred"])
        rows = frame.select(*key, *[F.col(n).cast("double").alias(n) for n in self.names])
        kinds = dict(rows.dtypes)
        return rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", pred double")

    def importances(self) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        return self.gains / max(self.gains.sum(), 1e-300)


def lambdas(labels: np.ndarray, scores: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per candidate: the pull on its score, and the curvature. Groups follow each other, ``sizes`` long; without it all is one.

    A pair of different labels pulls apart by how wrong the order is, times the change of NDCG that swapping the two in
    the present order would make. Ties of score stand in pool order. A group of equal labels pulls nowhere.
    """
    sizes = np.array([len(labels)]) if sizes is None else np.asarray(sizes)
    width = int(sizes.max(initial=0))
    if not width:
        return np.zeros(0), np.zeros(0)
    column = np.arange(width)
    there = column < sizes[:, None]
    label, score = np.zeros(there.shape, np.int64), np.full(there.shape, -np.inf)
    label[there], score[there] = labels, scores
    place = np.empty(there.shape, np.int64)
    np.put_along_axis(place, np.argsort(-score, axis=1, kind="stable"), np.broadcast_to(column, there.shape), axis=1)
    discount, gain = 1 / np.log2(place + 2.0), np.where(there, np.exp2(label.astype(float)) - 1, 0.0)
    ideal = (np.sort(gain, axis=1)[:, ::-1] / np.log2(column + 2.0)).sum(axis=1)
    least = np.where(there, label, np.iinfo(np.int64).max).min(axis=1)
    pull, curve = np.zeros(there.shape), np.zeros(there.shape)
    groups, at = np.nonzero(there & (label > least[:, None]))
    for i in range(0, len(groups), step := max(1, PAIRS // width)):          # a row per candidate with a lower one in its group
        g, c = groups[i:i + step], at[i:i + step]
        lower = there[g] & (label[g] < label[g, c][:, None])
        wrong = 1 / (1 + np.exp(np.clip(score[g, c][:, None] - score[g], -60, 60)))
        weight = np.where(lower, (gain[g, c][:, None] - gain[g]) * np.abs(discount[g, c][:, None] - discount[g]), 0.0) / ideal[g][:, None]
        force, bend = wrong * weight, wrong * (1 - wrong) * weight
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        pull[g, c] += force.sum(axis=1)
        pull[g[first]] -= np.add.reduceat(force, first)
        curve[g, c] += bend.sum(axis=1)
        curve[g[first]] += np.add.reduceat(bend, first)
    return pull[there], curve[there]


def _unpacked(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sizes of groups, their labels, bins of all their rows) by slices of groups. Each feature's bins lie side by side."""
    for at in range(0, batch.num_rows, SLICE_GROUPS):
        part = batch.slice(at, SLICE_GROUPS)
        labels = part.column("labels")
        blob = b"".join(part.column("codes").to_pylist())
        yield (labels.value_lengths().to_numpy(), labels.flatten().to_numpy(),
               np.asfortranarray(np.frombuffer(blob, np.uint8).reshape(-1, features)))


def _pack(frame: DataFrame, model: Ranker, group: str, item: str, label: str) -> DataFrame:
    """One row per group with its labels and bins, in order of ``item``; a group is a pool of bounded depth.

    Groups of equal labels are left out, since they pull nowhere. Rows are binned before they are shuffled.
    """
    graded = frame.withColumn("_label", F.coalesce(F.col(label).cast("int"), F.lit(0)))
    uneven = graded.groupBy(F.col(group).alias("_uneven")).agg(F.min("_label").alias("lo"), F.max("_label").alias("hi")).where("lo < hi").select("_uneven")
    rows = (graded.join(uneven, F.col(group).eqNullSafe(F.col("_uneven")), "left_semi")
            .select(F.col(group).alias("group"), F.col(item).alias("item"), F.col("_label").alias("label"), *[F.col(c).cast("double").alias(c) for c in model.names]))
    kinds = dict(rows.dtypes)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.codes(model.matrix(batch)).tobytes()
            n = len(model.names)
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("item"), batch.column("label"), pa.array(
                [codes[i:i + n] for i in range(0, len(codes), n)], pa.binary())], ["group", "item", "label", "codes"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [b"".join(v) for v in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("labels"), pa.array(codes, pa.binary())], ["labels", "codes"])
    coded = rows.mapInArrow(binned, f"group {kinds['group']}, item {kinds['item']}, label int, codes binary")
    dealt = coded.repartition(2 * frame.sparkSession.sparkContext.defaultParallelism, "group")       # few bytes, but much work a pass
    listed = dealt.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("item", "label", "codes"))).alias("rows"))
    return listed.select(F.col("rows.label").alias("labels"), F.col("rows.codes").alias("codes")).mapInArrow(joined, "labels array<int>, codes binary")


def _level(packed: DataFrame, model: Ranker, tree: Tree, level: int) -> np.ndarray:
    """Sums of (pull, curvature) by node of a level, feature and bin."""
    n, cells = len(model.names), (1 << level) * (BINS + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n, cells))
        for batch in batches:
            for sizes, labels, codes in _unpacked(batch, n):
                pull, curve = lambdas(labels, model.scores(codes), sizes)
                base = tree.node(codes, level) * (BINS + 2)
                for f in range(n):
                    total[0, f] += np.bincount(base + codes[:, f], pull, cells)
                    total[1, f] += np.bincount(base + codes[:, f], curve, cells)
        used = np.flatnonzero(total[1].ravel())
        if len(used):
            yield pa.RecordBatch.from_pydict({"cell": pa.array(used, pa.int32()), **{
                c: pa.array(total[i].ravel()[used]) for i, c in enumerate("gh")}})
    got = (packed.mapInArrow(run, "cell int, g double, h double").groupBy("cell")
           .agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas())           # at most nodes x features x bins rows
    out = np.zeros((2, n * cells))
    out[:, got["cell"].to_numpy()] = got[["g", "h"]].to_numpy().T
    return out.reshape(2, n, 1 << level, BINS + 2).transpose(0, 2, 1, 3)


def best_splits(sums: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node: feature, cut, gain, and the (left, right) sums; a node that gains nothing sends every row left."""
    left = sums.cumsum(axis=3)
    whole = left[..., -1:]
    right = whole - left
    gain = (left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - whole[0] ** 2 / (whole[1] + L2))
    gain[(left[1] < least) | (right[1] < least)] = 0.0
    nodes, features, bins = gain.shape
    best = np.round(gain, 9).reshape(nodes, -1).argmax(axis=1)
    feature, cut = np.divmod(best, bins)
    top = gain.reshape(nodes, -1)[np.arange(nodes), best]
    feature, cut = np.where(top > 0, feature, 0), np.where(top > 0, cut, bins - 1)
    at = (slice(None), np.arange(nodes), feature, cut)
    return feature, cut, top, np.stack([left[at], right[at]], axis=2)


@dataclass(frozen=True)
class Prepared:
    """Features in bins, one staged row per group, for as many fits as are wanted."""

    names: list[str]
    edges: list[np.ndarray]
    packed: DataFrame


def prepare(frame: DataFrame, names: list[str], *, group: str = "user_idx", item: str = "anime_idx", label: str = "label") -> Prepared:
    """Bins end at approximate percentiles of each feature; ``label`` holds grades, 0 for none."""
    wide = frame.select(*[F.col(n).cast("double").alias(n) for n in names])
    steps = [i / BINS for i in range(1, BINS)]
    edges = [np.unique(np.array(e, float)) for e in wide.approxQuantile(names, steps, 0.002)]
    return Prepared(names, edges, stage(_pack(frame, Ranker(names, edges, 0), group, item, label), "ranker-groups"))


def boost(data: Prepared, trees: int = 20, depth: int = 3, rate: float = 0.2, least: float = 1e-3) -> Ranker:
    """A leaf's value is the sum of pulls over the sum of curvatures of its rows, times ``rate``; a child needs a
    curvature of ``least``. Without rows the model scores 0."""
    model = Ranker(data.names, data.edges, depth, [], np.zeros(len(data.names)))
    for _ in range(trees):
        tree = Tree(np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS + 1), np.zeros(1 << depth))
        for level in range(depth):
            feature, cut, gain, sides = best_splits(_level(data.packed, model, tree, level), least)
            here = slice((1 << level) - 1, (1 << level + 1) - 1)
            tree.features[here], tree.cuts[here] = feature, cut
            np.add.at(model.gains, feature, gain)
        pull, curve = sides.reshape(2, -1)
        tree.values[:] = rate * pull / (curve + L2)
        if not tree.values.any():
            break
        model.trees.append(tree)
    return model


def fit(frame: DataFrame, names: list[str], *, group: str = "user_idx", item: str = "anime_idx", label: str = "label",
        **settings) -> Ranker:
    """One fit on a frame of features and grades, by the settings of ``boost``."""
    data = prepare(frame, names, group=group, item=item, label=label)
    model = boost(data, **settings)
    discard(data.packed)
    return model
