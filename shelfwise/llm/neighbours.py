"""Approximate largest inner products over several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.staging import stage


@dataclass(frozen=True)
class Curves:
    """``share``: how far to look along each curve, to either side, as a share of all rows, in blocks of ``least_block`` or more."""

    curves: int = 16
    dims: int = 8
    bits: int = 7
    share: float = 0.05
    shift: float = 0.3
    sample: int = 20_000
    seed: int = 7
    least_block: int = 1024


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of integer points (one row each, every coordinate below ``2**bits``).

    Works down from the highest bit: each level's cell decides how the finer levels are reflected
    and which axes change places; the Gray code of what remains is the index.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            upper = (x[i] >> b) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> b) & 1 == 1, flip ^ ((1 << b) - 1), flip)
    x ^= flip
    key = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Grid:
    """The curves: random orthonormal projections, scaled on a sample and shifted."""

    def __init__(self, sample: np.ndarray, longest: float, p: Curves):
        rng = np.random.default_rng(p.seed)
        self.p, self.longest = p, longest
        lifted = self.lift(sample)
        width = lifted.shape[1]
        dims = min(p.dims, width)
        self.ways = []
        for _ in range(p.curves):
            axes = np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dims]
            low, high = np.quantile(lifted @ axes, [0.001, 0.999], axis=0)
            self.ways.append((axes, low, np.maximum(high - low, 1e-12), rng.random(dims) * p.shift))

    def lift(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """One more coordinate makes all stored vectors equally long, so that nearest means largest inner product."""
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.longest ** 2 - (v * v).sum(axis=1), 0))
        return np.column_stack([v, extra])

    def keys(self, v: np.ndarray, query: bool) -> np.ndarray:
        """One row per vector, one column per curve."""
        lifted, top = self.lift(v, query), (1 << self.p.bits) - 1
        out = []
        for axes, low, span, shift in self.ways:
            place = ((lifted @ axes - low) / span + shift) / (1 + self.p.shift)
            out.append(hilbert(np.clip(np.floor(place * (top + 1)), 0, top).astype(np.int64), self.p.bits))
        return np.column_stack(out)


def usable(vectors: DataFrame, id_col: str, vec_col: str, length: int | None = None) -> DataFrame:
    """``(id, v)`` of vectors that are not null or zero and hold only finite numbers, of the commonest length or that given."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    if length is None:
        common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
        length = common.n if common else 0
    return rows.where(F.size("v") == length)


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten()).reshape(n, -1)


def _keyed(rows: DataFrame, grid: Grid, query: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                keys = grid.keys(_matrix(batch.column("v"), n), query)
                yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "v": batch.column("v"), "keys": pa.array(list(keys), pa.list_(pa.int64()))})
    return (rows.mapInArrow(run, "id bigint, v array<double>, keys array<bigint>")
            .select("id", "v", F.posexplode("keys").alias("curve", "key"), F.lit(query).alias("query")))


def _number(batches):
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(at, at + n), pa.int64())],
                                         names=[*batch.schema.names, "part", "at"])
        at += n


def _nearest(k: int):
    """Best ``k`` stored vectors of a group for each of its queries; scores are plain sums in one fixed order."""
    def run(group: pa.Table) -> pa.Table:
        ids, query = group.column("id").to_numpy(), group.column("query").to_numpy(zero_copy_only=False)
        vectors = _matrix(group.column("v"), len(ids))
        stored, asked = np.flatnonzero(~query), np.flatnonzero(query)
        out_q, out = [], []
        for i in range(0, len(asked) if len(stored) else 0, 512):
            some = asked[i:i + 512]
            rough = vectors[some] @ vectors[stored].T
            m = min(k + 4, len(stored))
            top = np.argpartition(-rough, m - 1, axis=1)[:, :m]
            for q, cols in zip(some.tolist(), stored[top]):
                score = (vectors[q] * vectors[cols]).sum(axis=1)
                best = np.lexsort((ids[cols], -score))[:k]
                out_q.append(ids[q])
                out.append([{"score": s, "id": c} for s, c in zip(score[best].tolist(), ids[cols[best]].tolist())])
        return pa.table({"query_id": pa.array(out_q, pa.int64()),
                         "found": pa.array(out, pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())])))})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, curves: Curves = Curves(), id_col: str = "vec_id",
            vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query the ``k`` stored vectors with the largest inner product found.

    Both tables have ``id_col`` and ``vec_col``; a query's own id is no candidate. ``score`` is the inner product
    in double precision. Ties go to the smaller id.

    Equal vectors enter the search once, with their ``k + 1`` smallest ids, so a vector that a third of the rows
    share is one point. Stored and asked points are put in order along each curve (range partitions), numbered,
    and cut into blocks of equal size; a query visits the blocks within ``share`` of the rows to either side.
    A group holds one block and at most some thousands of queries.

    Vectors that are null, zero, of another length than most stored ones, or hold null or non-finite numbers take no part, nor do null
    ids; repeated ids with equal vectors count once, with different ones each is searched and the best score kept.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col).distinct()
    by = Window.partitionBy("v").orderBy("id")
    classes = stage(rows.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k + 1)
                    .groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
                    .select(F.col("ids")[0].alias("id"), "v", "ids"), "vector-classes")
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    stored_length = classes.select(F.size("v").alias("n")).first()
    if stored_length is None:
        return spark.createDataFrame([], schema)
    asked = stage(usable(queries, id_col, vec_col, stored_length.n).distinct(), "vector-queries")
    total, asked_n = classes.count(), asked.count()
    if not asked_n:
        return spark.createDataFrame([], schema)
    longest = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] ** 0.5
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(curves.sample).select("v").toArrow().column("v")
    grid = Grid(_matrix(sample, len(sample)), longest, curves)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(classes.select("id", "v"), grid, False).unionByName(_keyed(asked, grid, True))
    sort = ["curve", "key", "query", "id"]
    numbered = stage(keyed.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).mapInArrow(
        _number, "id bigint, v array<double>, curve int, key bigint, query boolean, part bigint, at bigint"), "curves")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))     # one row per partition

    length = total + asked_n
    reach = curves.share * length
    block = int(min(max(reach / 3, curves.least_block), 16384))
    steps = int(-(-reach // block))
    shares = int((2 * steps + 1) * block * asked_n / length // 16384) + 1
    placed = numbered.join(F.broadcast(begins), "part").select(
        "curve", "id", "v", "query", F.floor((F.col("begin") + F.col("at") - F.col("curve") * length) / block).alias("block"))
    last = (length - 1) // block
    stored = placed.where("NOT query").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    visits = placed.where("query").withColumn("share", F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.greatest(F.col("block") - steps, F.lit(0)), F.least(F.col("block") + steps, F.lit(last)))))
    met = stored.unionByName(visits).groupBy("curve", "block", "share").applyInArrow(
        _nearest(k + 1), "query_id bigint, found array<struct<score:double,id:bigint>>")
    # at most (curves * blocks visited) * (k + 1) entries a query
    best = met.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    best = best.select("query_id", F.explode(F.slice(F.array_sort("found", lambda a, b: F.when(a["score"] != b["score"], F.when(
        a["score"] > b["score"], -1).otherwise(1)).otherwise((a["id"] - b["id"]).cast("int"))), 1, k + 1)).alias("f"))
    named = best.select("query_id", F.col("f.score").alias("score"), F.col("f.id").alias("id")).join(classes.select("id", "ids"), "id")
    each = named.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
