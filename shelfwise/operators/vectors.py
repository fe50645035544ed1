"""Vector pooling, scoring and exact masked top-K retrieval."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.vectors import dot, mean_of, scaled_sum, unit

SCORE_PLACES = 6
BROADCAST_BYTES = 64 << 20          # largest item matrix sent whole to every task
USER_BLOCK, ITEM_BLOCK = 4096, 16384
BLOCKS = 8                          # blocks of users at most, unless lanes or memory ask for more
BLOCK_BYTES = 192 << 20             # memory for the vectors, lists and masks of a block of users
MASKED = 64                         # masked items a user that a block reckons with, unless told
CELLS, CELL_ITEMS = 64, 2048        # cells that items are ordered by: at most so many, of about so many items or more
LANES, MAX_TASKS = 16, 20000        # lists per user that are merged at most, and tasks at most
SCORE_ROWS, SCORE_ITEMS = 256, 2048 # users and items scored at once inside a task
EXACT_PAIRS = 1 << 15               # pairs whose vectors are laid side by side at once
WAVES = 3                           # tasks a core has at least where they cost little, since blocks are not of one size
PICKED = 120                        # products made in the time that a pair takes which gets into a list
NO_ID = np.iinfo(np.int64).max      # in a place of a list that no item has yet


def normalised(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, unit(F.col(column)))


def pool_mean(history: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """Mean item vector per user."""
    joined = history.select("user_idx", "anime_idx").join(items.select("anime_idx", "vec"), "anime_idx")
    return joined.groupBy("user_idx").agg(mean_of(F.col("vec"), dim).alias("vec"))


def pool_weighted(history: DataFrame, items: DataFrame, dim: int, weight: Column) -> DataFrame:
    """Weighted mean; ``weight`` is an expression over the history columns."""
    rows = history.select("user_idx", "anime_idx", weight.cast("double").alias("w"))
    joined = rows.join(items.select("anime_idx", "vec"), "anime_idx")
    return joined.groupBy("user_idx").agg(mean_of(F.col("vec"), dim, F.col("w")).alias("vec"))


def score_weight() -> Column:
    return F.greatest(F.col("score"), F.lit(1)).cast("double")


def table_weight(weights: list[float]) -> Column:
    """softplus of a weight per score 0..10."""
    raw = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.col("score") + 1)
    return F.log1p(F.exp(raw))


def pool_attention(history: DataFrame, items: DataFrame, dim: int, query: Column) -> DataFrame:
    """softmax(v . query / sqrt(d)) weighted mean, made stable by the group's largest logit.

    A key matrix folds into the query beforehand: (K v) . q = v . (K^T q).
    """
    rows = history.select("user_idx", "anime_idx")
    judged = items.select("anime_idx", "vec", (dot(F.col("vec"), query) / F.sqrt(F.lit(float(dim)))).alias("_logit"))
    # the largest logits meet rows without vectors, which come last
    top = rows.join(judged.drop("vec"), "anime_idx").groupBy("user_idx").agg(F.max("_logit").alias("_top"))
    weighed = (rows.join(top, "user_idx").join(judged, "anime_idx")
               .withColumn("_w", F.exp(F.col("_logit") - F.col("_top"))))
    return weighed.groupBy("user_idx").agg(mean_of(F.col("vec"), dim, F.col("_w")).alias("vec"))


def or_default(users: DataFrame, pooled: DataFrame, default: Column) -> DataFrame:
    """Every user's vector, the default one where the history is empty."""
    return (users.select("user_idx").join(pooled, "user_idx", "left")
            .withColumn("vec", F.coalesce("vec", default)))


def dense_layers(df: DataFrame, column: str, out: str, layers: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Apply given dense layers (ReLU between them) to a vector column in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(layers)       # a model of fixed, small size

    @F.pandas_udf("array<double>")
    def forward(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return batch
        h = np.stack(batch.to_numpy())
        for i, (w, b) in enumerate(shared.value):
            h = h @ w + b
            if i + 1 < len(shared.value):
                h = np.maximum(h, 0.0)
        return pd.Series(list(h))
    return df.withColumn(out, forward(column))


def bag_mean(df: DataFrame, key: str, ids: str, table: DataFrame, dim: int) -> DataFrame:
    """Mean embedding of an id list without the 0 pads; an all-zero list uses the embedding of 0."""
    real = F.filter(ids, lambda i: i != 0)
    used = F.when(F.size(real) > 0, real).otherwise(F.array(F.lit(0)))
    long = df.select(key, F.explode(used).alias("id"))
    return long.join(table, "id").groupBy(key).agg(mean_of(F.col("vec"), dim).alias("vec"))


def lookup_key(item_index: DataFrame) -> DataFrame:
    """Row to read an item's id embedding from: cold items use the unknown item's."""
    return item_index.select("anime_idx", F.when(F.col("is_cold"), 1).otherwise(F.col("anime_idx")).alias("lookup_idx"))


def pair_cosine(pairs: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Score given (user, item) pairs; both vectors come by equi-join."""
    return (pairs.select("user_idx", "anime_idx")
            .join(users.select("user_idx", F.col("vec").alias("_u")), "user_idx")
            .join(items.select("anime_idx", F.col("vec").alias("_v")), "anime_idx")
            .select("user_idx", "anime_idx", F.round(dot(F.col("_u"), F.col("_v")), SCORE_PLACES).alias("cos")))


def flat_vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


def list_slices(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Each list of a list column as an array; a null gives an empty one."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, ends = arr.values.to_numpy(zero_copy_only=False), arr.offsets.to_numpy()
    return [values[a:b] if ok else values[:0] for a, b, ok in zip(ends[:-1], ends[1:], arr.is_valid().to_numpy(zero_copy_only=False))]


_TOP_SCHEMA = "user_idx int, anime_idx int, cos double"


def share_matrix(items: DataFrame, limit: int = BROADCAST_BYTES):
    """Broadcast (ascending ids, matrix) if the vectors take at most ``limit`` bytes, else None."""
    size = items.agg(F.coalesce(F.sum(F.size("vec") * 8), F.lit(0))).first()[0]         # one number
    if not 0 < size <= limit:
        return None
    rows = items.select("anime_idx", "vec").toArrow()
    ids = rows["anime_idx"].to_numpy()
    order = np.argsort(ids)
    return items.sparkSession.sparkContext.broadcast((ids[order], flat_vectors(rows["vec"])[order]))


def _by_broadcast(users: DataFrame, shared, mask: DataFrame, k: int) -> DataFrame:
    masks = mask.groupBy("user_idx").agg(F.collect_set("anime_idx").alias("mask"))    # at most one entry per shared item

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        pieces = near_pieces(ids, matrix)
        for b in batches:
            if b.num_rows:
                vecs, masks = flat_vectors(b["vec"]), list_slices(b["mask"])
                alike = np.concatenate(list(near_parts(vecs, SCORE_ROWS)))
                state = Running(k)
                state.add_users(b["user_idx"].to_numpy()[alike], vecs[alike], [masks[i] for i in alike])
                state.add_all(pieces)
                yield from state.out()
    # a small file is one task to read, but each of its users meets every item
    dealt = users.select("user_idx", "vec").repartition(users.sparkSession.sparkContext.defaultParallelism, "user_idx")
    return dealt.join(masks, "user_idx", "left").mapInArrow(score, _TOP_SCHEMA)


class Piece:
    """Some items by ascending id, with what bounds their scores. Of rows with the same id a mask meets the ``first``."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, first: np.ndarray):
        self.ids, self.matrix, self.first = ids, matrix, first
        self.centre = self.matrix.mean(axis=0)
        self.radius = np.linalg.norm(self.matrix - self.centre, axis=1).max()
        self.longest = np.linalg.norm(self.matrix, axis=1).max()
        with np.errstate(over="ignore", invalid="ignore"):
            self.rough = self.matrix.astype(np.float32)


def pieces_of(ids: np.ndarray, matrix: np.ndarray) -> Iterator[Piece]:
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    first = np.append(True, ids[1:] != ids[:-1])
    for at in range(0, len(ids), SCORE_ITEMS):
        cut = slice(at, at + SCORE_ITEMS)
        yield Piece(ids[cut], matrix[cut], first[cut])


def near_parts(matrix: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Rows in parts of ``size`` (the last may be smaller) that lie together: halves by the widest component, halved again."""
    waiting = [np.arange(len(matrix))]
    while waiting:
        at = waiting.pop()
        if len(at) <= size:
            yield np.sort(at)
            continue
        part, half = matrix[at], size * (-(-len(at) // size) // 2)
        order = np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], half)
        waiting += [at[order[half:]], at[order[:half]]]


def near_pieces(ids: np.ndarray, matrix: np.ndarray) -> list[Piece]:
    """Pieces of items that lie together; ``ids`` ascend."""
    first = np.append(True, ids[1:] != ids[:-1])
    return [Piece(ids[at], matrix[at], first[at]) for at in near_parts(matrix, SCORE_ITEMS) if len(at)]


def few_places(over: np.ndarray) -> np.ndarray:
    """Flat places of the true cells of a matrix that has few: eight cells are looked at as one number."""
    flat = over.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    rows, cells = np.nonzero(flat.reshape(-1, 8)[words])
    return words[rows] * 8 + cells


class Running:
    """The k best items so far of one block of users, while items come by in pieces.

    No item of a piece scores over ``min(u . c + |u| r, |u| s)`` for its centre c, its radius r and its longest vector s.
    A user whose k-th score is above that leaves the piece out; ``scored`` counts the products that were made. Products are
    made in single precision, whose error is at most ``slack``; those that may reach the k-th score are made again in double.
    """

    def __init__(self, k: int):
        self.k, self.chunks, self.scored = k, [], 0

    def add_users(self, uids: np.ndarray, vecs: np.ndarray, masks: list[np.ndarray]) -> None:
        for at in range(0, len(uids), SCORE_ROWS):
            cut = slice(at, at + SCORE_ROWS)
            n = len(uids[cut])
            held = [np.asarray(m, np.int64) + (r << 32) for r, m in enumerate(masks[cut])]
            with np.errstate(over="ignore", invalid="ignore"):
                rough = vecs[cut].astype(np.float32)
            self.chunks.append({"uids": uids[cut], "vecs": vecs[cut], "rough": rough, "size": np.linalg.norm(vecs[cut], axis=1),
                                "masked": np.sort(np.concatenate([np.zeros(0, np.int64), *held])),
                                "ids": np.full((n, self.k), NO_ID), "scores": np.full((n, self.k), -np.inf),
                                "kth": np.full(n, -np.inf), "kth_id": np.full(n, NO_ID), "new": [], "waiting": 0})

    def see(self, ids: np.ndarray, matrix: np.ndarray) -> None:
        for piece in pieces_of(ids, matrix):
            self.add(piece)

    def add(self, piece: Piece) -> None:
        for c in self.chunks:
            bound = np.minimum(c["vecs"] @ piece.centre + c["size"] * piece.radius, c["size"] * piece.longest)
            active = np.flatnonzero(~(bound + 10.0 ** -SCORE_PLACES < c["kth"]))        # scores are rounded
            if len(active):
                self.scored += len(active) * len(piece.ids)
                self._score(c, active, piece)

    def add_all(self, pieces: list[Piece]) -> None:
        """Each chunk of users meets the pieces it likes best first, and leaves out those that can change no list."""
        if not pieces:
            return
        centres = np.array([p.centre for p in pieces]).T
        radius, longest = (np.array([getattr(p, name) for p in pieces]) for name in ("radius", "longest"))
        for c in self.chunks:
            size = c["size"][:, None]
            liked = c["vecs"] @ centres
            bounds = np.minimum(liked + size * radius, size * longest) + size * longest * 1e-12 + 10.0 ** -SCORE_PLACES
            for i in np.argsort(-liked.mean(axis=0), kind="stable"):
                active = np.flatnonzero(~(bounds[:, i] < c["kth"]))
                if len(active):
                    self.scored += len(active) * len(pieces[i].ids)
                    self._score(c, active, pieces[i])

    def _score(self, c: dict, active: np.ndarray, piece: Piece) -> None:
        """Keep the pairs that may be among the best, with their exact scores, until there are enough to merge."""
        largest = c["size"][active] * piece.longest
        if np.all(largest < 1e30) and np.all(c["size"][active] < 1e30) and piece.longest < 1e30:
            scores = c["rough"][active] @ piece.rough.T
            slack = largest * (c["vecs"].shape[1] + 8) * 2.0 ** -23 + 2 * 10.0 ** -SCORE_PLACES
        else:
            scores = c["vecs"][active] @ piece.matrix.T
            slack = np.where(np.isnan(largest), 0, largest) * (c["vecs"].shape[1] + 8) * 2.0 ** -51 + 2 * 10.0 ** -SCORE_PLACES
        least, short = c["kth"][active], not np.isfinite(c["kth"][active]).all()

        def reaching(rows) -> np.ndarray:
            floor = least[rows] - slack[rows]
            if scores.dtype == np.float32:
                floor = np.nextafter(floor.astype(np.float32), np.float32(-np.inf))
            return scores[rows] >= floor[:, None]
        over = reaching(slice(None))
        if len(piece.ids) > self.k and (short or np.count_nonzero(over) > len(active) * self.k // 4):
            crowded = np.flatnonzero(np.count_nonzero(over, axis=1) > self.k)            # the piece itself says where their k-th score is
            if len(crowded):
                seen = scores[crowded].astype(np.float64)
                rows, cols = self._masked(c, active[crowded], piece)
                seen[rows, cols] = -np.inf
                seen[~np.isfinite(seen)] = -np.inf
                here = np.partition(seen, len(piece.ids) - self.k, axis=1)[:, len(piece.ids) - self.k] - slack[crowded]
                least[crowded] = np.maximum(least[crowded], here)
                over[crowded] = reaching(crowded)
        rows, cols = np.divmod(few_places(over), scores.shape[1])      # much faster than nonzero of a matrix
        if not len(rows):
            return
        rows = active[rows]
        keys, masked = (rows << 32) + piece.ids[cols], c["masked"]
        if len(masked):
            free = (masked[np.minimum(np.searchsorted(masked, keys), len(masked) - 1)] != keys) | ~piece.first[cols]
            rows, cols = rows[free], cols[free]
        exact = np.empty(len(rows))
        for at in range(0, len(rows), EXACT_PAIRS):
            cut = slice(at, at + EXACT_PAIRS)
            exact[cut] = np.einsum("ij,ij->i", c["vecs"][rows[cut]], piece.matrix[cols[cut]])
        exact = np.round(exact, SCORE_PLACES) + 0.0
        kth, ids = c["kth"][rows], piece.ids[cols].astype(np.int64)
        good = np.isfinite(exact) & ((exact > kth) | ((exact == kth) & (ids < c["kth_id"][rows])))
        if good.any():
            c["new"].append((rows[good], ids[good], exact[good]))
            c["waiting"] += int(good.sum())
            if short or c["waiting"] > c["ids"].size // 4:
                self._merge(c)

    def _masked(self, c: dict, users: np.ndarray, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``users``, column) of the piece's masked items."""
        masked = c["masked"]
        place = np.full(len(c["uids"]), -1)
        place[users] = np.arange(len(users))
        rows, ids = place[masked >> 32], masked & 0xFFFFFFFF
        cols = np.minimum(np.searchsorted(piece.ids, ids), len(piece.ids) - 1)
        here = (rows >= 0) & (piece.ids[cols] == ids) & piece.first[cols]
        return rows[here], cols[here]

    def _merge(self, c: dict) -> None:
        """Fold the waiting pairs into the lists of the users that have any."""
        if not c["new"]:
            return
        rows, ids, scores = (np.concatenate(part) for part in zip(*c["new"]))
        c["new"], c["waiting"] = [], 0
        n = np.bincount(rows, minlength=len(c["uids"]))
        order = np.argsort(rows, kind="stable")
        users = np.flatnonzero(n)
        place = np.cumsum(n > 0)[rows[order]] - 1
        at = self.k + np.arange(len(rows)) - np.repeat((np.cumsum(n) - n)[users], n[users])
        width = self.k + n.max()
        every, names = np.full((len(users), width), -np.inf), np.full((len(users), width), NO_ID)
        every[:, :self.k], names[:, :self.k] = c["scores"][users], c["ids"][users]
        every[place, at], names[place, at] = scores[order], ids[order]
        kth = np.partition(every, width - self.k, axis=1)[:, width - self.k]
        kept = every >= kth[:, None]
        tied = np.flatnonzero(kept.sum(axis=1) > self.k)        # more entries with the k-th score than places: lower ids first
        if len(tied):
            first = np.lexsort((names[tied], -every[tied]), axis=1)[:, :self.k]
            kept[tied] = False
            kept[tied[:, None], first] = True
        c["scores"][users], c["ids"][users] = every[kept].reshape(-1, self.k), names[kept].reshape(-1, self.k)
        c["kth"][users] = kth
        c["kth_id"][users] = np.where(c["scores"][users] == kth[:, None], c["ids"][users], -1).max(axis=1)

    def out(self) -> Iterator[pa.RecordBatch]:
        for c in self.chunks:
            self._merge(c)
            rows, cols = np.nonzero(c["scores"] > -np.inf)
            ids, scores = c["ids"][rows, cols], c["scores"][rows, cols]
            order = np.lexsort((ids, -scores, rows))
            yield pa.RecordBatch.from_arrays([pa.array(c["uids"][rows[order]], pa.int32()), pa.array(ids[order], pa.int32()), pa.array(scores[order])],
                                             names=["user_idx", "anime_idx", "cos"])


def _with_ranks(items: DataFrame, pivots: np.ndarray, asking: int) -> DataFrame:
    """``(id, vec, size, ranks)``: the length of each item, and per user cell the place of the item's cell in that cell's order."""
    half = (pivots ** 2).sum(axis=1) / 2
    place = np.argsort(np.argsort(-(pivots[:asking] @ pivots.T), axis=1, kind="stable"), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = flat_vectors(b["vec"])
                ranks = place[:, np.argmax(m @ pivots.T - half, axis=1)].T.astype(np.int32)
                yield pa.RecordBatch.from_arrays([b["id"], b["vec"], pa.array(np.linalg.norm(m, axis=1)), pa.array(list(ranks), pa.list_(pa.int32()))],
                                                 names=["id", "vec", "size", "ranks"])
    return items.select(F.col("anime_idx").cast("int").alias("id"), "vec").mapInArrow(run, "id int, vec array<double>, size double, ranks array<int>")


def _with_cells(users: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(id, vec, cell)``: the pivot with the largest product with the user's vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = np.argmax(flat_vectors(b["vec"]) @ pivots.T, axis=1)
                yield pa.RecordBatch.from_arrays([b["id"], b["vec"], pa.array(cell, pa.int32())], names=["id", "vec", "cell"])
    return users.select(F.col("user_idx").cast("int").alias("id"), "vec").mapInArrow(run, "id int, vec array<double>, cell int")


def block_size(n_users: int, n_items: int, dim: int, k: int, slots: int, least: int, masked: int = MASKED) -> int:
    """Users of a block. ``b`` blocks send items ``b`` times, and users with their lists to ``slots / b`` lanes."""
    sent_user, sent_item = 8 * dim + 20 * k, 8 * dim
    best = round((slots * n_users * sent_user / (n_items * sent_item)) ** 0.5)
    blocks = max(min(best, BLOCKS), -(-slots // LANES), 1)
    most = max(least, BLOCK_BYTES // (12 * dim + 24 * k + 8 * masked + 64))
    size = max(1, min(max(least, -(-n_users // blocks)), most))
    if size == most and slots <= -(-n_users // size) < WAVES * slots:           # memory asks for that many; a few more end together
        size = max(least, -(-n_users // (WAVES * slots)))
    return size


def lane_count(blocks: int, n_items: int, k: int, slots: int) -> int:
    """Lanes that keep all cores busy; ``WAVES`` times as many if the lists, of which every lane fills its own, take little of the time."""
    needed = -(-slots // blocks)
    free = int(0.15 * n_items / (PICKED * k * (1 + math.log(max(1.0, n_items / k)))))
    return max(1, min(LANES, max(needed, min(-(-WAVES * slots // blocks), free))))


def _by_blocks(users: DataFrame, items: DataFrame, mask: DataFrame, k: int, user_block: int, item_block: int, lanes: int | None,
               masked: int = MASKED) -> DataFrame:
    """A task keeps one block of like users and their best items so far, and items stream past it, the likeliest cells first.

    Items are dealt to ``lanes``, so at most ``lanes * k`` rows a user leave the tasks. In memory are a block of users with
    their lists and ``item_block`` items. Items are sent once per block, users and lists once per lane, so the number of blocks is
    the one that sends least, of at least ``user_block`` users, unless they would pass ``BLOCK_BYTES``. At most ``CELLS`` vectors
    and as many counts reach the driver.
    """
    spark = users.sparkSession
    n_users, n_items = users.count(), items.count()
    if not n_users or not n_items:
        return spark.createDataFrame([], _TOP_SCHEMA)
    cells = min(CELLS, -(-n_items // CELL_ITEMS))
    pivots = np.array([r.vec for r in items.orderBy(F.xxhash64("anime_idx"), "anime_idx").limit(cells).select("vec").collect()])
    user_block = block_size(n_users, n_items, pivots.shape[1], k, spark.sparkContext.defaultParallelism, user_block, masked)
    asking = min(len(pivots), -(-n_users // user_block))
    located = _with_cells(users, pivots[:asking])
    sizes = dict(located.groupBy("cell").count().collect())
    blocks = [max(int(c in sizes), round(sizes.get(c, 0) / user_block)) for c in range(asking)]       # up to 1.5 times the users
    first = np.concatenate([[0], np.cumsum(blocks)]).tolist()
    lanes = lanes or lane_count(first[-1], n_items, k, spark.sparkContext.defaultParallelism)
    tasks = min(first[-1] * lanes, MAX_TASKS)

    def of(values: list[int], cell: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(cell) + 1)

    masks = mask.groupBy(F.col("user_idx").alias("id")).agg(F.collect_set("anime_idx").alias("mask"))      # at most one entry per item
    every_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    left = (located.join(masks, "id", "left").select("id", "vec", "mask", "cell", every_lane)
            .withColumn("block", of(first[:-1], "cell") + F.pmod(F.xxhash64("id"), of(blocks, "cell")).cast("int"))
            .select((F.col("block") * lanes + F.col("lane")).alias("g"), F.lit(-1).alias("rank"), F.lit(0.0).alias("size"), "id", "vec", "mask"))
    right = (_with_ranks(items, pivots, asking).select("id", "vec", "size", F.posexplode("ranks").alias("cell", "rank"))
             .where(of(blocks, "cell") > 0)
             .select("id", "vec", "size", "rank", F.explode(F.sequence(of(first[:-1], "cell"), of(first[1:], "cell") - 1)).alias("block"))
             .select((F.col("block") * lanes + F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")).alias("g"), "rank", "size", "id", "vec",
                     F.lit(None).cast("array<int>").alias("mask")))
    streamed = (left.unionByName(right).repartitionById(tasks, F.col("g") % tasks)
                .sortWithinPartitions("g", "rank", F.desc("size"), "id"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, Running(k)
        for b in batches:
            if not b.num_rows:
                continue
            g, rank, ids = (b[c].to_numpy() for c in ("g", "rank", "id"))
            cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(rank) != 0)) + 1).tolist(), b.num_rows]
            for at, end in zip(cuts[:-1], cuts[1:]):
                if g[at] != now:
                    yield from state.out()
                    now, state = g[at], Running(k)
                piece = b.slice(at, end - at)
                if rank[at] < 0:
                    state.add_users(ids[at:end], flat_vectors(piece["vec"]), list_slices(piece["mask"]))
                    continue
                matrix = flat_vectors(piece["vec"])
                for i in range(0, end - at, item_block):
                    state.see(ids[at:end][i:i + item_block], matrix[i:i + item_block])
        yield from state.out()
    return streamed.mapInArrow(score, _TOP_SCHEMA)


def masked_top_k(users: DataFrame, items: DataFrame, mask: DataFrame, k: int, *,
                 exclude: DataFrame | None = None, only: DataFrame | None = None,
                 broadcast_bytes: int = BROADCAST_BYTES,
                 user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK, lanes: int | None = None,
                 masked: int = MASKED) -> DataFrame:
    """The k best items per user by inner product, exact, with their 0-based ``pool_rank``.

    Never returned: the special items, ``exclude``, anything outside ``only``, and the user's
    ``mask`` rows. Scores are rounded to 6 places, ties go to the lower index, and a user with
    fewer than k items left gets those alone. A small item matrix (counted first) goes to every
    task; a larger one streams past blocks of users, who leave out what cannot beat their k-th score.
    ``masked`` is how many masked items a user may be reckoned to have.
    """
    able = items.where("anime_idx >= 2").select("anime_idx", "vec")
    if exclude is not None:
        able = able.join(exclude.select("anime_idx"), "anime_idx", "left_anti")
    if only is not None:
        able = able.join(only.select("anime_idx"), "anime_idx", "left_semi")
    mask = mask.select("user_idx", "anime_idx")
    shared = share_matrix(able, broadcast_bytes)
    if shared is not None:
        best = _by_broadcast(users, shared, mask, k)
    else:
        best = _by_blocks(users, able, mask, k, user_block, item_block, lanes, masked)
    order = Window.partitionBy("user_idx").orderBy(F.desc("cos"), "anime_idx")
    return (best.withColumn("pool_rank", F.row_number().over(order)).where(F.col("pool_rank") <= k)
            .withColumn("pool_rank", F.col("pool_rank") - 1))


def nearest_allowed(users: DataFrame, items: DataFrame, allowed: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """Nearest items among an allow-list that are not in the user's history."""
    return masked_top_k(users, items, history, k, only=allowed)


def tag_cohesion(tags: DataFrame, items: DataFrame, dim: int) -> DataFrame:
    """Mean cosine of items to their tag's centroid, against the mean cosine to the overall centroid.

    For unit vectors the mean of v . c/|c| over a group with mean c is |c|, so one pass of sums suffices.
    """
    def length_of(total: Column, n: Column) -> Column:
        mean = F.transform(total, lambda x: x / n)
        return F.sqrt(dot(mean, mean))
    units = normalised(items.select("anime_idx", "vec"), "vec")
    per_tag = (tags.join(units, "anime_idx").groupBy("tag")
               .agg(F.count("*").alias("n_items"), scaled_sum(F.col("vec"), dim).alias("_s"))
               .select("tag", "n_items", length_of(F.col("_s"), F.col("n_items")).alias("mean_cos")))
    base = (units.agg(scaled_sum(F.col("vec"), dim).alias("_s"), F.count("*").alias("_n"))
            .select(length_of(F.col("_s"), F.col("_n")).alias("b")))
    return per_tag.withColumn("baseline", base.scalar())
