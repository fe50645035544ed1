"""Places on a map: leading eigenvectors of the normalised neighbour graph, by power iteration over joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.keys import hash_unit
from shelfwise.functions.staging import discard, stage
from shelfwise.functions.vectors import scaled_sum
from shelfwise.operators import vectors

NEIGHBOURS = 15
SEED = 42


def _nearest(asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(src, dst, cos) by inner product, without the item itself."""
    me = asked.select("user_idx", F.col("user_idx").alias("anime_idx"))
    return vectors.masked_top_k(asked, items, me, k, masked=1).select(F.col("user_idx").alias("src"), F.col("anime_idx").alias("dst"), "cos")


def neighbour_graph(items: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """Symmetric links (src, dst, w) between each item and its ``k`` most similar ones; ``w`` is the cosine, 0 if negative."""
    units = vectors.normalised(items.where("anime_idx >= 2").select("anime_idx", "vec"), "vec")
    found = _nearest(units.withColumnRenamed("anime_idx", "user_idx"), units, k).withColumn("w", F.greatest("cos", F.lit(0.0)))
    turned = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return found.select("src", "dst", "w").unionByName(turned).groupBy("src", "dst").agg(F.max("w").alias("w")).where("w > 0")


def _applied(places: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Each row's ``x`` times a small matrix."""
    columns = [sum((F.get("x", F.lit(i)) * F.lit(float(m)) for i, m in enumerate(col)), F.lit(0.0)) for col in matrix.T]
    return places.withColumn("x", F.array(*columns))


def _gram(places: DataFrame, p: int) -> np.ndarray:
    """Products of all pairs of columns, summed over the rows: p (p + 1) / 2 numbers."""
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    sums = places.agg(*[F.sum(F.get("x", F.lit(i)) * F.get("x", F.lit(j))).alias(f"s{i}_{j}") for i, j in cells]).first()
    out = np.zeros((p, p))
    for (i, j), s in zip(cells, sums):
        out[i, j] = out[j, i] = s or 0.0
    return out


def eigenvectors(links: DataFrame, wanted: int, *, spare: int = 5, steps: int = 3, rounds: int = 40,
                 tolerance: float = 1e-3) -> tuple[DataFrame, np.ndarray]:
    """((id, degree, x), eigenvalues): orthonormal leading eigenvectors of (1 + A) / 2, one entry of ``x`` each.

    A is the link matrix over the square roots of both ends' degrees; halving keeps every eigenvalue positive, so the
    order is that of A. A round multiplies ``steps`` times, a join and a sum by item each, and makes the ``wanted + spare``
    vectors orthogonal by their products. It ends when no wanted eigenvalue moves by ``tolerance``, or after ``rounds``.
    The start is a hash of the id. Links without an end on either side do not occur: an item without links has no place.
    """
    p = wanted + spare
    degree = stage(links.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("degree")), "layout-degrees")
    ends = [degree.select(F.col("id").alias(side), F.col("degree").alias(f"_{side}")) for side in ("src", "dst")]
    scaled = stage(links.join(ends[0], "src").join(ends[1], "dst")
                   .select("src", "dst", (F.col("w") / F.sqrt(F.col("_src") * F.col("_dst"))).alias("w")), "layout-links")
    start = [F.sqrt("degree")] + [(hash_unit(SEED + j, F.col("id")) - 0.5) * F.sqrt("degree") for j in range(1, p)]
    places = stage(degree.select("id", "degree", F.array(*start).alias("x")), "layout")
    values, turn = np.zeros(p), np.eye(p)
    for _ in range(rounds):
        moved = _applied(places, turn)
        for _ in range(steps):
            met = scaled.join(moved.select(F.col("id").alias("dst"), "x"), "dst")
            pulled = met.groupBy(F.col("src").alias("id")).agg(scaled_sum(F.col("x"), p, F.col("w")).alias("y"))
            moved = (moved.join(pulled, "id")
                     .select("id", "degree", F.zip_with("x", "y", lambda a, b: (a + b) / 2).alias("x")))
        moved = stage(moved, "layout")
        discard(places)
        places, before = moved, values
        grown, turn = np.linalg.eigh(_gram(places, p))
        grown, turn = np.maximum(grown[::-1], 1e-300), turn[:, ::-1]
        turn = turn * np.sign(turn[np.abs(turn).argmax(axis=0), np.arange(p)]) / np.sqrt(grown)
        values = grown ** (0.5 / steps)
        if np.abs(values - before)[:wanted].max() < tolerance:
            break
    discard(scaled)
    return _applied(places, turn).withColumn("x", F.slice("x", 1, wanted)), values[:wanted]


def spectral_layout(links: DataFrame, **options) -> DataFrame:
    """(anime_idx, x, y), of mean 0 by degree and deviation 1: the second and third eigenvector over the root of the degree.

    Linked items come close together, so neighbourhoods survive where a projection folds them. Parts of the graph that no
    link joins become points of their own.
    """
    found, _ = eigenvectors(links, 3, **options)
    rough = stage(found.select(F.col("id").alias("anime_idx"), *[
        (F.get("x", F.lit(i)) / F.sqrt("degree")).alias(c) for i, c in ((1, "x"), (2, "y"))]), "layout-places")
    spread = rough.agg(*[F.stddev_pop(c).alias(c) for c in "xy"]).first()
    return rough.select("anime_idx", *[(F.col(c) / F.lit(spread[c] or 1.0)).alias(c) for c in "xy"])


def kept_neighbours(links: DataFrame, places: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """One row ``share``: how many of the links' pairs are among the ``k`` nearest places of either end.

    The nearest place is the one of largest x x' + y y' - (x'^2 + y'^2) / 2, so the exact top-K finds it.
    """
    half = -(F.col("x") * F.col("x") + F.col("y") * F.col("y")) / 2
    items = places.select("anime_idx", F.array("x", "y", half).alias("vec"))
    asked = places.select(F.col("anime_idx").alias("user_idx"), F.array("x", "y", F.lit(1.0)).alias("vec"))
    near = _nearest(asked, items, k).select("src", "dst")
    one_way = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().withColumn("near", F.lit(1))
    return (links.select("src", "dst").join(one_way, ["src", "dst"], "left")
            .agg((F.count("near") / F.count("*")).alias("share")))
