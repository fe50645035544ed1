"""Helpers against plain Python on small or skewed data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from shelfwise.functions import keys, quantiles
from shelfwise.functions.lists import parse_list
from shelfwise.functions.staging import stage
from shelfwise.functions.vectors import mean_of, unit


def test_parse_list(spark):
    texts = ["['a', 'b']", '["Collector\'s", \'Large\']', "[]", None, "not a list", "['open", "['a' 'b' x]", "[ 'x' ,'y', ]", r"['it\'s']", "[1, 2]"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.l for r in rows.select("i", parse_list(F.col("t")).alias("l")).collect()}
    assert got == {0: ["a", "b"], 1: ["Collector's", "Large"], 2: [], 3: [], 4: [], 5: [], 6: [], 7: ["x", "y"], 8: ["it's"], 9: []}


def test_dense_index_strings(spark):
    names = [f"u{(i * 7919) % 100003:06d}" for i in range(3000)]
    out = keys.dense_index(spark.createDataFrame([(n,) for n in names], "n string"), "n", "i", start=5, buckets=16)
    assert {r.n: r.i for r in out.collect()} == {n: i + 5 for i, n in enumerate(sorted(names))}


def test_dense_index_integers(spark):
    ids = [i * i for i in range(500)] + [-7]
    out = keys.dense_index(spark.createDataFrame([(n,) for n in ids], "n bigint"), "n", "i", buckets=8)
    assert {r.n: r.i for r in out.collect()} == {n: i for i, n in enumerate(sorted(ids))}


def test_quantiles_with_hot_group_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, 4000)] + [("flat", 2.0)] * 7 + [("one", -1.5)] + [("two", 1.0), ("two", 4.0)]
    rows += [("wide", float(v)) for v in rng.normal(0, 1e6, 900)] + [("wide", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles.interpolated(df, ["g"], "v", {"m": 0.5, "p": 0.99}).collect()}
    for g in ("hot", "flat", "one", "two", "wide"):
        vals = [v for k, v in rows if k == g and v is not None]
        assert abs(got[g].m - np.median(vals)) < 1e-6
        assert abs(got[g].p - np.percentile(vals, 99)) < 1e-6
    near = quantiles.nearest_rank(df.where("g = 'hot'"), [], "v", {"q": 0.9}).first()
    vals = sorted(v for k, v in rows if k == "hot")
    assert near.q == vals[int(np.floor((len(vals) - 1) * 0.9 + 0.5))]


def test_order_statistics_cut_heavy_bins_again(spark):
    """One outlier presses all other values of a group into one bin; a third of its rows are equal."""
    rng = np.random.default_rng(5)
    heavy = [*rng.normal(0, 1, 3000), *[0.25] * 1500, 1e300]
    rows = [("heavy", float(v)) for v in heavy] + [("low", float(v)) for v in (-1e300, *rng.random(400))] + [("small", 2.0), ("small", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    at = {n: F.floor((F.col("_n") - 1) * F.lit(p)) for n, p in {"lo": 0.0, "q": 0.2, "m": 0.5, "p": 0.999, "hi": 1.0}.items()}
    got = {r.g: r for r in quantiles.order_statistics(df, ["g"], "v", at, bin_values=8).collect()}
    for g in ("heavy", "low", "small"):
        vals = sorted(v for k, v in rows if k == g)
        assert got[g]["_n"] == len(vals)
        for n, p in {"lo": 0.0, "q": 0.2, "m": 0.5, "p": 0.999, "hi": 1.0}.items():
            assert got[g][n] == vals[int((len(vals) - 1) * p)]
    whole = quantiles.order_statistics(df.where("g = 'heavy'"), [], "v", at, bin_values=8).first()
    assert whole.m == got["heavy"].m and whole["_n"] == len(heavy)
    empty = quantiles.order_statistics(df.where("g = 'none'"), ["g"], "v", at, bin_values=8)
    assert empty.count() == 0


def test_mean_and_unit_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [0.0, 0.0])], "g int, v array<double>")
    got = {r.g: r for r in df.groupBy("g").agg(mean_of(F.col("v"), 2).alias("m")).withColumn("u", unit(F.col("m"))).collect()}
    assert got[1].m == [2.0, 4.0]
    assert np.allclose(got[1].u, [1 / 5 ** 0.5, 2 / 5 ** 0.5])
    assert got[2].u == [0.0, 0.0]


def test_hash_is_stable_and_spread(spark):
    df = spark.range(2000).select(keys.hash_unit(42, F.col("id")).alias("h"))
    a = sorted(r.h for r in df.collect())
    assert a == sorted(r.h for r in df.repartition(7).collect())
    assert 0.45 < np.mean(a) < 0.55 and 0 <= a[0] and a[-1] < 1


def test_stage_keeps_rows_and_schema(spark):
    df = spark.range(10).select("id", F.array("id").alias("a"))
    back = stage(df, "t")
    assert back.schema == df.schema or back.columns == df.columns
    assert back.count() == 10
