"""Physical plans: pruning, pushdown, early group limits, map-side combining."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, key):
    return entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_asked(spark):
    p = plan(spark, "src_4")
    assert "GreaterThanOrEqual(l_quantity,45.0)" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in p
    assert "ReadSchema: struct<p_partkey:bigint,p_type:string>" in plan(spark, "src_3")


def test_partition_pruning(spark):
    assert "PartitionFilters: [isnotnull(split" in plan(spark, "src_5")


@pytest.mark.parametrize("key", ["vec_11", "smp_3", "spl_13", "rec_7", "cln_4", "cln_24", "log_13"])
def test_top_per_group_limits_before_the_shuffle(spark, key):
    assert "WindowGroupLimit" in plan(spark, key)


@pytest.mark.parametrize("key", ["cln_4", "cln_24", "log_13"])
def test_newest_rows_are_not_aggregated_by_sorting(spark, key):
    assert "SortAggregate" not in plan(spark, key)


@pytest.mark.parametrize("key,partial", [("log_2", "partial_min_by"), ("vec_2", "partial_sum"), ("cln_9", "partial_avg")])
def test_hot_keys_combine_on_the_map_side(spark, key, partial):
    assert partial in plan(spark, key)


def test_encoding_does_not_shuffle_by_category(spark):
    main = plan(spark, "fea_3").split("Subquery")[0]
    assert "Exchange" not in main
