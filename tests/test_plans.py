"""Plans: columns are pruned at the scan, filters reach it, and reducers have partial sums before the shuffle."""

import re

import pytest

from pulsegrid.operators import points
from pulsegrid.plans import catalog
from pulsegrid.sources.tables import table

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def columns(text, name):
    found = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", text) if name in s]
    return {c.split(":")[0] for s in found for c in s.split(",")}


@pytest.mark.parametrize("query,used", [
    ("t_one", {"l_returnflag", "l_quantity"}), ("auroc", {"l_returnflag", "l_linestatus", "l_extendedprice"}), ("pev_anova2", {"l_returnflag", "l_linestatus", "l_quantity"}), ("mutual_info", {"l_returnflag", "l_linestatus", "l_quantity"}),
])
def test_pruned_scans(spark, query, used):
    assert columns(plan(catalog.QUERIES[query](spark, FOLDER)), "l_returnflag") == used


@pytest.mark.parametrize("query", ["t_one", "t_two", "auroc", "mutual_info", "condition_mean", "binned_rate", "isi_fano_pooled"])
def test_partial_sums(spark, query):
    assert "partial_" in plan(catalog.QUERIES[query](spark, FOLDER))


@pytest.mark.parametrize("query", ["t_one", "t_two", "f_one_way", "pearson", "spearman", "dprime", "auroc", "mutual_info", "pev_anova1", "zscore", "isi_cv2", "binned_rate", "realign", "coherence"])
def test_no_python_and_no_nested_loops(spark, query):
    text = plan(catalog.QUERIES[query](spark, FOLDER))
    assert not re.search(r"Python|Pandas|MapInArrow|CartesianProduct", text)
    if query != "binned_rate":  # whose bins are an argument, joined to every train
        assert "BroadcastNestedLoopJoin" not in text


def test_filters_reach_the_scan(spark):
    e = table(spark, FOLDER, "events").selectExpr("user_id", "value AS t")
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(value,10\.0\)[^\]]*LessThan\(value,20\.0\)", plan(points.select_time_range(e, 10.0, 20.0)))


def test_transforms_of_series_need_no_shuffle(spark):
    assert "Exchange" not in plan(catalog.QUERIES["fft_power"](spark, FOLDER)) and "Exchange" not in plan(catalog.QUERIES["wavelet"](spark, FOLDER))


@pytest.mark.parametrize("query", ["perm_two_sample", "perm_one_way", "perm_two_way", "perm_assoc", "boot_items", "boot_two_sample", "perm_items", "perm_groups_items", "raster", "stacked_lines", "draw_randperm"])
def test_no_window_over_a_draw_or_a_whole_table(spark, query):
    text = plan(catalog.QUERIES[query](spark, FOLDER))
    windows = re.findall(r"Window .*", text)
    assert not [w for w in windows if "row_number" in w and "s#" not in w], windows
