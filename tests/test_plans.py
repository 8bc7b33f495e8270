"""Plan checks: the physical plans have the shape the scale design relies on."""

import contextlib
import io

from haulframe.plans.registry import load_all
from tests.conftest import SMALL


def plan(spark, name):
    df = load_all()[name].fn(spark, SMALL)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_overlap_has_no_cartesian_product(spark):
    p = plan(spark, "join7_overlaps")
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_fanouts_have_no_cartesian_product(spark):
    for name in ("join4_expand_grants", "join5_audience"):
        p = plan(spark, name)
        assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_filters_reach_the_scan(spark):
    p = plan(spark, "flt2_filter_by")
    assert "EqualTo(o_orderpriority,1-URGENT)" in p and "In(o_orderstatus, [F,P])" in p
    assert "StringStartsWith(p_brand,Brand#1)" in plan(spark, "flt11_prefix_filter")


def test_projection_reaches_the_scan(spark):
    p = plan(spark, "src1_scan_pruned")
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in p


def test_positions_avoid_single_partition_window(spark):
    # positions come from the range-partitioned sort: no row_number window over the data;
    # the only single-partition exchange is the per-partition count table (one row per partition)
    for name in ("ord2_sort_multi", "pag3_page_windows", "win6_with_position"):
        p = plan(spark, name)
        assert "row_number()" not in p
        assert p.count("Exchange SinglePartition") <= 1
        assert "BroadcastHashJoin" in p


def test_top_n_limits_before_the_shuffle(spark):
    for name in ("win2_top_per_group", "kpi2_delay_reasons", "set3_distinct_tags"):
        assert "WindowGroupLimit" in plan(spark, name) and "Partial" in plan(spark, name)


def test_whole_table_totals_scan_once(spark):
    # min/max used in many expressions: one scalar subquery, not one per use.  The formatted
    # plan names each scan twice (tree and details): main query + one subquery per table.
    for name, tables in (("dat5_auto_bucket_events", 1), ("num5_color_scale", 2), ("num2_linear_bins", 1)):
        p = plan(spark, name)
        assert p.count("Scan parquet") <= 2 * 2 * tables, name
