"""Null keys in joined-back aggregates, constant columns, long digit runs, malformed files: nothing is lost."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from haulframe.functions import dates, numbers, strings
from haulframe.operators import aggs, filters, joins, kpi, ordering, segmented, setops, upserts
from haulframe.session import clean_scratch, materialize, scratch_path
from haulframe.sources import files


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.createDataFrame([(1, "a", 2.0), (2, None, 6.0), (3, None, 4.0), (4, "a", 2.0)], "id int, k string, v double")


def by_id(df, *cols):
    return {r.id: tuple(r[c] for c in cols) for r in df.collect()}


def test_null_groups_are_groups(keyed):
    got = by_id(aggs.group_rows(keyed, ["k"], ["id"]), "group_size", "member_no", "group_id")
    assert got == {2: (2, 1, 1), 3: (2, 2, 1), 1: (2, 1, 2), 4: (2, 2, 2)}


def test_null_x_has_shares(keyed):
    got = by_id(aggs.percent_share(keyed.withColumn("s", F.col("id")), "k", "v", "id"), "share_of_x")
    assert got == {1: (50.0,), 4: (50.0,), 2: (60.0,), 3: (40.0,)}


def test_box_stats_of_null_and_repeated_values(spark):
    rows = [("a", float(x)) for x in (1, 2, 2, 2, 9)] + [(None, 5.0), ("b", None)]
    got = {r[0]: tuple(r)[1:] for r in aggs.box_stats(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {"a": (1.0, 2.0, 2.0, 2.0, 9.0), None: (5.0, 5.0, 5.0, 5.0, 5.0)}


def test_box_stats_equal_exact_percentiles(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), F.floor(F.rand(3) * 300).alias("v"))
    df = spark.createDataFrame(df.collect(), df.schema)
    want = {r.k: tuple(r.p) for r in df.groupBy("k").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("p")).collect()}
    got = {r.k: (r.q1, r.median, r.q3) for r in aggs.box_stats(df, "k", "v").collect()}
    assert got == want


def test_top_per_group_keeps_a_null_group(keyed):
    got = by_id(ordering.top_per_group(keyed, "k", ["id"], 1, None), "group_rank")
    assert got == {1: (1,), 2: (1,)}


def test_gate_keeps_files_without_a_batch(spark):
    m = spark.createDataFrame([("f1", 10, "text/csv", None), ("f2", 10, "text/csv", "b")], "name string, size long, content_type string, batch string")
    assert files.gate_batch(m, 5, None, None, None).count() == 2


def test_visitors_count_null_users(spark):
    d = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(None, d), (None, d + dt.timedelta(days=1)), (1, d)], "user_id long, ts timestamp_ntz")
    got = {r.weekday: (r.total, r.returning) for r in kpi.visitors(e).collect()}
    assert got == {2: (2, 0), 3: (1, 1)}


def test_request_without_email_is_answered(spark):
    state = spark.createDataFrame([("a@x", "acme", "", False)], "email string, company string, area string, removed boolean")
    req = spark.createDataFrame([(1, None, "q", 1), (2, "a@x", "acme", 1)], "arrival long, em_nl string, cp_name string, tp_area int")
    out, new = upserts.upsert_subscriptions(state, req)
    assert sorted(r.arrival for r in out.collect()) == [1, 2]
    assert new.count() == 2


def test_runs_go_on_across_buckets_for_a_null_key(spark):
    rows = [(i, None, "ab"[i % 2], i // 2) for i in range(4)] + [(9, "k", "a", 0)]
    df = spark.createDataFrame(rows, "id int, part string, v string, day int")
    got = by_id(ordering.run_groups(df, ["part"], F.col("day"), ["id"], ["v"]), "group_1")
    assert got == {0: (1,), 1: (2,), 2: (3,), 3: (4,), 9: (1,)}
    assert by_id(segmented.prev_value(df, ["part"], F.col("day"), ["id"], "v", "p"), "p")[2] == ("b",)


def test_good_and_bad_rows_do_not_depend_on_the_columns_read(spark):
    path = scratch_path(spark, "t-routes")
    spark.createDataFrame([("a,b",), ("1,2024-01-01",), ("x,2024-01-02",), ("3,never",), ("4,2024-01-04",), ("5",)], "value string") \
        .coalesce(1).write.text(path)
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DateType())])
    good, bad = files.read_routes(spark, path, schema)
    assert sorted(r.a for r in good.select("a").collect()) == [1, 4]
    assert good.count() == good.groupBy("b").count().count() == 2
    assert sorted(r.raw_line for r in bad.select("raw_line").collect()) == ["3,never", "5", "x,2024-01-02"]
    assert bad.count() == 3


def test_scales_of_constant_and_narrow_columns(spark):
    one = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [tuple(r) for r in numbers.linear_bins(one, "v").collect()] == [(0, 5.0, 5.0, 2)]
    narrow = spark.createDataFrame([(0.001,), (0.002,)], "v double")
    got = sorted(tuple(r) for r in numbers.linear_bins(narrow, "v", 10).collect())
    assert [(b, n) for b, _, _, n in got] == [(0, 1), (9, 1)]
    powers = spark.createDataFrame([(float(10 ** k),) for k in range(-3, 16)] + [(0.0,), (999.9999,)], "v double")
    got = {r.exponent: r.n for r in numbers.log_bins(powers, "v").collect()}
    assert got == {None: 1, 2: 2, **{k: 1 for k in range(-3, 16) if k != 2}}
    eight = spark.createDataFrame([(8.0,), (64.0,), (63.9,)], "v double")
    assert {r.exponent: r.n for r in numbers.log_bins(eight, "v", 2.0).collect()} == {3: 1, 6: 1, 5: 1}


def test_log_share_of_constant_and_null_series(spark):
    df = spark.createDataFrame([(1, "c", 10.0), (2, None, 1.0), (3, None, 100.0), (4, None, 10.0), (5, "z", 0.0), (6, "z", None)],
                               "id int, k string, v double")
    got = {k: (None if v is None else round(v, 9)) for k, (v,) in by_id(numbers.log_norm(df, "k", "v"), "log_value").items()}
    assert got == {1: 0.0, 2: 0.0, 3: 1.0, 4: 0.5, 5: 0.0, 6: None}


def test_band_percent(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "v double")
    assert [r.percent for r in numbers.band(df, "v", []).orderBy("v").collect()] == [25.0, 75.0]
    assert [r.percent for r in numbers.band(df, "v", [(0, 2, "low")]).orderBy("v").collect()] == [50.0, 75.0]


def test_natural_order_of_long_digit_runs(spark):
    names = ["a" + "9" * 25, "a1" + "0" * 25, "a007", "a7b", "A8", "b", None]
    df = spark.createDataFrame(list(enumerate(names)), "id int, s string")
    got = [r.s for r in ordering.sort_natural(df, "s", ["id"]).orderBy("position").collect()]
    assert got == [None, "a007", "a7b", "A8", "a" + "9" * 25, "a1" + "0" * 25, "b"]


def test_numeric_strings_sort_by_value(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, "b"), (4, None), (5, "A")], "id int, s string")
    assert [r.id for r in ordering.sort_multi(df, [("s", "asc")], ["id"], fold_case=True).orderBy("position").collect()] == [4, 2, 1, 5, 3]


def test_all_rows_of_a_request_keep_the_order(spark):
    df = spark.range(5)
    rows = ordering.table_request(df, {"length": -1, "order": [("id", "desc")]}, []).collect()
    assert [r.id for r in rows] == [4, 3, 2, 1, 0]
    assert [r.id for r in ordering.table_request(df, {"start": 3, "length": 10, "order": [("id", "asc")]}, []).collect()] == [3, 4]


def test_tags_are_trimmed(spark):
    df = spark.createDataFrame([(1, " A ", 1), (1, "a", 2), (1, " ", 3), (1, "", 4), (1, None, 5)], "o int, tag string, n int")
    assert [r.tag for r in setops.distinct_tags(df, "o", "tag", "n").collect()] == ["A"]


def test_series_of_the_data_are_all_kept(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("new", 1, 3.0), ("new", 2, 4.0)], "series string, x int, y double")
    assert sorted(tuple(r) for r in joins.align_series(df, "series", "x", "y").collect()) == [(1, 2.0, 3.0), (2, None, 4.0)]


def test_fanout_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(joins, "FANOUT_CHUNK", 3)
    news = spark.range(20).select(F.col("id").alias("newsletter_id"), F.lit(False).alias("dispatched"))
    subs = spark.createDataFrame([("a", False), ("b", False), ("c", True)], "email string, removed boolean")
    out = joins.audience(news, subs)
    assert out.count() == out.distinct().count() == 40
    assert joins.audience(news.limit(0), subs).count() == 0


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    assert filters.java_regex("(?<year>[0-9]+)") is not None
    assert filters.java_regex("(?P<year>[0-9]+)") is None


@pytest.mark.parametrize("text, want", [(">10", (">", 10)), ("<= -5", ("<=", -5)), ("10<", (">", 10)), ("3 >=", ("<=", 3)), ("=>7", (">=", 7)), (">", (">", None)), ("x", None)])
def test_typed_comparisons(text, want):
    assert filters.parse_comparison(text) == want


def test_breakdown_without_seconds_rounds_up(spark):
    def parts(a, b, units, **kw):
        df = spark.createDataFrame([(dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b))], "a timestamp_ntz, b timestamp_ntz")
        return tuple(dates.breakdown(df, "a", "b", units, **kw).select(*dates.BREAKDOWN_NAMES).first())

    assert parts("2024-01-01T00:00:00", "2024-01-02T01:02:03", "DHM") == (0, 0, 0, 1, 1, 3, 0)
    assert parts("2024-01-01T00:00:00", "2024-01-02T01:02:03", "DHM", since=True) == (0, 0, 0, 1, 1, 2, 0)
    assert parts("2024-01-01T00:00:00", "2024-01-01T23:59:30", "DHM") == (0, 0, 0, 1, 0, 0, 0)
    assert parts("2024-01-31T10:00:00", "2024-02-29T10:00:00", "YOWDHMS") == (0, 1, 0, 0, 0, 0, 0)
    assert parts("2024-01-31T10:00:00", "2024-02-29T09:00:00", "YOWDHMS") == (0, 0, 4, 0, 23, 0, 0)


def test_marks_stay_out_of_tags(spark):
    df = spark.createDataFrame([("<b class=\"ab\">ab a.b AB</b><i></i>",)], "s string")
    assert df.select(strings.highlight(F.col("s"), ["a", "ab"]).alias("m")).first().m == (
        "<b class=\"ab\"><strong>ab</strong> <strong>a</strong>.b <strong>AB</strong></b><i></i>")


def test_export_cleaning_of_scripts(spark):
    df = spark.createDataFrame([("a<SCRIPT x=1>if (1<2) {}\n</script>b<!-- c -->",)], "s string")
    assert df.select(strings.clean_cell(F.col("s")).alias("c")).first().c == "ab"


def test_scratch_folders_can_be_cleaned(spark, tmp_path, monkeypatch):
    from haulframe import session

    monkeypatch.setattr(session, "_SCRATCH", [])
    materialize(spark.range(3), "t-clean")
    folder = session._SCRATCH[0].removeprefix("file:")
    import os
    assert os.path.isdir(folder)
    assert clean_scratch(spark) == 1 and not os.path.exists(folder)


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from haulframe.session import ensure_checkpoint_dir

    unset = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: unset, master="spark://host:7077")
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=unset))


def test_a_null_client_has_its_report(spark):
    """Change against the month before, reasons and suggestion of shipments without a client."""
    def some(client, month, n):
        return [(client, dt.datetime(2024, month, 3), 400, "road works", "R1", "C1") for _ in range(n)]

    df = spark.createDataFrame(some(None, 1, 6) + some(None, 2, 12) + some("a", 1, 6) + some("a", 2, 12),
                               "client string, shipped_at timestamp_ntz, delivery_days int, reason string, route string, carrier string")
    rows = {(r.client_name, r.month.month): r for r in kpi.monthly_report(df).collect()}
    assert len(rows) == 4
    for month, change in ((1, None), (2, 100)):
        null, named = rows[None, month], rows["a", month]
        assert null.percent_change == named.percent_change == change
        assert null.delayreasons == named.delayreasons == "road works" and null.suggested == named.suggested == "R1, C1"
    worst = {r.client: (r.route, r.carrier) for r in kpi.suggest(df).collect()}
    assert worst == {None: ("R1", "C1"), "a": ("R1", "C1")}


def test_what_reads_as_a_number(spark):
    texts = ["7d", "3f", "NaN", "Infinity", "1e999", " 12 ", "-3.5", "+4", ".5", "5.", "1e2", "", None, "0x10"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(texts)], "id int, v string")
    order = [r.v for r in ordering.sort_smart(df, "v", ["id"]).orderBy("position").collect()]
    assert order == ["", None, "-3.5", ".5", "+4", "5.", " 12 ", "1e2", "0x10", "1e999", "3f", "7d", "Infinity", "NaN"]
    assert order == [r.v for r in ordering.sort_multi(df, [("v", "asc")], ["id"]).orderBy("position").collect()]
    back = [r.v for r in ordering.sort_multi(df, [("v", "desc")], ["id"]).orderBy("position").collect()]
    assert back == [r.v for r in ordering.sort_smart(df, "v", ["id"], descending=True).orderBy("position").collect()]
    assert back[-2:] == ["", None] and back[0] == "NaN"


def test_accents_fold_in_every_script(spark):
    texts = {"Ελλάδα": "Ελλαδα", "Йод": "Иод", "Ёлка": "Елка", "Nguyễn Thị": "Nguyen Thi", "plain": "plain", "e\u0301": "e", "한국": "한국", "": "", "Å": "A"}
    df = spark.createDataFrame([(k,) for k in texts], "v string")
    assert {r.v: r.f for r in df.select("v", strings.fold_accents(F.col("v")).alias("f")).collect()} == texts


def test_quoted_records_over_several_lines(spark, tmp_path):
    path = str(tmp_path / "routes.csv")
    text = 'a,b\n1,"two\nlines, and ""quotes"""\n2,x\nbad,y\n3,"z"\n'
    (tmp_path / "routes.csv").write_text(text)
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.StringType())])
    good, bad = files.read_routes(spark, path, schema)
    assert sorted(r.a for r in good.select("a").collect()) == [1, 2, 3]
    assert good.where("a = 1").first().b == 'two\nlines, and "quotes"'
    assert [r.b for r in bad.collect()] == ["y"] and bad.count() == 1


def test_a_folder_is_listed_with_its_files(spark, tmp_path):
    for name, size in (("a/x.csv", 10), ("a/y b.PDF", 5), ("b/c/z", 3), ("b/c/w+1.xlsx", 7)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    manifest = files.file_manifest(spark, str(tmp_path))
    got = {r.name: (r.batch, r.size, r.content_type) for r in manifest.collect()}
    assert got == {"x.csv": ("a", 10, "text/csv"), "y b.PDF": ("a", 5, "application/pdf"), "z": ("c", 3, None),
                   "w+1.xlsx": ("c", 7, files.ROUTE_FILE_TYPES[2])}
    gated = {r.name: r.reason for r in files.gate_files(manifest, max_bytes=8).collect()}
    assert gated == {"x.csv": "too_large", "y b.PDF": "unsupported_type", "z": None, "w+1.xlsx": None}
    assert "content" not in manifest._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


def test_small_results_are_defined(spark):
    df = spark.createDataFrame([("s", 1, 5.0, 1), ("s", 1, 3.0, 2), ("r", 0, 1.0, 3)], "series string, x int, y double, at int")
    assert [tuple(r) for r in joins.align_series(df, "series", "x", "y", order="at").collect()] == [(0, 1.0, None), (1, None, 3.0)]
    one = spark.createDataFrame([("a", 4.0), ("a", 4.0), ("b", 0.0), ("b", 10.0)], "g string, v double")
    ticks = numbers.ticks(one, "v", ["g"])
    assert [tuple(r) for r in ticks.where("g = 'a'").collect()] == [("a", 0, 4.0, 4.0, 0.0)] and ticks.where("g = 'b'").count() == 6
    items = {"texts": spark.createDataFrame([("x",), (None,)], "value string"), "flags": spark.createDataFrame([(True,)], "display boolean"),
             "rows": spark.createDataFrame([("y", 1)], "display string, n int")}
    assert sorted((r.display, r.group) for r in setops.tagged_union(items, "display").collect()) == [("x", "texts"), ("y", "rows")]
    tags = spark.createDataFrame([(1, "b", 0), (1, "a", 0), (1, "c", 1)], "o int, t string, at int")
    assert [r.t for r in setops.distinct_tags(tags, "o", "t", "at").orderBy("tag_rank").collect()] == ["a", "b", "c"]
    rows = spark.createDataFrame([("x[oops",)], "v string")
    assert filters.smart_search(rows, "[oops", ["v"], regex=True).count() == 0
    assert filters.smart_search(rows, "X\\[", ["v"], regex=True).count() == 1


def test_a_rest_rounded_up_may_fill_a_month(spark):
    def parts(a, b, units):
        df = spark.createDataFrame([(dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b))], "a timestamp_ntz, b timestamp_ntz")
        return tuple(dates.breakdown(df, "a", "b", units).select(*dates.BREAKDOWN_NAMES).first())

    assert parts("2024-01-01T00:00:00", "2024-01-31T05:00:00", "YOD") == (0, 1, 0, 0, 0, 0, 0)
    assert parts("2024-01-01T00:00:00", "2024-01-30T05:00:00", "YOD") == (0, 0, 0, 30, 0, 0, 0)
    assert parts("2023-01-01T00:00:00", "2023-12-31T23:30:00", "YODH") == (1, 0, 0, 0, 0, 0, 0)
    assert parts("2023-01-01T00:00:00", "2023-03-10T00:00:01", "O") == (0, 3, 0, 0, 0, 0, 0)
    assert parts("2023-01-01T00:00:00", "2025-03-10T00:00:01", "Y") == (3, 0, 0, 0, 0, 0, 0)
    assert parts("2023-01-01T00:00:00", "2023-12-10T00:00:01", "YO") == (1, 0, 0, 0, 0, 0, 0)
    assert parts("2023-01-01T00:00:00", "2023-12-31T12:00:00", "YD") == (0, 0, 0, 365, 0, 0, 0)
    assert parts("2024-01-01T00:00:00", "2024-12-31T12:00:00", "YD") == (1, 0, 0, 0, 0, 0, 0)
