"""Edge cases from the survey (nulls, sentinels, day clamps, decision tables) on inline frames."""

import datetime as dt

from pyspark.sql import functions as F

from haulframe.functions import dates, strings
from haulframe.operators import filters, ordering, upserts


def test_norm_key_sentinel(spark):
    df = spark.createDataFrame([(None,), ("",), ("ACME",)], "c string")
    assert [r[0] for r in df.select(strings.norm_key(F.col("c"))).collect()] == ["none", "none", "acme"]


def test_search_number_text_like_js(spark):
    df = spark.createDataFrame([(1, 900.0), (2, 900.5)], "id int, p double")
    # 900.0 prints as "900" in the widget, so ".0" must not match it
    assert filters.search(df, ".0", ["p"]).count() == 0
    assert [r.id for r in filters.search(df, ".5", ["p"]).collect()] == [2]
    # reversed comparison: "899<" means value > 899, OR-ed with contains
    assert filters.search(df, "899<", ["p"]).count() == 2


def test_regex_search_bad_pattern_matches_nothing(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    assert filters.search(df, "/([a/", ["s"], mode="regex").count() == 0


def test_column_filters_arrays_maps_nulls(spark):
    df = spark.createDataFrame([(1, ["red", "blue"], {"k": "x"}, "a"), (2, ["green"], {"k": "y"}, None)],
                               "id int, tags array<string>, m map<string,string>, s string")
    assert [r.id for r in filters.column_filters(df, {"tags": {"value": "blu"}}).collect()] == [1]
    assert [r.id for r in filters.column_filters(df, {"m": {"value": "y"}}).collect()] == [2]
    # a null cell never matches a non-empty filter; an empty filter keeps it
    assert [r.id for r in filters.column_filters(df, {"s": {"value": "a"}}).collect()] == [1]
    assert filters.column_filters(df, {"s": {"value": ""}}).count() == 2


def test_dynamic_filter(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x")], "id int, t string, u string")
    out = filters.dynamic_filter(df, {"&t": "a", "u": "x"}).collect()
    assert [r.id for r in out] == [1]


def test_month_add_clamps_and_keeps_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 31, 10, 30),)], "t timestamp_ntz")
    r = df.select(dates.shift(F.col("t"), months=1).alias("r")).first()["r"]
    assert r == dt.datetime(2024, 2, 29, 10, 30)


def test_month_diff_end_of_month(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29), dt.datetime(2024, 1, 31))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(dates.diff(F.col("a"), F.col("b"), "month")).first()[0] == 1


def test_between_inclusivity(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 10, 0, 0),)], "t timestamp_ntz")
    lo, hi = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 11)
    got = df.select(dates.is_between(F.col("t"), lo, hi, "day", "()").alias("o"),
                    dates.is_between(F.col("t"), lo, hi, "day", "[)").alias("lc")).first()
    assert (got.o, got.lc) == (False, True)


def test_age_label(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 0), dt.datetime(2024, 1, 1, 0, 5, 0))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert df.select(dates.age_label(F.col("a"), F.col("b"))).first()[0] == "in 5 minutes"
    assert df.select(dates.age_label(F.col("b"), F.col("a"))).first()[0] == "5 minutes ago"


def test_run_groups_null_label_and_return(spark):
    rows = [(1, 1, "a"), (1, 2, None), (1, 3, None), (1, 4, "a")]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    r = ordering.run_groups(df, ["k"], F.lit(0), ["o"], ["v"]).orderBy("o").collect()
    assert [x["group_1"] for x in r] == [1, 2, 2, 3]


def test_sort_smart_mixed_column(spark):
    df = spark.createDataFrame([(1, "10"), (2, "9"), (3, "apple"), (4, None)], "id int, v string")
    r = ordering.sort_smart(df, "v", ["id"]).orderBy("position").collect()
    assert [x["id"] for x in r] == [4, 2, 1, 3]  # empty first, numbers by value, then text


def test_subscription_decision_table(spark):
    state = spark.createDataFrame([("a@x", "none", "", False), ("b@x", "acme", "lo", False)],
                                  "email string, company string, area string, removed boolean")
    req = spark.createDataFrame([
        (1, "A@x", None, 1),      # stored 'none', request none -> already registered
        (2, "a@x", "Beta", 2),    # stored 'none', request company -> registered, sets company + area
        (3, "a@x", "beta", 1),    # now stored beta, same -> already registered
        (4, "b@x", "other", 1),   # stored acme, different -> different company
        (5, "b@x", "ACME", 1),    # same company -> already registered
        (6, "c@x", None, 3),      # no row -> registered (inserted with 'none')
        (7, "c@x", "gamma", 2),   # row now 'none' -> registered, company set
    ], "arrival long, em_nl string, cp_name string, tp_area int")
    out, st = upserts.upsert_subscriptions(state, req)
    got = {r.arrival: r.outcome for r in out.collect()}
    assert got == {1: "already_registered", 2: "registered", 3: "already_registered", 4: "different_company",
                   5: "already_registered", 6: "registered", 7: "registered"}
    s = {r.email: (r.company, r.area, r.action) for r in st.collect()}
    assert s == {"a@x": ("beta", "ki", "updated"), "b@x": ("acme", "lo", "unchanged"),
                 "c@x": ("gamma", "ki", "inserted")}


def test_book_calls_fill_and_last_phone(spark):
    clients = spark.createDataFrame([(1, "c@x", "", None, "old")],
                                    "client_id long, email string, company string, contact_name string, phone string")
    req = spark.createDataFrame([(1, "C@x", "", "", "p1"), (2, "c@x", "Co", "Ann", "p2"), (3, "c@x", "X", "Bob", "p3"),
                                 (4, "zz@x", "Q", "Q", "p9")],
                                "arrival long, em_nm string, cp_nm string, client_nm string, phone_nb string")
    st, calls = upserts.book_calls(clients, req)
    r = st.first()
    assert (r.company, r.contact_name, r.phone) == ("Co", "Ann", "p3")
    assert calls.count() == 3


def test_update_by_id_merge_latest_wins(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id long, s string, v double")
    up = spark.createDataFrame([(1, 10, None, 5.0), (1, 11, "z", None), (9, 1, "q", 0.0)],
                               "id long, arrival long, s string, v double")
    r = {x.id: (x.s, x.v, x.action) for x in upserts_update(df, up)}
    assert r == {1: ("z", 5.0, "updated"), 2: ("b", 2.0, "unchanged")}


def upserts_update(df, up):
    return upserts.update_by_id(df, up, "id", "arrival").collect()


def test_export_scopes(spark):
    from haulframe.session import scratch_path
    from haulframe.sources import sinks

    df = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "id int, picked boolean")
    p1, p2 = scratch_path(spark, "t-exp"), scratch_path(spark, "t-exp")
    sinks.export(df, "json", p1, scope="basic", page=([F.col("id")], 2, 4), exclude=["picked"])
    sinks.export(df, "csv", p2, scope="selected", selected="picked")
    assert sorted(r.id for r in spark.read.json(p1).collect()) == [4, 5, 6, 7]
    assert spark.read.option("header", True).csv(p2).count() == 5


def test_pandas_group_aggregate_matches_columns(spark):
    from haulframe.functions import hooks

    df = spark.createDataFrame([(k % 7, float(k)) for k in range(2000)], "k int, v double")
    got = {r.k: r.spread for r in hooks.pandas_group_aggregate(
        df, ["k"], lambda g: {"spread": float(g["v"].max() - g["v"].min())}, "k int, spread double").collect()}
    want = {r.k: r.spread for r in df.groupBy("k").agg((F.max("v") - F.min("v")).alias("spread")).collect()}
    assert got == want


def test_pandas_partial_aggregate_merges_parts(spark, tables):
    """Parts of a batch are merged; no part of the hook's query holds a whole group."""
    from haulframe.functions import hooks
    from haulframe.plans import jobs_hooks

    rows = [(2 ** 53 + k % 3, float(k)) for k in range(900)] + [(None, 5.0), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "k bigint, v double").repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def part(g):
        seen.add(1)
        assert len(g) <= 50
        return {"hi": g["v"].max(), "lo": g["v"].min(), "n": len(g)}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = hooks.pandas_partial_aggregate(df, ["k"], part, "hi double, lo double, n long", {
            "spread": F.max("hi") - F.min("lo"), "n": F.sum("n")}).collect()
        assert {r.k: (r.spread, r.n) for r in got} == {
            r.k: (r.s, r.n) for r in df.groupBy("k").agg((F.max("v") - F.min("v")).alias("s"), F.count(F.lit(1)).alias("n")).collect()}
        assert seen.value >= 18
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = jobs_hooks.udf4_pandas_aggregate(tables)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and plan.index("partial_max") < plan.index("MapInArrow")  # combined above the hook, no shuffle below
    assert "Exchange" not in plan[plan.index("MapInArrow"):]


def test_group_transform_keeps_null_groups(spark):
    from haulframe.functions import hooks

    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (None, 3.0), (None, 4.0)], "k int, v double")
    out = hooks.group_transform(df, ["k"], lambda g: g.assign(v=g["v"].sum()), "k int, v double").collect()
    assert sorted((str(r.k), r.v) for r in out) == [("1", 3.0), ("1", 3.0), ("None", 7.0), ("None", 7.0)]


def test_group_transform_of_groups_cut_by_batches(spark):
    from haulframe.functions import hooks

    rows = [(2 ** 53 + k, float(i)) for k in range(6) for i in range(7 * k + 1)] + [(None, 1.0)] * 40
    df = spark.createDataFrame(rows, "k bigint, v double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        for vectorized in (False, True):
            def sizes(g, vectorized=vectorized):
                n = g.groupby("v", dropna=False)["v"].transform("size") if vectorized else len(g)
                return g[["v"]].assign(n=n)

            out = hooks.group_transform(df, ["k"], sizes, "v double, n long", vectorized=vectorized).collect()
            assert len(out) == len(rows)
            if not vectorized:
                assert sorted({r.n for r in out}) == [1, 8, 15, 22, 29, 36, 40]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_tree_levels_paths_and_cycles(spark):
    from haulframe.operators import joins

    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("x", "y"), ("y", "x")],
                                  "id string, pid string")
    r = {x.id: (x.level, x.path, x.child_count, x.sibling_no) for x in joins.tree(spark, edges).collect()}
    assert r == {"a": (1, "a", 2, 1), "b": (2, "a/b", 1, 1), "c": (3, "a/b/c", 0, 1), "d": (2, "a/d", 0, 2)}
    assert sorted(x.id for x in joins.tree_cycles(edges).collect()) == ["x", "y"]
    # a chosen root in a cycle: its own parent is not followed
    assert sorted((x.id, x.level) for x in joins.tree(spark, edges, root="x").collect()) == [("x", 1), ("y", 2)]


def test_tree_of_any_depth(spark):
    from haulframe.operators import joins

    edges = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None) for i in range(260)] + [("orphan", "nobody")], "id string, pid string")
    r = {x.id: x.level for x in joins.tree(spark, edges).collect()}
    assert r == {f"n{i}": i + 1 for i in range(260)}


def test_subscription_batch_is_idempotent(spark):
    state = spark.createDataFrame([("a@x", "none", "", False), ("b@x", "acme", "lo", False)],
                                  "email string, company string, area string, removed boolean")
    req = spark.createDataFrame([(1, "a@x", None, 1), (2, "a@x", "Beta", 2), (3, "c@x", None, 3), (4, "d@x", "q", 1)],
                                "arrival long, em_nl string, cp_name string, tp_area int")
    _, once = upserts.upsert_subscriptions(state, req)
    once = once.drop("action")
    _, twice = upserts.upsert_subscriptions(once, req)
    key = lambda df: sorted(map(tuple, df.select("email", "company", "area", "removed").collect()))
    assert key(once) == key(twice.drop("action"))


def test_date_range_presets_clamp_and_drop(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in range(1, 31)], "ts timestamp_ntz")
    # last 30 days as of Jan 20, clamped to a min date of Jan 10: Jan 10 .. Jan 20
    r = filters.date_range(df, "ts", "last_30_days", dt.date(2024, 1, 20), min_date=dt.date(2024, 1, 10))
    assert sorted(x.ts.day for x in r.collect()) == list(range(10, 21))
    # a maximum span of 3 days from the start
    r = filters.date_range(df, "ts", "last_7_days", dt.date(2024, 1, 20), max_span_days=3)
    assert sorted(x.ts.day for x in r.collect()) == [14, 15, 16]
    # a preset that ends before the minimum date is impossible and dropped
    assert filters.date_range(df, "ts", "yesterday", dt.date(2024, 1, 5), min_date=dt.date(2024, 1, 10)) is None


def test_page_number_clamps_to_last_page(spark):
    df = spark.range(45).withColumnRenamed("id", "k")
    r = ordering.page(df, ["k"], 1000, 20).collect()
    assert [x.k for x in r] == [40, 41, 42, 43, 44]
    assert (r[0].page_number, r[0].from_row, r[0].to_row, r[0].total) == (3, 41, 45, 45)


def test_natural_order(spark):
    df = spark.createDataFrame([(1, "item10"), (2, "item2"), (3, "Item1"), (4, "item2b")], "id int, name string")
    r = ordering.sort_natural(df, "name", ["id"]).orderBy("position").collect()
    assert [x.name for x in r] == ["Item1", "item2", "item2b", "item10"]


def test_round_ticks(spark):
    from haulframe.functions import numbers

    df = spark.createDataFrame([(0.0,), (37.0,), (100.0,)], "v double")
    r = numbers.ticks(df, "v").orderBy("tick_no").collect()
    assert [x.label for x in r] == [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]


def test_auto_bucket_choice(spark):
    names = spark.createDataFrame([(d,) for d in (6 * 365.0, 900.0, 200.0, 100.0, 70.0, 40.0, 10.0, 0.5, 0.02, 0.005,
                                                  0.001, 0.0003, 0.0001)], "d double")
    got = [r[0] for r in names.select(dates.choose_bucket(F.col("d"))).collect()]
    assert got == ["years", "half_year", "months", "months_fortnight", "months_days", "week_days", "days",
                   "hours", "minutes_fives", "minutes", "seconds_tens", "seconds_fives", "seconds"]


def test_color_scale_endpoints(spark):
    from haulframe.functions import numbers

    df = spark.createDataFrame([(1.0,), (50.0,), (1000.0,)], "v double")
    c = {r.v: r.color for r in numbers.color_scale(df, "v", ["#C8EEFF", "#0071A4"]).collect()}
    assert c[1.0] == "#c8eeff" and c[1000.0] == "#0071a4"


def test_mercator_origin(spark):
    from haulframe.functions import numbers

    df = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    r = numbers.project_points(df, "lat", "lon", "merc").first()
    assert abs(r.x) < 1e-6 and abs(r.y) < 1e-6


def test_age_label_thresholds(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(base, base + dt.timedelta(seconds=s)) for s in (44, 45, 89, 90, 3600 * 22, 86400 * 26)]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(dates.age_label(F.col("a"), F.col("b"), with_suffix=False)).collect()]
    assert got == ["a few seconds", "a minute", "a minute", "2 minutes", "a day", "a month"]


def test_export_cleaning_guards_formulas(spark):
    df = spark.createDataFrame([("=SUM(A1)",), ("<b>a</b>\n&amp;lt;",), ("  +1 ",)], "c string")
    got = [r[0] for r in df.select(strings.clean_cell(F.col("c"))).collect()]
    assert got == ["'=SUM(A1)", "a &lt;", "'+1"]


def test_copy_rows_skip_null_cells(spark):
    from haulframe.sources import sinks

    df = spark.createDataFrame([(1, None, "x", 2.0)], "a int, b string, c string, d double")
    assert df.select(sinks.tsv_line(df)).first()[0] == "1\tx\t2"
