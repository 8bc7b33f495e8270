"""Golden values from the reference's vendored test suites and inline samples."""

import datetime as dt

from pyspark.sql import functions as F

from haulframe.functions import dates, strings
from haulframe.operators import aggs, ordering


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first()["r"]


def test_remove_accent_table(spark):
    assert one(spark, strings.remove_accent, "ãàáäâẽèéëêìíïîõòóöôùúüûñç") == "aaaaaeeeeeiiiiooooouuuunc"


def test_slugify(spark):
    assert one(spark, strings.slug, "url with àccénts") == "url-with-accents"
    assert one(spark, strings.slug, "url  with   spaces") == "url-with-spaces"
    assert one(spark, strings.slug, "url with !@#$%?&?&*() special chars") == "url-with-special-chars"
    assert one(spark, strings.slug, "-url not start+=-end with-") == "url-not-start-end-with"


def test_highlight(spark):
    h = strings.highlight
    assert one(spark, lambda c: h(c, ["test"]), "highlight test") == "highlight <strong>test</strong>"
    assert one(spark, lambda c: h(c, ["accent"]), "highlight àççént test") == "highlight àççént test"
    assert one(spark, lambda c: h(c, ["accent"], accents=True), "highlight àççént test") == \
        "highlight <strong>àççént</strong> test"
    assert one(spark, lambda c: h(c, ["test", "key"]), "test keys highlight multiple test key") == \
        "<strong>test</strong> <strong>key</strong>s highlight multiple <strong>test</strong> <strong>key</strong>"
    assert one(spark, lambda c: h(c, ["number 42"]), "highlight number 42 test") == \
        "highlight <strong>number 42</strong> test"
    # never inside a tag
    assert one(spark, lambda c: h(c, ["a"]), '<a href="x">b</a>') == '<a href="x">b</a>'


def test_top_per_group_cap(spark):
    rows = [(f"group{g}", f"group{g}-data{i}", n * 4 + i) for n, g in enumerate([4, 1, 2, 3]) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "grp string, display string, arrival long")
    out = [r["display"] for r in ordering.top_per_group(df, "grp", ["arrival"], 3, 8).collect()]
    assert out == ["group4-data1", "group4-data2", "group4-data3", "group1-data1", "group1-data2",
                   "group1-data3", "group2-data1", "group2-data2"]


def test_group_order(spark):
    df = spark.createDataFrame([("Phoenix", "Arizona", 1), ("Indianapolis", "Indiana", 2)],
                               "name string, category string, id long")
    desc = ordering.order_groups(df, "category", "desc", ["id"]).orderBy("position").collect()
    asc = ordering.order_groups(df, "category", "asc", ["id"]).orderBy("position").collect()
    assert [r["category"] for r in desc] == ["Indiana", "Arizona"]
    assert [r["category"] for r in asc] == ["Arizona", "Indiana"]


def test_countdown_breakdown(spark):
    a = dt.datetime(2024, 1, 10, 8, 0, 0)
    b = dt.datetime(2025, 3, 13, 12, 5, 6)  # +1y 2o 3d 4h 5m 6s
    df = spark.createDataFrame([(a, b)], "a timestamp_ntz, b timestamp_ntz")
    r = dates.breakdown(df, "a", "b", "YOWDHMS").first()
    assert [r[n] for n in dates.BREAKDOWN_NAMES] == [1, 2, 0, 3, 4, 5, 6]
    r = dates.breakdown(df, "a", "b", "OWDHMS").first()
    assert r["months"] == 14 and r["years"] == 0


def test_percent_of_stack(spark):
    # two series stacked on four x values: first series' share of each stack
    rows = [(x, s, float(v)) for s, vals in (("a", [32, 33, 43, 12]), ("b", [2, 3, 5, 1])) for x, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "x int, series string, y double")
    got = {r["x"]: round(r["share_of_x"], 1) for r in aggs.percent_share(df, "x", "y", "series").collect()
           if r["series"] == "a"}
    assert [got[i] for i in range(4)] == [94.1, 91.7, 89.6, 92.3]


def test_named_sources_and_group_filter(spark):
    from haulframe.operators import filters, setops

    sources = {f"group{g}": spark.createDataFrame([(f"group{g}-data{i}",) for i in (1, 2, 3)], "display string")
               for g in (1, 2, 3)}
    allrows = setops.tagged_union(sources, "display")
    assert allrows.count() == 9
    only1 = filters.category_filter(allrows, "group", "group1")
    assert sorted(r.display for r in only1.collect()) == ["group1-data1", "group1-data2", "group1-data3"]
    assert filters.category_filter(allrows, "group", "all").count() == 9


def test_correlative_words_over_compiled_text(spark):
    from haulframe.functions.strings import html_unescape
    from haulframe.operators import filters

    df = spark.createDataFrame([("user1", "email1@domain.com"), ("user2", "email2@domain.com")],
                               "username string, email string")
    compiled = df.withColumn("compiled", F.concat("username", F.lit(" &lt;"), "email", F.lit("&gt;")))
    compiled = compiled.withColumn("compiled", html_unescape(F.col("compiled")))
    hits = filters.all_words(compiled, "user", "compiled").where("matched").collect()
    assert [r.compiled for r in hits] == ["user1 <email1@domain.com>", "user2 <email2@domain.com>"]
    # every query word must be found, each occurrence used once
    assert filters.all_words(compiled, "user user", "compiled").where("matched").count() == 0
