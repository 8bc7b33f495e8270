"""STR4: character references against the standard library; NUM6: bands from a table against a plain pass."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from haulframe.functions import numbers, strings


def decoded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    return [r.d for r in df.select("i", strings.decode_references(F.col("s")).alias("d")).orderBy("i").collect()]


def test_every_named_reference(spark):
    texts = ["&" + n for n in sorted(html5)]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_generated_texts(spark):
    rng = random.Random(5)
    names = sorted(html5)

    def part():
        kind = rng.randrange(8)
        if kind == 0:
            return "&" + rng.choice(names)
        if kind == 1:
            return "&" + rng.choice(names).rstrip(";")[: rng.randint(1, 9)]
        if kind == 2:
            return f"&#{rng.choice([0, 1, 9, 11, 13, 38, 39, 127, 128, 129, 150, 233, 8364, 55296, 64976, 65534, 128512, 1114111, 1114112, 10**9, 10**30])}"
        if kind == 3:
            return f"&#{rng.choice('xX')}{rng.randrange(2 ** rng.randint(1, 22)):0{rng.randint(1, 9)}x}"
        return rng.choice(["&", "#", ";", "amp;", "lt", " ", "x", "9", "\u00e9", "\n", "&&", "&#", "&#x", "&#;", "&amp;lt;"])

    texts = ["".join(part() for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    assert decoded(spark, texts) == [html.unescape(t) for t in texts]


def test_odd_cells(spark):
    assert decoded(spark, ["", None, "plain", "&", "a & b"]) == ["", None, "plain", "&", "a & b"]
    df = spark.createDataFrame([("&#61;1+1",), ("&eacute;t&eacute; &#169; AT&ampT",), (None,)], "s string")
    assert [r.c for r in df.select(strings.clean_cell(F.col("s")).alias("c")).collect()] == ["'=1+1", "\u00e9t\u00e9 \u00a9 AT&T", None]


RANGES = "position long, from double, to double, label string"


def plainly(values, ranges):
    known = [v for v in values if v is not None]
    out = []
    for v in values:
        held = [r for r in ranges if v is not None and None not in r[1:3] and r[1] <= v <= r[2]]
        won = max(held) if held else None
        whole = abs(won[1]) + abs(won[2]) if won else abs(min(known)) + abs(max(known))
        out.append((won[3] if won else None, None if v is None else round(100 * v / (whole or -0.000001), 6)))
    return out


def banded(spark, values, ranges):
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(values)], "i int, v double, label string")
    got = numbers.band_table(df, "v", spark.createDataFrame(ranges, RANGES))
    assert got.columns == ["i", "v", "label", "band", "percent"]
    return [(r.band, None if r.percent is None else round(r.percent, 6)) for r in got.orderBy("i").collect()]


def test_bands_from_a_table(spark):
    rng = random.Random(3)
    for n in (0, 1, 7, 400):
        ranges = [(rng.randrange(200), float(a := rng.randrange(-50, 50)), float(a + rng.choice([0, 0, 1, 3, 40, -1])), f"r{k}") for k in range(n)]
        ranges += [(500, None, 3.0, "open"), (501, 3.0, None, "open")]
        values = [rng.choice([float(rng.randrange(-60, 60)), rng.randrange(-600, 600) / 10, 7.0, None]) for _ in range(600)]
        assert banded(spark, values, ranges) == plainly(values, ranges)


def test_bands_agree_with_the_short_form(spark):
    short = [(0.0, 100.0, "low"), (50.0, 200.0, "mid"), (200.0, 1000.0, "high")]
    values = [0.0, 49.9, 50.0, 100.0, 150.0, 200.0, 200.5, 1000.0, 1001.0, -1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    want = [(r.band, round(r.percent, 6)) for r in numbers.band(df, "v", short).orderBy("i").collect()]
    assert banded(spark, values, [(k, *r) for k, r in enumerate(short)]) == want


def test_no_values(spark):
    assert banded(spark, [], [(1, 0.0, 1.0, "a")]) == []


def test_a_hundred_thousand_ranges(spark):
    rng = random.Random(8)
    ranges = [(k, float(a := rng.randrange(0, 1_000_000)), float(a + rng.randrange(1, 2 ** rng.randint(1, 20))), f"r{k}") for k in range(100_000)]
    values = [float(rng.randrange(-10, 2_000_000)) for _ in range(40)]
    assert banded(spark, values, ranges) == plainly(values, ranges)
