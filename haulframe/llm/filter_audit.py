"""Filter interaction audit: what each filter removes in every order of application.

Each document gets a mask of the filters that it fails.  The documents of a
part are counted per mask (a cell: documents, good ones, toxic ones), and
from there on nothing grows with the documents.  ``aggregate`` folds each
cell along every order of the order array, which travels with the plan, and
yields one struct per order and step; the structs of a part's cells are
merged by elementwise sums, so 5 filters give 600 structs per part.

Texts are "equal" here when their SHA-256 digests are.  Hot texts are
counted by partial aggregates, and their rows meet their first id in
salted groups.

Defined results: a null text counts as empty and a null source as the part
''; a row without id is identical to no smaller id and has no label; rows
repeated with one id count once each and are not copies of each other; an
id with several label rows is good (toxic) when one of them says so; long
texts are read whole; an empty table has no part and gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.tables import salt_of, with_salts, written

WORD_GAPS = r"[\x20\x09-\x0D]+"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def few_words(text: Column, least: int = 50) -> Column:
    return F.size(_words(text)) < least


def repeated_words(text: Column, percent: int = 65) -> Column:
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def many_capitals(text: Column, percent: int = 5) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > percent * F.length(text)


def odd_signs(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAPS), "")


#: The text filters by letter; a copy filter (a letter of its own) follows them in the mask.
TEXT_FILTERS = {"A": few_words, "B": repeated_words, "C": many_capitals, "D": odd_signs}


def masks(docs: DataFrame, labels: DataFrame, *, filters: dict = TEXT_FILTERS, copies: str = "E",
          id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", salts: int = 16) -> DataFrame:
    """Cells: part, mask, n, good, toxic.  Bit k of the mask is the k-th filter, the last bit the copy filter."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = [F.when(fails(F.col("text")), F.lit(1 << k)).otherwise(0) for k, fails in enumerate(filters.values())]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text"))
    rows = written(rows.select("id", "part", sum(bits, F.lit(0)).alias("mask"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")),
                   "audit-masks")
    alike = rows.groupBy("id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    nameless = alike.where("id IS NULL").select("part", "mask", "n", *[F.lit(False).alias(c) for c in ("copy", "good", "toxic")])

    ids = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    shared = ids.where("first_id < last_id").select("digest", "first_id")
    known = (alike.where("id IS NOT NULL").withColumn("salt", salt_of(salts, "id"))
             .join(with_salts(shared, salts, "salt"), ["digest", "salt"], "left")
             .select("id", "part", "mask", "n", F.coalesce(F.col("id") > F.col("first_id"), F.lit(False)).alias("copy")))
    known = known.groupBy("id", "part", "mask", "copy").agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(
        *[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))])
    known = known.join(marks, "id", "left").select("part", "mask", "n", "copy", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])

    mask = F.col("mask") + F.when(F.col("copy"), 1 << len(filters)).otherwise(0)
    return known.unionByName(nameless).groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def audit(cells: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """Rows part, filter_order, step, the counts and shapley, from the cells of :func:`masks`."""
    orders = ["".join(p) for p in permutations(letters)]
    order_array = F.lit([[letters.index(x) for x in o] for o in orders])
    names = F.lit(orders)
    # at most 2 ** len(letters) cells to a part; the folds are work on few bytes, so tasks must not be merged by size
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = cells.repartition(tasks, "part").groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("filter", *COUNTS)])

    def plus(a: Column, b: Column) -> Column:
        return F.struct(b["filter"].alias("filter"), *[(a[c] + b[c]).alias(c) for c in COUNTS])

    merged = F.aggregate(
        "cells", F.array_repeat(none, len(orders) * len(letters)),
        lambda sums, cell: F.zip_with(sums, F.flatten(F.transform(order_array, lambda order: _fold(cell, order))), plus))
    found = parts.select("part", merged.alias("found"))
    shapley = F.transform(F.sequence(F.lit(0), F.lit(len(letters) - 1)), lambda f: F.aggregate(
        "found", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["filter"] == f, x["removed"]).otherwise(0)))
    at = F.col("at")
    order = F.floor(at / len(letters)).cast("int")
    return (found.withColumn("shapley", shapley).select("part", "shapley", F.posexplode("found").alias("at", "x"))
            .select("part", F.get(names, order).alias("filter_order"), (at % len(letters) + 1).cast("int").alias("step"),
                    *[F.col("x")[c].alias(c) for c in COUNTS], F.get("shapley", F.col("x")["filter"].cast("int")).alias("shapley")))


def _fold(cell: Column, order: Column) -> Column:
    """The cell's structs along one order: what its documents add to each step."""
    fields = ", ".join(f"{c}: bigint" for c in ("filter", *COUNTS))
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<struct<{fields}>>").alias("steps"))

    def step(state: Column, f: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), f)
        fails = cell["mask"].bitwiseAND(bit) != 0
        now = fails & ~state["gone"]
        weigh = {"kept": (~fails & ~state["gone"], "n"), "removed": (now, "n"), "redundant": (fails & state["gone"], "n"),
                 "unique_fails": (cell["mask"] == bit, "n"), "good_lost": (now, "good"), "toxic_lost": (now, "toxic")}
        found = F.struct(f.cast("bigint").alias("filter"),
                         *[F.when(counts, cell[weight]).otherwise(F.lit(0).cast("bigint")).alias(c) for c, (counts, weight) in weigh.items()])
        return F.struct((state["gone"] | fails).alias("gone"), F.concat(state["steps"], F.array(found)).alias("steps"))

    return F.aggregate(order, start, step, lambda state: state["steps"])
