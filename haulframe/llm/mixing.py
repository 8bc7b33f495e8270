"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves of a domain - language - source tree.  ``weights``
gives relative weights to nodes by their path, ``("web",)``,
``("web", "en")`` or ``("web", "en", "src3")``; a node without one counts 1.
A total of tokens is propagated from the root: a node's budget is split
among its children by weight.  A leaf can give its tokens up to
``max_epochs`` times.  What a child cannot use goes to its siblings, by
weight, until none of them has room; only what a whole family cannot use
goes up, to the siblings of its parent, and so on to the root.

A leaf's quota is filled epoch by epoch; each epoch visits the leaf's
documents in its own seeded order, and the last one is taken as a prefix
by tokens: documents are taken while the tokens before them are fewer than
what is left of the quota, so a leaf exceeds its quota by less than one
document.

The prefix of a hot leaf is found in two steps without gathering the leaf:
tokens are summed per (leaf, epoch, slice of the order), whole slices
before the border are taken, and only the slice at the border is ordered
row by row.  The number of slices grows with the leaf.

Only the nodes above the leaves reach the driver; the leaves of a family
(sources, which may be as many as hosts) share its budget on Spark.

Defined results: nulls in a path column are the node ``""``; a null text
counts as empty; an empty text has no tokens and is never taken; rows that
agree in id and text have one place in the order, and at the border as many
of them are taken as the quota has room for; very long texts count whole; an
empty table gives an empty result; other columns are passed on, and columns
of documents must not begin with ``__hf_``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.tables import repeated, written
from haulframe.operators.positions import global_running_sum

Path = tuple[str, ...]
SLICE_ROWS = 1024


def word_tokens(text: Column) -> Column:
    """Tokens of a text: runs of characters other than white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("bigint")


def domain_of(source: Column, domains: int = 4) -> Column:
    """The default domain: sources are dealt to ``domains`` domains by the crc32 of their name."""
    return F.concat(F.lit("domain"), F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(domains)))


def budgets(room: Mapping[Path, float], total: float, weights: Mapping[Path, float]) -> dict[Path, float]:
    """Tokens each leaf is to give; ``room`` is the most each leaf can."""
    below: dict[Path, set[Path]] = {}
    space: dict[Path, float] = {}
    for leaf, most in room.items():
        for k in range(len(leaf) + 1):
            space[leaf[:k]] = space.get(leaf[:k], 0) + most
            if k:
                below.setdefault(leaf[:k - 1], set()).add(leaf[:k])
    out: dict[Path, float] = {}

    def give(node: Path, amount: float) -> None:
        if node not in below:
            out[node] = amount
            return
        open_ = sorted(below[node])
        given = dict.fromkeys(open_, 0.0)
        left = min(amount, space[node])
        # what a full child leaves goes to its siblings; the amount fits below this node
        while open_ and left > 1e-9:
            whole = sum(weights.get(c, 1.0) for c in open_)
            if whole <= 0:
                break
            share = {c: left * weights.get(c, 1.0) / whole for c in open_}
            full = [c for c in open_ if given[c] + share[c] >= space[c] - 1e-9]
            if not full:
                for c in open_:
                    given[c] += share[c]
                left = 0.0
            for c in full:
                left -= space[c] - given[c]
                given[c] = space[c]
                open_.remove(c)
        for child, amount_ in given.items():
            give(child, amount_)

    if space:
        give((), total)
    return out


def mix(docs: DataFrame, path_cols: dict[str, Column], *, total: float | None = None, share: float = 0.5,
        weights: Mapping[Path, float] | None = None, tokens: Column | None = None, max_epochs: int = 2,
        seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """The chosen rows of ``docs`` with all their columns, once per epoch they are taken in.

    Added columns: __hf_epoch (from 0), __hf_tokens, and the path columns
    __hf_<name>.  ``total`` is the budget in tokens (default: ``share`` of
    all tokens).
    """
    names = [f"__hf_{n}" for n in path_cols]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = (docs.withColumns({f"__hf_{n}": F.coalesce(c.cast("string"), F.lit("")) for n, c in path_cols.items()})
            .withColumn("__hf_tokens", tokens if tokens is not None else word_tokens(F.col("text"))))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = rows.withColumn("__hf_key", F.xxhash64(ident, text)).where("__hf_tokens > 0")
    # what the budgets and prefixes need of each row, written once: the texts are read here and for the result
    narrow = written(rows.select(*names, "__hf_tokens", "__hf_key"), "mixing-rows")
    # one row per leaf: the number of leaves is the number of (domain, language, source) combinations
    leaves = narrow.groupBy(*names).agg(F.sum("__hf_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    quota = _quotas(written(leaves, "mixing-leaves"), names, total, share, weights or {}, max_epochs)
    if quota is None:
        return rows.limit(0).withColumn("__hf_epoch", F.lit(0)).drop("__hf_key")
    leaf = [*names, "__hf_epoch"]

    def dealt(some: DataFrame) -> DataFrame:
        # one row per leaf and epoch on the right; Spark broadcasts it while it is small
        order = F.xxhash64(F.col("__hf_key"), F.col("__hf_epoch") + F.lit(seed))
        slice_ = F.pmod(F.shiftrightunsigned("__hf_order", 16), F.col("__hf_slices"))
        return some.join(quota, names).withColumn("__hf_order", order).withColumn(
            "__hf_slice", F.when(F.col("__hf_whole"), F.lit(-1)).otherwise(slice_))

    border = _borders(dealt(narrow).where(~F.col("__hf_whole")), leaf)
    cut = border.select(*leaf, F.col("__hf_slice").alias("__hf_at"), F.col("threshold").alias("__hf_threshold"),
                        F.col("left").alias("__hf_left"), (F.col("many") > 1).alias("__hf_tied"))
    placed = dealt(rows).join(cut, leaf, "left")
    s, o = F.col("__hf_slice"), F.col("__hf_order")
    at_border = F.coalesce((s == F.col("__hf_at")) & (o == F.col("__hf_threshold")) & F.col("__hf_tied"), F.lit(False))
    taken = (F.col("__hf_whole") | (s < F.col("__hf_at"))
             | ((s == F.col("__hf_at")) & (o <= F.col("__hf_threshold"))))
    out = [*docs.columns, "__hf_epoch", "__hf_tokens", *names]
    chosen = placed.where(taken & ~at_border).select(*out)
    if border.where("many > 1").isEmpty():
        return chosen
    # rows of one place in the order are repeats: equal ones are counted, and as many given out as the quota has room for
    alike = placed.where(at_border).groupBy(*out, "__hf_left").agg(F.count(F.lit(1)).alias("__hf_n"))
    before = F.coalesce(F.sum(F.col("__hf_n") * F.col("__hf_tokens")).over(
        Window.partitionBy(*leaf).orderBy(F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.ceil((F.col("__hf_left") - before) / F.col("__hf_tokens")).cast("bigint")
    some = alike.withColumn("__hf_n", F.greatest(F.lit(0), F.least("__hf_n", room)))
    return chosen.unionByName(repeated(some.drop("__hf_left"), "__hf_n"))


def _quotas(leaves: DataFrame, names: list[str], total: float | None, share: float,
            weights: Mapping[Path, float], max_epochs: int) -> DataFrame | None:
    """Per leaf and epoch it is taken in: __hf_quota, __hf_whole (the whole epoch?) and __hf_slices; None without leaves.

    ``leaves``: path, t (tokens), n (rows).  The driver sees the nodes above
    the leaves.  Leaves of a family are filled on Spark, in the order of
    tokens per weight: those that are full before the level is reached give
    all they have, the others share the rest by weight.
    """
    spark, parents = leaves.sparkSession, names[:-1]
    have = {tuple(r[n] for n in parents): r["t"] for r in leaves.groupBy(*parents).agg(F.sum("t").alias("t")).collect()}
    if not have:
        return None
    total = share * sum(have.values()) if total is None else total
    given = budgets({p: float(t * max_epochs) for p, t in have.items()}, total, weights)
    amounts = spark.createDataFrame([(*p, a) for p, a in given.items()], ", ".join(f"{n} string" for n in [*parents, "a"]).removesuffix("string") + "double")
    own = {k: float(w) for k, w in weights.items() if len(k) == len(names)}
    family = leaves.withColumn("room", F.col("t") * max_epochs)
    if own:  # as many rows as the caller gave weights
        named = spark.createDataFrame([(*k, w) for k, w in own.items()], ", ".join(f"{n} string" for n in names) + ", own double")
        family = family.join(named, names, "left").withColumn("w", F.coalesce("own", F.lit(1.0))).drop("own")
    else:
        family = family.withColumn("w", F.lit(1.0))
    per_weight = F.when(F.col("w") > 0, F.col("room") / F.col("w")).otherwise(float("inf"))
    order = [*map(F.col, parents), per_weight, F.col(names[-1])]
    family = global_running_sum(global_running_sum(family, order, "room", "rooms"), order, "w", "ws")
    starts = family.groupBy(*parents).agg(F.min(F.col("rooms") - F.col("room")).alias("room0"), F.min(F.col("ws") - F.col("w")).alias("w0"), F.sum("w").alias("w_all"))
    family = family.join(starts.join(amounts, parents), parents)
    rest = F.col("a") - (F.col("rooms") - F.col("room") - F.col("room0"))
    weight_left = F.col("w_all") - (F.col("ws") - F.col("w") - F.col("w0"))
    full = (F.col("w") > 0) & (rest * F.col("w") >= (F.col("room") - 1e-9) * weight_left)
    family = family.withColumn("full", full)
    level = family.groupBy(*parents).agg(F.sum(F.when(F.col("full"), F.col("room")).otherwise(0)).alias("filled"),
                                         F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).alias("w_open"))
    amount = F.when(F.col("full"), F.col("room").cast("double")).when(F.col("w_open") > 0, F.greatest(
        F.lit(0.0), F.col("a") - F.col("filled")) * F.col("w") / F.col("w_open")).otherwise(0.0)
    family = family.join(level, parents).withColumn("amount", F.least(amount, F.col("room").cast("double")))
    epochs = family.withColumn("__hf_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    left = F.col("amount") - F.col("__hf_epoch") * F.col("t")
    return written(epochs.where(left > 1e-6).select(
        *names, "__hf_epoch", left.cast("double").alias("__hf_quota"), (left >= F.col("t") - 1e-6).alias("__hf_whole"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / SLICE_ROWS)).cast("int").alias("__hf_slices")), "mixing-quotas")


def _borders(dealt: DataFrame, leaf: list[str]) -> DataFrame:
    """Per leaf and epoch: the slice where the quota ends, the last order value taken in it, the rows there and the tokens left for them."""
    narrow = dealt.select(*leaf, "__hf_quota", "__hf_slice", "__hf_order", "__hf_tokens")
    # a slice holds about SLICE_ROWS rows, so this has about rows / SLICE_ROWS rows
    sums = narrow.groupBy(*leaf, "__hf_quota", "__hf_slice").agg(F.sum("__hf_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(*leaf).orderBy("__hf_slice")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = (sums.withColumn("before", before).where("before < __hf_quota AND before + t >= __hf_quota")
          .drop("__hf_quota", "t"))
    inside = narrow.join(at, [*leaf, "__hf_slice"])  # by slice too, so a hot leaf is dealt out
    same = inside.groupBy(*leaf, "__hf_slice", "before", "__hf_quota", "__hf_order").agg(
        F.sum("__hf_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    upto = F.coalesce(F.sum("t").over(Window.partitionBy(*leaf, "__hf_slice").orderBy("__hf_order")
                                      .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written(same.withColumn("upto", upto).where("before + upto < __hf_quota")
                   .groupBy(*leaf, "__hf_slice").agg(
                       F.max("__hf_order").alias("threshold"), F.max_by("n", "__hf_order").alias("many"),
                       F.max_by(F.col("__hf_quota") - F.col("before") - F.col("upto"), F.col("__hf_order")).alias("left")), "mixing-borders")
