"""URL verdicts from rules and a tree of path templates (DataFrame functions only).

A rule fits its host and all its subdomains when the path starts with the
rule's; the longest rule wins.  Where none fits, the method decides:

1. Paths are cut into segments, and variable ones (numbers, UUIDs, long
   hexadecimal ids) are generalised by shape.  Equal (host, shaped path)
   rows are one row from here on, with their pages and their labelled and
   good pages counted.
2. Per host a tree is grown from the root, one branching per round.
   Children of a node whose share of good pages does not differ from their
   siblings' by a two-proportion z test become one ``*`` branch (a child
   without labels differs from nobody), however many children there are.
   Those that differ are sorted by share, and neighbours that the same test
   does not part are one branch, ``{first+others}``.
   A chain, where the paths of a node only go on or end, is decided in the
   same round, whatever its length.
3. A node's purity is its share of good labelled pages smoothed towards its
   parent's with ``weight`` pseudo pages.  Above the host come its domains,
   label by label, and above them the whole corpus: pages of a host without
   labels lean on its sister hosts.  A template whose purity is below
   ``least_purity`` is rejected.

Labels are, unless given, the verdicts of the rules on the pages they fit.

Defined results: a null url, or one without ``://``, has an empty host and
path and gets the method's verdict for that (empty) template; paths of any
number of segments are followed to their end, very long ones too; a null id is a row like any
other; repeated rows are judged alike; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.tables import salt_of, with_salts, written

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHAPES = (
    (r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "{uuid}"),
    (r"[0-9a-f]{12,}", "{hex}"),
    (r"[0-9]+", "{n}"),
)
SALTS = 8


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str  # with its leading slash

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Tree:
    z: float = 1.96
    weight: float = 4.0
    least_purity: float = 0.3


def host_and_path(url: Column) -> tuple[Column, Column]:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, A_TO_Z, A_TO_Z.lower()), path


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.text)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Shaped segments, all of them."""
    def shaped(s: Column) -> Column:
        for pattern, name in SHAPES:
            s = F.regexp_replace(s, pattern, name)
        return s

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), shaped)


def verdicts(pages: DataFrame, rules: list[Rule], tree: Tree = Tree(), id_col: str = "page_id",
             url_col: str = "url", good: Column | None = None) -> DataFrame:
    """id, host, path, rule, verdict, template, purity for every row.

    ``good`` (boolean, null where unlabelled) replaces the rules' verdicts
    as labels.
    """
    host, path = host_and_path(F.col(url_col))
    known = F.lit(None).cast("string")
    for r in rules:
        known = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(known)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"),
                        (good if good is not None else F.lit(None).cast("boolean")).alias("good"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("known", known)
    if good is None:
        rows = rows.withColumn("good", F.col("known") == "allow")
    rows = rows.withColumn("segs", segments(F.col("path"))).withColumn("salt", salt_of(SALTS, "id", "path"))
    grown = with_salts(grow(rows, tree), SALTS, "salt")
    # a hot (host, path) is dealt out by its salt
    out = rows.join(grown, ["host", "segs", "salt"])
    verdict = F.coalesce("known", F.when(F.col("purity") < tree.least_purity, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def grow(rows: DataFrame, tree: Tree) -> DataFrame:
    """host, segs, template and smoothed purity of every distinct (host, shaped path)."""
    counts = [F.count("good").alias("seen"), F.coalesce(F.count_if("good"), F.lit(0)).alias("fine")]
    paths = written(rows.groupBy("host", "segs").agg(*counts), "url-paths")
    nodes = (paths.withColumn("salt", salt_of(SALTS, "segs"))
             .join(with_salts(host_purity(paths, tree), SALTS, "salt"), ["host", "salt"]).drop("salt").withColumn("template", F.lit("")))
    nodes = written(nodes.withColumns({"rest": F.col("segs"), "goes_on": F.size("segs") > 0}), "url-tree")
    out = nodes.where("NOT goes_on")
    # a round per branching on the way to a path; only rows that go on are written again
    while not nodes.where("goes_on").isEmpty():
        nodes = written(_round(nodes.where("goes_on"), tree), "url-tree")
        out = out.unionByName(nodes.where("NOT goes_on"))
    return out.select("host", "segs", "template", "purity")


def host_purity(paths: DataFrame, tree: Tree) -> DataFrame:
    """host, purity: smoothed from the whole corpus down the host's domains to the host."""
    hosts = paths.groupBy("host").agg(F.sum("seen").alias("seen"), F.sum("fine").alias("fine"))
    whole = hosts.agg(F.sum("seen").alias("s"), F.sum("fine").alias("f")).select(
        (F.coalesce("f", F.lit(0)) + tree.weight * 0.5) / (F.coalesce("s", F.lit(0)) + tree.weight))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    each = hosts.select("host", "seen", "fine", F.posexplode(domains).alias("level", "domain"))
    sums = each.groupBy("domain").agg(F.sum("seen").alias("s"), F.sum("fine").alias("f"))
    # a hot domain (one suffix may hold a third of the hosts) is dealt out by salts
    placed = (each.select("host", "level", "domain", salt_of(SALTS, "host").alias("salt"))
              .join(with_salts(sums, SALTS, "salt"), ["domain", "salt"]))
    chain = placed.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("level", "s", "f"))).alias("chain"))
    down = F.aggregate("chain", F.col("top"), lambda p, d: (d["f"] + tree.weight * p) / (d["s"] + tree.weight))
    return chain.withColumn("top", whole.scalar().cast("double")).select("host", down.alias("purity"))


def parts(seen: Column, fine: Column, other_seen: Column, other_fine: Column, z: float) -> Column:
    """Whether the shares of two groups differ by the z test, without a division by nothing; False where one has no labels."""
    both, gap = seen * other_seen, fine * other_seen - other_fine * seen
    share = (fine + other_fine) / F.greatest(seen + other_seen, F.lit(1))
    # z * z: (p - q)^2 > z^2 * share * (1 - share) * (1/a + 1/b)
    return (both > 0) & (gap.cast("double") * gap > z ** 2 * share * (1 - share) * (seen + other_seen) * both.cast("double"))


def _round(going: DataFrame, tree: Tree) -> DataFrame:
    """Follow the chain below each node, then put every row that goes on below one child: its segment, or a merged branch."""
    node = ["host", "template"]
    walked = written(_chains(going.drop("goes_on"), tree), "url-chains")
    ended, going = walked.where("size(rest) = 0"), walked.where("size(rest) > 0")
    going = going.withColumn("seg", F.get("rest", F.lit(0)))
    child = going.groupBy(*node, "seg").agg(F.count(F.lit(1)).alias("paths"), F.sum("seen").alias("seen"), F.sum("fine").alias("fine"))
    family = child.groupBy(*node).agg(F.sum("seen").alias("all_seen"), F.sum("fine").alias("all_fine"))
    child = (child.withColumn("salt", salt_of(SALTS, "seg"))
             .join(with_salts(family, SALTS, "salt"), [*node, "salt"]).drop("salt"))
    differs = parts(F.col("seen"), F.col("fine"), F.col("all_seen") - F.col("seen"), F.col("all_fine") - F.col("fine"), tree.z)
    child = written(child.select(*node, "seg", "paths", "seen", "fine", differs.alias("differs")), "url-children")
    moves = (child.where("NOT differs").withColumns({"name": F.lit("*"), "branch": F.lit("*")})
             .unionByName(_alike(child.where("differs"), node, tree)))
    moves = moves.select(*node, "seg", F.concat("template", F.lit("/"), "name").alias("next"), "seen", "fine")
    branch = moves.groupBy("host", "next").agg(F.sum("seen").alias("b_seen"), F.sum("fine").alias("b_fine"))
    moves = (moves.drop("seen", "fine").withColumn("salt", salt_of(SALTS, "seg"))
             .join(with_salts(branch, SALTS, "salt"), ["host", "next", "salt"]).drop("salt"))
    below = going.join(moves, [*node, "seg"])
    purity = (F.col("b_fine") + tree.weight * F.col("purity")) / (F.col("b_seen") + tree.weight)
    rest = F.slice("rest", 2, F.size("rest"))
    moved = below.select("host", "segs", "seen", "fine", purity.alias("purity"), F.col("next").alias("template"), rest.alias("rest"))
    return moved.unionByName(ended.select(*moved.columns)).withColumn("goes_on", F.size("rest") > 0)


def _alike(child: DataFrame, node: list[str], tree: Tree) -> DataFrame:
    """Children that differ from their siblings, those with one share under one name."""
    by_share = Window.partitionBy(*node).orderBy(F.col("fine") / F.col("seen"), "seg")
    apart = parts(F.col("seen"), F.col("fine"), F.lag("seen").over(by_share), F.lag("fine").over(by_share), tree.z)
    # the children of a node that have labels enough to differ: narrow rows, sorted with spilling
    ranked = child.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    ranked = ranked.withColumn("branch", F.sum("apart").over(by_share).cast("string"))
    names = ranked.groupBy(*node, "branch").agg(F.min("seg").alias("first"), F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("n") == 1, F.col("first")).otherwise(F.concat(F.lit("{"), "first", F.lit("+"), F.col("n") - 1, F.lit("}")))
    return ranked.join(names.select(*node, "branch", name.alias("name")), [*node, "branch"]).select(*child.columns, "name", "branch")


def _chains(going: DataFrame, tree: Tree) -> DataFrame:
    """Rows moved to the end of the chain below their node, or to their own end on it.

    The chain follows the node's greatest path as long as the others agree
    with it or end.  A row's purity is folded over the levels it passes,
    each with the labels of the rows that reach it.
    """
    node = ["host", "template"]

    def joined(rows: DataFrame, nodes: DataFrame) -> DataFrame:
        return rows.join(with_salts(nodes, SALTS, "salt"), [*node, "salt"])

    rows = going.withColumn("salt", salt_of(SALTS, "segs"))
    rows = joined(rows, going.groupBy(*node).agg(F.max("rest").alias("longest")))
    same = F.aggregate(F.zip_with("rest", F.slice("longest", F.lit(1), F.size("rest")), lambda x, y: F.equal_null(x, y)),
                       F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
                       lambda a, eq: F.struct((a["n"] + (a["on"] & eq).cast("int")).alias("n"), (a["on"] & eq).alias("on")), lambda a: a["n"])
    rows = rows.withColumn("same", same)
    length = rows.groupBy(*node).agg(F.min(F.when(F.col("same") < F.size("rest"), F.col("same"))).alias("parting"), F.max("same").alias("whole"))
    length = length.select(*node, F.coalesce("parting", "whole").alias("chain"))
    rows = written(joined(rows, length).withColumn("passed", F.least(F.size("rest"), F.col("chain"))), "url-chain-rows")
    # labels of the rows that end at each level; as many levels as a path has segments
    ends = rows.groupBy(*node, "chain", "passed").agg(F.sum("seen").alias("s"), F.sum("fine").alias("f"), F.max("purity").alias("p"))
    chain = ends.groupBy(*node, "chain").agg(F.collect_list(F.struct("passed", "s", "f")).alias("ends"), F.max("p").alias("p"))

    def reach(level: Column, what: str) -> Column:
        return F.aggregate(F.filter("ends", lambda e: e["passed"] >= level), F.lit(0).cast("bigint"), lambda n, e: n + e[what])

    steps = F.aggregate(F.when(F.col("chain") > 0, F.sequence(F.lit(1), F.col("chain"))).otherwise(F.array().cast("array<int>")),
                        F.array("p"), lambda ps, level: F.concat(ps, F.array(
                            (reach(level, "f") + tree.weight * F.element_at(ps, -1)) / (reach(level, "s") + tree.weight))))
    rows = joined(rows.drop("purity", "chain"), chain.select(*node, steps.alias("steps")))
    template = F.concat_ws("/", F.array("template"), F.slice("rest", F.lit(1), F.col("passed")))
    return rows.select("host", "segs", "seen", "fine", F.get("steps", F.col("passed")).alias("purity"), template.alias("template"),
                       F.slice("rest", F.col("passed") + 1, F.size("rest")).alias("rest"))
