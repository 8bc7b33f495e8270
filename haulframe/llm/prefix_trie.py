"""Prefix trie of conversations from sorted neighbours.

Every conversation is one row: the digests of its turns, 16 bytes each, as
one binary key.  The keys are range-partitioned and sorted, so conversations
with a common prefix are neighbours, and the longest common prefix (LCP) of
two neighbours is an edge between them.  A union-find takes the edges of a
partition in descending depth: the components that the edges of one depth
join become one branching node, and the components below it its children.

A component that touches a border of its partition may go on in the next
one, so it is not closed.  It is contracted into one item per depth of its
border path: the partition hands over at most the two border paths, whatever
its size.  A second union-find over the items of all partitions, with the
LCPs across the borders as further edges, closes them and tells their
children the parent.

A component stands for a chain of nodes with the same members, from below
its parent's depth to its own; the chain is spelled out at the end.  All
figures are sums over the sorted order: the members but the first share
``LCP`` turns with their neighbour, so what sharing saves in a subtree is
the sum of the bytes of those turns.

Turns are the same when the SHA-256 digests (128 bits) of role and text
are.  A list of conversations that end at one node is hashed as a stream of
packed pieces in the order of their ids, in bounded memory.

Defined results: a null role or text becomes empty; rows without
conversation id belong to none; null turn numbers come first, turns with
one number are ordered by role and digest; repeated rows are turns of their
own; equal conversations end at one node; an empty table has no nodes; long
texts are read whole; other columns are not looked at.  One conversation is
one row: 24 bytes a turn, so Spark's row limit is at about 80 million turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.tables import written
from haulframe.operators.positions import sorted_partitions

DIGEST = 16
#: Ids packed into one piece of a list of conversations.
PIECE = 4096


def rebuilt(turns: DataFrame, *, every: int = 5, most: int = 9, conv_col: str = "conv_id", turn_col: str = "turn",
            role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, key, sizes: each conversation after the first h turns of the group's leading one replace its own.

    Conversation c follows c - c % ``every``; h is crc32 of c modulo ``most``.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    conv = F.col(conv_col).cast("bigint")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)
    rows = turns.where(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % every).alias("leader"),
        F.struct(F.col(turn_col).alias("turn"), role.alias("role"), digest.alias("digest"),
                 F.octet_length(text).cast("bigint").alias("size")).alias("t"))
    narrow = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size")))
    one = rows.repartition("leader").groupBy("leader", "conv_id").agg(narrow.alias("own"))
    # at most 2 * every - 1 conversations have one leader
    group = one.groupBy("leader").agg(F.collect_list(F.struct("conv_id", "own")).alias("all"))
    lead = F.flatten(F.transform(F.filter("all", lambda c: c["conv_id"] == F.col("leader")), lambda c: F.slice(c["own"], 1, most - 1)))
    each = group.select(lead.alias("lead"), F.explode("all").alias("c")).select("lead", "c.*")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    new = F.concat(F.slice("lead", F.lit(1), h), F.slice("own", h + 1, F.size("own")))
    return each.select("conv_id", new.alias("t")).select(
        "conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("key"),
        F.transform("t", lambda t: t["size"]).alias("sizes"))


@dataclass(slots=True, eq=False)
class Part:
    """Some members of a node at ``depth``, neighbours in the sorted order.

    ``inner``: members, but the last, that are the last of a leaf; ``shared``:
    bytes that members share with their neighbour before; ``path``: bytes of
    the first 0, 1, .. ``depth`` turns; ``ends``: members of just ``depth``
    turns; ``items``, ``edges``: set for a part on a border.
    """

    depth: int
    conv: int
    n: int
    last_len: int
    ends: int
    end_conv: int | None
    path: list[int]
    kids: int = 0
    inner: int = 0
    shared: int = 0
    item: tuple[int, int] | None = None
    below: list[Part] = field(default_factory=list)
    items: list[Part] | None = None
    edges: list[int] | None = None


def join(parts: list[Part], depth: int) -> Part:
    """The parts that edges of ``depth`` connect, as one part of a node at that depth."""
    path = parts[0].path
    new = Part(depth, min(p.conv for p in parts), sum(p.n for p in parts), parts[-1].last_len, 0, None, path[:depth + 1])
    new.inner = sum(p.inner for p in parts) + sum(p.last_len > depth for p in parts[:-1])
    new.shared = sum(p.shared for p in parts) + (len(parts) - 1) * path[depth]
    for p in parts:
        if p.depth > depth:
            new.kids += 1
            new.below.append(p)
        else:
            new.kids += p.kids
            new.ends += p.ends
            new.end_conv = p.end_conv if new.end_conv is None else new.end_conv if p.end_conv is None else min(new.end_conv, p.end_conv)
            new.below += p.below if p.item is None else [p]
    return new


def forest(parts: list[Part], lcps: list[int], borders: bool) -> tuple[Part, list[tuple[Part, Part, int]]]:
    """Union-find over ``lcps[i]`` between parts i and i + 1, deepest first.

    Returns the last component and (child, parent, parent's depth) for each
    closed component.  With ``borders``, the components of the first and the
    last part stay open and are returned as items.
    """
    above = list(range(len(parts)))
    held = dict(enumerate(parts))

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    if borders:
        for p in {id(p): p for p in (parts[0], parts[-1])}.values():
            p.items, p.edges = [p], []
    closed = []
    by_depth: dict[int, list[int]] = {}
    for i, d in enumerate(lcps):
        by_depth.setdefault(d, []).append(i)
    for depth in sorted(by_depth, reverse=True):
        runs: list[list[int]] = []
        for i in by_depth[depth]:
            a, b = find(i), find(i + 1)
            if runs and runs[-1][-1] == a:
                runs[-1].append(b)
            else:
                runs.append([a, b])
        for run in runs:
            found = [held.pop(i) for i in run]
            for i in run[1:]:
                above[i] = run[0]
            first, last = found[0], found[-1]
            inside = [p for p in found if p.items is None]
            new = join(inside, depth) if inside else None
            if len(inside) == len(found):
                held[run[0]] = new
            else:  # contracted: the border paths stay as they are, what lies inside becomes one item
                items = [first.items or [], [new] if new else [], (last.items or []) if last is not first else []]
                edges = [first.edges or [], [], (last.edges or []) if last is not first else []]
                border = first if first.items else last
                border.items, border.edges = [], []
                for some, between in zip(items, edges):
                    if some:
                        border.edges += ([depth] if border.items else []) + between
                        border.items += some
                held[run[0]] = border
            if new:
                closed += [(p, new) for p in new.below]
                new.below = []
    return held[find(0)], closed


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    low, high = 0, n // DIGEST  # the first ``low`` turns agree, the first ``high`` do not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * DIGEST:mid * DIGEST] == b[low * DIGEST:mid * DIGEST]:
            low = mid
        else:
            high = mid
    return low


OUT = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("item", pa.int32()), ("edge", pa.int32()), ("conv_id", pa.int64()),
    ("top", pa.int32()), ("depth", pa.int32()), ("n", pa.int64()), ("kids", pa.int64()), ("inner", pa.int64()),
    ("shared", pa.int64()), ("last_len", pa.int32()), ("ends", pa.int64()), ("end_conv", pa.int64()),
    ("path", pa.list_(pa.int64())), ("key", pa.binary()), ("parent", pa.int64()), ("ids", pa.string()),
])
OUT_DDL = ("kind string, part int, item int, edge int, conv_id bigint, top int, depth int, n bigint, kids bigint, inner bigint, "
           "shared bigint, last_len int, ends bigint, end_conv bigint, path array<bigint>, key binary, parent bigint, ids string")


def _node(p: Part, parent: Part | None, parent_item: int | None = None, part: int | None = None) -> dict:
    """A closed component: the chain of nodes below its parent down to its depth."""
    top = parent.depth if parent else -1
    return {"kind": "node", "part": part, "item": parent_item, "conv_id": p.conv, "top": top, "depth": p.depth, "n": p.n, "kids": p.kids,
            "inner": p.inner, "shared": p.shared, "ends": p.ends, "end_conv": p.end_conv,
            "path": p.path[max(top, 0):p.depth] if p.n > 1 else [], "parent": parent.conv if parent else None}


def _batches(rows: Iterator[dict], size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, OUT)
            held = []
    yield pa.RecordBatch.from_pylist(held, OUT)


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closed nodes, items of the border paths and pieces of lists of equal conversations of one sorted partition."""
    yield from _batches(_partition_rows(batches, TaskContext.get().partitionId()))


def _partition_rows(batches: Iterator[pa.RecordBatch], number: int) -> Iterator[dict]:
    parts: list[Part] = []
    lcps: list[int] = []
    first_key = key = None
    run: list[int] = []  # conversations equal to the last one, as yet not handed over
    handed = False  # some of them were

    def piece() -> dict:
        return {"kind": "list", "key": hashlib.sha256(key).digest(), "conv_id": run[0], "n": len(run), "ids": ",".join(map(str, run))}

    for batch in batches:
        for conv, new_key, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "sizes"))):
            path = [0]
            for s in sizes:
                path.append(path[-1] + s)
            if key is None:
                first_key = new_key
            else:
                lcps.append(lcp(key, new_key))
                if len(parts) > 1:  # only what neighbours share is needed of a path
                    parts[-1].path = parts[-1].path[:max(lcps[-2:]) + 1]
                if key != new_key or len(run) == PIECE:
                    if len(run) > 1 or handed or key == first_key:
                        yield piece()
                    handed = key == new_key
                    run = []
            key = new_key
            run.append(conv)
            n = len(new_key) // DIGEST
            parts.append(Part(n, conv, 1, n, 1, conv, path))
    if not parts:
        return
    yield piece()
    rest, closed = forest(parts, lcps, borders=True)
    keys = {id(parts[0]): first_key, id(parts[-1]): key}
    at = {id(p): i for i, p in enumerate(rest.items)}
    for i, p in enumerate(rest.items):
        yield {"kind": "item", "part": number, "item": i, "edge": rest.edges[i - 1] if i else None, "conv_id": p.conv, "depth": p.depth,
               "n": p.n, "kids": p.kids, "inner": p.inner, "shared": p.shared, "last_len": p.last_len, "ends": p.ends,
               "end_conv": p.end_conv, "path": p.path, "key": keys.get(id(p))}
    for p, parent in closed:
        i = at.get(id(parent))
        yield _node(p, parent, i, None if i is None else number)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Closes the items of all partitions; kind "parent" tells an item's children their parent."""
    yield from _batches(_border_rows(r for batch in batches for r in batch.to_pylist()))


def _border_rows(rows: Iterator[dict]) -> Iterator[dict]:
    parts, lcps, key = [], [], None
    for r in rows:
        if parts:
            lcps.append(r["edge"] if r["edge"] is not None else lcp(key, r["key"]))
        key = r["key"]
        parts.append(Part(r["depth"], r["conv_id"], r["n"], r["last_len"], r["ends"], r["end_conv"], r["path"], r["kids"], r["inner"],
                          r["shared"], (r["part"], r["item"])))
    if not parts:
        return
    root, closed = forest(parts, lcps, borders=False)
    for p, parent in [*closed, (root, None)]:
        if p.item is not None:
            alone = parent is None or p.depth > parent.depth
            yield {"kind": "parent", "part": p.item[0], "item": p.item[1], "parent": p.conv if alone else parent.conv}
            if not alone:
                continue
        yield _node(p, parent)


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per list; its pieces come one after another."""
    schema = pa.schema([("end_conv", pa.int64()), ("list_sha", pa.string())])
    key = first = digest = None
    for batch in batches:
        out = []
        for k, conv, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "ids"))):
            if k != key:
                if digest:
                    out.append({"end_conv": first, "list_sha": digest.hexdigest()})
                key, first, digest = k, conv, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist(out, schema)
    if digest:
        yield pa.RecordBatch.from_pylist([{"end_conv": first, "list_sha": digest.hexdigest()}], schema)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node from conv_id, key and sizes (see :func:`rebuilt`)."""
    found = written(sorted_partitions(conversations, [F.col("key"), F.col("conv_id")]).mapInArrow(_partition, OUT_DDL), "trie-parts")
    # two border paths per partition: this is all that one task sees
    items = found.where("kind = 'item'").coalesce(1).sortWithinPartitions("part", "item")
    closed = written(items.mapInArrow(_borders, OUT_DDL), "trie-borders")
    told = closed.where("kind = 'parent'").select("part", "item", F.col("parent").alias("told"))
    cols = ["conv_id", "top", "depth", "n", "kids", "inner", "shared", "ends", "end_conv", "path"]
    nodes = found.where("kind = 'node'")
    nodes = (nodes.where("item IS NULL").select(*cols, "parent")
             .unionByName(nodes.where("item IS NOT NULL").join(told, ["part", "item"]).select(*cols, F.col("told").alias("parent")))
             .unionByName(closed.where("kind = 'node'").select(*cols, "parent")))
    lists = (found.where("kind = 'list'").select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id")
             .mapInArrow(_hash_lists, "end_conv bigint, list_sha string"))
    several = nodes.where("ends > 1").join(lists, "end_conv")
    return _spelled(nodes.where("ends <= 1").withColumn("list_sha", F.lit(None).cast("string")).unionByName(several))


def _spelled(nodes: DataFrame) -> DataFrame:
    """Each component as the nodes of its chain."""
    d = F.col("d")
    base = F.greatest("top", F.lit(0))
    before = F.coalesce(F.get("path", d - 1 - base), F.lit(0).cast("bigint"))
    saved = F.col("shared") - (F.col("n") - 1) * before
    ends = F.when(d < F.col("depth"), F.lit("")).when(F.col("ends") == 1, F.col("end_conv").cast("string")).when(F.col("ends") == 0, F.lit(""))
    return nodes.withColumn("d", F.explode(F.sequence(F.col("top") + 1, F.col("depth")))).select(
        "conv_id", d.cast("bigint").alias("depth"),
        F.when(d == 0, F.lit(None)).when(d == F.col("top") + 1, F.col("parent")).otherwise(F.col("conv_id")).cast("bigint").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(d < F.col("depth"), 1).otherwise(F.col("kids")).cast("bigint").alias("n_children"),
        (F.col("inner") + 1).alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce(F.sha2(ends.cast("binary"), 256), F.col("list_sha")).alias("ends_sha256"))
