"""Exact top-k inner products by block-at-a-time pruning.

A vector is a document whose terms are its dimensions with a sign: a query
weight meets either the greatest value a block has in that dimension or,
when the weight is negative, the least.

* Index. Documents are ordered by their strongest terms, so that blocks of
  consecutive documents are alike, and every ``block_rows`` of them become
  one row: ids, forward index (the packed integer matrix) and the term
  maxima and minima. Blocks are grouped into ``shards`` of bounded size.
* Queries. Each query starts with the k-th best score of its own block.
  Queries travel in groups of bounded size to the shards whose summed term
  maxima reach that score. In a task, a query's blocks are ordered by their
  bounds and scored through the forward index until the next bound is below
  its k-th score (an equal bound is still scored: ties go to the smaller
  id).
* The best k of each (query, shard) are merged per query.

Scores are exact: float64 products while every partial sum stays below
2^53, Python integers beyond.  A score that does not fit a long is
saturated.

Defined results: vectors that are null or hold null or non-finite
components, and rows with a null id, take no part; vectors of unequal
length are compared as if padded with zeros; an empty vector scores 0 with
all; of repeated rows each is a query and a candidate of the others; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.tables import written

EXACT = float(2 ** 53)
LEAST, MOST = -(2 ** 63), 2 ** 63 - 1


def valid_vector(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return vector.isNotNull() & F.forall(vector, finite)


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as doubles (whole numbers)."""
    # a double's floor is a long in SQL and would not hold large values; those are whole already
    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0 ** 52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of possibly unequal length as one matrix, padded with zeros."""
    rows = [np.asarray(r.values, np.float64) if len(r) else np.zeros(0) for r in column]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _padded(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def products(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Inner products as exact integers (int64, or objects when sums may pass 2^53)."""
    width = max(queries.shape[1], docs.shape[1])
    q, d = _padded(queries, width), _padded(docs, width)
    top = np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * max(width, 1)
    if top < EXACT:
        return (q @ d.T).astype(np.int64)
    big = [[int(x) for x in r] for r in d]
    out = np.empty((len(q), len(d)), object)
    for i, r in enumerate(q):
        r = [int(x) for x in r]
        for j, c in enumerate(big):
            out[i, j] = min(max(sum(a * b for a, b in zip(r, c)), LEAST), MOST)
    return out.astype(np.int64)


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Summed term maxima of each block for each query: no document scores more."""
    width = max(queries.shape[1], most.shape[1])
    q = _padded(queries, width)
    most, least = _padded(most, width), _padded(least, width)
    out = np.maximum(q, 0) @ most.T + np.minimum(q, 0) @ least.T
    # above 2^53 sums are rounded: widen by more than the rounding
    return np.where(np.abs(out) < EXACT / 2, out, out + np.abs(np.abs(q) @ np.maximum(np.abs(most), np.abs(least)).T) * 1e-9)


def best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: highest score, then smaller id, then uid."""
    # the complement falls as the score grows, and has no overflow
    order = np.lexsort((uids, ids, ~scores), axis=-1)[:, :k]
    take = np.take_along_axis
    return take(scores, order, 1), take(ids, order, 1), take(uids, order, 1)


def own_thresholds(queries: np.ndarray, docs: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query within its own block, itself left out."""
    scores = products(queries, docs)
    scores[np.arange(len(own)), own] = LEAST
    if len(docs) <= k:
        return np.full(len(own), LEAST)
    return np.sort(scores, axis=1)[:, -k]


BLOCK = "shard bigint, block bigint, ids array<bigint>, width int, forward binary, most array<double>, least array<double>"
QUERY = "uid bigint, query_id bigint, vector array<double>, floor bigint"


def build_index(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, *, k: int, block_rows: int,
                shard_blocks: int, scale: float) -> DataFrame:
    """Blocks and queries in one table (written once): a block row has no query, a query row no block."""
    rows = vectors.where(F.col(id_col).isNotNull() & valid_vector(F.col(vector_col))).select(
        F.col(id_col).cast("bigint").alias("id"), whole_numbers(F.col(vector_col), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = written(rows, "topk-vectors")
    # the strongest terms first: their number and sign, strongest to weakest
    ranked = F.slice(F.array_sort(F.transform(
        "vector", lambda x, i: F.struct((-F.abs(x)).alias("w"), i.alias("i"), (x > 0).alias("s")))), 1, 4)
    keyed = rows.withColumn("place", F.transform(ranked, lambda t: t["i"] * 2 + t["s"].cast("int")))
    parts = max(1, math.ceil(rows.count() / (block_rows * shard_blocks)))
    ordered = keyed.repartitionByRange(parts, "place", "vector", "id").sortWithinPartitions("place", "vector", "id").drop("place")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        block, kept = first, []
        for batch in batches:
            kept.append(batch)
            while sum(b.num_rows for b in kept) >= block_rows:
                whole = pa.Table.from_batches(kept).combine_chunks()
                yield from rows_of(whole.slice(0, block_rows), block, first, shard_blocks)
                block += 1
                kept = whole.slice(block_rows).to_batches()
        if sum(b.num_rows for b in kept):
            yield from rows_of(pa.Table.from_batches(kept).combine_chunks(), block, first, shard_blocks)

    def rows_of(part: pa.Table, block: int, first: int, per_shard: int) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(part.column("vector").chunk(0))
        ids = part.column("id").to_numpy()
        own = np.flatnonzero(part.column("asks").to_numpy(zero_copy_only=False))
        floors = own_thresholds(matrix[own], matrix, own, k) if len(own) else []
        shard = first + (block - first) // per_shard
        rows = [{"shard": shard, "block": block, "ids": ids.tolist(), "width": matrix.shape[1], "forward": matrix.tobytes(),
                 "most": matrix.max(axis=0).tolist(), "least": matrix.min(axis=0).tolist()}]
        rows += [{"uid": block * block_rows + int(i), "query_id": int(ids[i]), "vector": matrix[i].tolist(), "floor": int(f)}
                 for i, f in zip(own, floors)]
        yield pa.RecordBatch.from_pylist(rows, schema)

    longs = pa.list_(pa.float64())
    schema = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("width", pa.int32()),
                        ("forward", pa.binary()), ("most", longs), ("least", longs),
                        ("uid", pa.int64()), ("query_id", pa.int64()), ("vector", longs), ("floor", pa.int64())])
    return written(ordered.mapInArrow(build, f"{BLOCK}, {QUERY}"), "topk-index")


def search_shard(blocks: pa.Table, queries: pa.Table, k: int, block_rows: int) -> dict[str, list]:
    """The best k of the shard for each query, block at a time in the order of its bounds."""
    out: dict[str, list] = {"uid": [], "query_id": [], "vec_id": [], "vec_uid": [], "score": []}
    if not blocks.num_rows or not queries.num_rows:
        return out
    number = blocks.column("block").to_numpy()
    ids = [np.asarray(r.values, np.int64) for r in blocks.column("ids")]
    docs = [np.frombuffer(f.as_py(), np.float64).reshape(len(i), w.as_py()) for f, i, w in
            zip(blocks.column("forward"), ids, blocks.column("width"))]
    uids = [b * block_rows + np.arange(len(i)) for b, i in zip(number, ids)]
    most, least = _matrix(blocks.column("most").combine_chunks()), _matrix(blocks.column("least").combine_chunks())
    q = _matrix(queries.column("vector").combine_chunks())
    q_uid, floor = queries.column("uid").to_numpy(), queries.column("floor").to_numpy().astype(np.float64)
    upper = bounds(q, most, least)
    order = np.argsort(-upper, axis=1, kind="stable")
    m = len(q)
    none = np.iinfo(np.int64).max
    top_s, top_i, top_u = np.full((m, k), LEAST), np.full((m, k), none), np.full((m, k), none)
    active = np.arange(m)
    for step in range(len(docs)):
        nth = order[active, step]
        need = np.maximum(floor[active], top_s[active, k - 1].astype(np.float64))
        going = upper[active, nth] >= need
        active, nth = active[going], nth[going]
        if not len(active):
            break
        for b in np.unique(nth):
            who = active[nth == b]
            scores = products(q[who], docs[b])
            rows = (len(who), len(ids[b]))
            # the query's own row is no candidate
            own_id = np.where(uids[b] == q_uid[who][:, None], none, np.broadcast_to(ids[b], rows))
            own_u = np.where(uids[b] == q_uid[who][:, None], none, np.broadcast_to(uids[b], rows))
            scores = np.where(own_u == none, LEAST, scores)
            top_s[who], top_i[who], top_u[who] = best(
                np.concatenate([top_s[who], scores], 1), np.concatenate([top_i[who], own_id], 1),
                np.concatenate([top_u[who], own_u], 1), k)
    r, c = np.nonzero(top_u != none)
    out["uid"], out["query_id"] = q_uid[r].tolist(), queries.column("query_id").to_numpy()[r].tolist()
    out["vec_id"], out["vec_uid"], out["score"] = top_i[r, c].tolist(), top_u[r, c].tolist(), top_s[r, c].tolist()
    return out


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, block_rows: int = 512, shard_blocks: int = 32, group_queries: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores, ties to the smaller id."""
    index = build_index(vectors, id_col, vector_col, is_query, k=k, block_rows=block_rows, shard_blocks=shard_blocks, scale=scale)
    blocks = index.where("block IS NOT NULL").select("shard", "block", "ids", "width", "forward", "most", "least")
    asks = index.where("uid IS NOT NULL").select("uid", "query_id", "vector", "floor")
    groups = max(1, math.ceil(asks.count() / group_queries))
    asks = asks.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))

    # a shard's summed maxima for a query, from the maxima of its blocks
    parts = blocks.select("shard", F.posexplode(F.arrays_zip("most", "least")).alias("dim", "v"))
    shards = (parts.groupBy("shard", "dim").agg(F.max("v.most").alias("most"), F.min("v.least").alias("least"))
              .groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("dim", "most", "least"))).alias("terms")))
    plan = written(_routes(asks, shards, groups), "topk-routes")
    work = plan.select("shard", "grp").distinct()
    routed = plan.join(asks, ["uid", "grp"])
    sent = blocks.join(work.select("shard", F.col("grp").alias("for_grp")), "shard")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(search_shard(left, right, k, block_rows), schema=pa.schema(
            [(c, pa.int64()) for c in ("uid", "query_id", "vec_id", "vec_uid", "score")]))

    found = sent.groupBy("shard", "for_grp").cogroup(routed.groupBy("shard", "grp")).applyInArrow(
        run, "uid bigint, query_id bigint, vec_id bigint, vec_uid bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "vec_uid"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _routes(asks: DataFrame, shards: DataFrame, groups: int) -> DataFrame:
    """uid, grp, shard: each query with the shards whose bound reaches its first threshold."""
    lists = shards.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = asks.join(lists, "grp")
    # padded with null where the lengths differ: such a term adds nothing
    terms = F.arrays_zip(F.col("vector").alias("q"), F.col("terms").alias("t"))
    bound = F.aggregate(terms, F.lit(0.0), lambda s, x: s + F.coalesce(
        F.when(x["q"] > 0, x["q"] * F.greatest(x["t"]["most"], F.lit(0.0))).otherwise(
            x["q"] * F.least(x["t"]["least"], F.lit(0.0))), F.lit(0.0)))
    slack = F.abs(F.col("bound")) * 1e-9
    return (both.withColumn("bound", bound).where(F.col("bound") + slack >= F.col("floor").cast("double"))
            .select("uid", "grp", "shard"))
