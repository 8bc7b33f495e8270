"""N-gram Jaccard join by MinHash banding.

The n-gram set of a text is the set of its word n-grams (lower-cased runs
of word characters; a text of fewer than n words has one gram, a text
without words none).  Grams are 64-bit hashes.  Two texts are linked when
the Jaccard similarity of their full sets reaches the threshold.

1. Equal texts are one class from the start (their copies are counted, not
   paired).  Each class gets ``bands`` band hashes of ``rows`` MinHash
   values; both numbers follow from the target recall (``plan_bands``).
2. Classes that share a band hash are candidates.  The shuffle carries two
   longs per class and band.
3. Candidate classes are laid out in blocks of bounded size, neighbours by
   band hash next to each other.  Each block is compared with itself, and
   two blocks in those of their classes that share a band hash with the
   other block.  A task holds the full sets of two blocks at most, counts
   all common grams and returns, per class, its number of links and a
   spanning forest.  So a group of g near copies costs g * g / 2
   comparisons in (g / block)^2 / 2 tasks, but no rows of pairs.
4. Classes connected by links are joined by contracting the forest.

Defined results: a null text counts as empty; texts without words are
never linked (equal ones are still copies of each other); a null id is a
row like any other; repeated rows are copies; an empty table gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.tables import written

WORD = re.compile(r"\w+")
BLOCK_ROWS = 1024
BLOCK_GRAMS = 1_000_000


def plan_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands find a pair at the
    threshold with probability ``recall`` within ``most_hashes`` hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        miss = 1 - threshold ** rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall within most_hashes")
    return best


class WordHashes(dict):
    """word -> 64-bit hash; a cache of bounded size."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def grams(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct gram hashes of a text."""
    words = WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter((hashes[x] for x in words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - size + 1 + i])
    return np.unique(h)


def band_hashes(grams_: np.ndarray, bands: int, rows: int, factors: np.ndarray) -> np.ndarray:
    """One hash per band from bands * rows MinHash values."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(grams_), 512):
        np.minimum(low, np.multiply.outer(grams_[a:a + 512], factors).min(axis=0), out=low)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for part in low.reshape(bands, rows).T:
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out.view(np.int64)


def _factors(count: int) -> np.ndarray:
    """Odd multipliers; the order of x * a mod 2^64 stands for a random order."""
    return np.random.default_rng(20_2404).integers(0, 2 ** 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), key_of(text).alias("key"))


def key_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _classes(rows: DataFrame, n: int, bands: int, hashes: int) -> DataFrame:
    """key, first id, copies, gram count and band hashes of each distinct text."""
    factors = _factors(bands * hashes)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sizes, found = [], []
            for text in batch.column("text"):
                g = grams(text.as_py(), n, words)
                sizes.append(len(g))
                found.append(band_hashes(g, bands, hashes, factors) if len(g) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), pa.array(sizes, pa.int32()),
                 pa.array(found, pa.list_(pa.int64()))], ["id", "key", "n", "bands"])

    kind = rows.schema["id"].dataType.simpleString()
    sketched = rows.mapInArrow(sketch, f"id {kind}, key binary, n int, bands array<bigint>")
    return (sketched.groupBy("key")
            .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
                 F.first("n").alias("n"), F.first("bands").alias("bands"))
            .withColumn("num", F.monotonically_increasing_id()))


def _layout(classes: DataFrame) -> DataFrame:
    """Candidate classes with their block: num, key, first_id, copies, buckets, block."""
    entries = classes.where("n > 0").select("num", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("c"), F.min("num").alias("lead")).where("c > 1")
    member = (entries.join(shared.select("bucket", "lead"), "bucket")
              .groupBy("num").agg(F.min("lead").alias("near"), F.collect_list("bucket").alias("buckets")))
    active = written(classes.select("num", "key", "first_id", "copies", "n").join(member, "num"), "ngram-active")
    # once more along the shared hashes, so that chains of candidates lie closer together
    entries = active.select("num", "near", F.explode("buckets").alias("bucket"))
    least = entries.groupBy("bucket").agg(F.min("near").alias("lead"))
    nearer = entries.join(least, "bucket").groupBy("num").agg(F.min("lead").alias("near"))
    ordered = active.drop("near").join(nearer, "num")
    parts = max(1, math.ceil(active.count() / (8 * BLOCK_ROWS)))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            out = []
            for n in batch.column("n").to_pylist():
                if rows and (rows >= BLOCK_ROWS or size + n > BLOCK_GRAMS):
                    block, rows, size = block + 1, 0, 0
                rows, size = rows + 1, size + n
                out.append(block)
            yield batch.append_column("block", pa.array(out, pa.int64()))

    # only locality depends on the order: any layout finds the same links
    ordered = ordered.repartitionByRange(parts, "near", "num").sortWithinPartitions("near", "num")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema) + ", block bigint"
    return written(ordered.mapInArrow(blocks, schema), "ngram-layout")


def _block_sets(rows: DataFrame, layout: DataFrame, n: int) -> DataFrame:
    """The full gram sets of the candidate classes: num, copies, block, grams (packed longs)."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            sets = [grams(t.as_py(), n, words).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("num"), batch.column("copies"), batch.column("block"), pa.array(sets, pa.binary())],
                ["num", "copies", "block", "grams"])

    ident = F.coalesce(F.col("id").cast("string"), F.lit("")).alias("ident")
    first = F.coalesce(F.col("first_id").cast("string"), F.lit("")).alias("ident")
    # by (text, first id): of the copies of a hot text only the first one's rows join
    one = (rows.select("key", ident, "text")
           .join(layout.select("key", first, "num", "copies", "block"), ["key", "ident"])
           .groupBy("key", "ident")
           .agg(*[F.first(c).alias(c) for c in ("text", "num", "copies", "block")]))
    return written(one.select("text", "num", "copies", "block")
                   .mapInArrow(pack, "num bigint, copies bigint, block bigint, grams binary"), "ngram-sets")


def _tasks(layout: DataFrame) -> DataFrame:
    """num, a, b: the classes that the task comparing blocks a and b reads.

    A task for two blocks reads only those classes that share a band hash
    with the other block; the task of a block itself (a = b) reads all.
    """
    entries = layout.select("num", "block", F.explode("buckets").alias("bucket"))
    across = (entries.groupBy("bucket").agg(F.collect_set("block").alias("blocks")).where(F.size("blocks") > 1))
    others = (entries.join(across, "bucket").groupBy("num", "block")
              .agg(F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks")))
    cross = others.select("num", "block", F.explode(F.array_remove("blocks", F.col("block"))).alias("other"))
    return (cross.select("num", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
            .unionByName(layout.select("num", F.col("block").alias("a"), F.col("block").alias("b"))))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common grams of every two sets (upper triangle is enough for the caller)."""
    m = len(sets)
    out = np.zeros((m, m), np.int32)
    if not m:
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    all_ = np.concatenate(sets)
    order = np.argsort(all_, kind="stable")
    owner, all_ = owner[order], all_[order]
    starts = np.flatnonzero(np.r_[True, all_[1:] != all_[:-1]]) if len(all_) else np.zeros(0, np.int64)
    degree = np.diff(np.r_[starts, len(all_)])
    flat = out.reshape(-1)
    for d in np.unique(degree[(degree > 1) & (degree <= 48)]):
        # grams held by exactly d sets: add one to each of their pairs
        lists = owner[starts[degree == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        step = max(1, 2_000_000 // len(i))
        for a in range(0, len(lists), step):
            part = lists[a:a + step]
            np.add.at(flat, (part[:, i] * m + part[:, j]).ravel(), 1)
    wide = np.flatnonzero(degree > 48)
    for a in range(0, len(wide), 2048):
        some = wide[a:a + 2048]
        has = np.zeros((m, len(some)), np.float32)
        for k, g in enumerate(some):
            has[owner[starts[g]:starts[g] + degree[g]], k] = 1
        out += (has @ has.T).astype(np.int32)
    return out


def compare(table: pa.Table, threshold: float) -> dict[str, list]:
    """The links between two blocks, or inside one: per class its links, and a forest."""
    table = table.sort_by([("block", "ascending"), ("num", "ascending")])
    num = table.column("num").to_numpy()
    copies = table.column("copies").to_numpy()
    block = table.column("block").to_numpy()
    sets = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("grams")]
    sizes = np.array([len(s) for s in sets], np.int64)
    common = common_counts(sets)
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    linked = np.triu(linked & (common > 0), 1)
    if len(num) and block[0] != block[-1]:
        linked &= block[:, None] != block[None, :]
    i, j = np.nonzero(linked)
    text_links = np.bincount(i, minlength=len(num)) + np.bincount(j, minlength=len(num))
    links = (np.bincount(i, copies[j], len(num)) + np.bincount(j, copies[i], len(num))).astype(np.int64)
    # least position of each connected part: neighbours' minima, then one jump along them
    root, last = np.arange(len(num)), None
    while last is None or (root != last).any():
        last = root.copy()
        np.minimum.at(root, i, last[j])
        np.minimum.at(root, j, last[i])
        root = root[root]
    has = np.flatnonzero(text_links)
    return {"num": num[has].tolist(), "links": links[has].tolist(), "text_links": text_links[has].tolist(),
            "root": num[root[has]].tolist()}


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node of ``edges``; equal roots within a component.

    Each round moves every node to the least of its neighbours (three jumps
    along those moves), rewrites the edges and drops the loops; rounds end
    when no edge is left.  All tables stay distributed and are written, so
    a lost executor repeats one round at most.
    """
    left = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")), "cc-edges")
    roots = left.select(F.col("a").alias("node")).union(left.select(F.col("b"))).distinct()
    roots = written(roots.withColumn("root", F.col("node")), "cc-roots")
    left = left.where("a <> b")
    while not left.isEmpty():
        both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        move = both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to"))
        for _ in range(3):
            move = written(move, "cc-move")
            jump = move.select(F.col("a").alias("to"), F.col("to").alias("on"))
            move = move.join(jump, "to").select("a", F.col("on").alias("to"))
        move = written(move, "cc-move")
        roots = written(
            roots.join(move.select(F.col("a").alias("root"), F.col("to").alias("new")), "root", "left")
            .select("node", F.coalesce("new", "root").alias("root")), "cc-roots")
        left = written(
            left.join(move.select("a", F.col("to").alias("x")), "a")
            .join(move.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return roots


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5,
                   threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row per distinct text: key, first_id, copies, links, text_links, class_id, root.

    ``links`` counts linked rows with other texts (copies included),
    ``text_links`` linked texts; ``class_id`` is the least id of the
    component, ``root`` its internal number.
    """
    bands, hashes = plan_bands(threshold, recall)
    rows = _keyed(docs, id_col, text_col)
    classes = written(_classes(rows, n, bands, hashes), "ngram-classes")
    layout = _layout(classes)
    tasks = _block_sets(rows, layout, n).join(_tasks(layout), "num")

    def run(table: pa.Table) -> pa.Table:
        return pa.table(compare(table, threshold), schema=pa.schema(
            [("num", pa.int64()), ("links", pa.int64()), ("text_links", pa.int64()), ("root", pa.int64())]))

    found = written(tasks.groupBy("a", "b").applyInArrow(run, "num bigint, links bigint, text_links bigint, root bigint"),
                    "ngram-links")
    roots = components(found, "num", "root")
    counted = found.groupBy("num").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    near = (classes.select("num", "first_id").join(roots.withColumnRenamed("node", "num"), "num")
            .join(counted, "num"))
    least = near.groupBy("root").agg(F.min("first_id").alias("class_id"))
    near = near.join(least, "root").select("num", "root", "links", "text_links", "class_id")
    return (classes.select("num", "key", "first_id", "copies").join(near, "num", "left")
            .select("key", "first_id", "copies", F.coalesce("links", F.lit(0)).alias("links"),
                    F.coalesce("text_links", F.lit(0)).alias("text_links"),
                    F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("root", "num").alias("root")))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: id, class_id, n_links, n_text_links, text_id.

    ``n_links`` counts the other rows whose set reaches the threshold, rows
    with an equal text included; ``text_id`` is the least id of the equal
    texts.
    """
    texts = written(linked_classes(docs, id_col, text_col, **options), "ngram-result")
    rows = _keyed(docs, id_col, text_col).select("id", "key")
    return rows.join(texts, "key").select(
        F.col("id").alias(id_col), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"),
        F.col("text_links").alias("n_text_links"), F.col("first_id").alias("text_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each class is kept (the least id's), all columns."""
    texts = linked_classes(docs, id_col, text_col, **options)
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("best"))
    stay = best.select(F.col("best.key").alias("__hf_key"),
                       F.coalesce(F.col("best.first_id").cast("string"), F.lit("")).alias("__hf_id"))
    keyed = docs.withColumns({"__hf_key": key_of(F.coalesce(F.col(text_col), F.lit(""))),
                              "__hf_id": F.coalesce(F.col(id_col).cast("string"), F.lit(""))})
    nth = F.row_number().over(Window.partitionBy("__hf_key", "__hf_id").orderBy("__hf_key"))
    return (keyed.join(stay, ["__hf_key", "__hf_id"]).withColumn("__hf_nth", nth).where("__hf_nth = 1")
            .select(*docs.columns))
