"""Document quality: random-indexing word vectors, pooled per document, and a two-layer network.

Fitting has three steps, the first two over all documents, the last on a
bounded sample of labelled ones (``fit_rows`` ids of the fit fold, those with
the smallest hash, one text each):

* the ``vocabulary`` most frequent tokens get a row each; every other token
  shares one of a fixed number of rows by its shape (letters, capitals,
  digits, symbols) and hash;
* random indexing: every row has a fixed sparse ternary index vector, and
  its word vector is the sum of the index vectors of the tokens within
  ``window`` places, over all occurrences (one grouped sum on Spark, of whole
  numbers, so it does not depend on the order of the rows);
* a two-layer numpy network on the pooled vectors (mean, deviation and the
  mean product of neighbours) and three length and repetition figures,
  trained on four fifths of the sample; the temperature that calibrates its
  probabilities is fitted on the last fifth.

Scoring is one pass over whole texts; the model (a few MB, whatever the
size of the input) goes with the tasks.

Defined results: a null text counts as empty; an empty text gets the
network's score for a document without tokens; ids with both labels, null
ids and labels other than 0 and 1 are not learnt from; without rows of
both labels every score is the smoothed share of label 1 (0.5 when there
are no labels at all).  Repeated rows are scored alike, and all count for
the vocabulary; of the texts of one sampled id the smallest is learnt from;
ties of token counts and of hashes are decided by the token and the id; very
long texts are read whole, in slices; an empty table gives an empty result;
other columns are passed on by ``keep_good`` and not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from haulframe.llm.tables import written

SHAPES = 6
SHARED = 64  # rows per shape for tokens outside the vocabulary
FIGURES = 3


class Rows(dict):
    """token -> row; tokens outside the vocabulary are added as they come, up to a bound."""

    MOST = 400_000

    def __init__(self, words: list[str]):
        super().__init__(zip(words, range(len(words))))
        self.known = len(words)
        self.words = words

    def __missing__(self, token: str) -> int:
        row = self.known + shape(token) * SHARED + zlib.crc32(token.encode("utf-8", "replace")) % SHARED
        if len(self) >= self.MOST:  # only a cache: start again from the vocabulary
            self.clear()
            self.update(zip(self.words, range(self.known)))
        self[token] = row
        return row


def shape(token: str) -> int:
    bare = token.rstrip(".,;:!?")
    if bare.isalpha():
        return 0 if bare.islower() else 1 if bare.istitle() else 2
    if not bare:
        return 3
    return 4 if any(c.isdigit() for c in bare) else 5


def index_vectors(rows: int, dims: int, seed: int) -> np.ndarray:
    """A sparse ternary vector for each row: four places, two of each sign."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, dims), np.float32)
    places = np.argsort(rng.random((rows, dims)), axis=1)[:, :4]
    np.put_along_axis(out, places, np.array([1, 1, -1, -1], np.float32), axis=1)
    return out


def contexts(ids: np.ndarray, lengths: np.ndarray, index: np.ndarray, window: int, step: int = 500_000) -> np.ndarray:
    """Summed index vectors of the neighbours of each row's occurrences."""
    size, dims = index.shape
    places = np.nonzero(index)[1].reshape(size, -1)  # as many in every row
    signs = np.take_along_axis(index, places, axis=1)
    out = np.zeros(size * dims, np.float64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    for gap in range(1, window + 1):
        for a in range(0, max(len(ids) - gap, 0), step):
            b = min(a + step, len(ids) - gap)
            same = doc[a:b] == doc[a + gap:b + gap]
            left, right = ids[a:b][same].astype(np.int64), ids[a + gap:b + gap][same].astype(np.int64)
            for row, near in ((left, right), (right, left)):
                for k in range(places.shape[1]):
                    out += np.bincount(row * dims + places[near, k], signs[near, k], len(out))
    return out.reshape(size, dims)


def spans(texts: list[str], chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``chars`` characters (a longer text is alone), at most 512 of them."""
    a, held = 0, 0
    for b, t in enumerate(texts):
        if b > a and (held + len(t) > chars or b - a == 512):
            yield texts[a:b]
            a, held = b, 0
        held += len(t)
    if a < len(texts):
        yield texts[a:]


def tokenised(texts: list[str], rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ids of all tokens, tokens per text, distinct tokens per text."""
    parts = [t.split() for t in texts]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    distinct = np.fromiter((len(set(p)) for p in parts), np.int64, len(parts))
    ids = np.fromiter((rows[w] for p in parts for w in p), np.int32, int(lengths.sum()))
    return ids, lengths, distinct


def pooled(ids: np.ndarray, lengths: np.ndarray, distinct: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Features per document; tokens are visited in slices of bounded size."""
    n, dims = len(lengths), vectors.shape[1]
    total, squares, near = np.zeros((n, dims)), np.zeros((n, dims)), np.zeros(n)
    repeats = np.zeros(n)
    doc = np.repeat(np.arange(n), lengths)
    step = 100_000
    for a in range(0, len(ids), step):
        d = doc[a:a + step]
        v = vectors[ids[a:a + step]]
        starts = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
        total[d[starts]] += np.add.reduceat(v, starts, axis=0)
        squares[d[starts]] += np.add.reduceat(v * v, starts, axis=0)
        b = min(a + step + 1, len(ids))  # the slice's last token has its right neighbour in the next one
        here, there = ids[a:b - 1], ids[a + 1:b]
        same = doc[a:b - 1] == doc[a + 1:b]
        w = np.append(v, vectors[ids[b - 1:b]], axis=0) if b - a > len(v) else v
        dots = np.einsum("ij,ij->i", w[:b - a - 1], w[1:b - a]) * same
        np.add.at(near, doc[a:b - 1], dots)
        np.add.at(repeats, doc[a:b - 1], same & (here == there))
    one = np.maximum(lengths, 1)[:, None]
    mean = total / one
    spread = np.sqrt(np.maximum(squares / one - mean * mean, 0))
    pairs = np.maximum(lengths - 1, 1)
    figures = np.stack([np.log1p(lengths), distinct / one[:, 0], repeats / pairs], axis=1)
    return np.concatenate([mean, spread, (near / pairs)[:, None], figures], axis=1).astype(np.float32)


@dataclass
class Model:
    words: list[str]
    vectors: np.ndarray | None
    layers: tuple[np.ndarray, ...] | None
    scale: tuple[np.ndarray, np.ndarray] | None
    temperature: float
    prior: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -40, 40)))

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = (features - self.scale[0]) / self.scale[1]
        return np.tanh(np.clip(x, -8, 8) @ w1 + b1) @ w2 + b2

    def score_texts(self, texts: list[str], rows: Rows) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.prior)
        return self.scores(pooled(*tokenised(texts, rows), self.vectors)).astype(np.float64)

    def column(self, text: Column) -> Column:
        """The score of a text column (0 to 1)."""
        model = self

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            rows = Rows(model.words)
            for texts in batches:
                whole = [t if t is not None else "" for t in texts]
                parts = [model.score_texts(part, rows) for part in spans(whole)]
                yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

        return F.pandas_udf(run, "double")(F.coalesce(text, F.lit("")))


def in_fit_fold(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return fold_of(doc_id) != 0


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def sample(docs: DataFrame, labels: DataFrame, fit_rows: int, label_col: str) -> DataFrame:
    """At most ``fit_rows`` labelled rows of the fit fold: h, label, text."""
    usable = (labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
              .where("label = other").where(in_fit_fold(F.col("doc_id")))
              .select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
              .orderBy("h", "doc_id").limit(fit_rows))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # broadcast: at most fit_rows rows of three numbers
    found = rows.join(F.broadcast(usable), "doc_id")
    return found.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text")).select("h", "label", "text")


def most_frequent(tokens: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent values of ``w``, ties by value.

    How often the last of them occurs is found from the counts of counts
    first, so that a sort sees those few values and not the largest of
    every partition.
    """
    counts = written(tokens.groupBy("w").count(), "quality-counts")
    # one row per different count: about the square root of the tokens, at most
    steps = counts.groupBy("count").agg(F.count(F.lit(1)).alias("values"))
    upto = F.sum("values").over(Window.orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, 0))
    least = steps.withColumn("upto", upto).where(F.col("upto") >= most).agg(F.max("count")).first()[0]
    return (counts if least is None else counts.where(F.col("count") >= least)).orderBy(F.desc("count"), "w").limit(most)


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", fit_rows: int = 6000,
        vocabulary: int = 16384, dims: int = 32, window: int = 2, hidden: int = 24, seed: int = 7) -> Model:
    """Word vectors of all ``docs``, and the network from at most ``fit_rows`` labelled ones of the fit fold."""
    rows = written(sample(docs, labels, fit_rows, label_col).repartition(8), "quality-sample")
    counts = dict(rows.groupBy("label").count().collect())
    good, all_ = counts.get(1, 0), sum(counts.values())
    prior = (good + 1) / (all_ + 2)
    if good in (0, all_):
        return Model([], None, None, None, 1.0, prior)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    top = most_frequent(texts.select(F.explode(F.split(F.trim("text"), r"\s+")).alias("w")).where("w <> ''"), vocabulary)
    words = [r.w for r in top.collect()]
    size = len(words) + SHAPES * SHARED
    index = index_vectors(size, dims, seed)

    def gather(batches):
        known = Rows(words)
        out = np.zeros(index.shape, np.float64)
        for batch in batches:
            for part in spans(list(batch["text"])):  # the tokens of a whole batch would be hundreds of MB
                ids, lengths, _ = tokenised(part, known)
                out += contexts(ids, lengths, index, window)
        used = np.flatnonzero(out.any(axis=1))
        yield pd.DataFrame(out[used], columns=names).assign(row=used)[["row", *names]]

    names = [f"v{i}" for i in range(dims)]
    schema = "row long, " + ", ".join(f"{n} double" for n in names)
    summed = texts.mapInPandas(gather, schema).groupBy("row").agg(*[F.sum(n).alias(n) for n in names])
    table = summed.toPandas()  # one row per vocabulary entry at most
    vectors = np.zeros((size, dims), np.float32)
    vectors[table["row"].to_numpy()] = table[names].to_numpy()
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)

    def features(batches):
        known = Rows(words)
        for batch in batches:
            got = [x for part in spans(list(batch["text"])) for x in pooled(*tokenised(part, known), vectors)]
            yield pd.DataFrame({"h": batch["h"], "label": batch["label"], "x": got})

    data = rows.mapInPandas(features, "h long, label int, x array<float>").toPandas()  # fit_rows rows
    data = data.sort_values(["h", "label"], kind="stable")
    x, y = np.stack(data["x"]), data["label"].to_numpy(np.float64)
    scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    cut = np.arange(len(y)) % 5 != 0
    layers = train((x[cut] - scale[0]) / scale[1], y[cut], hidden, seed)
    model = Model(words, vectors, layers, scale, 1.0, prior)
    model.temperature = temperature(model.logits(x[~cut]), y[~cut])
    return model


def train(x: np.ndarray, y: np.ndarray, hidden: int, seed: int, epochs: int = 60, decay: float = 1e-4):
    """Two layers by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    x = np.clip(x, -8, 8).astype(np.float64)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        for a in range(0, len(y), 64):
            xb, yb = x[order[a:a + 64]], y[order[a:a + 64]]
            h = np.tanh(xb @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - yb) / len(yb)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [xb.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(a.astype(np.float32) for a in p)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on held-back rows."""
    if len(y) == 0:
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        return float(np.mean(np.logaddexp(0, z) - y * z))

    return float(min(np.geomspace(0.25, 8, 60), key=loss))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, **options)
    return docs.select(
        "doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"),
        model.column(F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    model = fit(docs, labels, **options)
    scored = docs.withColumn("__hf_score", model.column(F.col("text")))
    return scored.where(F.col("__hf_score") >= threshold).drop("__hf_score")
