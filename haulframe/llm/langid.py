"""Language of web pages by Bayesian evidence fusion.

Three kinds of evidence are combined by Bayes' rule:

* text: log likelihoods of the visible text under character-trigram models
  of all languages of a labelled corpus (each fitted on about ``fit_rows``
  of its texts), scaled by ``text_weight`` because trigrams are not independent;
* the declared markup language: P(declared | language), from counts of
  declared languages against the text's own verdicts over all pages;
* the address: a prior per host, smoothed towards its domain's, that
  towards its suffix's, that towards all pages', each with ``strength``
  pseudo pages.  The counts are sums of text posteriors, one grouped
  aggregation per level; a page's own share is taken out of its host's.

Defined results: a null html counts as empty and a null url as one without
host; a page without words or declared language gets its host's prior; of
equal posteriors the language first in order wins; without a labelled
corpus the language is null; a null id is a row like any other; repeated
rows each give a row; an empty table gives an empty result; other columns
are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulframe.llm.tables import salt_of, with_salts, written
from haulframe.llm.urls import host_and_path

# unclosed parts run to the end, so each pattern passes over a page once
HIDDEN = re.compile(r"<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
TAG = re.compile(r"<[^<>]*>")
DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
WORD = re.compile(r"[^\W\d_]+")
SALTS = 8
HASHES = 2 ** 40


def visible_text(html: str) -> str:
    return entities.unescape(TAG.sub(" ", HIDDEN.sub(" ", html)))


def declared_language(html: str) -> str:
    """The primary subtag of the root element's lang, or ''."""
    m = DECLARED.search(html)
    return m[1].lower() if m else ""


def trigrams(word: str) -> list[str]:
    w = f" {word} "
    return [w[i:i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    languages: list[str]
    grams: dict[str, int]
    logs: np.ndarray  # one row per gram, and a last one for all others

    def word(self, word: str) -> np.ndarray:
        return self.logs[[self.grams.get(g, -1) for g in trigrams(word)]].sum(axis=0)


class Words:
    """word -> log likelihoods; a cache of bounded size."""

    def __init__(self, model: Model, most: int = 100_000):
        self.model, self.most = model, most
        self.rows: dict[str, int] = {}
        self.table = np.zeros((most, len(model.languages)))

    def total(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(self.model.languages))
        for a in range(0, len(words), 10_000):
            part = words[a:a + 10_000]
            if len(self.rows) + len(part) > self.most:
                self.rows.clear()
            out += self.table[[self._row(w) for w in part]].sum(axis=0)
        return out

    def _row(self, word: str) -> int:
        row = self.rows.get(word)
        if row is None:
            row = self.rows[word] = len(self.rows)
            self.table[row] = self.model.word(word)
        return row


def fit(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text", fit_rows: int = 4000, grams: int = 20000,
        smoothing: float = 0.5) -> Model:
    """Trigram models of all languages of the labelled rows, each of about ``fit_rows`` of its texts (all, if it has fewer).

    Which ones is decided by the text's hash.  ``grams`` are the most
    frequent ones by their mean share of a language, so a language with few
    texts has its own among them.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    # over all labelled rows: one row per language
    sizes = written(usable.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("texts")), "langid-sizes")
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    part = F.pmod("h", F.lit(HASHES)) * F.col("texts").cast("double") < fit_rows * float(HASHES)
    rows = (usable.join(F.broadcast(sizes), "lang").where((F.col("texts") <= fit_rows) | part)
            .dropDuplicates(["h", "lang"]).select("lang", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for word, n in Counter(WORD.findall(text.lower())).items():
                    for g in trigrams(word):
                        seen[lang, g] += n
            if len(seen) > 500_000:
                yield flushed(seen)
                seen.clear()
        yield flushed(seen)

    def flushed(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()),
                                           pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])

    counts = written(rows.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")),
                     "langid-grams")
    whole = counts.groupBy("lang").agg(F.sum("n").alias("of"))
    totals = dict.fromkeys(languages, 0) | dict(whole.collect())
    # whole billionths: the sum does not depend on the order of the rows
    share = F.floor(F.col("n") * 1e9 / F.col("of"))
    top = (counts.join(F.broadcast(whole), "lang").groupBy("gram").agg(F.sum(share).alias("all"))
           .orderBy(F.desc("all"), "gram").limit(grams))
    names = [r["gram"] for r in top.select("gram").collect()]
    place, lang_at = {g: i for i, g in enumerate(names)}, {x: i for i, x in enumerate(languages)}
    table = np.zeros((len(names) + 1, len(languages)))
    for r in counts.join(F.broadcast(top.select("gram")), "gram").collect():  # grams times languages at most
        table[place[r["gram"]], lang_at[r["lang"]]] = r["n"]
    if languages:
        known = table.sum(axis=0)
        table[-1] = [totals[x] - k for x, k in zip(languages, known)]
        logs = np.log(table + smoothing) - np.log(table.sum(axis=0) + smoothing * len(table))
    else:
        logs = table
    return Model(languages, place, logs)


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max())
    return p / p.sum()


def evidence(pages: DataFrame, model: Model, text_weight: float, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """Per page: id, host, domain, suffix, declared, logs (scaled text log likelihoods), share (text posterior)."""
    host, _ = host_and_path(F.col(url_col))
    labels = F.split(F.regexp_replace("host", r":[0-9]*$", ""), r"\.")
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).select(
        "id", "host", F.array_join(F.slice(labels, -F.least(F.size(labels), F.lit(2)), 2), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"), "html")
    kind = rows.schema["id"].dataType.simpleString()
    known = set(model.languages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(model)
        for batch in batches:
            declared, logs, shares = [], [], []
            for page in batch.column("html"):
                page = page.as_py()
                said = declared_language(page)
                declared.append(said if said in known else "other" if said else "none")
                found = WORD.findall(visible_text(page).lower())
                logs.append(words.total(found) * text_weight)
                shares.append(_posterior(logs[-1]) if known else logs[-1])
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "host", "domain", "suffix")]
                + [pa.array(declared, pa.string()), pa.array(logs, floats), pa.array(shares, floats)],
                ["id", "host", "domain", "suffix", "declared", "logs", "share"])

    return rows.mapInArrow(read, f"id {kind}, host string, domain string, suffix string, declared string, "
                                 "logs array<double>, share array<double>")


def _sums(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Summed text posteriors per key, as an array."""
    out = rows.groupBy(*keys).agg(*[F.sum(F.col("share")[i]).alias(f"s{i}") for i in range(size)])
    return out.select(*keys, F.array(*[f"s{i}" for i in range(size)]).alias("sum"))


def _smoothed(sums: Column, parent: Column, strength: float) -> Column:
    whole = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x) + strength
    return F.zip_with(sums, parent, lambda s, p: (s + strength * p) / whole)


def languages_of_pages(pages: DataFrame, model: Model, *, text_weight: float = 0.2, strength: float = 8.0,
                       id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, lang, confidence, text_lang, declared, host for every page."""
    size = len(model.languages)
    if not size:
        return pages.select(id_col, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"),
                            F.lit(None).cast("string").alias("text_lang"), F.lit(None).cast("string").alias("declared"),
                            host_and_path(F.col(url_col))[0].alias("host"))
    rows = written(evidence(pages, model, text_weight, id_col, url_col, html_col), "langid-evidence")
    hosts = _sums(rows, ["host", "domain", "suffix"], size)
    domains, suffixes = _sums(rows, ["domain", "suffix"], size), _sums(rows, ["suffix"], size)
    # over all pages: one row of sums and, per declared value, at most languages + 2 rows
    flat = F.array(*[F.lit(1.0 / size)] * size)
    whole = rows.agg(*[F.coalesce(F.sum(F.col("share")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(size)]).first()
    root = _smoothed(F.array(*[F.lit(float(x)) for x in whole]), flat, strength)
    suffixes = suffixes.select("suffix", _smoothed(F.col("sum"), root, strength).alias("up"))
    domains = (domains.join(suffixes, "suffix").select("domain", "suffix", _smoothed(F.col("sum"), F.col("up"), strength).alias("up")))
    hosts = hosts.join(domains, ["domain", "suffix"]).select("host", "domain", "suffix", "sum", "up")

    spoken = {r["declared"]: np.array(r["sum"]) for r in _sums(rows, ["declared"], size).collect()}
    per_language = sum(spoken.values(), np.zeros(size))
    said = {d: np.log((spoken[d] + 0.5) / (per_language + 0.5 * (size + 2))) for d in spoken}
    declared = F.lit(None).cast("array<double>")
    for d, logs in sorted(said.items()):
        # no declaration says nothing about the language
        declared = F.when(F.col("declared") == d, F.array(*[F.lit(0.0 if d == "none" else float(x)) for x in logs])).otherwise(declared)

    joined = (rows.withColumn("salt", salt_of(SALTS, "id", "logs"))
              .join(with_salts(hosts, SALTS, "salt"), ["host", "domain", "suffix", "salt"]))
    others = F.zip_with("sum", "share", lambda s, own: F.greatest(s - own, F.lit(0.0)))
    prior = _smoothed(others, F.col("up"), strength)
    joined = joined.withColumn("prior", prior).withColumn("said", declared)
    total = F.transform(F.arrays_zip("logs", "prior", "said"), lambda x: x["logs"] + F.ln(F.greatest(x["prior"], F.lit(1e-12))) + x["said"])
    joined = joined.withColumn("total", total).withColumn("most", F.array_max("total"))
    scale = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("most")))
    names = F.array(*[F.lit(x) for x in model.languages])
    return joined.select(
        F.col("id").alias(id_col), F.element_at(names, F.array_position("total", F.col("most")).cast("int")).alias("lang"),
        (1 / scale).alias("confidence"), F.element_at(names, F.array_position("share", F.array_max("share")).cast("int")).alias("text_lang"),
        "declared", "host")
