"""Operator 5: accuracy on pages, and each kind of evidence on planted cases."""

import pytest

from haulframe.llm import langid
from tests.conftest import MEDIUM


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet(f"{MEDIUM}/documents.parquet"))


def test_accuracy_without_the_declared_language(spark, model):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    pages = docs.selectExpr("doc_id AS page_id", "concat('http://h', doc_id % 7, '.test/') AS url", "text AS html", "lang AS truth")
    out = langid.languages_of_pages(pages, model).join(pages.select("page_id", "truth"), "page_id").toPandas()
    assert len(out) == docs.count()
    assert (out.lang == out.truth).mean() > 0.97


def test_evidence_is_fused(spark, model):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("length(text) > 400").collect()
    de = [r.text for r in docs if r.lang == "de"][:40]
    en = [r.text for r in docs if r.lang == "en"][:40]
    rows = [(i, "http://www.seite.test/", f"<html lang=\"de\"><body>{t}") for i, t in enumerate(de)]
    rows += [(100 + i, "http://site.test/", f"<html lang='en-GB'><body>{t}") for i, t in enumerate(en)]
    rows += [(200, "http://www.seite.test/", ""), (201, "http://site.test/x", None), (202, "http://new.test", "<html lang=de><p>12"),
             (203, None, f"<html lang=en>{de[0]}"), (None, "http://site.test/", en[0]), (100, *rows[40][1:])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, share int").repartition(3)
    out = langid.languages_of_pages(df, model).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out}
    assert by[200].lang == "de" and by[201].lang == "en"  # the host's prior
    assert by[202].lang == "de" and by[202].declared == "de"  # the declaration
    assert by[203].lang == "de"  # a whole text outweighs a wrong declaration
    assert all(0 < r.confidence <= 1.0000001 for r in out)


def test_posteriors_against_plain_python(spark, model):
    """Every step of the fusion recomputed page by page: text, declaration, and the host's prior through its levels."""
    import math
    import re
    from collections import defaultdict

    pages = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    langs, weight, strength = model.languages, 0.2, 8.0
    size = len(langs)

    def softmax(x):
        top = max(x)
        e = [math.exp(v - top) for v in x]
        return [v / sum(e) for v in e]

    def smooth(sums, up):
        return [(s + strength * p) / (sum(sums) + strength) for s, p in zip(sums, up)]

    seen = {}
    sums = {k: defaultdict(lambda: [0.0] * size) for k in ("host", "domain", "suffix", "declared")}
    for r in pages.collect():
        html = r.html or ""
        logs = [0.0] * size
        for word in re.findall(r"[^\W\d_]+", langid.visible_text(html).lower()):
            for g in langid.trigrams(word):
                row = model.logs[model.grams.get(g, -1)]
                logs = [a + weight * b for a, b in zip(logs, row)]
        host = re.match(r"[^/?#]*", r.url.split("://", 1)[1])[0].lower()
        labels = host.split(":")[0].split(".")
        said = langid.declared_language(html)
        keys = {"host": host, "domain": ".".join(labels[-2:]), "suffix": labels[-1], "declared": said if said in langs else "other" if said else "none"}
        share = softmax(logs)
        seen[r.page_id] = keys, logs, share
        for k, v in keys.items():
            sums[k][v] = [a + b for a, b in zip(sums[k][v], share)]
    whole = [sum(x) for x in zip(*(share for _, _, share in seen.values()))]
    root = smooth(whole, [1 / size] * size)
    per_language = [sum(x) for x in zip(*sums["declared"].values())]
    for r in langid.languages_of_pages(pages, model).collect():
        keys, logs, share = seen[r.page_id]
        up = smooth(sums["domain"][keys["domain"]], smooth(sums["suffix"][keys["suffix"]], root))
        prior = smooth([max(s - own, 0.0) for s, own in zip(sums["host"][keys["host"]], share)], up)
        said = [0.0] * size if keys["declared"] == "none" else [
            math.log((s + 0.5) / (t + 0.5 * (size + 2))) for s, t in zip(sums["declared"][keys["declared"]], per_language)]
        p = softmax([a + math.log(max(b, 1e-12)) + c for a, b, c in zip(logs, prior, said)])
        assert r.lang == langs[p.index(max(p))] and abs(r.confidence - max(p)) < 1e-6 and r.text_lang == langs[share.index(max(share))]
        assert (r.declared, r.host) == (keys["declared"], keys["host"])


def test_rare_languages_have_models(spark):
    """Each language is sampled by itself: a few texts among many of another language make a model."""
    docs = [(i, "en", f"the weather of day {i} was fine and the people went home with thoughts of winter") for i in range(600)]
    docs += [(1000 + i, "fi", f"kylmän talven {i} jälkeen järven jää sulaa hyvin hitaasti keväällä") for i in range(3)] + [(2000, "xx", "17")]
    df = spark.createDataFrame(docs, "doc_id bigint, lang string, text string")
    few = langid.fit(df, fit_rows=20, grams=60)
    assert few.languages == langid.fit(df).languages == ["en", "fi", "xx"]
    pages = [(1, "http://a.test/", "<html lang=fi><p>järven jää sulaa keväällä"), (2, "http://b.test/", "<html lang=en><p>the people went home")]
    out = langid.languages_of_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string"), few).collect()
    assert {r.page_id: (r.text_lang, r.lang, r.declared) for r in out} == {1: ("fi", "fi", "fi"), 2: ("en", "en", "en")}


def test_visible_text():
    assert langid.visible_text("<p>a<script>x</script>b<!-- c --><style>d</style>&amp;<i>e</i>").split() == ["a", "b", "&", "e"]
    assert langid.visible_text("a <script> never closed").strip() == "a"
    for page in ("<" * 200_000, "<script>" * 50_000, "<!--" * 50_000, "&" * 100_000):
        langid.visible_text(page)
        langid.declared_language(page)


def test_empty_tables(spark, model):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert langid.languages_of_pages(pages, model).collect() == []
    none = langid.fit(spark.createDataFrame([(1, None, "a"), (2, "en", None)], "doc_id bigint, lang string, text string"))
    one = spark.createDataFrame([(1, "http://x.test", "<html lang=de>")], pages.schema)
    assert [r.lang for r in langid.languages_of_pages(one, none).collect()] == [None]
