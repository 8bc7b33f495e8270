"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm import dedup, filter_audit, langid, main_text, merkle, mixing, ngram_join, packing, pii, prefix_trie, quality, topk, urls
from haulframe.llm.tables import table, written
from haulframe.llm.urls_sql import verdict_sql


def op1_deobfuscate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a copy of the pages' archive in which some records were overwritten, cut short or lost.

    Only damage in place is located: records of the copy keep the original's
    offsets.  In a copy whose later offsets have shifted, the audit, keyed by
    (file, offset), would report those records as missing and extra.
    """
    kind = F.coalesce(F.col("page_id") % 97, F.lit(0))
    html = F.coalesce("html", F.lit(""))
    damaged = (F.when(kind == 13, F.concat(F.lit("~"), F.substring(html, 2, 2 ** 31 - 1)))
               .when(kind == 29, F.left(html, F.floor(F.length(html) / 2).cast("int"))).otherwise(html))
    index = written(merkle.archive(table(spark, sf_dir, "pages"), copy=damaged, present=kind != 61), "merkle-archive")
    copy = index.where("copy_digest IS NOT NULL").select(
        "file", "offset", F.col("copy_length").alias("length"), F.col("copy_digest").alias("digest"))
    top = merkle.reach(index)
    return merkle.audit(spark, merkle.tree(index, top), merkle.tree(copy, top))


def op3_block_max_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages_of_pages(table(spark, sf_dir, "pages"), langid.fit(table(spark, sf_dir, "documents")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


URL_RULES = [
    urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"),
]


def op8_url_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(table(spark, sf_dir, "pages"), URL_RULES).drop("purity")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The mixture of the registered query and of the pipeline: relative weights of tree nodes.
MIX_WEIGHTS = {
    ("domain0",): 3.0, ("domain1",): 2.0, ("domain2",): 2.0, ("domain3",): 1.0,
    **{(f"domain{i}", lang): w for i in range(4) for lang, w in (("en", 4.0), ("de", 2.0), ("fr", 2.0), ("es", 1.0))},
}


def mixture(docs: DataFrame, share: float, max_epochs: int) -> DataFrame:
    path = {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, path, share=share, weights=MIX_WEIGHTS, max_epochs=max_epochs)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture(table(spark, sf_dir, "documents"), share=0.5, max_epochs=2)
    return out.select("doc_id", F.col("__hf_domain").alias("domain"), F.col("__hf_lang").alias("lang"),
                      F.col("__hf_source").alias("source"), F.col("__hf_epoch").alias("epoch"),
                      F.col("__hf_tokens").alias("n_tokens"))


def op11_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (
    op1_deobfuscate_pii, op2_merkle_fixity, op3_block_max_top_k, op4_ngram_jaccard_join,
    op5_language_evidence, op6_best_fit_packing, op7_exact_dedup,
    op8_url_template_tree, op9_quality_classifier, op10_mix_sources,
    op11_tag_path_text, op12_conversation_trie, op13_filter_interactions,
)}

ORACLE_SQL = {
    # all pairs of texts with a common gram: for small tables
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER (ORDER BY text) AS num, text, min(doc_id) AS first_id, count(*) AS copies,
         regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS words
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) GROUP BY text),
g AS (
  SELECT DISTINCT num, array_to_string(words[i:i + 4], ' ') AS gram
  FROM (SELECT num, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM t WHERE len(words) > 0)),
n AS (SELECT num, count(*) AS n FROM g GROUP BY num),
c AS (SELECT a.num AS x, b.num AS y, count(*) AS c FROM g a JOIN g b USING (gram) WHERE a.num < b.num GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.num = x JOIN n b ON b.num = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(num, other) AS (SELECT num, num FROM t UNION SELECT r.num, e.y FROM reach r JOIN e ON e.x = r.other),
class AS (SELECT r.num, min(t.first_id) AS class_id FROM reach r JOIN t ON t.num = r.other GROUP BY r.num),
k AS (SELECT e.x AS num, sum(t.copies) AS links, count(*) AS text_links FROM e JOIN t ON t.num = e.y GROUP BY e.x)
SELECT d.doc_id, class.class_id, CAST(coalesce(k.links, 0) + t.copies - 1 AS BIGINT) AS n_links,
       coalesce(k.text_links, 0) AS n_text_links, t.first_id AS text_id
FROM documents d JOIN t ON t.text = coalesce(d.text, '') JOIN class USING (num) LEFT JOIN k USING (num)
""",
    "op7_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents),
r AS (
  SELECT *, count(*) OVER (PARTITION BY content) AS group_size,
         first_value(doc_id) OVER w AS keep_id,
         row_number() OVER w AS nth
  FROM d WINDOW w AS (PARTITION BY content ORDER BY len DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(content) AS text_sha256 FROM r
""",
    "op3_block_max_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op2_merkle_fixity": r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         CASE coalesce(page_id % 97, 0) WHEN 13 THEN '~' || substr(coalesce(html, ''), 2)
           WHEN 29 THEN left(coalesce(html, ''), length(coalesce(html, '')) // 2)
           WHEN 61 THEN NULL ELSE coalesce(html, '') END AS copied
  FROM pages),
r AS (
  SELECT page_id, concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id,
           '>', chr(13), chr(10), 'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Length: ') AS head, strlen(html) AS n,
         html, copied, strlen(copied) AS m FROM p),
l AS (
  SELECT *, strlen(head) + strlen(n::VARCHAR) + 8 + n AS length,
         strlen(head) + strlen(m::VARCHAR) + 8 + m AS other_length,
         row_number() OVER (ORDER BY page_id NULLS LAST) - 1 AS pos FROM r),
o AS (
  SELECT *, pos // 4096 AS file,
         (sum(length) OVER (PARTITION BY pos // 4096 ORDER BY pos) - length)::BIGINT AS "offset" FROM l)
SELECT file, "offset", length, other_length, CASE WHEN copied IS NULL THEN 'missing' ELSE 'changed' END AS kind
FROM o WHERE copied IS DISTINCT FROM html
""",
    "op8_url_template_tree": verdict_sql(URL_RULES),
    # every pair of a node and a node below it: for small tables
    "op12_conversation_trie": r"""
WITH t AS (
  SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
         strlen(coalesce(text, '')) AS bytes, coalesce(role, '') AS role, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) AS pos FROM t),
crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))) AS tab),
ids AS (
  SELECT c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda v, x: xor(v >> 8, tab[(xor(v, x) & 255) + 1]))) % 9 AS h
  FROM (SELECT DISTINCT c FROM t), crc),
new AS (
  SELECT ids.c, pos AS d, digest, bytes FROM ids JOIN own ON own.c = ids.c - ids.c % 5 WHERE pos <= h
  UNION ALL
  SELECT ids.c, pos - h + least(h, (SELECT count(*) FROM own o WHERE o.c = ids.c - ids.c % 5)) AS d, digest, bytes
  FROM ids JOIN own ON own.c = ids.c WHERE pos > h),
path AS (
  SELECT c, d, bytes, sha256(string_agg(digest, '') OVER (PARTITION BY c ORDER BY d)) AS node FROM new
  UNION ALL SELECT c, 0, 0, '' FROM ids),
up AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, d = max(d) OVER (PARTITION BY c) AS last FROM path),
nodes AS (
  SELECT node, any_value(d) AS d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256
  FROM up GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS kids FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (SELECT DISTINCT a.node AS top, b.node FROM path a JOIN path b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT top AS node, sum((n - 1) * bytes) AS saved, count(*) FILTER (kids IS NULL) AS leaves
  FROM below JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top)
SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, x.ends_sha256
FROM nodes x JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN nodes p ON p.node = x.parent
""",
    "op13_filter_interactions": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > first_id, false) AS e
  FROM w LEFT JOIN marks USING (doc_id)),
cells AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m GROUP BY ALL),
perm AS (
  SELECT '' AS o UNION ALL
  SELECT o || x FROM perm, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
steps AS (
  SELECT o AS filter_order, s::INT AS step, ascii(o[s]) - 64 AS f, list_transform(range(1, s), lambda k: ascii(o[k]) - 64) AS before
  FROM perm, (SELECT unnest(range(1, 6)) AS s) WHERE length(o) = 5),
r AS (
  SELECT *, fails[f] AS hit, len(list_filter(before, lambda k: fails[k])) > 0 AS gone,
         fails[f] AND len(list_filter(fails, lambda x: x)) = 1 AS lone
  FROM cells, steps),
t AS (
  SELECT part, filter_order, step, f,
         coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (lone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost
  FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM t
""",
}
