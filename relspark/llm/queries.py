"""One query for each operator, over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import jaccard, mixing, packing, pii, quality, sharding, tokens, topk, toxicity, urlfilter
from .common import LOWER, UPPER, table


def op1_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op2_ngram_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(list(urlfilter.RULES), urlfilter.RULE_TYPE)
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), rules)


def op4_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op8_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_counts(spark, sf_dir):
    """Two edits of every document that has a text: its first line goes, and the ten characters in its middle become a mark."""
    n = F.length("text")
    line = F.struct(F.lit(0).alias("start"), F.locate("\n", F.col("text")).alias("stop"), F.lit("").alias("replacement"))
    mark = F.struct(F.floor(n / 2).cast("int").alias("start"), (F.floor(n / 2) + 10).cast("int").alias("stop"), F.lit("[removed]").alias("replacement"))
    return tokens.count_tokens(table(spark, sf_dir, "documents"), edits=F.when(F.col("text").isNotNull(), F.array(line, mark)))


def op10_topk_search(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_ngram_jaccard_join, op3_url_filter, op4_pii, op5_quality_rules, op6_best_fit_packing, op7_mixing, op8_toxicity, op9_token_counts, op10_topk_search)}

RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)
OP3 = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM rest
), rules(verdict, h, p) AS (VALUES {RULE_ROWS}
), fit AS (
  SELECT page_id, host, path, verdict, h || p AS rule,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC, verdict DESC) AS k
  FROM cut LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1
"""
STOP = ", ".join(f"'{w}'" for w in quality.STOP_FORMS)
LIMITS = " AND ".join(f"coalesce({(r.ratio.replace(' / ', '::DOUBLE / nullif(') + ', 0)') if ' / ' in r.ratio else r.ratio} BETWEEN {r.least} AND {r.most}, FALSE)" for r in quality.RULES)
OP5 = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, t, w, list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2)) AS g,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM w
), x AS (
  SELECT doc_id, i, g[i] AS v, count(*) OVER (PARTITION BY doc_id, g[i]) AS c
  FROM (SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i FROM g)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM x WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT g.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(w, lambda y: y IN ({STOP})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
  FROM g LEFT JOIN r ON g.doc_id = r.doc_id
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {LIMITS} AS kept FROM f
"""
OP2 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM o JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 75 * (p.n + q.n - k)
), r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(k.k, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT x, count(*) AS k FROM l GROUP BY x) k ON d.doc_id = k.x JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON d.doc_id = c.x
"""
OP10 = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0
), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
ORACLE_SQL = {"op2_ngram_jaccard_join": OP2, "op10_topk_search": OP10, "op3_url_filter": OP3, "op5_quality_rules": OP5}
