"""The opN_ queries over the driver tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import urls
from .bpe import digests, encode_documents
from .embeddings import vector_links
from .mixing import mix_report
from .ogg import read_media, store_media
from .pii import pii_report
from .sharding import shard_documents
from .simhash import simhash_groups
from .toxicity import score_documents
from .urlfilter import RULES, judge_pages
from .warc import captures_of, resolve_revisits

SHARDS = 40
RANKS = "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an Ogg file of 8-bit samples in two logical streams, read back and measured."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "coalesce(octet_length(text), 0L) AS n_bytes", "text")
    return read_media(store_media(docs))


def op2_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the rules, decisions carried to aliases."""
    return judge_pages(table(spark, sf_dir, "pages"), RULES)


def op3_weighted_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all sources by weighted fair queueing."""
    return mix_report(table(spark, sf_dir, "documents"))


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text and the terms near it that give it away."""
    return pii_report(table(spark, sf_dir, "documents"))


def op5_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every text, fitted to labels outside the held-out third."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of all pages with a revisit each, resolved to the response it stands for."""
    return resolve_revisits(captures_of(table(spark, sf_dir, "pages")))


def op7_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with cosine 0.95 or more: link counts, components, the one kept."""
    return vector_links(table(spark, sf_dir, "embeddings"), 0.95)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, components over two or fewer differing bits."""
    return simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=2)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in 40 shards of near equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS).selectExpr("*", "'bytes' AS law", "CAST(NULL AS INT) AS grown_shard")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and what they decode to, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_text=False)
    return coded.select("doc_id", *digests(coded))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ogg, op2_redirects, op3_weighted_fair, op4_disclosure, op5_grammar, op6_revisits, op7_pca_tiles, op8_simhash, op9_best_fit, op10_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op2_redirects": OP2_SQL, "op6_revisits": OP6_SQL, "op7_pca_tiles": OP7_SQL}


_HOST = "translate(regexp_extract(CASE WHEN contains({u}, '://') THEN substr({u}, instr({u}, '://') + 3) ELSE '' END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(CASE WHEN contains({u}, '://') THEN substr({u}, instr({u}, '://') + 3) ELSE '' END, '^[^/?#]*([^?#]*)', 1)"
_LINKS = r"""list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))"""
_JUMPS = r"""list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1))"""
_WALKED = r"""list_reduce(list_concat([''], string_split(regexp_extract(w, '^/([^?]*)', 1), '/')),
  lambda a, x: CASE WHEN x = '.' THEN a WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)"""

OP2_SQL = f"""
WITH RECURSIVE rules(verdict, rule, rhost, rpath) AS (VALUES
  ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), declared AS (
  SELECT url AS src, regexp_replace(t.to, '#.*$', '') AS t FROM pages, (SELECT unnest(list_concat({_LINKS}, {_JUMPS})) AS to) t
), whole AS (
  SELECT src, t, regexp_extract(src, '^[^:/?#]*://[^/?#]*') AS root, regexp_replace({_PATH.format(u="src")}, '[^/]*$', '') AS folder FROM declared
), placed AS (SELECT src, t, root, CASE WHEN t LIKE '/%' THEN t ELSE CASE folder WHEN '' THEN '/' ELSE folder END || t END AS w FROM whole),
links AS (
  SELECT url AS src, {urls.CANONICAL_SQL.format(u="url")} AS dst FROM pages
  UNION SELECT src, CASE WHEN contains(t, '://') THEN t WHEN t LIKE '//%' THEN regexp_extract(src, '^[^:/?#]*:') || t
    WHEN t = '' OR regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') OR root = '' THEN NULL ELSE root || {_WALKED} || regexp_extract(w, '\\?.*$') END FROM placed
), ends AS (SELECT src, dst FROM links WHERE src <> dst),
edges AS (SELECT * FROM ends UNION SELECT dst, {urls.CANONICAL_SQL.format(u="dst")} FROM ends),
both_ways AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
nodes AS (SELECT DISTINCT a AS u FROM both_ways UNION SELECT url FROM pages WHERE url IS NOT NULL),
parsed AS (SELECT u, {_HOST.format(u="u")} AS host, {_PATH.format(u="u")} AS path FROM nodes),
own AS (
  SELECT u, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY u
), class AS (
  SELECT a AS u, min(b) AS component, bool_or(o.verdict = 'allow') AS allowed, bool_or(o.verdict = 'block') AS blocked
  FROM reach LEFT JOIN own o ON o.u = b GROUP BY a
)
SELECT page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, o.rule AS rule,
  coalesce(o.verdict, CASE WHEN c.allowed THEN 'allow' WHEN c.blocked THEN 'block' END, 'allow') AS verdict,
  CASE WHEN o.rule IS NOT NULL THEN 'rule' WHEN c.allowed OR c.blocked THEN 'alias' ELSE 'default' END AS how,
  coalesce(c.component, url) AS component
FROM pages LEFT JOIN parsed p ON p.u = url LEFT JOIN own o ON o.u = url LEFT JOIN class c ON c.u = url
"""

OP6_SQL = f"""
WITH p AS (
  SELECT page_id * 2 AS t, page_id, url AS uri, {urls.CANONICAL_SQL.format(u="url")} AS site, md5(coalesce(html, '')) AS d,
    coalesce(strlen(html), 0) AS n, 'day ' || (page_id // 10)::VARCHAR AS day
  FROM pages
), responses AS (
  SELECT *, 'cache-control: max-age=60' AS cc, 'content-length: ' || n AS cl, 'content-type: text/html' AS ct,
    '"' || substr(d, 1, 12) || '"' AS tag FROM p
), revisits AS (
  SELECT t + 1 AS record_id, uri, site, t + 1 + 2 * (page_id * 37 % 50) AS ts, 'time ' || t AS date, day,
    CASE WHEN page_id % 7 = 3 THEN '"other"' WHEN page_id % 5 <> 0 THEN 'W/' || tag END AS tag
  FROM responses
), met AS (
  SELECT r.*, f.t AS src, f.d AS src_d, f.n AS src_n, f.tag AS src_tag, f.day AS src_day, f.cc, f.cl, f.ct
  FROM revisits r ASOF LEFT JOIN responses f ON r.site = f.site AND r.ts > f.t
), judged AS (
  SELECT *, CASE WHEN src IS NULL THEN 'missing' WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = src_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN day = src_day THEN 'resolved' ELSE 'mismatch' END AS outcome FROM met
)
SELECT t AS record_id, uri, t AS ts, 'full' AS outcome, t AS source_id, d AS payload_digest, n AS payload_bytes,
  cc || chr(10) || cl || chr(10) || ct || chr(10) || 'etag: ' || tag || chr(10) || 'last-modified: ' || day AS headers FROM responses
UNION ALL
SELECT record_id, uri, ts, outcome, CASE WHEN outcome = 'resolved' THEN src END, CASE WHEN outcome = 'resolved' THEN src_d END,
  CASE WHEN outcome = 'resolved' THEN src_n ELSE 0 END,
  CASE WHEN outcome = 'resolved' THEN cc || chr(10) || cl || chr(10) || ct || chr(10) || 'date: ' || date || chr(10) || 'etag: ' || coalesce(tag, src_tag) || chr(10) || 'last-modified: ' || day
  ELSE 'content-length: 0' || chr(10) || 'date: ' || date || coalesce(chr(10) || 'etag: ' || tag, '') || chr(10) || 'last-modified: ' || day || chr(10) || 'set-cookie: x=1' END
FROM judged
"""


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([coalesce(isfinite(x), false) FOR x IN embedding])
    AND list_bool_or([x <> 0 FOR x IN embedding])
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.95
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counts c ON c.a = vec_id LEFT JOIN least l ON l.a = vec_id
"""
