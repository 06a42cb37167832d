"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chunks, decontam, html_text, licenses, lines, mixing, near_dups, toxicity, urls, warc
from .common import table


def op1_mixing(spark, d):
    return mixing.mix(table(spark, d, "documents"), carry=False)


def op2_licenses(spark, d):
    return licenses.scan(table(spark, d, "documents"))


def op3_toxicity(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, d, "labels")))


def op4_html(spark, d):
    out = html_text.main_text(table(spark, d, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_fingerprints(spark, d):
    return chunks.fingerprints(table(spark, d, "documents"))


def op6_urls(spark, d):
    return urls.judge(table(spark, d, "pages"), urls.rules_table(spark))


def op7_lines(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    out = lines.dedup(docs.withColumn("n_before", F.length("text")))
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), F.col("n_before").cast("long").alias("n_before"))


def op8_decontamination(spark, d):
    return decontam.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op9_warc(spark, d):
    return warc.verified(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_near_dups(spark, d):
    return near_dups.near_duplicates(table(spark, d, "documents"), k=3, percent=85)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_licenses, op3_toxicity, op4_html, op5_fingerprints, op6_urls, op7_lines, op8_decontamination, op9_warc, op10_near_dups)}

ORACLE_SQL = {
    "op6_urls": r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.v, length(r.h || r.p)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND top <> page_id THEN top END AS refers_to
FROM g""",
    "op7_lines": r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents
), t AS (SELECT coalesce(source, '') AS site, count(*) AS total FROM documents GROUP BY 1),
c AS (SELECT site, trim(line, ' ') AS line, count(DISTINCT doc_id) AS pages FROM l WHERE trim(line, ' ') <> '' GROUP BY 1, 2),
b AS (SELECT c.site, c.line FROM c JOIN t USING (site) WHERE pages >= 5 AND pages > 0.02 * total),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY pos) AS text FROM l
      LEFT JOIN b ON l.site = b.site AND trim(l.line, ' ') = b.line WHERE b.line IS NULL GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CAST(length(CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END) AS BIGINT) AS n_chars, CAST(length(d.text) AS BIGINT) AS n_before
FROM documents d LEFT JOIN k USING (doc_id)""",
}
