"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import dartminhash, decontaminate, disclosure, kdtree, license_scan, quality, raking, sstable, urlfilter, vamana
from .common import table

SHARDS = 24
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Pages of hosts with one of these labels make the list of blocked canonical urls. They lie under several
#: top-level domains, so that at every scale some are under none of the rules and the list decides.
LISTED_LABELS = ("spam-farm", "casino-win", "ads-track", "free-bets", "cheap-pills", "adult-x")


def op1_kdtree_sharding(spark, sf_dir):
    return kdtree.kdtree_shards(table(spark, sf_dir, "documents"), shards=SHARDS)


def op2_license_notices(spark, sf_dir):
    return license_scan.license_notices(table(spark, sf_dir, "documents")).drop("spans")


def op3_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_template_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_raked_mixture(spark, sf_dir):
    return raking.rake(table(spark, sf_dir, "documents")).withColumns({"weight": F.round("weight", 6), "probability": F.round("probability", 6)})


def op6_dartminhash_dedup(spark, sf_dir):
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_disclosure_spans(spark, sf_dir):
    found = disclosure.personal_data(table(spark, sf_dir, "documents"))
    return found.withColumns({"base_sha256": F.sha2(disclosure.listed("base"), 256), "spans": disclosure.listed("spans")}).drop("base")


def op8_pruned_graph_search(spark, sf_dir):
    return vamana.nearest(table(spark, sf_dir, "embeddings"))


def op9_bloom_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = urlfilter.with_parts(pages.select(F.col("url").alias("_url"))).where(F.arrays_overlap(F.split("host", "[.]"), F.array(*map(F.lit, LISTED_LABELS)))).select("canonical")
    return urlfilter.filter_urls(pages, URL_RULES, listed)


def op10_token_shards(spark, sf_dir):
    return sstable.token_shards(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_kdtree_sharding, op2_license_notices, op3_quality_classifier, op4_template_decontamination, op5_raked_mixture, op6_dartminhash_dedup, op7_disclosure_spans, op8_pruned_graph_search, op9_bloom_url_filter, op10_token_shards)}

_URL_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT r, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, substr(rest, length(raw) + 1) AS tail FROM h),
q AS (SELECT *, ltrim(regexp_replace('&' || regexp_extract(substr(tail, length(path) + 1), '^[?]([^#]*)', 1), '&(utm_[^&=]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '&') AS query FROM p),
c AS (SELECT *, regexp_replace(host, '^(www|m)[.]', '') || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM q),
rules(verdict, rhost, rpath) AS (VALUES {', '.join(str(r) for r in URL_RULES)}),
best AS (SELECT r, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule, arg_max(verdict, length(rhost || rpath) * 1000 + length(rhost)) AS verdict
  FROM c, rules WHERE host <> '' AND (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY r),
listed AS (SELECT DISTINCT canonical FROM c WHERE list_has_any(string_split(host, '.'), {list(LISTED_LABELS)}))
SELECT page_id, host, path, best.rule, coalesce(best.verdict, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best USING (r) LEFT JOIN listed USING (canonical)
"""

ORACLES = {"op5_raked_mixture": raking.oracle(), "op9_bloom_url_filter": _URL_SQL}
