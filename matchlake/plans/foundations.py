"""Scans, coercions, keys and state tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators import feed
from matchlake.plans.common import query, table
from matchlake.sources import catalog


@query("scan_catalog_dedup", "SELECT p_name AS slug, p_partkey AS first_key, p_brand AS winery FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part WHERE p_name <> '') WHERE n = 1")
def scan_catalog_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where(F.col("p_name") != "")
    return feed.latest(rows, ["p_name"], [F.col("p_partkey")]).select(F.col("p_name").alias("slug"), F.col("p_partkey").alias("first_key"), F.col("p_brand").alias("winery"))


@query("coerce_floats", "SELECT p_partkey, round(TRY_CAST(replace(replace(CAST(round(p_retailprice, 2) AS VARCHAR), '.', ','), ',', '.') AS DOUBLE), 2) AS price, TRY_CAST(p_brand AS DOUBLE) AS none, TRY_CAST(regexp_extract(p_brand, '([0-9]+[.,]?[0-9]*)', 1) AS DOUBLE) AS brand_no FROM part")
def coerce_floats(spark, sf_dir):
    comma = F.replace(F.round("p_retailprice", 2).cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.optional_number(comma), 2).alias("price"), X.optional_number("p_brand").alias("none"), X.first_number("p_brand").alias("brand_no"))


@query("split_tokens", "SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[a-zа-яё0-9]+'))) AS INTEGER) AS tokens, CAST(len(list_filter(list_transform(string_split_regex(text, '[,;]'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS INTEGER) AS parts FROM documents")
def split_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.tokens("text")).alias("tokens"), F.size(X.split_list("text")).alias("parts"))


@query("normalize_text", "SELECT doc_id, sha256(array_to_string(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[a-zа-яё0-9]+'), ' ')) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.normalize("text"), 256).alias("digest"))


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '([^/]*)$', 1) AS tail FROM pages")
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.url_part(url, "PROTOCOL").alias("scheme"), X.url_part(url, "HOST").alias("host"), X.url_part(url, "PATH").alias("path"), F.substring_index(F.regexp_extract(url, "^([^?#]*)", 1), "/", -1).alias("tail"))


@query("html_extract", r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, CAST(len(regexp_extract_all(html, '<a href=')) AS INTEGER) AS links, regexp_extract(html, '<script[^>]*>([^<]*)', 1) AS script FROM pages")
def html_extract(spark, sf_dir):
    html = F.col("html")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(html, 'lang="([a-z]+)"', 1).alias("lang"), F.size(F.regexp_extract_all(html, F.lit("<a href="), F.lit(0))).alias("links"),
        F.regexp_extract(html, "<script[^>]*>([^<]*)", 1).alias("script"),
    )


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), "event_type")


@query("mime_sniff")
def mime_sniff(spark, sf_dir):
    """Pages stand for uploads: a header of some kind before their bytes."""
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("FFD8FFE0", "89504E470D0A1A0A", "52494646000000005745425056503820", "000000186674797068656963000000006D696631", "000000186674797061766966000000006D696631", "25504446")])
    data = F.concat(F.get(heads, F.pmod(F.col("page_id"), F.lit(6)).cast("int")), F.encode("html", "utf-8"))
    return table(spark, sf_dir, "pages").select("page_id", X.mime_type(data).alias("mime"), X.upload_allowed(F.lit("text/html"), data).alias("allowed"))


@query("upsert_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    return feed.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("upsert_merge", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def upsert_merge(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return feed.upsert(old, new, ["c_custkey"])


@query("incremental_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def incremental_anti_join(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select("c_custkey")
    return feed.missing(wanted, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("get_or_create_profiles", """WITH have AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') SELECT sha256(CAST(c_custkey AS VARCHAR)) AS profile_id, '{"seen":1}' AS state FROM have
UNION ALL SELECT DISTINCT sha256(CAST(user_id AS VARCHAR)), '{}' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM have)""")
def get_or_create_profiles(spark, sf_dir):
    """Customers of one segment have a profile already; every user of an event gets one."""
    have = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").select(F.sha2(F.col("c_custkey").cast("string"), 256).alias("profile_id"), F.lit('{"seen":1}').alias("state"))
    return feed.get_or_create(have, table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("token")))


@query("duplicate_free", "SELECT p_partkey, p_name FROM part WHERE p_retailprice IN (SELECT p_retailprice FROM part GROUP BY 1 HAVING count(*) = 1)")
def duplicate_free(spark, sf_dir):
    return catalog.duplicate_free(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", "p_name")


@query("health_counts", "SELECT 'customers' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'pages', count(*) FROM pages")
def health_counts(spark, sf_dir):
    return feed.health(customers=table(spark, sf_dir, "customer"), pages=table(spark, sf_dir, "pages"))
