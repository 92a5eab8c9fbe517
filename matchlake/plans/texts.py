"""Text search and text evidence: passages of the benchmark against documents."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators import lexical
from matchlake.plans.common import query, table

TOKEN = "regexp_extract_all(replace(lower(text), 'ё', 'е'), '[a-zа-яё0-9]+')"
INDEX = f"""dt AS (SELECT DISTINCT doc_id AS entity, unnest({TOKEN}) AS token FROM documents), f AS (SELECT entity, token, 1.0 AS weight FROM dt WHERE length(token) >= 4),
n AS (SELECT count(DISTINCT entity) AS n FROM f), idf AS (SELECT token, count(*) AS df, ln((max(n.n) + 1) / (count(*) + 1)) + 1 AS idf FROM f, n GROUP BY 1),
norms AS (SELECT entity, sum(CASE WHEN NOT regexp_matches(token, '^[0-9]+$') THEN weight * idf ELSE 0 END) AS norm FROM f JOIN idf USING (token) GROUP BY 1),
qt AS (SELECT DISTINCT item_id AS query_id, unnest({TOKEN}) AS word FROM benchmark), q AS (SELECT * FROM qt WHERE length(word) >= 4)"""
CONTRIB = "c AS (SELECT q.query_id, f.entity, q.word, f.weight * idf.idf AS value FROM q JOIN idf ON idf.token = q.word JOIN f ON f.token = q.word)"
EVIDENCE = "ev AS (SELECT c.query_id, c.entity, sum(value) AS score, least(1.0, sum(value) / max(greatest(norm, 1e-6))) AS coverage FROM c JOIN norms USING (entity) GROUP BY 1, 2)"


def index(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity"), F.explode(X.tokens("text")).alias("token"))
    return lexical.build_index(tokens.where(F.length("token") >= 4).withColumn("weight", F.lit(1.0)))


def passages(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(X.tokens("text")).alias("word"))
    return words.where(F.length("word") >= 4).withColumn("weight", F.lit(1.0))


@query("idf_table", f"WITH {INDEX} SELECT token, df, round(idf, 6) AS idf FROM idf")
def idf_table(spark, sf_dir):
    return index(spark, sf_dir).idf.select("token", "df", F.round("idf", 6).alias("idf"))


@query("text_norms", f"WITH {INDEX} SELECT entity, round(norm, 4) AS norm FROM norms")
def text_norms(spark, sf_dir):
    return index(spark, sf_dir).norms.select("entity", F.round("norm", 4).alias("norm"))


@query("lexical_topk", f"WITH {INDEX}, {CONTRIB}, {EVIDENCE}, r AS (SELECT query_id, entity, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, entity) AS k FROM ev) SELECT query_id, entity, score, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 10")
def lexical_topk(spark, sf_dir):
    own = index(spark, sf_dir)
    found = lexical.evidence(lexical.contributions(passages(spark, sf_dir), own), own).withColumn("score", F.round("score", 5))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "entity"))
    return found.withColumn("rank", n).where("rank <= 10").select("query_id", "entity", "score", F.col("rank").cast("int").alias("rank"))


@query("coverage", f"WITH {INDEX}, {CONTRIB}, {EVIDENCE} SELECT query_id, entity, round(coverage, 4) AS coverage FROM ev")
def coverage(spark, sf_dir):
    own = index(spark, sf_dir)
    return lexical.evidence(lexical.contributions(passages(spark, sf_dir), own), own).select("query_id", "entity", F.round("coverage", 4).alias("coverage"))


@query(
    "contradiction",
    f"""WITH {INDEX}, {CONTRIB}, {EVIDENCE}, top AS (SELECT query_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, entity) AS k FROM ev) WHERE k <= 10),
g AS (SELECT doc_id AS entity, source AS grp FROM documents), own AS (SELECT top.query_id, top.entity, g.grp FROM top JOIN g USING (entity)),
best AS (SELECT own.query_id, own.grp, c.word, max(c.value) AS value FROM own JOIN c ON c.query_id = own.query_id AND c.entity = own.entity GROUP BY 1, 2, 3),
mis AS (SELECT own.query_id, own.entity, sum(best.value) AS s FROM own JOIN best ON best.query_id = own.query_id AND best.grp = own.grp
 WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.query_id = own.query_id AND c.entity = own.entity AND c.word = best.word) GROUP BY 1, 2)
SELECT own.query_id, own.entity, round(coalesce(mis.s, 0), 4) AS contradiction FROM own LEFT JOIN mis ON mis.query_id = own.query_id AND mis.entity = own.entity""",
)
def contradiction(spark, sf_dir):
    own = index(spark, sf_dir)
    told = lexical.contributions(passages(spark, sf_dir), own)
    scored = lexical.evidence(told, own).withColumn("k", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 5)), "entity")))
    groups = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity"), F.col("source").alias("group"))
    found = lexical.contradiction(told, groups, scored.where("k <= 10"))
    return found.select("query_id", "entity", F.round("contradiction", 4).alias("contradiction"))


@query(
    "style_votes",
    """WITH v AS (SELECT conv_id AS query_id, role AS grp, CASE WHEN length(text) % 3 = 0 THEN 'dry' WHEN length(text) % 3 = 1 THEN 'sweet' ELSE 'brut' END AS style, 0.1 + (turn % 4) / 4.0 AS weight, turn AS ord FROM conversations),
t AS (SELECT query_id, grp, style, sum(weight) AS weight, min(ord) AS ord FROM v GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp ORDER BY weight DESC, ord, style) AS n FROM t)
SELECT query_id, grp AS "group", style, round(weight, 4) AS weight FROM r WHERE n = 1 AND weight >= 0.2""",
)
def style_votes(spark, sf_dir):
    """Turns of a conversation vote for a style by the length of their text."""
    size = F.length("text") % 3
    votes = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("group"), F.when(size == 0, "dry").when(size == 1, "sweet").otherwise("brut").alias("style"), (0.1 + F.col("turn") % 4 / 4.0).alias("weight"), F.col("turn").alias("ord"))
    return lexical.style_votes(votes).withColumn("weight", F.round("weight", 4))


@query(
    "fuzzy_resolve",
    f"""WITH {INDEX}, w AS (SELECT DISTINCT regexp_replace(word, '^(..).', '\\1') AS word FROM q), known AS (SELECT token FROM idf), miss AS (SELECT word FROM w WHERE word NOT IN (FROM known) AND length(word) >= 4 AND NOT regexp_matches(word, '^[0-9]+$')),
p AS (SELECT word, token, levenshtein(word, token) AS d, idf FROM miss JOIN idf ON abs(length(word) - length(token)) <= 2 WHERE length(token) >= 3 AND levenshtein(word, token) <= CASE WHEN length(word) <= 6 THEN 1 ELSE 2 END),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY d, idf, token) AS n FROM p), cuts AS (SELECT word, unnest(range(3, length(word) - 2)) AS cut FROM miss WHERE length(word) >= 6 AND word NOT IN (SELECT word FROM r)),
g AS (SELECT word, cut, substring(word, 1, cut) AS a, substring(word, cut + 1) AS b FROM cuts), h AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cut) AS n FROM g WHERE a IN (FROM known) AND b IN (FROM known))
SELECT word, word AS token, CAST(1 AS DOUBLE) AS factor FROM w WHERE word IN (FROM known) UNION ALL SELECT word, token, CAST(0.6 AS DOUBLE) FROM r WHERE n = 1 UNION ALL SELECT word, unnest([a, b]), CAST(0.8 AS DOUBLE) FROM h WHERE n = 1""",
)
def fuzzy_resolve(spark, sf_dir):
    """All words of the passages with their third letter lost, as dictionary tokens: equal, one or two edits away, or two in one."""
    words = passages(spark, sf_dir).select(F.regexp_replace("word", "^(..).", "$1").alias("word")).distinct()
    return lexical.resolve(words, index(spark, sf_dir).idf)


@query(
    "catalog_search",
    """WITH c AS (SELECT DISTINCT p_name AS text FROM part), ce AS (SELECT text, dense_rank() OVER (ORDER BY text) AS entity FROM c), q AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS text FROM part), qe AS (SELECT text, dense_rank() OVER (ORDER BY text) AS query_id FROM q),
ct AS (SELECT entity, unnest(list_distinct(string_split(text, ' '))) AS token FROM ce), qt AS (SELECT query_id, unnest(list_distinct(string_split(text, ' '))) AS token FROM qe), qn AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1),
s AS (SELECT query_id, entity, count(*) AS shared FROM qt JOIN ct USING (token) GROUP BY 1, 2), r AS (SELECT query_id, entity, round(0.75 * shared / n, 6) AS score FROM s JOIN qn USING (query_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM r) SELECT query_id, entity, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 20 AND score >= 0.25""",
)
def catalog_search(spark, sf_dir):
    queries, catalog = names(spark, sf_dir)
    return lexical.search(queries, catalog, ratio=F.lit(0.0)).select("query_id", "entity", "score", F.col("rank").cast("int").alias("rank"))


def names(spark, sf_dir):
    """Distinct part names, numbered, as the catalogue; names with their type as queries. There are few of them."""
    part = table(spark, sf_dir, "part")
    number = lambda rows, c: rows.distinct().withColumn(c, F.dense_rank().over(W.orderBy("text")).cast("long"))
    return number(part.select(F.concat_ws(" ", "p_name", F.lower("p_type")).alias("text")), "query_id"), number(part.select(F.col("p_name").alias("text")), "entity")


@query("search_ratio")
def search_ratio(spark, sf_dir):
    return lexical.search(*names(spark, sf_dir)).select("query_id", "entity", F.round("ratio", 6).alias("ratio"), "score", "rank")


@query("ocr_delta")
def ocr_delta(spark, sf_dir):
    """Turns of a conversation read against the words of their first turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.tokens("text").alias("words"))
    first = rows.where("turn = 0").select("conv_id", F.col("words").alias("known"))
    return rows.join(first, "conv_id").select("conv_id", "turn", lexical.ocr_delta(F.col("words"), F.col("known")).alias("delta"))


@query("word_variants")
def word_variants(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(X.raw_words(X.nfkc_cased(F.col("text")))).alias("word")).distinct()
    return words.select("word", X.variants(F.col("word")).alias("variants"), X.fold_word(F.col("word")).alias("folded"))


@query("token_overlap", f"WITH {INDEX}, s AS (SELECT q.query_id, dt.entity, count(*) AS shared FROM q JOIN dt ON dt.token = q.word GROUP BY 1, 2), qc AS (SELECT query_id, count(*) AS c FROM q GROUP BY 1) SELECT query_id, entity, shared, round(shared / c, 6) AS overlap FROM s JOIN qc USING (query_id) WHERE shared >= 10")
def token_overlap(spark, sf_dir):
    words = passages(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entity"), F.explode(X.tokens("text")).alias("word"))
    shared = words.join(docs, "word").groupBy("query_id", "entity").agg(F.count("*").alias("shared")).where("shared >= 10")
    return shared.join(words.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").select("query_id", "entity", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("overlap"))
