"""What the query plans share: tables, the stand-in roles of tables, and shared SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators import vector

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name with its DuckDB oracle."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gallery(spark: SparkSession, sf_dir: str, by: str = "label", part: tuple[int, int] | None = None) -> DataFrame:
    """(entity, item, v) of embeddings; part: first place and length of the components used."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col(by).cast("long").alias("entity"), F.col("vec_id").alias("item"), (F.slice(v, *part) if part else v).alias("v"))


def queries_of(g: DataFrame) -> DataFrame:
    return g.select(F.col("item").alias("query_id"), "v")


def scores(spark: SparkSession, sf_dir: str, part: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, entity, item, score): every vector's best item of every label, itself left out."""
    g = gallery(spark, sf_dir, part=part)
    return vector.top_entities(queries_of(g), g)


def text_channel(rows: DataFrame) -> DataFrame:
    """A second channel for (query_id, entity): text values derived from the ids."""
    a = lambda m, n, k: F.pmod(F.col("query_id") * m + F.col("entity") * n, F.lit(k))
    return (
        rows.withColumn("text", a(7, 13, 17) / 4.0).withColumn("coverage", a(3, 5, 11) / 10.0).withColumn("sweetness", (a(1, 2, 3) - 1).cast("int")).withColumn("colour", (a(2, 1, 3) - 1).cast("int"))
        .withColumn("year", (a(5, 4, 3) - 1).cast("int")).withColumn("contradiction", a(11, 3, 7) / 2.0).withColumn("photo", a(5, 9, 13) / 3.0)
    )


# SQL of scores() and of text_channel().
BEST = """e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, g.label AS entity, g.vec_id AS item, round(list_dot_product(q.v, g.v), 6) AS score FROM e q JOIN e g ON g.vec_id <> q.vec_id),
best AS (SELECT query_id, entity, max(score) AS score, min_by(item, (-score, item)) AS item FROM pairs GROUP BY 1, 2)"""
CHANNEL = """chan AS (SELECT query_id, entity, score AS visual, ((query_id * 7 + entity * 13) % 17) / 4.0 AS text, ((query_id * 3 + entity * 5) % 11) / 10.0 AS coverage,
 (query_id * 1 + entity * 2) % 3 - 1 AS sweetness, (query_id * 2 + entity * 1) % 3 - 1 AS colour, (query_id * 5 + entity * 4) % 3 - 1 AS year,
 ((query_id * 11 + entity * 3) % 7) / 2.0 AS contradiction, ((query_id * 5 + entity * 9) % 13) / 3.0 AS photo FROM best)"""
FEATURES = """b AS (SELECT *, max(text) OVER q AS tb, max(photo) OVER q AS pb, visual - max(visual) OVER q AS gap, row_number() OVER (PARTITION BY query_id ORDER BY text DESC, entity) AS tp FROM chan WINDOW q AS (PARTITION BY query_id)),
b2 AS (SELECT *, max(CASE WHEN tp = 2 THEN text END) OVER (PARTITION BY query_id) AS ts FROM b),
feat AS (SELECT query_id, entity, visual, gap AS visual_gap, least(0.0, gap + 0.08) AS visual_far, CASE WHEN tb > 0 THEN text / tb ELSE 0.0 END AS text_share, ln(1 + text) AS text_log, coverage,
 sweetness, colour, year, CASE WHEN text >= tb AND tb > 0 THEN 1.0 ELSE 0.0 END AS text_leader, CASE WHEN tb > 0 THEN contradiction / tb ELSE 0.0 END AS contradiction,
 CASE WHEN text >= tb AND tb > 0 THEN (tb - coalesce(ts, 0)) / tb ELSE 0.0 END AS text_margin, CASE WHEN pb > 0 THEN photo / pb ELSE 0.0 END AS photo_text_share, ln(1 + photo) AS photo_text_log, text FROM b2)"""
LOGIT = """lg AS (SELECT *, round(26.89784 * visual_gap + 6.22669 * visual_far + 1.25038 * text_share + 0.26364 * text_log + 9.00645 * coverage + 0.6606 * sweetness + 0.79866 * colour - 0.15175 * year
 + 0.07948 * text_leader - 0.17179 * contradiction + 3.60001 * text_margin + 0.92562 * photo_text_share + 0.29754 * photo_text_log, 6) AS logit FROM feat),
rk AS (SELECT *, exp(logit - max(logit) OVER q) / sum(exp(logit - m)) OVER q AS probability, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, entity) AS rank
 FROM (SELECT *, max(logit) OVER (PARTITION BY query_id) AS m FROM lg) WINDOW q AS (PARTITION BY query_id))"""
MARGIN = "m AS (SELECT *, row_number() OVER w AS rank, round(score - coalesce(lead(score) OVER w, 0), 4) AS margin FROM best WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, entity))"
