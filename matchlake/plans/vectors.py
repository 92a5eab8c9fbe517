"""Retrieval, decisions, fusion and evaluation over the embedding table."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.functions import tables as T
from matchlake.operators import decide, evaluate, fusion, vector
from matchlake.plans.common import BEST, CHANNEL, FEATURES, LOGIT, MARGIN, gallery, queries_of, query, scores, text_channel


@query(
    "resolve_topk",
    f"""WITH {BEST}, z AS (SELECT *, round(26.89784 * (score - max(score) OVER (PARTITION BY query_id)), 6) AS logit FROM best),
p AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY query_id) AS probability, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM z),
t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN entity END) AS entity, max(CASE WHEN rank = 1 THEN score END) AS score, max(CASE WHEN rank = 1 THEN probability END) AS p1,
 coalesce(max(CASE WHEN rank = 2 THEN probability END), 0) AS p2, coalesce(max(CASE WHEN rank = 2 THEN score END), 0) AS s2 FROM p GROUP BY 1)
SELECT query_id, entity, round(score, 4) AS score, round(p1, 4) AS probability, round(p2, 4) AS runner_probability, round(score - s2, 4) AS visual_lead,
 CASE WHEN p1 >= 0.4 OR (p1 >= 0.6 AND score - s2 >= 0.06) OR (p1 >= 0.5 - 1e-9 AND p1 - p2 >= 0.1 - 1e-9) THEN 'matched' WHEN p1 >= 0.35 OR score >= 0.65 THEN 'uncertain' ELSE 'unknown' END AS status FROM t""",
)
def resolve_topk(spark, sf_dir):
    best = scores(spark, sf_dir)
    logit = F.round(T.RANKER["visual_gap"] * (F.col("score") - F.max("score").over(decide.by_query())), 6)
    rows = vector.ranked(best.withColumn("logit", logit).withColumn("p", decide.softmax(F.col("logit"))))
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    one = rows.where("rank <= 2").groupBy("query_id").agg(at(1, "entity").alias("entity"), at(1, "score").alias("s1"), at(1, "p").alias("p1"), F.coalesce(at(2, "p"), F.lit(0.0)).alias("p2"), F.coalesce(at(2, "score"), F.lit(0.0)).alias("s2"))
    lead = F.col("s1") - F.col("s2")
    return one.select(
        "query_id", "entity", F.round("s1", 4).alias("score"), F.round("p1", 4).alias("probability"), F.round("p2", 4).alias("runner_probability"), F.round(lead, 4).alias("visual_lead"),
        decide.fusion_status(F.col("p1"), F.col("p2"), F.col("s1"), lead).alias("status"),
    )


@query(
    "knn_per_query",
    f"WITH {BEST}, r AS (SELECT query_id, item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM pairs) SELECT query_id, item, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10",
)
def knn_per_query(spark, sf_dir):
    g = gallery(spark, sf_dir, by="vec_id")
    rows = vector.ranked(vector.top_entities(queries_of(g), g, k=10))
    return rows.select("query_id", "item", "score", F.col("rank").cast("int").alias("rank"))


@query("best_by_entity", f"WITH {BEST} SELECT query_id, entity, item, score FROM best")
def best_by_entity(spark, sf_dir):
    return scores(spark, sf_dir).select("query_id", "entity", "item", "score")


HALVES = """e AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[])[1:32] AS v, CAST(embedding AS DOUBLE[])[33:64] AS w FROM embeddings),
p AS (SELECT q.vec_id AS query_id, g.label AS entity, g.vec_id AS item, round(list_dot_product(q.v, g.v), 6) AS a, round(list_dot_product(q.w, g.w), 6) AS b FROM e q JOIN e g ON g.vec_id <> q.vec_id)"""


def two_models(spark, sf_dir):
    return scores(spark, sf_dir, part=(1, 32)), scores(spark, sf_dir, part=(33, 32))


@query(
    "two_view_union",
    f"""WITH {HALVES}, u AS (SELECT query_id, entity, max(greatest(a, b)) AS score FROM p GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM u) SELECT query_id, entity, score FROM r WHERE rank <= 5""",
)
def two_view_union(spark, sf_dir):
    a, b = two_models(spark, sf_dir)
    return vector.merge_views(a, b, 5).select("query_id", "entity", "score")


@query(
    "full_crop_split",
    f"""WITH {BEST}, s AS (SELECT query_id, entity, max(CASE WHEN item % 3 <> 0 THEN score END) AS full_score, max(CASE WHEN item % 3 = 0 THEN score END) AS crop_score FROM pairs GROUP BY 1, 2)
SELECT query_id, entity, full_score, crop_score, greatest(full_score, crop_score) AS score, CASE WHEN crop_score IS NOT NULL AND (full_score IS NULL OR crop_score >= full_score) THEN 'crop' ELSE 'full' END AS best_view FROM s""",
)
def full_crop_split(spark, sf_dir):
    """Every third image stands for the crop of another one."""
    g = gallery(spark, sf_dir)
    views = g.withColumn("entity", F.col("entity") * 2 + (F.col("item") % 3 == 0).cast("long"))
    hits = vector.top_entities(queries_of(g), views).select("query_id", (F.col("entity") % 2 == 1).alias("crop"), F.floor(F.col("entity") / 2).alias("entity"), "score")
    return vector.split_full_crop(hits, F.col("crop"))


@query(
    "fuse_two_models",
    f"WITH {HALVES}, s AS (SELECT query_id, entity, max(a) AS primary_score, max(b) AS secondary_score FROM p GROUP BY 1, 2) SELECT query_id, entity, primary_score, secondary_score, round(0.5 * primary_score + 0.5 * secondary_score, 8) AS score FROM s",
)
def fuse_two_models(spark, sf_dir):
    return vector.fuse_models(*two_models(spark, sf_dir)).withColumn("score", F.round("score", 8))


@query(
    "exact_rescore_semi_join",
    f"WITH {HALVES}, u AS (SELECT query_id, entity, max(a) AS s FROM p GROUP BY 1, 2), c AS (SELECT query_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, entity) AS r FROM u) WHERE r <= 3), f AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT c.query_id, c.entity, max(round(list_dot_product(q.v, g.v), 6)) AS score FROM c JOIN f q ON q.vec_id = c.query_id JOIN f g ON g.label = c.entity AND g.vec_id <> c.query_id GROUP BY 1, 2",
)
def exact_rescore(spark, sf_dir):
    """Candidates of half the components, then exact scores over their whole vectors."""
    half = gallery(spark, sf_dir, part=(1, 32))
    candidates = vector.top_entities(queries_of(half), half, k=3)
    g = gallery(spark, sf_dir)
    return vector.rescore(candidates, queries_of(g), g)


@query("probe_entity", f"WITH {BEST} SELECT query_id, score FROM best WHERE entity = 3")
def probe_entity(spark, sf_dir):
    g = gallery(spark, sf_dir)
    return vector.top_entities(queries_of(g), g.where("entity = 3")).select("query_id", "score")


@query("margin_runner_up", f"WITH {BEST}, {MARGIN} SELECT query_id, entity, score, CAST(rank AS INTEGER) AS rank, margin FROM m")
def margin_runner_up(spark, sf_dir):
    return decide.with_margin(scores(spark, sf_dir)).select("query_id", "entity", "score", F.col("rank").cast("int").alias("rank"), "margin")


@query(
    "pseudo_f1",
    f"""WITH {BEST}, r AS (SELECT query_id, round(score, 4) AS s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS k FROM best),
t AS (SELECT query_id, max(CASE WHEN k = 1 THEN s END) AS a, max(CASE WHEN k = 2 THEN s END) AS b, min_by(s, -k) AS e FROM r WHERE k <= 5 GROUP BY 1),
u AS (SELECT query_id, round(a - coalesce(b, 0), 4) AS margin, least(greatest(a, 0.0), 1.0) AS p, least(greatest(round(a - coalesce(b, 0), 4) / 0.15, 0.0), 1.0) AS r1, least(greatest((a - e) / 0.15, 0.0), 1.0) AS r5 FROM t)
SELECT query_id, margin, CASE WHEN p + r1 > 0 THEN round(2 * p * r1 / (p + r1), 4) ELSE 0.0 END AS f1_top1, CASE WHEN p + r5 > 0 THEN round(2 * p * r5 / (p + r5), 4) ELSE 0.0 END AS f1_top5 FROM u""",
)
def pseudo_f1(spark, sf_dir):
    return decide.pseudo_f1(scores(spark, sf_dir))


@query(
    "distinct_margin",
    f"""WITH {BEST}, r AS (SELECT *, entity % 2 AS family, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS k FROM best),
l AS (SELECT query_id, entity, score, family FROM r WHERE k = 1), o AS (SELECT r.query_id, max(r.score) AS s FROM r JOIN l USING (query_id) WHERE r.k > 1 AND r.family <> l.family GROUP BY 1)
SELECT l.query_id, l.entity, l.score, round(l.score - coalesce(o.s, 0), 4) AS margin FROM l LEFT JOIN o USING (query_id)""",
)
def distinct_margin(spark, sf_dir):
    return decide.distinct_margin(scores(spark, sf_dir).withColumn("family", F.col("entity") % 2), "family")


@query(
    "match_status",
    f"""WITH {BEST}, {MARGIN} SELECT query_id, entity, CASE WHEN (score >= 0.75 AND (margin >= 0.04 OR score >= 0.85)) OR (score >= 0.70 AND margin >= 0.035) THEN 'matched' WHEN score >= 0.65 THEN 'uncertain' ELSE 'unknown' END AS status,
 CASE WHEN score >= 0.75 AND (margin >= 0.04 OR score >= 0.85) THEN 'matched' WHEN score >= 0.65 THEN 'uncertain' ELSE 'unknown' END AS batch_status FROM m WHERE rank = 1""",
)
def match_status(spark, sf_dir):
    rows = decide.with_margin(scores(spark, sf_dir)).where("rank = 1")
    return rows.select("query_id", "entity", decide.visual_status(F.col("score"), F.col("margin")).alias("status"), decide.batch_status(F.col("score"), F.col("margin")).alias("batch_status"))


def featured(spark, sf_dir):
    return fusion.features(text_channel(scores(spark, sf_dir).withColumnRenamed("score", "visual")))


FEATURE_NAMES = ["visual_gap", "visual_far", "text_share", "text_log", "coverage", "sweetness", "colour", "year", "text_leader", "contradiction", "text_margin", "photo_text_share", "photo_text_log"]


@query("feature_matrix", f"WITH {BEST}, {CHANNEL}, {FEATURES} SELECT query_id, entity, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in FEATURE_NAMES) + " FROM feat")
def feature_matrix(spark, sf_dir):
    return featured(spark, sf_dir).select("query_id", "entity", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in FEATURE_NAMES])


@query("softmax_rank", f"WITH {BEST}, {CHANNEL}, {FEATURES}, {LOGIT} SELECT query_id, entity, logit, round(probability, 4) AS probability, CAST(rank AS INTEGER) AS rank FROM rk")
def softmax_rank(spark, sf_dir):
    rows = fusion.rank(featured(spark, sf_dir))
    return rows.select("query_id", "entity", "logit", F.round("probability", 4).alias("probability"), F.col("rank").cast("int").alias("rank"))


@query(
    "share_lead",
    f"""WITH {BEST}, {CHANNEL}, {FEATURES}, {LOGIT}, t AS (SELECT query_id, max(CASE WHEN rank = 1 THEN probability END) AS p, coalesce(max(CASE WHEN rank = 2 THEN probability END), 0) AS r FROM rk GROUP BY 1)
SELECT query_id, round(p, 4) AS probability, round(r, 4) AS runner, p >= 0.5 - 1e-9 AND p - r >= 0.1 - 1e-9 AS leads FROM t""",
)
def share_lead(spark, sf_dir):
    rows = fusion.rank(featured(spark, sf_dir)).where("rank <= 2").groupBy("query_id").agg(F.max("probability").alias("p"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("probability"))), F.lit(0.0)).alias("r"))
    return rows.select("query_id", F.round("p", 4).alias("probability"), F.round("r", 4).alias("runner"), decide.share_leads(F.col("p"), F.col("r")).alias("leads"))


@query(
    "candidate_union",
    f"""WITH {BEST}, {CHANNEL}, v AS (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY visual DESC, entity) AS r FROM chan),
t AS (SELECT query_id, entity, 1000 + row_number() OVER (PARTITION BY query_id ORDER BY text DESC, entity) AS r FROM chan), p AS (SELECT query_id, entity, 2000 + row_number() OVER (PARTITION BY query_id ORDER BY photo DESC, entity) AS r FROM chan)
SELECT query_id, entity, CAST(min(r) AS INTEGER) AS priority FROM (SELECT * FROM v WHERE r <= 4 UNION ALL SELECT * FROM t WHERE r <= 1002 UNION ALL SELECT * FROM p WHERE r <= 2002) GROUP BY 1, 2""",
)
def candidate_union(spark, sf_dir):
    rows = text_channel(scores(spark, sf_dir).withColumnRenamed("score", "visual"))
    channel = lambda c: rows.select("query_id", "entity", F.col(c).alias("score"))
    return fusion.candidate_union(channel("visual"), [channel("text"), channel("photo")], 4, 2).withColumn("priority", F.col("priority").cast("int"))


WORDS = "w AS (SELECT query_id, entity, 'w' || CAST((query_id + entity * k) % 7 AS VARCHAR) AS word, max(((query_id * k + entity) % 5) / 2.0) AS value FROM chan, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2, 3)"


def words(rows):
    k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
    each = rows.select("query_id", "entity", k)
    word = F.concat(F.lit("w"), F.pmod(F.col("query_id") + F.col("entity") * F.col("k"), F.lit(7)).cast("string"))
    return each.groupBy("query_id", "entity", word.alias("word")).agg(F.max(F.pmod(F.col("query_id") * F.col("k") + F.col("entity"), F.lit(5)) / 2.0).alias("value"))


@query(
    "sibling_override",
    f"""WITH {BEST}, {CHANNEL}, {FEATURES}, {LOGIT}, {WORDS}, t AS (SELECT query_id, entity, rank, visual, 'g' || CAST(entity % 2 AS VARCHAR) AS grp FROM rk WHERE rank <= 3),
pr AS (SELECT o.query_id, o.entity, o.rank, l.entity AS lead FROM t o JOIN t l ON l.query_id = o.query_id AND l.rank = 1 AND o.rank > 1 AND o.grp = l.grp AND l.visual - o.visual <= 0.05),
s AS (SELECT pr.query_id, pr.entity, pr.rank, (SELECT coalesce(sum(a.value), 0) FROM w a WHERE a.query_id = pr.query_id AND a.entity = pr.entity AND NOT EXISTS (SELECT 1 FROM w b WHERE b.query_id = pr.query_id AND b.entity = pr.lead AND b.word = a.word)) AS o,
 (SELECT coalesce(sum(a.value), 0) FROM w a WHERE a.query_id = pr.query_id AND a.entity = pr.lead AND NOT EXISTS (SELECT 1 FROM w b WHERE b.query_id = pr.query_id AND b.entity = pr.entity AND b.word = a.word)) AS l FROM pr),
win AS (SELECT query_id, min_by(entity, rank) AS winner FROM s WHERE o >= 2.0 AND l < 2.0 / 3 GROUP BY 1)
SELECT rk.query_id, rk.entity, coalesce(win.winner = rk.entity, false) AS promoted, CAST(row_number() OVER (PARTITION BY rk.query_id ORDER BY coalesce(win.winner = rk.entity, false) DESC, rk.rank) AS INTEGER) AS rank FROM rk LEFT JOIN win ON win.query_id = rk.query_id""",
)
def sibling_override(spark, sf_dir):
    rows = fusion.rank(featured(spark, sf_dir)).select("query_id", "entity", "rank", "visual")
    groups = rows.select("entity").distinct().withColumn("group", F.concat(F.lit("g"), (F.col("entity") % 2).cast("string")))
    return fusion.sibling_override(rows, words(rows), groups).select("query_id", "entity", "promoted", F.col("rank").cast("int").alias("rank"))


@query(
    "promote_distinctive",
    f"""WITH {BEST}, r AS (SELECT query_id, entity, score AS visual, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM best),
t AS (SELECT *, entity % 2 AS grp, ['m' || CAST(entity % 3 AS VARCHAR), 'n' || CAST(entity % 4 AS VARCHAR)] AS mk, ['m' || CAST(query_id % 3 AS VARCHAR), 'n' || CAST(query_id % 4 AS VARCHAR)] AS seen FROM r WHERE rank <= 5),
q AS (SELECT o.query_id, min_by(o.entity, o.rank) AS winner FROM t o JOIN t l ON l.query_id = o.query_id AND l.rank = 1 AND o.rank > 1 AND o.grp = l.grp AND l.visual - o.visual <= 0.06
 WHERE len(list_filter(o.mk, lambda x: NOT list_contains(l.mk, x) AND list_contains(o.seen, x))) > 0 AND len(list_filter(l.mk, lambda x: NOT list_contains(o.mk, x) AND list_contains(o.seen, x))) = 0 GROUP BY 1)
SELECT r.query_id, r.entity, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY coalesce(q.winner = r.entity, false) DESC, r.rank) AS INTEGER) AS rank FROM r LEFT JOIN q ON q.query_id = r.query_id""",
)
def promote_distinctive(spark, sf_dir):
    rows = vector.ranked(scores(spark, sf_dir).withColumnRenamed("score", "visual"), by="visual").select("query_id", "entity", "rank", "visual")
    two = lambda c: F.array(F.concat(F.lit("m"), (F.col(c) % 3).cast("string")), F.concat(F.lit("n"), (F.col(c) % 4).cast("string")))
    markers = rows.select("entity").distinct().select("entity", (F.col("entity") % 2).alias("group"), two("entity").alias("markers"))
    seen = rows.select("query_id").distinct().select("query_id", two("query_id").alias("words"))
    return fusion.distinctive(rows, markers, seen).select("query_id", "entity", F.col("rank").cast("int").alias("rank"))


@query(
    "lock_leader",
    f"""WITH {BEST}, c AS (SELECT query_id, entity, score AS visual, ((query_id + entity * 3) % 13) / 100.0 AS delta FROM best), v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY visual DESC, entity) AS k FROM c),
t AS (SELECT query_id, max(visual) AS top, max(CASE WHEN k = 2 THEN visual END) AS second, max(CASE WHEN k = 1 THEN delta END) AS own FROM v GROUP BY 1),
x AS (SELECT v.query_id, max(CASE WHEN v.k > 1 AND v.delta - t.own >= 0.06 AND t.top - v.visual <= 0.05 THEN 1 ELSE 0 END) AS rival FROM v JOIN t USING (query_id) GROUP BY 1)
SELECT v.query_id, v.entity, t.top - coalesce(t.second, 0) >= 0.02 AND x.rival = 0 AS locked,
 CAST(row_number() OVER (PARTITION BY v.query_id ORDER BY ((t.top - coalesce(t.second, 0) >= 0.02 AND x.rival = 0) AND v.k = 1) DESC, round(v.visual + v.delta, 6) DESC, v.entity) AS INTEGER) AS rank FROM v JOIN t USING (query_id) JOIN x USING (query_id)""",
)
def lock_leader(spark, sf_dir):
    rows = scores(spark, sf_dir).select("query_id", "entity", F.col("score").alias("visual"), (F.pmod(F.col("query_id") + F.col("entity") * 3, F.lit(13)) / 100.0).alias("delta"))
    return decide.lock_leader(rows.withColumn("score", F.round(F.col("visual") + F.col("delta"), 6)), "visual", "delta").select("query_id", "entity", "locked", F.col("rank").cast("int").alias("rank"))


TRUTH = f"""{BEST}, {MARGIN}, tr AS (SELECT vec_id AS query_id, CAST(label AS BIGINT) AS truth FROM embeddings),
ev AS (SELECT m.query_id, max(CASE WHEN m.entity = tr.truth THEN m.rank END) AS rank_of_truth, max(CASE WHEN m.rank = 1 THEN m.score END) AS score, max(CASE WHEN m.rank = 1 THEN m.margin END) AS margin,
 max(CASE WHEN m.rank = 1 AND m.entity = tr.truth THEN 1 ELSE 0 END) = 1 AS correct FROM m JOIN tr USING (query_id) GROUP BY 1)"""


def judged(spark, sf_dir):
    """(query_id, rank_of_truth, score, margin, correct) of every vector's own label."""
    truth = gallery(spark, sf_dir).select(F.col("item").alias("query_id"), F.col("entity").alias("truth"))
    rows = decide.with_margin(scores(spark, sf_dir)).join(truth, "query_id")
    first, own = F.col("rank") == 1, F.col("entity") == F.col("truth")
    return rows.groupBy("query_id").agg(F.max(F.when(own, F.col("rank"))).alias("rank_of_truth"), F.max(F.when(first, F.col("score"))).alias("score"), F.max(F.when(first, F.col("margin"))).alias("margin"), F.max(first & own).alias("correct"))


@query(
    "retrieval_metrics",
    f"""WITH {TRUTH}, s AS (SELECT count(*) AS queries, sum(CASE WHEN rank_of_truth <= 1 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN rank_of_truth <= 3 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN rank_of_truth <= 5 THEN 1 ELSE 0 END) AS c, avg(coalesce(1.0 / rank_of_truth, 0)) AS m,
 sum(CASE WHEN score >= 0.3 AND margin >= 0.01 THEN 1 ELSE 0 END) AS k, sum(CASE WHEN score >= 0.3 AND margin >= 0.01 AND NOT correct THEN 1 ELSE 0 END) AS f FROM ev)
SELECT CAST(queries AS BIGINT) AS queries, round(a / queries, 6) AS top1, round(b / queries, 6) AS top3, round(c / queries, 6) AS top5, round(m, 6) AS mrr, CAST(k AS BIGINT) AS accepted, round(k / queries, 6) AS coverage, CASE WHEN k > 0 THEN round(1 - f / k, 6) END AS precision, CAST(f AS BIGINT) AS false_accepts FROM s""",
)
def retrieval_metrics(spark, sf_dir):
    return evaluate.retrieval_metrics(judged(spark, sf_dir), 0.3, 0.01)


GRID_T, GRID_M = [round(0.1 + 0.02 * i, 2) for i in range(40)], [round(0.005 * i, 3) for i in range(16)]
GRID = f"""{TRUTH}, g AS (SELECT t.t AS threshold, m.m AS margin FROM (SELECT unnest({GRID_T}::DOUBLE[]) AS t) t, (SELECT unnest({GRID_M}::DOUBLE[]) AS m) m),
cells AS (SELECT g.threshold, g.margin, CAST(count(ev.query_id) AS BIGINT) AS accepted, CAST(coalesce(sum(CASE WHEN ev.correct THEN 1 ELSE 0 END), 0) AS BIGINT) AS "right" FROM g LEFT JOIN ev ON ev.score >= g.threshold - 1e-9 AND ev.margin >= g.margin - 1e-9 GROUP BY 1, 2)"""


@query("threshold_grid", f'WITH {GRID} SELECT threshold, margin, accepted, "right" FROM cells')
def threshold_grid(spark, sf_dir):
    return evaluate.threshold_grid(judged(spark, sf_dir), GRID_T, GRID_M)


@query(
    "wilson",
    f"""WITH {GRID} SELECT threshold, margin, CASE WHEN accepted > 0 THEN round((("right" / accepted) + 3.8416 / (2 * accepted) - 1.96 * sqrt((("right" / accepted) * (1 - "right" / accepted) + 3.8416 / (4 * accepted)) / accepted)) / (1 + 3.8416 / accepted), 6) ELSE 0.0 END AS lower FROM cells""",
)
def wilson(spark, sf_dir):
    cells = evaluate.threshold_grid(judged(spark, sf_dir), GRID_T, GRID_M)
    return cells.select("threshold", "margin", F.round(evaluate.wilson_lower(F.col("right"), F.col("accepted")), 6).alias("lower"))


@query(
    "choose_threshold",
    f"""WITH {GRID}, x AS (SELECT *, "right" / accepted AS p FROM cells WHERE accepted >= 20), y AS (SELECT *, round(p, 6) AS precision, round((p + 3.8416 / (2 * accepted) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * accepted)) / accepted)) / (1 + 3.8416 / accepted), 6) AS wilson FROM x)
SELECT threshold, margin, accepted, "right", precision, wilson FROM y WHERE precision >= 0.1 AND wilson >= 0.05 ORDER BY accepted DESC, precision DESC, threshold, margin LIMIT 1""",
)
def choose_threshold(spark, sf_dir):
    return evaluate.choose_threshold(evaluate.threshold_grid(judged(spark, sf_dir), GRID_T, GRID_M), 20, 0.1, 0.05)


@query(
    "threshold_curve",
    f"WITH {TRUTH}, t AS (SELECT unnest([0.1, 0.2, 0.3, 0.4]::DOUBLE[]) AS threshold), n AS (SELECT count(*) AS n FROM ev) SELECT threshold, round(count(*) / max(n.n), 6) AS kept, round(sum(CASE WHEN correct THEN 1 ELSE 0 END) / count(*), 6) AS precision FROM t JOIN ev ON ev.score >= t.threshold, n GROUP BY 1",
)
def threshold_curve(spark, sf_dir):
    return evaluate.threshold_curve(judged(spark, sf_dir), [0.1, 0.2, 0.3, 0.4])


@query("paired_bootstrap")
def paired_bootstrap(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("group", F.col("query_id") % 50).withColumn("a", F.col("correct").cast("double")).withColumn("b", (F.col("rank_of_truth") <= 3).cast("double"))
    return evaluate.paired_bootstrap(rows, "group", "a", "b")


@query("conditional_logit")
def conditional_logit(spark, sf_dir):
    truth = gallery(spark, sf_dir).select(F.col("item").alias("query_id"), F.col("entity").alias("truth"))
    names = list(T.RANKER)
    rows = featured(spark, sf_dir).join(truth, "query_id").withColumn("correct", F.col("entity") == F.col("truth"))
    found = evaluate.conditional_logit(rows, names)
    return spark.createDataFrame(list(zip(names, found)), "feature string, weight double")


@query("content_digest_split", "SELECT vec_id, sha256('crop:' || CAST(vec_id AS VARCHAR)) AS digest, CAST(CAST('0x' || substr(sha256('split:' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS INTEGER) AS bucket FROM embeddings")
def content_digest_split(spark, sf_dir):
    from matchlake.sources.catalog import split_bucket, view_digest

    key = F.col("item").cast("string")
    return gallery(spark, sf_dir).select(F.col("item").alias("vec_id"), view_digest("crop", key).alias("digest"), split_bucket(key, "split").alias("bucket"))


@query("kfold_assign", "SELECT vec_id, CAST(CAST('0x' || substr(sha256('fold:' || CAST(vec_id AS VARCHAR)), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM embeddings")
def kfold_assign(spark, sf_dir):
    return evaluate.folds(gallery(spark, sf_dir).select(F.col("item").alias("vec_id")), F.col("vec_id"), 5)
