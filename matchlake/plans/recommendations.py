"""Alternatives, occasions, tastes and fit over the part catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.functions import tables as T
from matchlake.functions import text as X
from matchlake.operators import recommend as R
from matchlake.plans.common import query, table

# Part types as wine styles: the stand-in catalogue's texts.
STYLES = {"STANDARD": "красное сухое каберне", "MEDIUM": "белое полусухое", "PROMO": "игристое брют", "SMALL": "розовое полусладкое", "ECONOMY": "красное сладкое пино ягодное", "LARGE": "оранжевое сухое лимонное"}
DISHES = {"STANDARD": "мясо стейк", "MEDIUM": "рыба", "PROMO": "закуски аперитив", "SMALL": "десерт фрукты", "ECONOMY": "сыры", "LARGE": "морепродукты"}


def case(column: str, values: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " ELSE '' END"


def mapped(column: str, values: dict):
    out = F.lit("")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


PARTS = f"p AS (SELECT p_partkey AS entity, p_name, p_brand, p_type, p_size, p_retailprice, {case('p_type', STYLES)} AS blob, {case('p_type', DISHES)} AS dishes, p_size / 3.0 AS alcohol, round(p_retailprice / 400, 8) AS rating FROM part)"


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice", mapped("p_type", STYLES).alias("blob"), mapped("p_type", DISHES).alias("dishes"),
        (F.col("p_size") / 3.0).alias("alcohol"), F.round(F.col("p_retailprice") / 400, 8).alias("rating"),
    )


@query(
    "alternatives",
    f"""WITH {PARTS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, entity) AS n FROM p) WHERE n = 1),
x AS (SELECT s.entity AS query_id, p.entity, round(3.0 * len(list_intersect(string_split(s.p_name, ' '), string_split(p.p_name, ' '))) + CASE WHEN s.p_type = p.p_type THEN 2.0 ELSE 0.0 END + CASE WHEN s.p_size = p.p_size THEN 1.5 ELSE 0.0 END
 + CASE WHEN s.p_size // 10 <> p.p_size // 10 THEN 0.4 ELSE 0.0 END + p.rating / 10, 9) AS score, p.p_size % 2 = 0 AS photo FROM s JOIN p ON p.entity <> s.entity AND p.p_brand <> s.p_brand),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS k FROM x WHERE score > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY photo DESC, k) AS rank FROM t WHERE k <= 24)
SELECT query_id, entity, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def alternatives(spark, sf_dir):
    """For the dearest part of each brand, the three best of other brands; brands are few, so their side is broadcast."""
    from matchlake.operators.feed import latest

    p = parts(spark, sf_dir)
    s = latest(p, ["p_brand"], [F.desc("p_retailprice"), F.col("entity")]).select(F.col("entity").alias("query_id"), F.col("p_name").alias("n"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("z"))
    rows = p.join(F.broadcast(s), (F.col("entity") != F.col("query_id")) & (F.col("p_brand") != F.col("b")))
    shared = F.size(F.array_intersect(F.split("n", " "), F.split("p_name", " ")))
    region = F.floor(F.col("z") / 10) != F.floor(F.col("p_size") / 10)
    score = R.alternative_score(shared, F.col("t") == F.col("p_type"), F.col("z") == F.col("p_size"), region, F.col("rating"))
    pairs = rows.select("query_id", "entity", F.round(score, 9).alias("score"), (F.col("p_size") % 2 == 0).alias("has_photo"), F.col("entity").alias("ord"))
    return R.alternatives(pairs).select("query_id", "entity", "score", F.col("rank").cast("int").alias("rank"))


@query(
    "occasion_recommend",
    f"""WITH {PARTS}, q(query_id, occasion, colour, sweetness, amin, amax) AS (VALUES (1, 'meat', 'red', 'dry', 8.0, 14.0), (2, 'fish', 'any', 'any', NULL, NULL), (3, 'cheese', 'white', 'any', NULL, 12.0), (4, 'dessert', 'any', 'any', NULL, NULL), (5, 'aperitif', 'sparkling', 'dry', 5.0, NULL)),
k AS (SELECT *, CASE WHEN contains(blob, 'розов') THEN 'rose' WHEN contains(blob, 'оранж') THEN 'orange' WHEN contains(blob, 'красн') THEN 'red' WHEN contains(blob, 'бел') THEN 'white' WHEN contains(blob, 'игрист') THEN 'sparkling' ELSE 'unknown' END AS c, contains(blob, 'игрист') OR contains(blob, 'брют') AS sp,
 CASE WHEN contains(blob, 'полуслад') THEN 'semi_sweet' WHEN contains(blob, 'полусух') THEN 'semi_dry' WHEN contains(blob, 'сладк') THEN 'sweet' WHEN contains(blob, 'сух') OR contains(blob, 'брют') THEN 'dry' ELSE 'unknown' END AS sw FROM p),
x AS (SELECT q.query_id, k.entity, p_size % 2 = 0 AS photo,
 CASE WHEN (occasion = 'meat' AND regexp_matches(dishes, 'мясо|стейк')) OR (occasion = 'fish' AND regexp_matches(dishes, 'рыба|морепродукты')) OR (occasion = 'cheese' AND contains(dishes, 'сыр')) OR (occasion = 'dessert' AND regexp_matches(dishes, 'десерт|фрукты')) OR (occasion = 'aperitif' AND regexp_matches(dishes, 'закуск|аперитив')) THEN 3.6 ELSE 0.0 END
 + CASE WHEN colour = 'sparkling' THEN CASE WHEN sp THEN 4.0 ELSE 0.7 END WHEN colour = 'white' THEN CASE WHEN c = 'white' THEN CASE WHEN sp THEN 4.4 ELSE 4.0 END WHEN c = 'orange' THEN 1.6 ELSE 0.7 END WHEN colour IN ('red', 'rose') THEN CASE WHEN c = colour THEN 4.0 ELSE 0.7 END
  WHEN (occasion = 'meat' AND c = 'red') OR (occasion = 'fish' AND (c IN ('white', 'sparkling', 'rose') OR sp)) OR (occasion = 'cheese' AND (c IN ('white', 'red', 'sparkling') OR sp)) OR (occasion = 'dessert' AND c IN ('white', 'red', 'rose')) OR (occasion = 'aperitif' AND (c IN ('sparkling', 'white', 'rose') OR sp)) THEN 1.8 WHEN c = 'orange' AND occasion <> 'meat' THEN 0.8 ELSE 0.4 END
 + CASE WHEN sweetness <> 'any' THEN CASE WHEN sw = sweetness THEN 4.0 ELSE 0.8 END WHEN occasion = 'dessert' THEN CASE sw WHEN 'sweet' THEN 3.4 WHEN 'semi_sweet' THEN 3.0 WHEN 'semi_dry' THEN 1.1 WHEN 'dry' THEN 0.35 ELSE 0.6 END WHEN occasion = 'meat' AND sw = 'dry' THEN 1.1 WHEN occasion = 'aperitif' AND sw IN ('dry', 'semi_dry', 'unknown') THEN 0.6 ELSE 0.3 END
 + CASE WHEN occasion = 'fish' AND c = 'red' THEN CASE WHEN contains(blob, 'пино') THEN 2.4 WHEN contains(blob, 'каберне') THEN 0.35 ELSE 0.9 END WHEN occasion = 'meat' AND c = 'red' AND contains(blob, 'каберне') THEN 0.8 ELSE 0.0 END
 + CASE WHEN amin IS NULL AND amax IS NULL THEN 0.0 WHEN coalesce(alcohol >= amin, true) AND coalesce(alcohol <= amax, true) THEN 1.6 ELSE 0.15 END + least(rating, 5.0) / 8 AS s FROM q, k),
y AS (SELECT query_id, entity, photo, round(s, 6) AS score FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, photo DESC, entity) AS rank, max(score) OVER (PARTITION BY query_id) AS top FROM y),
n AS (SELECT query_id, greatest(least(count(*), 8), least(sum(CASE WHEN score >= top * 0.82 THEN 1 ELSE 0 END), 48)) AS found FROM z GROUP BY 1)
SELECT CAST(query_id AS INTEGER) AS query_id, entity, round(score, 3) AS score, CAST(rank AS INTEGER) AS rank, CAST(found AS BIGINT) AS found FROM z JOIN n USING (query_id) WHERE rank <= 8""",
)
def occasion_recommend(spark, sf_dir):
    requests = spark.createDataFrame(
        [(1, "meat", "red", "dry", "", "", 8.0, 14.0, None), (2, "fish", "any", "any", "", "", None, None, None), (3, "cheese", "white", "any", "", "", None, 12.0, None), (4, "dessert", "any", "any", "", "", None, None, None), (5, "aperitif", "sparkling", "dry", "", "", 5.0, None, None)],
        "query_id int, occasion string, colour string, sweetness string, grape string, region string, alcohol_min double, alcohol_max double, exclude long",
    )
    catalog = parts(spark, sf_dir).select("entity", "blob", F.col("blob").alias("grapes"), "dishes", F.lit("").alias("region"), "alcohol", "rating", (F.col("p_size") % 2 == 0).alias("has_photo"), F.col("entity").alias("ord"))
    found = R.recommend(R.occasion_score(catalog, F.broadcast(requests)))
    return found.select("query_id", "entity", F.round("score", 3).alias("score"), F.col("rank").cast("int").alias("rank"), "found")


NOTES = "(" + " + ".join(f"CASE WHEN regexp_matches(blob, '{p}') THEN 1 ELSE 0 END" for p, _ in T.AROMAS) + ")"
TASTE = f"""t AS (SELECT *, CASE WHEN contains(blob, 'сладк') THEN 5 WHEN contains(blob, 'полуслад') THEN 3 WHEN contains(blob, 'полусух') THEN 2 ELSE 1 END AS sweetness,
 least(5, greatest(1, CASE WHEN contains(blob, 'белое') THEN 4 ELSE 3 END + CASE WHEN regexp_matches(blob, 'освеж|лимон|цитрус') THEN 1 ELSE 0 END)) AS acidity, least(5, greatest(1, 1 + least(4, greatest(1, least(6, {NOTES}))))) AS aromaticity,
 least(5, greatest(1, 3 - CASE WHEN regexp_matches(blob, 'игрист|брют') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(blob, 'красное|оранжевое') THEN 1 ELSE 0 END + CASE WHEN alcohol >= 13.5 THEN 1 ELSE 0 END - CASE WHEN alcohol > 0 AND alcohol <= 11 THEN 1 ELSE 0 END)) AS body FROM p)"""


def tasted(spark, sf_dir):
    rows = parts(spark, sf_dir)
    tone = F.when(F.col("blob").contains("красн"), "red").when(F.col("blob").contains("оранж"), "orange").when(F.col("blob").contains("розов"), "rose").otherwise("white")
    rows = rows.withColumn("notes", R.aromas(F.col("blob"), tone))
    for name, c in R.taste(F.col("blob"), F.col("notes"), F.col("alcohol")).items():
        rows = rows.withColumn(name, c)
    return rows


@query("taste_profile", f"WITH {PARTS}, {TASTE} SELECT entity, CAST(sweetness AS INTEGER) AS sweetness, CAST(acidity AS INTEGER) AS acidity, CAST(aromaticity AS INTEGER) AS aromaticity, CAST(body AS INTEGER) AS body FROM t")
def taste_profile(spark, sf_dir):
    return tasted(spark, sf_dir).select("entity", *R.DIMENSIONS)


RATED = "r AS (SELECT o_custkey AS \"user\", l_partkey AS entity, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rating FROM orders JOIN lineitem ON l_orderkey = o_orderkey), rt AS (SELECT r.*, sweetness, acidity, aromaticity, body FROM r JOIN t USING (entity))"
PREF = "pr AS (SELECT \"user\", " + ", ".join(f"sum(CASE WHEN rating >= 4 THEN {d} * rating END) / sum(CASE WHEN rating >= 4 THEN rating END) AS like_{d}, sum(CASE WHEN rating <= 2 THEN {d} * (6 - rating) END) / sum(CASE WHEN rating <= 2 THEN 6 - rating END) AS dislike_{d}" for d in R.DIMENSIONS) + ", count(CASE WHEN rating >= 4 THEN 1 END) AS likes, count(CASE WHEN rating <= 2 THEN 1 END) AS dislikes FROM rt GROUP BY 1)"


def rated(spark, sf_dir):
    """Lines of orders as ratings: the order's priority is the customer's rating of its parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rating"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("entity"))
    return orders.join(lines, "o_orderkey").select("user", "entity", "rating")


def preference_rows(spark, sf_dir):
    return R.preferences(rated(spark, sf_dir).join(tasted(spark, sf_dir).select("entity", *R.DIMENSIONS), "entity"), R.DIMENSIONS)


@query("preference_centroid", f"WITH {PARTS}, {TASTE}, {RATED}, {PREF} SELECT \"user\", " + ", ".join(f"round(like_{d}, 6) AS like_{d}, round(dislike_{d}, 6) AS dislike_{d}" for d in R.DIMENSIONS) + ", likes, dislikes FROM pr")
def preference_centroid(spark, sf_dir):
    return preference_rows(spark, sf_dir).select("user", *[F.round(f"{n}_{d}", 6).alias(f"{n}_{d}") for d in R.DIMENSIONS for n in ("like", "dislike")], "likes", "dislikes")


FAR = lambda n: "(" + " + ".join(f"abs({d} - {n}_{d}) / 4" for d in R.DIMENSIONS) + ") / 4"


@query(
    "fit_score",
    f"""WITH {PARTS}, {TASTE}, {RATED}, {PREF}, d AS (SELECT DISTINCT "user", entity FROM r) SELECT d."user", d.entity,
 CAST(greatest(0, least(100, floor(round(100 - {FAR('like')} * 100 - CASE WHEN dislike_body IS NOT NULL THEN (1 - {FAR('dislike')}) * 35 ELSE 0 END, 6) + 0.5))) AS INTEGER) AS fit FROM d JOIN t USING (entity) JOIN pr ON pr."user" = d."user" WHERE like_body IS NOT NULL""",
)
def fit_score(spark, sf_dir):
    """How each part a customer has bought fits the customer's taste."""
    bought = rated(spark, sf_dir).select("user", "entity").distinct()
    rows = bought.join(tasted(spark, sf_dir).select("entity", *R.DIMENSIONS), "entity").join(preference_rows(spark, sf_dir), "user")
    of = lambda n: {d: F.col(f"{n}_{d}") for d in R.DIMENSIONS}
    return rows.select("user", "entity", R.fit({d: F.col(d) for d in R.DIMENSIONS}, of("like"), of("dislike")).alias("fit")).where("fit IS NOT NULL")


@query(
    "compare_traits",
    "WITH a AS (SELECT p_partkey, p_name, p_retailprice, max(p_retailprice) OVER w AS t, min(p_retailprice) OVER w AS l, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_name)), b AS (SELECT *, count(*) FILTER (WHERE p_retailprice = t) OVER (PARTITION BY p_name) AS nt, count(*) FILTER (WHERE p_retailprice = l) OVER (PARTITION BY p_name) AS nl FROM a) SELECT p_partkey, CASE WHEN n > 1 AND p_retailprice = t AND nt = 1 THEN 'most' WHEN n > 1 AND p_retailprice = l AND nl = 1 THEN 'least' ELSE 'same' END AS trait FROM b",
)
def compare_traits(spark, sf_dir):
    return R.compare(table(spark, sf_dir, "part"), "p_retailprice", "p_name", "p_partkey").select("p_partkey", "trait")


@query("style_keys", f"WITH {PARTS} SELECT entity, CASE WHEN contains(blob, 'роз') THEN 'rose' WHEN contains(blob, 'оранж') THEN 'orange' WHEN contains(blob, 'красн') THEN 'red' WHEN contains(blob, 'бел') THEN 'white' ELSE 'unknown' END AS tone, CASE WHEN contains(blob, 'полусух') THEN 'Полусухое' WHEN contains(blob, 'полуслад') THEN 'Полусладкое' WHEN contains(blob, 'брют') THEN 'Брют' WHEN contains(blob, 'сух') THEN 'Сухое' WHEN contains(blob, 'сладк') THEN 'Сладкое' ELSE '' END AS sweetness FROM p")
def style_keys(spark, sf_dir):
    return parts(spark, sf_dir).select("entity", R.tone(F.col("blob"), F.lit("")).alias("tone"), R.display_sweetness(F.col("blob")).alias("sweetness"))


@query("aroma_notes")
def aroma_notes(spark, sf_dir):
    return tasted(spark, sf_dir).select("entity", "notes", R.swatch(F.col("blob")).alias("swatch"), X.plural(F.col("p_size"), "оценка", "оценки", "оценок").alias("ratings"))
