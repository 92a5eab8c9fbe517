"""Rule-scored alternatives and occasions, taste profiles and fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from matchlake.functions import tables as T
from matchlake.functions import text as X

DIMENSIONS = ["sweetness", "acidity", "aromaticity", "body"]


def colour_key(blob: Column) -> Column:
    has = lambda *s: X.contains_any(blob, list(s))
    return F.when(has("розов"), "rose").when(has("оранж"), "orange").when(has("красн"), "red").when(has("бел"), "white").when(has("игрист", "brut", "брют", "шампан"), "sparkling").otherwise("unknown")


def sparkling(blob: Column) -> Column:
    return X.contains_any(blob, ["игрист", "brut", "брют", "шампан", "spumante"])


def sweetness_key(blob: Column) -> Column:
    has = lambda *s: X.contains_any(blob, list(s))
    return F.when(has("полуслад"), "semi_sweet").when(has("полусух"), "semi_dry").when(has("сладк"), "sweet").when(has("сух", "брют", "brut"), "dry").otherwise("unknown")


def tone(colour: Column, category_and_name: Column) -> Column:
    """The colour column decides, else category and name."""

    def of(blob: Column) -> Column:
        has = lambda *s: X.contains_any(blob, list(s))
        return F.when(has("роз", "rose"), "rose").when(has("оранж", "orange"), "orange").when(has("красн", "red"), "red").when(has("бел", "white"), "white")

    return F.coalesce(of(X.normalize(colour)), of(X.normalize(category_and_name)), F.lit("unknown"))


def has_photo(url: Column) -> Column:
    return F.coalesce(F.substring_index(F.split(url, r"[?#]")[0], "/", -1).rlike(r"(?i)_[0-9a-f]{8,}\.(webp|jpe?g|png)$"), F.lit(False))


def alternative_score(shared: Column, same_colour: Column, same_category: Column, other_region: Column, rating: Column) -> Column:
    return 3.0 * shared + F.when(same_colour, 2.0).otherwise(0.0) + F.when(same_category, 1.5).otherwise(0.0) + F.when(other_region, 0.4).otherwise(0.0) + F.coalesce(rating, F.lit(0.0)) / 10


def alternatives(pairs: DataFrame, k: int = 3, pool: int = 24) -> DataFrame:
    """Best ``k`` of (query_id, entity, score, has_photo, ord): those with a photo first among the best ``pool``; score over 0."""
    top = pairs.where("score > 0").withColumn("_p", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "ord"))).where(F.col("_p") <= pool)
    return top.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("has_photo"), "_p"))).where(F.col("rank") <= k).drop("_p")


def colour_score(actual: Column, is_sparkling: Column, wanted: Column, colours: Column) -> Column:
    any_colour = F.when(F.array_contains(colours, actual) | (is_sparkling & F.array_contains(colours, "sparkling")), 1.8).when((actual == "orange") & F.array_contains(colours, "white"), 0.8).otherwise(0.4)
    return (
        F.when(wanted == "sparkling", F.when(is_sparkling, 4.0).otherwise(0.7))
        .when(wanted == "white", F.when(actual == "white", F.when(is_sparkling, 4.4).otherwise(4.0)).when(actual == "orange", 1.6).otherwise(0.7))
        .when(wanted.isin("red", "rose"), F.when(actual == wanted, 4.0).otherwise(0.7)).otherwise(any_colour)
    )


def sweetness_score(actual: Column, wanted: Column, occasion: Column) -> Column:
    dessert = F.when(actual == "sweet", 3.4).when(actual == "semi_sweet", 3.0).when(actual == "semi_dry", 1.1).when(actual == "dry", 0.35).otherwise(0.6)
    return (
        F.when(wanted != "any", F.when(actual == wanted, 4.0).otherwise(0.8)).when(occasion == "dessert", dessert)
        .when((occasion == "meat") & (actual == "dry"), 1.1).when((occasion == "aperitif") & actual.isin("dry", "semi_dry", "unknown"), 0.6).otherwise(0.3)
    )


def occasion_score(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Every entity's score for each request.

    catalog (entity, blob, grapes, dishes, region, alcohol, rating, has_photo, ord; texts
    normalised), requests (query_id, occasion, colour, sweetness, grape, region,
    alcohol_min, alcohol_max, exclude). Requests are a handful of rows a user; they are joined as a
    broadcast side whose rows the caller bounds.
    """
    valid = lambda c, known: F.when(F.col(c).isin(known), F.col(c)).otherwise("any")
    r = requests.select("query_id", "occasion", valid("colour", T.VALID_COLOURS).alias("w_colour"), valid("sweetness", T.VALID_SWEETNESS).alias("w_sweet"), X.normalize("grape").alias("w_grape"), X.normalize("region").alias("w_region"), "alcohol_min", "alcohol_max", "exclude")
    rows = catalog.join(r, ~F.col("entity").eqNullSafe(F.col("exclude")))
    actual, spark_ling, sweet = colour_key(F.col("blob")), sparkling(F.col("blob")), sweetness_key(F.col("blob"))
    colours, dish = F.array().cast("array<string>"), F.lit(False)
    for name, (_, stems, own, _) in T.OCCASIONS.items():
        colours = F.when(F.col("occasion") == name, F.array(*[F.lit(c) for c in own])).otherwise(colours)
        dish = F.when(F.col("occasion") == name, X.contains_any(F.col("dishes"), stems)).otherwise(dish)
    light, heavy = X.contains_any(F.col("grapes"), T.LIGHT_RED), X.contains_any(F.col("grapes"), T.HEAVY_RED)
    red = actual == "red"
    grape = F.when((F.col("occasion") == "fish") & red, F.when(light, 2.4).when(heavy, 0.35).otherwise(0.9)).when((F.col("occasion") == "meat") & red & heavy, 0.8).otherwise(0.0)
    wanted = lambda want, have, yes: F.when(F.col(want) != "", F.when(F.col(have).contains(F.col(want)), yes).otherwise(0.2)).otherwise(0.0)
    bounded = F.col("alcohol_min").isNotNull() | F.col("alcohol_max").isNotNull()
    inside = F.col("alcohol").isNotNull() & (F.coalesce(F.col("alcohol") >= F.col("alcohol_min"), F.lit(True))) & (F.coalesce(F.col("alcohol") <= F.col("alcohol_max"), F.lit(True)))
    score = (
        F.when(dish, 3.6).otherwise(0.0) + colour_score(actual, spark_ling, F.col("w_colour"), colours) + sweetness_score(sweet, F.col("w_sweet"), F.col("occasion")) + grape
        + wanted("w_grape", "grapes", 2.2) + wanted("w_region", "region", 2.0) + F.when(bounded, F.when(inside, 1.6).otherwise(0.15)).otherwise(0.0)
        + F.coalesce(F.least(F.col("rating"), F.lit(5.0)) / 8, F.lit(0.0))
    )
    return rows.withColumn("score", F.round(score, 6))


def recommend(scored: DataFrame, k: int = 8) -> DataFrame:
    """The best ``k`` of each request with found: how many come near the best (at least those returned, at most 48)."""
    rows = scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("has_photo"), "ord")))
    top = rows.groupBy("query_id").agg(F.max("score").alias("_top"))
    near = rows.join(top, "query_id").groupBy("query_id").agg(F.sum((F.col("score") >= F.col("_top") * 0.82).cast("int")).alias("_close"), F.count("*").alias("_n"))
    found = F.greatest(F.least(F.col("_n"), F.lit(k)), F.least(F.col("_close"), F.lit(48)))
    return rows.where(F.col("rank") <= k).join(near, "query_id").withColumn("found", found.cast("long")).drop("_close", "_n")


def aromas(text: Column, tone_of: Column) -> Column:
    """At most six notes whose pattern the text holds, in the table's order; none: the tone's default."""
    notes = F.slice(F.array_compact(F.array(*[F.when(text.rlike(p), n) for p, n in T.AROMAS])), 1, 6)
    default = F.lit(T.DEFAULT_AROMA["white"])
    for t in ("red", "orange", "rose"):
        default = F.when(tone_of == t, T.DEFAULT_AROMA[t]).otherwise(default)
    return F.when(F.size(notes) > 0, notes).otherwise(F.array(default))


def display_colour(text: Column) -> Column:
    has = lambda s: text.contains(s)
    return F.when(has("красн"), "Красное").when(has("оранж"), "Оранжевое").when(has("розов"), "Розовое").when(has("бел"), "Белое").otherwise("")


def display_sweetness(text: Column) -> Column:
    has = lambda s: text.contains(s)
    return F.when(has("полусух"), "Полусухое").when(has("полуслад"), "Полусладкое").when(has("брют"), "Брют").when(has("сух"), "Сухое").when(has("сладк"), "Сладкое").otherwise("")


def swatch(text: Column) -> Column:
    """The pair of colours of the pattern that occurs first in the text, earlier patterns on a tie."""
    at = [F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(i).alias("no"), F.array(F.lit(a), F.lit(b)).alias("tones")) for i, (p, a, b) in enumerate(T.SWATCHES)]
    return F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0))["tones"]


def taste(text: Column, notes: Column, alcohol: Column) -> dict[str, Column]:
    """Four dimensions from 1 to 5; the longer sweet word is tested first, so semi-sweet counts as sweet."""
    clamp = lambda x: F.least(F.greatest(F.floor(x + 0.5).cast("int"), F.lit(1)), F.lit(5))
    alcohol = F.coalesce(alcohol, F.lit(0.0))
    one = lambda pattern, by: F.when(text.rlike(pattern), by).otherwise(0)
    return {
        "sweetness": clamp(F.when(text.contains("сладк"), 5).when(text.contains("полуслад"), 3).when(text.contains("полусух"), 2).otherwise(1)),
        "acidity": clamp(F.when(text.contains("белое"), 4).otherwise(3) + one("освеж|ярк.*кислот|высок.*кислот|лимон|цитрус|грейпфрут", 1) - one("мягк|округл|сливоч|низк.*кислот", 1)),
        "aromaticity": clamp(1 + F.least(F.lit(4), F.size(notes)) + one("яркий аромат|насыщен|интенсив", 1)),
        "body": clamp(3 - one("игрист|брют", 1) + one("красное|оранжевое|плотн|полнот|маслян|сливоч", 1) + F.when(alcohol >= 13.5, 1).otherwise(0) - F.when((alcohol > 0) & (alcohol <= 11), 1).otherwise(0)),
    }


def preferences(rated: DataFrame, dimensions: list[str]) -> DataFrame:
    """(user, like_<d>.., dislike_<d>.., likes, dislikes): weighted centres of what was rated 4 or 5, and 1 or 2."""
    like, dislike = F.col("rating") >= 4, F.col("rating") <= 2
    lw, dw = F.when(like, F.col("rating")), F.when(dislike, 6 - F.col("rating"))
    cols = [(F.sum(F.col(d) * w) / F.sum(w)).alias(f"{n}_{d}") for n, w in (("like", lw), ("dislike", dw)) for d in dimensions]
    return rated.where(F.col("rating").between(1, 5)).groupBy("user").agg(*cols, F.count(F.when(like, 1)).alias("likes"), F.count(F.when(dislike, 1)).alias("dislikes"))


def fit(profile: dict[str, Column], like: dict[str, Column], dislike: dict[str, Column]) -> Column:
    """0 to 100: nearness to what is liked, less nearness to what is disliked; null without likes."""
    far = lambda other: sum((F.abs(profile[d] - other[d]) / 4 for d in profile), F.lit(0.0)) / len(profile)
    some = next(iter(dislike.values())).isNotNull()
    score = 100 - far(like) * 100 - F.when(some, (1 - far(dislike)) * 35).otherwise(0.0)
    return F.when(next(iter(like.values())).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.round(score, 6) + 0.5).cast("int"))))


def compare(rows: DataFrame, value: str, group: str, key: str) -> DataFrame:
    """Whether each member's value is over all others', under all others', or neither."""
    by = W.partitionBy(group)
    top, low = F.max(value).over(by), F.min(value).over(by)
    n_top, n_low = F.sum((F.col(value) == F.col("_t")).cast("int")).over(by), F.sum((F.col(value) == F.col("_l")).cast("int")).over(by)
    rows = rows.withColumn("_t", top).withColumn("_l", low)
    rows = rows.withColumn("_nt", n_top).withColumn("_nl", n_low).withColumn("_n", F.count("*").over(by))
    place = F.when((F.col("_n") > 1) & (F.col(value) == F.col("_t")) & (F.col("_nt") == 1), "most").when((F.col("_n") > 1) & (F.col(value) == F.col("_l")) & (F.col("_nl") == 1), "least").otherwise("same")
    return rows.withColumn("trait", place).drop("_t", "_l", "_nt", "_nl", "_n")
