"""Weighted text search over long tables: postings, document frequencies, norms, styles."""

from __future__ import annotations

import difflib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from matchlake.functions import tables as T
from matchlake.functions import text as X

#: Tokens of more letters are found by their thirds instead of what is left of them without letters.
LONG_TOKEN = 15


@dataclass
class TextIndex:
    """fields (entity, token, weight), idf (token, df, idf), norms (entity, norm)."""

    fields: DataFrame
    idf: DataFrame
    norms: DataFrame


def build_index(weighted: DataFrame) -> TextIndex:
    """Index of (entity, token, weight) rows: the greatest weight of each token of an entity.

    Smoothed inverse document frequency ln((N + 1) / (df + 1)) + 1. A norm leaves out
    tokens of digits.
    """
    fields = weighted.groupBy("entity", "token").agg(F.max("weight").alias("weight"))
    # the number of entities is one row, joined to each token
    n = fields.agg(F.countDistinct("entity").alias("n"))
    df = fields.groupBy("token").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n)).select("token", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    value = F.sum(F.when(~F.col("token").rlike("^[0-9]+$"), F.col("weight") * F.col("idf")))
    norms = fields.join(idf, "token").groupBy("entity").agg(F.coalesce(value, F.lit(0.0)).alias("norm"))
    return TextIndex(fields, idf, norms)


def resolve(words: DataFrame, idf: DataFrame) -> DataFrame:
    """(word, token, factor): each distinct word's dictionary tokens.

    The word itself; else the nearest token within one edit (two from seven letters), ties to
    the smaller idf and token; else the first cut into two tokens. Candidates come from an
    equi-join on what is left of both sides without a letter or two, for tokens of more than LONG_TOKEN letters
    on their thirds, so keys grow with a word's length alone and no pair of a word and a
    token that share nothing is looked at.
    """
    exact = words.join(idf.select(F.col("token").alias("word")), "word").select("word", F.col("word").alias("token"), F.lit(T.EXACT).alias("factor"))
    missing = words.join(idf.select(F.col("token").alias("word")), "word", "left_anti")
    long = missing.where((F.length("word") >= 4) & ~F.col("word").rlike("^[0-9]+$")).withColumn("limit", F.when(F.length("word") <= 6, 1).otherwise(2))
    keys = lambda c: F.when(F.length(c) > LONG_TOKEN + 2, F.array().cast("array<string>")).when(F.length(c) <= 5, X.deletes(F.col(c), 1)).otherwise(X.deletes(F.col(c), 2))
    probes = F.when(F.length("word") >= LONG_TOKEN - 1, X.piece_probes(F.col("word"), LONG_TOKEN + 1)).otherwise(F.array().cast("array<string>"))
    left = long.select("word", "limit", F.explode(F.concat(keys("word"), probes)).alias("key"))
    right = idf.where(F.length("token") >= 3).select("token", "idf", F.explode(F.when(F.length("token") > LONG_TOKEN, X.piece_keys(F.col("token"))).otherwise(keys("token"))).alias("key"))
    pairs = left.join(right, "key").select("word", "limit", "token", "idf").distinct()
    near = pairs.withColumn("d", F.expr("levenshtein(word, token, 2)")).where((F.col("d") >= 0) & (F.col("d") <= F.col("limit")))
    best = near.withColumn("_n", F.row_number().over(W.partitionBy("word").orderBy("d", "idf", "token"))).where("_n = 1")
    fuzzy = best.select("word", "token", F.lit(T.FUZZY).alias("factor"))
    rest = long.join(best.select("word"), "word", "left_anti").where(F.length("word") >= 6)
    cut = rest.select("word", F.explode(F.sequence(F.lit(3), F.length("word") - 3)).alias("cut"))
    cut = cut.select("word", "cut", F.expr("substring(word, 1, cut)").alias("a"), F.expr("substring(word, cut + 1)").alias("b"))
    known = idf.select("token")
    cut = cut.join(known.withColumnRenamed("token", "a"), "a", "left_semi").join(known.withColumnRenamed("token", "b"), "b", "left_semi")
    cut = cut.groupBy("word").agg(F.min_by(F.array("a", "b"), "cut").alias("parts"))
    glued = cut.select("word", F.explode("parts").alias("token"), F.lit(T.GLUED).alias("factor"))
    return exact.unionByName(fuzzy).unionByName(glued)


def contributions(words: DataFrame, index: TextIndex, resolved: DataFrame | None = None) -> DataFrame:
    """(query_id, entity, word, value) of (query_id, word, weight): a word's best value for each entity."""
    if resolved is None:
        resolved = words.select("word", F.col("word").alias("token"), F.lit(1.0).alias("factor")).distinct()
    found = words.groupBy("query_id", "word").agg(F.max("weight").alias("w")).join(resolved, "word")
    found = found.join(index.idf, "token").join(index.fields, "token")
    # the two parts of a glued word count as words of their own
    word = F.when(F.col("factor") == T.GLUED, F.concat("word", F.lit("#"), "token")).otherwise(F.col("word"))
    return found.groupBy("query_id", "entity", word.alias("word")).agg(F.max(F.col("weight") * F.col("idf") * F.col("w") * F.col("factor")).alias("value"))


def evidence(contributed: DataFrame, index: TextIndex) -> DataFrame:
    """(query_id, entity, score, coverage): summed values, and their share of the entity's norm, at most 1."""
    total = contributed.groupBy("query_id", "entity").agg(F.sum("value").alias("score"))
    return total.join(index.norms, "entity").select("query_id", "entity", "score", F.least(F.lit(1.0), F.col("score") / F.greatest("norm", F.lit(1e-6))).alias("coverage"))


def contradiction(contributed: DataFrame, groups: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, entity, contradiction): what rivals of the same group explain and the entity does not.

    groups (entity, group): a null or empty group has no rivals. Each word counts with its
    greatest value among the rivals.
    """
    own = candidates.select("query_id", "entity").distinct().join(groups.where((F.col("group").isNotNull()) & (F.col("group") != "")), "entity")
    told = contributed.join(own, ["query_id", "entity"]).select("query_id", "group", F.col("entity").alias("rival"), "word", "value")
    best = told.groupBy("query_id", "group", "word").agg(F.max("value").alias("value"))
    # a word that the entity itself has is no contradiction, so the greatest over all of the group is that over the rivals
    missing = own.join(best, ["query_id", "group"]).join(contributed.select("query_id", "entity", "word"), ["query_id", "entity", "word"], "left_anti")
    total = missing.groupBy("query_id", "entity").agg(F.sum("value").alias("contradiction"))
    return candidates.select("query_id", "entity").distinct().join(total, ["query_id", "entity"], "left").na.fill(0.0, ["contradiction"])


def style_votes(votes: DataFrame, least: float = 0.2) -> DataFrame:
    """(query_id, group, style) of (query_id, group, style, weight, ord): the heaviest style, ties to the first seen."""
    total = votes.groupBy("query_id", "group", "style").agg(F.sum("weight").alias("weight"), F.min("ord").alias("ord"))
    n = F.row_number().over(W.partitionBy("query_id", "group").orderBy(F.desc("weight"), "ord", "style"))
    return total.withColumn("_n", n).where((F.col("_n") == 1) & (F.col("weight") >= least)).select("query_id", "group", "style", "weight")


def search(queries: DataFrame, catalog: DataFrame, limit: int = 20, floor: float = T.SEARCH_FLOOR, ratio: Column | None = None) -> DataFrame:
    """(query_id, entity, overlap, ratio, score, rank) of (query_id, text) in (entity, text).

    Three quarters token overlap, one quarter sequence ratio, at most 1; the best ``limit``
    of each query, and of these what reaches ``floor``. Entities that share a token
    with the query are found by an equi-join. A query that shares none with any can reach no floor of 0.25 or
    more; for a lower floor it meets all entities.
    """
    q = queries.select("query_id", X.normalize("text").alias("q_text"), X.tokens("text").alias("q_tokens"))
    c = catalog.select("entity", X.normalize("text").alias("c_text"), X.tokens("text").alias("c_tokens"))
    shared = q.select("query_id", F.explode("q_tokens").alias("token")).join(c.select("entity", F.explode("c_tokens").alias("token")), "token").groupBy("query_id", "entity").agg(F.count("*").alias("shared"))
    hit = shared.join(q, "query_id").join(c, "entity")
    columns = [*q.columns, *[c_ for c_ in c.columns if c_ not in q.columns], "shared"]
    rows = hit.select(*columns)
    if floor < 0.25:  # without a shared token, only a quarter of the ratio is left, and equal texts share one
        lost = q.join(shared.select("query_id").distinct(), "query_id", "left_anti").where(F.size("q_tokens") > 0)
        rows = rows.unionByName(lost.crossJoin(c).withColumn("shared", F.lit(0).cast("long")))
    rows = rows.withColumn("overlap", F.col("shared") / F.size("q_tokens"))
    rows = rows.withColumn("ratio", X.sequence_ratio("q_text", "c_text") if ratio is None else ratio)
    rows = rows.withColumn("score", F.round(F.least(F.lit(1.0), 0.75 * F.col("overlap") + 0.25 * F.col("ratio")), 6))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "entity"))
    return rows.withColumn("rank", n).where(F.col("rank") <= limit).where(F.col("score") >= floor).select("query_id", "entity", "overlap", "ratio", "score", "rank")


@F.pandas_udf(DoubleType())
def _ocr_delta(seen: pd.Series, known: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(seen, known):
        useful, catalog = {str(w) for w in (a if a is not None else ()) if len(w) >= 3}, {str(w) for w in (b if b is not None else ()) if len(w) >= 3}
        long = [w for w in catalog if len(w) >= 6 and w.isalpha()]
        near = lambda w: len(w) >= 6 and w.isalpha() and any(difflib.SequenceMatcher(None, w, t).ratio() >= T.FUZZY_RATIO for t in long)  # noqa: B023, E731
        matched = {w for w in useful if w in catalog or near(w)}
        enough = len(useful) >= 2 and catalog and sum(w.isalpha() for w in matched) >= 2
        out.append(round(min(T.OCR_WEIGHT, len(matched) / min(8, len(useful)) * T.OCR_WEIGHT), 4) if enough else 0.0)
    return pd.Series(out, dtype=float)


def ocr_delta(seen: Column, known: Column) -> Column:
    """Bonus of at most .12 for the share of useful words that the entity's words explain (arrays of tokens without stop words)."""
    return _ocr_delta(seen, known)
