"""Recognised label lines as weighted words, line choice, markers and label-based promotion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlake.functions import tables as T
from matchlake.functions import text as X
from matchlake.operators import decide


def _mean(points: Column, axis: int) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.greatest(F.size(points), F.lit(1))


def words_of_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (query_id, text, score, box, width, height) with ``weight``; lines without a box go.

    Confidence, nearness to the middle (the edge keeps a fifth) and size of the letters.
    """
    ys = F.transform("box", lambda p: p[1])
    wide, high = F.greatest(F.lit(1.0), F.col("width").cast("double")), F.greatest(F.lit(1.0), F.col("height").cast("double"))
    middle = F.exp(-F.pow((_mean(F.col("box"), 0) / wide - 0.5) / 0.25, F.lit(2)))
    glyph = (F.array_max(ys) - F.array_min(ys)) / high
    weight = F.coalesce("score", F.lit(0.0)) * (0.2 + 0.8 * middle) * F.least(F.lit(1.0), 0.4 + glyph * 12)
    return lines.where(F.size("box") > 0).withColumn("weight", weight)


def on_label(lines: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> DataFrame:
    """Lines whose middle is on the padded label (shares of the frame)."""
    cx, cy = _mean(F.col("box"), 0) / F.greatest("width", F.lit(1)), _mean(F.col("box"), 1) / F.greatest("height", F.lit(1))
    return lines.where((F.size("box") > 0) & cx.between(left - 0.04, right + 0.04) & cy.between(top - 0.16, bottom + 0.03))


def card_documents(catalog: DataFrame) -> DataFrame:
    """(entity, text, weight) of each field of a card that tells who it is."""
    w = T.FIELD_WEIGHTS
    parts = {"name": F.col("name"), "winery": F.col("winery"), "grapes": F.array_join("grapes", " "), "slug": F.translate("slug", "-_", "  "), "style": F.concat_ws(" ", "category", "colour")}
    return catalog.select(F.col("slug").alias("entity"), F.explode(F.array(*[F.struct(F.coalesce(c, F.lit("")).alias("text"), F.lit(w[n]).alias("weight")) for n, c in parts.items()])).alias("d")).select("entity", "d.text", "d.weight")


def index_rows(documents: DataFrame) -> DataFrame:
    """(entity, token, weight) of (entity, text, weight): every spelling of every word."""
    words = documents.select("entity", "weight", F.explode(X.raw_words("text")).alias("raw"))
    return words.select("entity", F.explode(X.variants(F.col("raw"))).alias("token"), "weight")


def useful(tokens: Column) -> Column:
    """Tokens of three letters or more that are evidence."""
    return F.filter(tokens, lambda w: (F.length(w) >= 3) & ~w.isin(T.LABEL_STOP))


def has_evidence(tokens: Column) -> Column:
    return F.size(F.filter(useful(tokens), lambda w: w.rlike("[a-zа-я]"))) >= 2


def markers(name: Column, category: Column, grapes: Column) -> Column:
    """Words that can tell two bottles of a series apart."""
    words = X.tokens(F.concat_ws(" ", name, category, F.array_join(grapes, " ")))
    return F.array_union(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(T.LABEL_STOP)), F.array_intersect(words, F.array(*[F.lit(w) for w in T.SWEETNESS_MARKERS])))


def confusable_series(name: Column, slug: Column) -> Column:
    """Names of the series whose labels differ by one line; the exclusions come first."""
    n, s = X.normalize(name), X.normalize(F.translate(slug, "-", " "))
    out = X.contains_any(n, ["шишка"]) | s.contains("shishka")
    return ~out & (X.contains_any(n, ["красная стрелка", "velvet season", "вельвет сизон", "loco cimbali", "локо чимбали", "мезыб", "русское игристое"]) | s.startswith("loco cimbali"))


def best_line(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, line_no, hits): the line that names most wanted words; the first of equal ones, none without a hit.

    lines (query_id, line_no, words), wanted (query_id, words).
    """
    rows = lines.join(wanted.withColumnRenamed("words", "wanted"), "query_id").withColumn("hits", F.size(F.array_intersect("words", "wanted")))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("hits"), "line_no"))
    return rows.where("hits > 0").withColumn("_n", n).where("_n = 1").select("query_id", "line_no", "hits")


def telling_line(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """(query_id, line_no): the first line that names own markers of exactly one candidate; else the line under the shared title.

    lines (query_id, line_no, words, top, bottom), candidates (query_id, entity, markers); a
    query needs two candidates.
    """
    each = candidates.select("query_id", "entity", F.explode("markers").alias("word"))
    n = candidates.groupBy("query_id").agg(F.countDistinct("entity").alias("n")).where("n >= 2")
    owners = each.join(n, "query_id").groupBy("query_id", "word", "n").agg(F.countDistinct("entity").alias("owners"), F.first("entity").alias("entity"))
    words = lines.select("query_id", "line_no", "top", "bottom", F.explode("words").alias("word"))
    hit = words.join(owners, ["query_id", "word"])
    unique = hit.where("owners = 1").groupBy("query_id", "line_no").agg(F.countDistinct("entity").alias("named")).where("named = 1").groupBy("query_id").agg(F.min("line_no").alias("line_no"))
    titled = hit.where("owners = n").groupBy("query_id", "line_no", "bottom").agg(F.count("*").alias("shared"))
    title = titled.withColumn("_n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("shared"), "line_no"))).where("_n = 1").select("query_id", F.col("line_no").alias("title"), F.col("bottom").alias("edge"))
    below = lines.join(title, "query_id").where((F.col("line_no") != F.col("title")) & (F.col("top") >= F.col("edge") - 4)).groupBy("query_id").agg(F.min_by("line_no", F.struct("top", "line_no")).alias("line_no"))
    return unique.unionByName(below.join(unique, "query_id", "left_anti"))


def quad_crop(box: Column, width: Column, height: Column, pad: float = 0.2) -> Column:
    """Padded rectangle of a box of points, in whole pixels within the frame; null under 12 by 8."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    l, r, t, b = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    w, h = F.greatest(F.lit(1.0), r - l), F.greatest(F.lit(1.0), b - t)
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("int")
    out = F.array(F.greatest(F.lit(0), whole(l - w * pad)), F.greatest(F.lit(0), whole(t - h * pad)), F.least(width.cast("int"), whole(r + w * pad)), F.least(height.cast("int"), whole(b + h * pad)))
    return F.when((F.size(box) >= 2) & (out[2] - out[0] >= 12) & (out[3] - out[1] >= 8), out)


def visual_score(secondary: Column, fused: Column, *views: Column) -> Column:
    """The fused score where a second model took part, else the best view."""
    return F.when(secondary.isNotNull(), fused).otherwise(F.coalesce(F.greatest(*views, fused), F.lit(0.0)))


def blend(rows: DataFrame, delta: Column) -> DataFrame:
    """Visual score plus text bonus, kept in 0..1, ranked; a clear visual leader stays first."""
    rows = rows.withColumn("delta", F.round(delta, 4)).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("visual") + F.col("delta"))))
    return decide.lock_leader(rows, "visual", "delta")


def promote_by_line(ranked: DataFrame, line_scores: DataFrame, gap: float = T.DISTINCTIVE_GAP) -> DataFrame:
    """Put the close sibling first whose line photo matches best: .40 at least, and .04 over the leader's."""
    rows = ranked.join(line_scores, ["query_id", "entity"], "left")
    by = decide.by_query()
    lead = F.max(F.when(F.col("rank") == 1, F.col("visual"))).over(by)
    own = F.max(F.when(F.col("rank") == 1, F.col("line_score"))).over(by)
    ok = F.col("rank").between(2, 5) & (lead - F.col("visual") <= gap) & (F.col("line_score") >= T.GRAPE_LINE_SCORE) & (own.isNull() | (F.col("line_score") >= own + T.GRAPE_LINE_LEAD))
    rows = rows.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return decide.promote(rows, F.col("_ok"), F.col("line_score")).drop("_ok")


@F.pandas_udf(StructType().add("brightness", "double").add("saturation", "double").add("paper", "string"))
def paper_of(pixels: pd.Series) -> pd.DataFrame:
    """Brightness, saturation and kind of paper of RGB pixels given as a flat array of 0..255."""
    out = []
    for p in pixels:
        x = np.asarray(p, np.float32).reshape(-1, 3) / 255 if p is not None and len(p) else np.zeros((1, 3), np.float32)
        bright, sat = float(x.mean()), float((x.max(axis=1) - x.min(axis=1)).mean())
        out.append((round(bright, 4), round(sat, 4), "cream" if bright >= 0.55 and sat < 0.28 else "dark" if bright < 0.32 else "mixed"))
    return pd.DataFrame(out, columns=["brightness", "saturation", "paper"])
