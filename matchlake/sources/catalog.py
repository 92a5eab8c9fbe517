"""Readers and writers of catalogues, vectors, pages and images."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.functions import text as X
from matchlake.operators.feed import latest

#: Columns of a card after coercion.
CARD = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("slug", "name", "winery", "category", "region", "description", "image_name", "image_url", "source_url", "colour", "temperature", "alcohol")],
        T.StructField("public_rating", T.DoubleType()), T.StructField("quality_rating", T.DoubleType()), T.StructField("grapes", T.ArrayType(T.StringType())), T.StructField("dishes", T.ArrayType(T.StringType())),
    ]
)
#: Raw column names by field; the enriched name first, it wins.
RAW = {
    "slug": ["Slug"], "name": ["Название вина"], "winery": ["Винодельня"], "category": ["svoe_vino_category", "Категория"], "region": ["svoe_vino_region", "Регион"],
    "description": ["svoe_vino_description", "Описание"], "image_name": ["Название фото"], "image_url": ["svoe_vino_image_url"], "source_url": ["svoe_vino_source_url"],
    "colour": ["svoe_vino_color"], "temperature": ["svoe_vino_temperature"], "alcohol": ["svoe_vino_alcohol"], "public_rating": ["svoe_vino_public_rating"],
    "quality_rating": ["svoe_vino_quality_rating"], "grapes": ["svoe_vino_grapes", "Сорт винограда"], "dishes": ["svoe_vino_dishes_json"],
}
NULLABLE = {"image_url", "source_url"}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, header row, quoted line breaks; a byte-order mark on the first name is dropped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or one under data or wines, with or without an attributes level."""
    rows = spark.read.option("multiLine", True).json(path)
    for wrap in ("data", "wines"):
        if wrap in rows.columns and isinstance(rows.schema[wrap].dataType, T.ArrayType):
            rows = rows.select(F.explode(wrap).alias("_")).select("_.*")
    if "attributes" in rows.columns and isinstance(rows.schema["attributes"].dataType, T.StructType):
        inner = rows.schema["attributes"].dataType.names
        rows = rows.select(*[c for c in rows.columns if c != "attributes" and c not in inner], "attributes.*")
    text = lambda f: F.to_json(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`").cast("string")
    return rows.select(*[text(f).alias(f.name) for f in rows.schema])


def cards(rows: DataFrame) -> DataFrame:
    """Typed cards, one a slug: the first row wins, rows without a slug or a name go.

    Missing text is empty, missing ratings and addresses are null. Names may be raw or
    those of the fields. The order of rows is that of the file.
    """

    def own(field: str) -> Column:
        names = [c for c in [*RAW[field], field, "color" if field == "colour" else field] if c in rows.columns]
        return F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in dict.fromkeys(names)], F.lit(None).cast("string"))

    picked = {}
    for f in CARD:
        if isinstance(f.dataType, T.DoubleType):
            picked[f.name] = X.optional_number(own(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            picked[f.name] = X.json_list(own(f.name))
        else:
            picked[f.name] = own(f.name) if f.name in NULLABLE else F.coalesce(own(f.name), F.lit(""))
    typed = rows.withColumn("_ord", F.monotonically_increasing_id()).select("_ord", *[c.alias(n) for n, c in picked.items()])
    return latest(typed.where((F.col("slug") != "") & (F.col("name") != "")), ["slug"], [F.col("_ord")]).withColumnRenamed("_ord", "ord")


def load(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a CSV or JSON file; a file without a usable row is an error."""
    found = cards(read_csv(spark, path) if path.lower().endswith(".csv") else read_json(spark, path))
    if found.isEmpty():
        raise ValueError(f"no usable row in {path}")
    return found


def from_json_cards(rows: DataFrame, column: str = "card") -> DataFrame:
    """Cards kept as JSON text; unknown keys are dropped."""
    return rows.select(F.from_json(F.col(column), CARD).alias("c")).select("c.*").orderBy("slug")


def card(catalog: DataFrame, slug: str) -> DataFrame:
    return catalog.where(F.col("slug") == slug)


def select_slugs(catalog: DataFrame, only: list[str] | None = None, prefix: str | None = None, skip: list[str] | None = None) -> DataFrame:
    if only:
        catalog = catalog.where(F.col("slug").isin(only))
    if prefix:
        catalog = catalog.where(F.col("slug").startswith(prefix))
    return catalog.where(~F.col("slug").isin(skip)) if skip else catalog


def read_images(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "heic", "avif"), most_bytes: int = 24 << 20) -> DataFrame:
    """(path, name, content, digest, mime) of image files up to a size, in all folders below."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= most_bytes)
    rows = rows.where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), "content", F.sha2("content", 256).alias("digest"), X.mime_type(F.col("content")).alias("mime"))


def view_digest(kind: str, digest: Column) -> Column:
    """Key of a derived view (crop, grape line) of an image."""
    return F.sha2(F.concat(F.lit(f"{kind}:"), digest), 256)


def duplicate_free(images: DataFrame, key: str = "digest") -> DataFrame:
    """Images whose digest occurs once."""
    once = images.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return images.join(once, key, "left_semi")


def split_bucket(key: Column, seed: str, n: int = 10) -> Column:
    """Deterministic bucket 0..n-1 of a key, the same wherever it is computed."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def script_json(html: Column, marker: str = "application/json") -> Column:
    """Text of the first script element of a type."""
    return F.nullif(F.regexp_extract(html, rf'(?s)<script[^>]*{marker}[^>]*>(.*?)</script>', 1), F.lit(""))


def references(rows: DataFrame, version: str) -> DataFrame:
    """Recognised reference texts of one pipeline version that are not blank."""
    return rows.where((F.col("version") == version) & (F.col("status") == "ok") & (F.trim("text") != ""))


def load_weights(path: str, names: list[str]) -> dict[str, float]:
    """Ranker weights of a JSON file; another feature list is an error."""
    with open(path) as f:
        found = json.load(f)
    if list(found["features"]) != list(names):
        raise ValueError("the weights are for other features")
    return dict(zip(names, found["weights"]))


def append_lines(rows: DataFrame, path: str, keys: list[str]) -> int:
    """Append to JSON lines what they do not hold yet; returns how many rows that was."""
    spark = rows.sparkSession
    try:
        have = spark.read.json(path).select(*keys)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        have = rows.select(*keys).limit(0)
    seen = Observation()
    rows.join(have, keys, "left_anti").observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]
