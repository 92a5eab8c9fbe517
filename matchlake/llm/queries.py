"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import ann, gru, langid, lines, mixing, nndescent, paragraphs, sentencepiece, simhash, suffixes
from matchlake.llm._common import crc_remainder

#: File of the public tokenizers package that op2 encodes with.
PIECE_MODEL = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model_path() -> str:
    import public_tokenizers  # noqa: PLC0415

    return public_tokenizers.path(PIECE_MODEL)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece.encode_decode(table(spark, sf_dir, "documents"), piece_model_path())
    return piece_digests(found)


def piece_digests(found: DataFrame) -> DataFrame:
    joined = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    profiles = langid.fit(docs.where(~held))
    return langid.predict(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: Shares of all tokens that op1 mixes to, by the domain that `labels` gives a document. Where more is good
#: already, that share stays; a clean document's rate is 1 or more at every mix, so it is kept. So little of the other
#: domains is asked for that rates come to zero.
MIX = {"good": 0.99, "low": 0.007, "toxic": 0.003}


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a labels table: toxic before all, else by quality; nothing known: no domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), MIX, keep="good")


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.dedup_paragraphs(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return found.select("doc_id", n.cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98).withColumnRenamed("id", "vec_id")


def op9_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(crc_remainder("doc_id", 5) == 1, F.lit(False))
    found = gru.score_documents(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.dedup_substrings(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_paragraphs": op3_paragraphs,
    "op4_neighbours": op4_neighbours,
    "op5_simhash": op5_simhash,
    "op6_language": op6_language,
    "op7_lines": op7_lines,
    "op8_embeddings": op8_embeddings,
    "op9_gru": op9_gru,
    "op10_suffixes": op10_suffixes,
}
ORACLE: dict[str, str] = {}
