"""Corpus pipeline: five stages over documents, each one operator of matchlake.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller may write it and
read it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm import langid, lines, mixing, queries, sentencepiece, simhash
from matchlake.llm._common import checkpointed, hidden, sized

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose lead of the first language over the next is smaller is rejected.
LEAST_LANGUAGE_SCORE = 0.02
#: Near copies: SimHash bits of five-word shingles that may differ, and the least share of shingles in common.
SHINGLE_WORDS, RADIUS, NEAR_SIMILARITY = 5, 12, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is told with a lead; texts without a letter go, and null texts."""
    profiles = langid.fit(docs)
    found = langid.with_language(docs, profiles)
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines that have a near copy earlier; a text that loses all its lines goes."""
    found = lines.dedup_lines(docs)
    text = F.col("kept")
    found = found.where((F.size("removed") == 0) | (F.trim(text) != ""))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("removed") == 0, F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies; of rows with one id, one.

    Near: SimHashes of five-word shingles at most RADIUS bits apart (all pairs are compared), and an exact Jaccard
    similarity of at least NEAR_SIMILARITY. At a Jaccard similarity of 0.8 a SimHash differs in
    9.7 bits on average (recall about 0.8), at 0.9 in 6.6 (0.98). Rows without an id cannot be told apart and
    stay, and so do texts without a word.
    """
    worded = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[^ \t-\r]")).select("doc_id", "text")
    groups = simhash.simhash_groups(worded, words=SHINGLE_WORDS, radius=RADIUS, similarity=NEAR_SIMILARITY)
    gone = checkpointed(groups.where("doc_id != component_id").select("doc_id").distinct())
    kept = docs.join(sized(gone, 24), "doc_id", "left_anti").select(*COLUMNS)
    twice = checkpointed(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return kept
    twice = sized(twice, 24)
    return kept.join(twice, "doc_id", "left_anti").unionByName(kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that domains have their target shares of tokens; a clean document is never left out."""
    labels = queries.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = mixing.mix(docs, labels, queries.MIX, keep="good")
    of, times, each = hidden(docs, "_mix_id", "_mix_copies", "_mix_each")
    changed = checkpointed(rated.where("copies != 1").select(F.col("doc_id").alias(of), F.col("copies").alias(times)))
    # a null id is a document as well
    joined = docs.join(sized(changed, 32), F.col("doc_id").eqNullSafe(F.col(of)), "left")
    return joined.withColumn(each, F.explode(F.array_repeat(F.lit(0), F.coalesce(times, F.lit(1))))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text that is left, with digests of the ids and of what they decode to."""
    found = sentencepiece.encode_decode(docs, queries.piece_model_path())
    return queries.piece_digests(found)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("encode", encode),
]

#: Stages that SQL cannot express: profiles, MinHash components, fitted rates and BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
