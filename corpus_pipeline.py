"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents, whatever they are.
Null texts count as empty (they fail the quality rules); an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import jaccard, packing, pii, quality, session, substrings


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays."""
    return jaccard.one_of_each(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat lose their bytes; a character that is cut in two goes whole. Every document stays.

    Broken bytes become U+FFFD and go; a U+FFFD that the text has itself waits as a character that stands for nothing (U+10FFFE) meanwhile.
    """
    removed, kept, spans = substrings.remove_repeats(docs)
    text, cut = F.col(kept).cast("string"), F.col(spans).isNotNull()
    own, waiting = F.lit("\ufffd"), F.lit("\U0010fffe")
    mended = F.replace(F.replace(F.make_valid_utf8(F.replace(text, own, waiting)), own, F.lit("")), waiting, own)
    whole = F.when(F.is_valid_utf8(text), text).otherwise(mended)
    fresh = removed.withColumn("text", F.when(cut, whole).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        fresh = fresh.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return fresh.select(*(F.col(f"`{c}`") for c in docs.columns))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences."""
    return packing.pack(docs).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids"
    )


STAGES = [
    ("quality rules", good_documents),
    ("n-gram Jaccard join", distinct_documents),
    ("suffix-array dedup", distinct_passages),
    ("personal data", without_personal_data),
    ("packing", packed),
]

#: Tokenisation, learned votes and retrieval order have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = session.cut(stage(spark, docs, sf_dir), name.split()[0])
    return docs
