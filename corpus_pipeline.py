"""A training-corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the encoded
documents. A document is a row; a stage leaves out rows or rewrites texts, and adds none.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareflow.llm import bpe, decontam, langid, line_dedup, queries, simhash
from fareflow.llm.common import shared_dir, unused, written

#: Below this probability, the language is not known well enough.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go: no text, no letter, or a score below LEAST_SCORE."""
    pred, score = unused(docs, "pred", "score")
    found = langid.predict(docs, queries.language_model(docs), pred=pred, score=score)
    return found.where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go; n_chars follows. Documents of which no line stays go, too."""
    found = line_dedup.deduplicated(docs)
    emptied = (F.col("_n_dropped") > 0) & ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return found.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one of smallest doc_id; of rows that share that id, the one of least text hash,
    and of rows with the same text, the one of least hash over all columns.

    Rows without an id come last, so one stays for each component that has no id at all. An id that several components
    have keeps a row in each that it names.
    """
    # fingerprints are made once; from here on, only ids, hashes and roots are joined until the kept rows are known
    own, other = unused(docs, "id", "h")
    found = simhash.near_duplicates(docs, roots=True)
    named = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own), F.col("h").alias(other), "root")
    stays = written(named.groupBy("root").agg(F.min(own).alias(own), F.min(other).alias(other)).drop("root"), "stays")

    def at(keys: DataFrame):
        return docs["doc_id"].eqNullSafe(keys[own]) & (F.xxhash64(docs["text"]) == keys[other])

    # only equal rows need a choice now, so only they are shuffled again
    several = written(named.groupBy(own, other).count().where("count > 1").select(own, other), "several")
    once = docs.join(stays, at(stays), "left_semi").join(several, at(several), "left_anti")
    again = docs.join(stays, at(stays), "left_semi").join(several, at(several), "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    chosen = again.groupBy("doc_id", F.xxhash64("text").alias(other)).agg(F.min_by(row, F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias(own)).select(f"{own}.*")
    return once.unionByName(chosen).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    items = queries.table(spark, sf_dir, "benchmark")
    own, other = unused(docs, "id", "h")
    bad = decontam.contamination(docs, items).where("contaminated").select(F.col("doc_id").alias(own), F.col("h").alias(other)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[own]) & (F.xxhash64(docs["text"]) == bad[other]), "left_anti")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, and whether they decode to the text."""
    ids = bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN, keep=("doc_id", "text"), decoded="decoded")
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return ids.select("doc_id", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("line_deduplication", line_deduplication),
    ("near_deduplication", near_deduplication),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Language identification is learned, so SQL can't express the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = queries.table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
