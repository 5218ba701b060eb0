"""The registered queries of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareflow.llm import bpe, chat, chunk_dedup, decontam, divergence, embed_dedup, langid, license_scan, line_dedup, pieces, simhash, spelling, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def language_model(docs: DataFrame) -> langid.Network | None:
    return langid.fit(docs.where(~F.coalesce(held_out(), F.lit(False))))


def language_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def simhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def embedding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the probe stays a conversation of its own, also where the table has one of its id
    both = chat.conversations(table(spark, sf_dir, "conversations")).unionByName(chat.conversations(chat.probe(spark)))
    return chat.digests(chat.formatted(both, back=chat.BACK))


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.write(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)
    return token_files.read(spark, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def chunk_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = chunk_dedup.annotated(docs)
    return found.select("doc_id", F.col("_repeated").alias("repeated_bytes"), F.col("_removed").alias("removed_bytes"), F.col("_spans").alias("removed_spans"))


def license_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.matches(table(spark, sf_dir, "documents"))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, decoded="decoded")
    return ids.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def pieces_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = pieces.encode(table(spark, sf_dir, "documents"), PIECES, decoded="decoded")
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def spelling_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"))
    return spelling.variants(words.where("length(word) >= 5 and n >= 3"))


def divergence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries():
    return {
        "op1_language_id": language_id_query,
        "op2_simhash": simhash_query,
        "op3_decontamination": decontamination_query,
        "op4_embedding_dedup": embedding_query,
        "op5_line_dedup": line_dedup_query,
        "op6_chat_format": chat_query,
        "op7_token_files": token_files_query,
        "op8_chunk_dedup": chunk_dedup_query,
        "op9_license_scan": license_query,
        "op10_bpe": bpe_query,
        "op11_pieces": pieces_query,
        "op12_spelling": spelling_query,
        "op13_divergence": divergence_query,
    }


def oracle_sql():
    return {"op3_decontamination": decontam.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op9_license_scan": license_scan.oracle(), "op13_divergence": divergence.ORACLE}
