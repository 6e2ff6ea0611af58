"""The registered queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagemill.llm import bpe, chat, ctw, decontamination, fingerprint, orchard, packing, pii, quality, resampling, sharding, simhash, toxicity
from passagemill.llm.common import spread, table


def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return simhash.groups(docs)


def op3_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of all documents under a model of the trusted ones, and whether they are kept."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded with the 50k byte-level vocabulary."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_permutation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents placed in 1,024 shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sharding.place(docs, "doc_id", [f"shard-{i:04d}" for i in range(1024)])


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    words = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", words), (-7, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_turns(talks.withColumn("parts", chat.text_part(F.col("text")))))


def op7_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


def op8_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under the context trees of the training ones."""
    return ctw.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labelled ones."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of 2,048 tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark's words, a tenth of them drawn."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark"))


def op13_orchard_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 16 clusters after three rounds."""
    return orchard.cluster(spread(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id"))


QUERIES = {f.__name__: f for f in (op1_prefix_fingerprints, op2_simhash_golay, op3_kneser_ney_quality, op4_byte_bpe, op5_permutation_sharding, op6_chat_formatting, op7_weak_pii, op8_context_tree_scores, op9_toxicity_chain, op10_decontamination, op11_best_fit_packing, op12_importance_resampling, op13_orchard_clustering)}

SQL: dict[str, str] = {"op10_decontamination": decontamination.SQL, "op12_importance_resampling": resampling.SQL, "op13_orchard_clustering": orchard.sql()}
