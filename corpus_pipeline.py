"""Corpus preparation: five stages over ``documents``, each written and read again as the next one's input.

Every stage moves whole texts through Python, so each bounds the Arrow batches by bytes: executors hold several batches at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinthwork.functions.storage import cut, in_small_batches, table
from plinthwork.llm import mixing, pieces, repeats, simhash, toxicity

#: SQL cannot express hashing, byte-level indexes, sampling or tokenizers; tests/llm holds brute-force versions.
ORACLE_SQL = None


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar does not reject."""
    docs = in_small_batches(docs)
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rest = tuple(c for c in docs.columns if c != "doc_id")
    return toxicity.score_documents(docs, grammar, keep=rest).where("predicted = 0").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.one_of_each_group(in_small_batches(docs))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 256 bytes (some 40 words) or more that occur more than once; emptied ones stay, with an empty text."""
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = repeats.remove_repeats(in_small_batches(docs), keep=rest, length=repeats.PASSAGE, with_text=True)
    return left.select("doc_id", F.col("kept").alias("text"), *rest, F.length("kept").cast("long").alias("n_chars")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the sources' target weights, each as often as it is taken."""
    return mixing.mixed_documents(in_small_batches(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return pieces.encode_documents(in_small_batches(docs), tokenizer_path(), keep=("doc_id", "lang", "source"), with_ids=True)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("repeats", cut_repeats), ("mixing", mix_sources), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
