"""Registered queries of the training-data operators: thin digests over the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from plinthwork.functions.storage import table
from plinthwork.llm import attention, chat, divergence, media, mixing, passages, periods, pieces, repeats, simhash, toxicity, urls, vectors


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of all documents with the smallest id of the group; ties, nulls and repeats as in :func:`simhash.simhash_components`."""
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all texts stored as images and read back; a null text is an empty one, repeated rows stay."""
    read = media.read_media(media.store_texts(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is left without repeated strings of 400 bytes, and the text without those of ``PASSAGE`` bytes."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), passage=repeats.PASSAGE, with_text=True).withColumnRenamed("kept", "text")


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors at a cosine of 0.9; unusable vectors stand alone."""
    return vectors.vector_components(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; labels of held-out rows are never read."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and one with control strings, read back from their formatted form."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return chat.read_back(chat.format_conversations(turns.unionByName(more)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document; a null text has none, a null source comes last."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents by near-duplicate passages; texts too short for one stand alone."""
    return passages.passage_components(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of token ids and of the text decoded from them; a null text is an empty one."""
    return pieces.encode_documents(table(spark, sf_dir, "documents"), corpus_pipeline.tokenizer_path())


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages by the longest rule or else the trees; a null URL has an empty host and path."""
    return urls.judge(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of the sources of each language and the terms in which each stands out; nulls are empty strings."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; labels of held-out rows are never read."""
    docs = table(spark, sf_dir, "documents")
    return attention.score_documents(docs, attention.fit(docs, table(spark, sf_dir, "labels")))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the periodic runs of all documents, every tenth one with a planted period; a null text has no words."""
    found = periods.periodic_runs(periods.with_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = periods.longest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict:
    named = (op1_simhash, op2_media, op3_repeats, op4_vectors, op5_toxicity, op6_chat, op7_mixing, op8_passages, op9_sentencepiece, op10_urls, op11_divergence, op12_quality, op13_periods)
    return {f.__name__: f for f in named} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op11_divergence": divergence.SQL}
