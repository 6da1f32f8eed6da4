"""Full-text search over a written inverted index with positions.

The index holds one row a term and document, put into hash buckets of terms as folders and sorted by term within
them, so that a search opens the folders of its terms only and skips their other row groups. Terms are stems of
words that are no stop words. Searching is term at a time: postings of the asked terms are joined and summed by document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinthwork.functions import text as tx
from plinthwork.functions.storage import shared_dir

# English words that are not indexed, the weight of an unlabelled position, and the limit that ranks are scaled by.
STOP = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but",
    "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
WEIGHT, SCALE = 0.1, 1.64493406685
BUCKETS = 64


def terms(text) -> Column:
    """Array of (place, term): places count all words from 1, stop words leave gaps."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    placed = F.transform(words, lambda w, i: F.struct((i + 1).alias("place"), w.alias("word")))
    kept = F.filter(placed, lambda p: ~p["word"].isin(*STOP))
    return F.transform(kept, lambda p: F.struct(p["place"].alias("place"), tx.stemmed(p["word"]).alias("term")))


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> str:
    """Write the index of ``docs`` and return its folder (in the shared one, if none is named). Rows without an id are left out."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/plinthwork/{spark.sparkContext.applicationId}/index-{uuid.uuid4().hex}"
    each = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.explode(terms(text)).alias("t")).select("doc", "t.*")
    rows = each.groupBy("term", "doc").agg(F.array_sort(F.collect_list("place")).alias("places")).withColumn("bucket", _bucket("term"))
    # A bucket may hold a term of all documents: its rows are spread over files by document.
    rows.repartition("bucket", F.pmod(F.xxhash64("doc"), F.lit(8))).sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return path


def _asked(queries: DataFrame) -> DataFrame:
    """``query, term, slot``: distinct stems of each query, and where each stands after its first."""
    each = queries.select("query", F.explode(terms("asked")).alias("t")).select("query", "t.*")
    return each.groupBy("query", "term").agg(F.min("place").alias("slot"))


def search(spark: SparkSession, path: str, queries: DataFrame, phrase: bool = False) -> DataFrame:
    """``query, doc, hits, rank`` of the documents that hold all terms of a query, or with ``phrase`` hold them in its places.

    ``queries`` are few rows ``query, asked``: their terms are sent to all tasks, and only postings of these
    terms' buckets are read. A query of stop words alone finds nothing. The rank is the mean over the terms of the
    sum of 1 / n**2 over a term's occurrences, as scaled by the fixed values.
    """
    asked = _asked(queries)
    wanted = asked.withColumn("bucket", _bucket("term"))
    size = wanted.groupBy("query").agg(F.count(F.lit(1)).alias("terms"), F.min("slot").alias("first"))
    wanted = wanted.join(size, "query")
    buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # at most BUCKETS
    postings = spark.read.parquet(path).where(F.col("bucket").isin(buckets))
    met = postings.join(F.broadcast(wanted), ["bucket", "term"])  # stated queries
    score = F.aggregate(F.sequence(F.lit(1), F.size("places")), F.lit(0.0), lambda a, j: a + F.lit(1.0) / (j * j))
    starts = F.transform("places", lambda p: p - (F.col("slot") - F.col("first")))
    found = met.groupBy("query", "doc", "terms").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("places")).alias("hits"), F.sum(score).alias("sum"), *([F.collect_list(starts).alias("starts")] if phrase else []))
    found = found.where("n = terms")
    if phrase:
        found = found.where(F.size(F.aggregate("starts", F.get("starts", F.lit(0)), lambda a, s: F.array_intersect(a, s))) > 0)
    return found.select("query", "doc", F.col("hits").cast("long").alias("hits"), (F.col("sum") * WEIGHT / SCALE / F.col("terms")).alias("rank"))
