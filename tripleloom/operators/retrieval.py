"""Context for statements: whole short texts, the best chunks of long ones, and a cache of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from .vectors import dot, top_k


def contexts(statements: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = 5, short: int = 3000) -> DataFrame:
    """(doc_id, stmt_id, context, full_text): the whole text of documents below `short` words, else the k best chunks.

    `statements` has (doc_id, stmt_id, vector), `chunks` (doc_id, chunk_id, text, vector) with unit vectors.
    Chunks come back in document order; ties go to the earlier chunk.
    """
    sized = docs.select("doc_id", "text", (word_count(F.col("text")) < short).alias("full_text"))
    whole = statements.select("doc_id", "stmt_id").join(sized.where("full_text"), "doc_id").select("doc_id", "stmt_id", F.col("text").alias("context"), "full_text")
    long = statements.join(sized.where("not full_text").select("doc_id"), "doc_id", "left_semi")
    pairs = long.join(chunks.select("doc_id", "chunk_id", "text", F.col("vector").alias("cv")), "doc_id").select("doc_id", "stmt_id", "chunk_id", "text", dot(F.col("vector"), F.col("cv")).alias("sim"))
    best = top_k(pairs, "stmt_id", "sim", "chunk_id", k)
    joined = best.groupBy("doc_id", "stmt_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda c: c["text"]), "\n\n").alias("context"))
    return whole.unionByName(joined.withColumn("full_text", F.lit(False)))


def with_own(best: DataFrame, own: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The best items of a query and the ones it brings along, each once."""
    return best.select(*keys, item).unionByName(own.select(*keys, item)).distinct()


def missing_vectors(texts: DataFrame, cache: DataFrame, config: str) -> DataFrame:
    """Texts (key, text) whose vector the cache lacks for a configuration."""
    return texts.join(cache.where(F.col("config") == config).select("key"), "key", "left_anti")


def fingerprints(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file, row_id, status): files matched to the first row with their first answer; found, collision or unknown."""
    firsts = rows.groupBy("answer").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))
    both = files.join(firsts, "answer", "left")
    return both.select("file", "row_id", F.when(F.col("row_id").isNull(), "unknown").when(F.col("n") > 1, "collision").otherwise("found").alias("status"))
