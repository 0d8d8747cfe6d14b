"""Inputs and SQL fragments that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import ALIASES, triple_columns
from ..sources.tables import table

#: White space as Unicode has it, in the dialect of the checking database.
UWS = "[\\s\\x0B\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def sq(x: str) -> str:
    """SQL for single blanks and none at the ends."""
    return f"trim(regexp_replace({x}, '{UWS}', ' ', 'g'))"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, '{UWS}'), lambda w: w <> ''))"


TRIPLE_COLUMNS = ("triple_id", "doc_id", "chunk_id", "triple_ord", "subject", "relation", "object", "evidence", "pipeline", "origin")


def every_triple(spark: SparkSession, folder: str) -> DataFrame:
    """Triples as stated in columns or in the payload, redelivered rows once; missing parts are null."""
    return triple_columns(table(spark, folder, "triples").select(*TRIPLE_COLUMNS, "payload")).select(*TRIPLE_COLUMNS).distinct()


def triples(spark: SparkSession, folder: str) -> DataFrame:
    """Triples that have all three parts, stated in columns or in the payload."""
    return every_triple(spark, folder).where("subject is not null and relation is not null and object is not null")


def sql_part(name: str) -> str:
    """SQL for a part of a triple: its column, or where all three are null the payload under any of its names."""
    inside = ", ".join(f"json_extract_string(payload, '$.{k}')" for k in ALIASES[name])
    return f"CASE WHEN subject IS NULL AND relation IS NULL AND object IS NULL THEN CASE WHEN json_valid(payload) THEN coalesce({inside}) END ELSE {name} END"


_OTHERS = ", ".join(c for c in TRIPLE_COLUMNS if c not in ALIASES)
SQL_EVERY_TRIPLE = f"(SELECT DISTINCT {_OTHERS}, {', '.join(f'{sql_part(n)} AS {n}' for n in ALIASES)} FROM triples)"
SQL_TRIPLES = f"(SELECT * FROM {SQL_EVERY_TRIPLE} WHERE subject IS NOT NULL AND relation IS NOT NULL AND object IS NOT NULL)"


def entities(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_entities").distinct()


SQL_ENTITIES = "(SELECT DISTINCT * FROM raw_entities)"


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks, redelivered rows once."""
    return table(spark, folder, "chunks").select("chunk_uid", "doc_id", "pipeline", "chunk_id", "text").distinct()


SQL_CHUNKS = "(SELECT DISTINCT chunk_uid, doc_id, pipeline, chunk_id, text FROM chunks)"


def results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "batch_results").select("result_id", "custom_id", "success", "content", "status_code", "error", "provider").distinct()


SQL_RESULTS = "(SELECT DISTINCT result_id, custom_id, success, content, status_code, error, provider FROM batch_results)"


def outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "judge_outcomes").select("outcome_id", "custom_id", "supporting_span", "verdict", "raw_content", "error", "judge_model").distinct()


SQL_OUTCOMES = "(SELECT DISTINCT outcome_id, custom_id, supporting_span, verdict, raw_content, error, judge_model FROM judge_outcomes)"


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "stage1_candidates").select("cand_id", "doc_id", "chunk_uid", "fact_ord", "fact", "supporting_span", "span_mismatch", "generator_model", "error").distinct()


SQL_CANDIDATES = "(SELECT DISTINCT cand_id, doc_id, chunk_uid, fact_ord, fact, supporting_span, span_mismatch, generator_model, error FROM stage1_candidates)"


def rnd(c, places: int = 6):
    """Doubles are compared at a fixed number of places."""
    return F.round(c, places)
