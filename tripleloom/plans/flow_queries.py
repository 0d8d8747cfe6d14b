"""Queries over record shapes, whole pipelines and incremental runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import records as R
from ..operators import retrieval
from ..operators.segment import sentence_chunks
from ..session import shared_folder
from ..sources.tables import table
from ..streaming.incremental import run_new
from .backends import complete, embedded
from .base import SQL_CANDIDATES, SQL_ENTITIES, SQL_RESULTS, SQL_TRIPLES, candidates, entities, results, triples
from .pipeline import extract

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


@query("token_surfaces", "SELECT doc_id, array_to_string(t[2:4], ' ') AS surface FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)")
def token_surfaces(spark: SparkSession, d: str) -> DataFrame:
    t = R.plain_tokens(F.split("text", " "))
    return table(spark, d, "documents").select("doc_id", R.surface(t, F.lit(1), F.lit(3)).alias("surface"))


@query("class_lists", f"SELECT doc_id, coalesce(list(fact_ord ORDER BY fact_ord) FILTER (WHERE coalesce(span_mismatch, true)), []) AS mismatch, coalesce(list(fact_ord ORDER BY fact_ord) FILTER (WHERE NOT coalesce(span_mismatch, true)), []) AS fine FROM {SQL_CANDIDATES} GROUP BY 1")
def class_lists(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.coalesce("span_mismatch", F.lit(True)), "mismatch").otherwise("fine")
    return R.class_lists(candidates(spark, d).withColumn("label", label), ["doc_id"], "fact_ord", "label", ["mismatch", "fine"])


@query("kg_triples", f"SELECT doc_id, triple_id, subject, relation, object FROM {SQL_TRIPLES} WHERE NOT starts_with(object, '[')")
def kg_triples(spark: SparkSession, d: str) -> DataFrame:
    """Entity-centred graphs built from the triples, then taken apart again."""
    t = triples(spark, d).where("not startswith(object, '[')")
    rel = F.array(F.struct(F.col("relation"), F.col("object").alias("target_name")))
    body = F.to_json(F.struct(F.struct(F.col("subject").alias("name"), rel.alias("relationships")).alias("central_entity")))
    return R.kg_triples(t.select("doc_id", "triple_id", body.alias("payload")), "payload", ["doc_id", "triple_id"])


@query("list_triples", f"SELECT triple_id, 0 AS triple_ord, subject, relation, object FROM {SQL_TRIPLES}")
def list_triples(spark: SparkSession, d: str) -> DataFrame:
    return R.list_triples(triples(spark, d).select("triple_id", F.array(F.array("subject", "relation", "object")).alias("r")), "r", ["triple_id"])


@query("entity_maps", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ent_id)::INT AS ent_no, name, coalesce(ent_type, '') AS type, coalesce(description, '') AS description FROM {SQL_ENTITIES} WHERE trim(coalesce(name, '')) <> '' AND coalesce(ent_type, '') <> 'State' AND NOT contains(coalesce(description, ''), 'State')")
def entity_maps(spark: SparkSession, d: str) -> DataFrame:
    rows = entities(spark, d).where("coalesce(ent_type, '') <> 'State' and not contains(coalesce(description, ''), 'State')")
    body = F.to_json(F.create_map("ent_key", F.struct("name", F.col("ent_type").alias("type"), "description")))
    return R.entity_maps(rows.select("doc_id", "ent_id", body.alias("payload")), "payload", ["doc_id"], "ent_id")


@query(
    "corpus_alignment",
    """WITH x AS (SELECT item_id AS item, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON substr(b.text, 1, 250) = substr(d.text, 1, 250) GROUP BY 1),
p AS (SELECT item_id AS item, k, substr(text, (k * greatest((length(text) - 80) // 3, 1) + 1)::INT, 80) AS p FROM benchmark, (SELECT unnest(range(4)) AS k) WHERE item_id NOT IN (SELECT item FROM x)),
h AS (SELECT item, doc_id, count(*) AS n FROM p JOIN documents d ON p <> '' AND contains(d.text, p) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT item, doc_id, 'prefix' AS how FROM x UNION ALL SELECT item, doc_id, 'probes' FROM h QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC, doc_id) = 1""",
)
def corpus_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the reference items come from, by an equal start or by probes."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text")
    return R.best_probe(items, table(spark, d, "documents").select("doc_id", "text"))


@query("extraction_pipeline")
def extraction_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return extract(table(spark, d, "documents").select("doc_id", "text"))


@query("summaries", "SELECT doc_id, substr(text, 1, 500) AS summary FROM documents")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Summarise the text.\n\n"), "text").alias("prompt"))
    return complete(docs, "prompt", "summary", _rules()).select("doc_id", "summary")


def _rules():
    from .backends import RuleBackend

    return RuleBackend


@query("name_vectors")
def name_vectors(spark: SparkSession, d: str) -> DataFrame:
    return embedded(entities(spark, d).select("ent_id", "name"), "name", "vector").select("ent_id", "vector")


@query("incremental_run", "SELECT DISTINCT result_id, provider FROM batch_results")
def incremental_run(spark: SparkSession, d: str) -> DataFrame:
    """Answers taken in as a stream of files, each record once; a second run finds nothing new."""
    base = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{d}/batch_results.parquet").schema.simpleString()[len("struct<") : -1].replace(":", " ")
    for _ in range(2):
        run_new(spark, f"{d}/batch_results.parquet*", schema, f"{base}/out", f"{base}/state", "result_id", lambda rows: rows.select("result_id", "provider"))
    return spark.read.parquet(f"{base}/out")


_IN = "regexp_replace(lower(regexp_replace(evidence, '^\\s+|\\s+$', '', 'g')), '[.!?]+$', '')"


@query(
    "inner_relations",
    f"""WITH t AS (SELECT triple_id, {_IN} AS s, lower(regexp_replace(subject, '^\\s+|\\s+$', '', 'g')) AS a, lower(regexp_replace(object, '^\\s+|\\s+$', '', 'g')) AS b FROM {SQL_TRIPLES} WHERE evidence IS NOT NULL),
u AS (SELECT triple_id, CASE WHEN a <> '' AND starts_with(s, a) THEN substr(s, length(a) + 1) ELSE s END AS s, b FROM t),
v AS (SELECT triple_id, CASE WHEN b <> '' AND ends_with(s, b) THEN substr(s, 1, length(s) - length(b)) WHEN b <> '' AND contains(s, b) THEN substr(s, 1, length(s) - instr(reverse(s), reverse(b)) - length(b) + 1) ELSE s END AS r FROM u)
SELECT triple_id, CASE WHEN length(r) >= 2 THEN r END AS relation FROM (SELECT triple_id, regexp_replace(r, '^\\s+|\\s+$', '', 'g') AS r FROM v)""",
)
def inner_relations(spark: SparkSession, d: str) -> DataFrame:
    t = triples(spark, d).where("evidence is not null")
    return t.select("triple_id", A.inner_relation(F.col("evidence"), F.col("subject"), F.col("object")).alias("relation"))


@query("strict_answers")
def strict_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers to triple requests that hold good triples only."""
    rows = results(spark, d).where("custom_id like 'triples|%' and content is not null")
    return rows.select("result_id", A.strict_triples(F.col("content")).alias("triples")).where("triples is not null")


@query(
    "fingerprints",
    f"SELECT file, row_id, CASE WHEN row_id IS NULL THEN 'unknown' WHEN n > 1 THEN 'collision' ELSE 'found' END AS status FROM (SELECT result_id AS file, content AS answer FROM {SQL_RESULTS} WHERE custom_id LIKE 'summary|%' AND content IS NOT NULL) f "
    f"LEFT JOIN (SELECT content AS answer, min(result_id) AS row_id, count(*) AS n FROM {SQL_RESULTS} WHERE content IS NOT NULL AND provider <> 'nimbus' GROUP BY 1) USING (answer)",
)
def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = results(spark, d).where("content is not null")
    files = rows.where("custom_id like 'summary|%'").select(F.col("result_id").alias("file"), F.col("content").alias("answer"))
    return retrieval.fingerprints(files, rows.where("provider <> 'nimbus'").select(F.col("result_id").alias("row_id"), F.col("content").alias("answer")))


@query("statement_contexts")
def statement_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Context of each candidate fact: its whole document if short, else the chunks nearest to it."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), "text")
    facts = embedded(candidates(spark, d).where("fact is not null").select("doc_id", F.col("cand_id").alias("stmt_id"), "fact"), "fact", "vector")
    asked = docs.join(facts.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = embedded(sentence_chunks(asked, ["doc_id"]), "text", "vector")
    return retrieval.contexts(facts.select("doc_id", "stmt_id", "vector"), chunks, asked, k=5, short=200)


@query("resolution_history")
def resolution_history(spark: SparkSession, d: str) -> DataFrame:
    """Before and after of every triple in the object resolution, with status and method; what was clean or failed stays as it was."""
    from .text_queries import QUERIES as TEXT

    before = triples(spark, d).select("triple_id", F.struct("subject", "relation", "object").alias("before"))
    after = TEXT["object_resolution"](spark, d)
    method = F.when(F.col("method") == "multi", "multiple_entities").when(F.col("method") != "none", "single_entity")
    after = after.groupBy("triple_id", "status", method.alias("method")).agg(F.sort_array(F.collect_list(F.struct("part", "subject", "relation", "object"))).alias("after"))
    after = after.withColumn("after", F.transform("after", lambda t: F.struct(t["subject"].alias("subject"), t["relation"].alias("relation"), t["object"].alias("object"))))
    kept = F.when(F.col("status") == "repaired", F.col("after")).otherwise(F.array("before"))
    return after.join(before, "triple_id").select("triple_id", "status", "method", "before", kept.alias("after"))


@query(
    "assembled",
    f"""SELECT d.doc_id, t.n_triples, e.n_entities, c.n_facts, c.n_facts IS NOT NULL AS has_facts FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_triples FROM {SQL_TRIPLES} GROUP BY 1) t ON t.doc_id = 'doc_' || d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n_entities FROM {SQL_ENTITIES} GROUP BY 1) e ON e.doc_id = 'doc_' || d.doc_id LEFT JOIN (SELECT doc_id, count(fact) AS n_facts FROM {SQL_CANDIDATES} GROUP BY 1) c ON c.doc_id = 'doc_' || d.doc_id""",
)
def assembled(spark: SparkSession, d: str) -> DataFrame:
    """One wide row a document; every side is aggregated before it is joined."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc_"), "doc_id").alias("key"))
    t = triples(spark, d).groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n_triples"))
    e = entities(spark, d).groupBy(F.col("doc_id").alias("key")).agg(F.count("*").alias("n_entities"))
    c = candidates(spark, d).groupBy(F.col("doc_id").alias("key")).agg(F.count("fact").alias("n_facts"))
    wide = docs.join(t, "key", "left").join(e, "key", "left").join(c, "key", "left")
    return wide.select("doc_id", "n_triples", "n_entities", "n_facts", F.col("n_facts").isNotNull().alias("has_facts"))
