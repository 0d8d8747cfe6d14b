"""Queries of the model-backed stages, with the rule stand-ins as models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.answers import ALIASES, triple_columns
from ..operators import linking as L
from ..operators import retrieval, vectors
from ..session import cut, shared_folder
from ..sources.tables import table
from . import asking
from .backends import embedded
from .base import SQL_CANDIDATES, SQL_CHUNKS, SQL_ENTITIES, SQL_TRIPLES, UWS, candidates, chunks, entities, results, rnd, sq, triples
from .text_queries import STATEMENT

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


_FACT = f"rtrim(lower({sq('fact')}), '.')"
_HELD = f"({_FACT} <> '' AND contains(lower({sq('text')}), {_FACT}))"
_FACTS = f"(SELECT cand_id, fact, text FROM {SQL_CANDIDATES} s JOIN {SQL_CHUNKS} c USING (chunk_uid) WHERE fact IS NOT NULL)"


def facts_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).where("fact is not null").join(chunks(spark, d).select("chunk_uid", "text"), "chunk_uid").select("cand_id", "fact", "text")


@query("judged_facts", f"SELECT cand_id, CASE WHEN {_HELD} THEN 'SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict, CASE WHEN {_HELD} THEN 'SUPPORTED' ELSE 'NOT_STATED' END AS verifier_verdict, {_HELD}::INT AS hit FROM {_FACTS}")
def judged_facts(spark: SparkSession, d: str) -> DataFrame:
    """Candidate facts against their chunk, by the entailment judge, the fact verifier and the recall judge."""
    rows = asking.verified_facts(asking.judged(facts_in_chunks(spark, d), "fact", "text"), "text")
    return asking.recalled(rows, "fact", "text").select("cand_id", "verdict", "verifier_verdict", "hit")


_PIECES = f"list_filter(string_split(regexp_replace(text, '([.!?]){UWS}', '\\1' || chr(3), 'g'), chr(3)), lambda x: regexp_replace(x, '{UWS}', '', 'g') <> '')"


@query("generated_facts", f"WITH p AS (SELECT doc_id, {_PIECES} AS s FROM documents), r AS (SELECT doc_id, unnest(s[1:15]) AS f, unnest(range(len(s[1:15])))::INT AS fact_ord FROM p) SELECT doc_id, fact_ord, {sq('f')} AS fact, false AS span_mismatch FROM r")
def generated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Up to fifteen facts of each document; the fifteen are the feature."""
    return asking.generated_facts(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "fact_ord", "fact", "span_mismatch")


@query("classified_facts")
def classified_facts(spark: SparkSession, d: str) -> DataFrame:
    return asking.classified_facts(candidates(spark, d).where("fact is not null").select("cand_id", "fact")).select("cand_id", "category")


_WHOLE = " AND ".join(f"{sq(x)} <> ''" for x in ("subject", "relation", "object"))
_TOLD = " || ' ' || ".join(sq(x) for x in ("subject", "relation", "object"))


@query("verbalised_triples", f"SELECT triple_id, {sq(STATEMENT.format('told'))} AS statement FROM (SELECT triple_id, {_TOLD} || '.' AS told FROM {SQL_TRIPLES} WHERE {_WHOLE})")
def verbalised_triples(spark: SparkSession, d: str) -> DataFrame:
    rows = asking.verbalised(triples(spark, d).select("triple_id", "subject", "relation", "object")).where("statement is not null")
    return rows.select("triple_id", T.squeeze(F.col("statement")).alias("statement"))


_OUT = f"{sq('replace(replace(lower(relation), lower(subject), chr(32)), lower(object), chr(32))')}"


@query(
    "fixed_triples",
    f"""WITH t AS (SELECT triple_id, subject, relation, object, NOT (contains(lower(relation), lower(subject)) OR contains(lower(relation), lower(object))) AS ok, lower({_OUT}) AS new,
nullif(lower(array_to_string(string_split({sq('subject')}, ' ')[1:3], ' ')), '') AS s, nullif(lower({sq('object')}), '') AS o FROM {SQL_TRIPLES}),
r AS (SELECT *, CASE WHEN ok THEN NULL WHEN new = '' OR s IS NULL OR o IS NULL THEN 'incomplete' WHEN contains(new, s) OR contains(new, o) THEN 'still_invalid' END AS reason FROM t)
SELECT triple_id, CASE WHEN NOT ok AND reason IS NULL THEN s ELSE subject END AS subject, CASE WHEN NOT ok AND reason IS NULL THEN new ELSE relation END AS relation, CASE WHEN NOT ok AND reason IS NULL THEN o ELSE object END AS object,
CASE WHEN ok THEN 'valid' WHEN reason IS NULL THEN 'fixed' ELSE 'discarded' END AS status, reason FROM r""",
)
def fixed_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose relation repeats an end, mended by the model or discarded with the reason."""
    return asking.fixed_triples(triples(spark, d))


@query("matched_relations")
def matched_relations(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose ends are entities of their document, those of other ends matched to them by the model once."""
    stated = triple_columns(table(spark, d, "triples").select("doc_id", *ALIASES, "payload"))
    whole = stated.where("subject is not null and relation is not null and object is not null")
    return asking.matched_relations(whole, table(spark, d, "raw_entities"))


_SQUASH = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}_]', '', 'g')"


@query(
    "same_entities",
    f"SELECT DISTINCT c.doc_id, ent_a, ent_b, coalesce({_SQUASH.format('x.name')} = {_SQUASH.format('y.name')} AND {_SQUASH.format('x.name')} <> '', false) AS same FROM (SELECT DISTINCT doc_id, ent_a, ent_b FROM candidate_pairs) c "
    f"JOIN {SQL_ENTITIES} x ON x.doc_id = c.doc_id AND x.ent_key = ent_a JOIN {SQL_ENTITIES} y ON y.doc_id = c.doc_id AND y.ent_key = ent_b",
)
def same_entities(spark: SparkSession, d: str) -> DataFrame:
    """Proposed pairs put to the model by their names."""
    names = entities(spark, d).select("doc_id", "ent_key", "name")
    pairs = table(spark, d, "candidate_pairs").select("doc_id", "ent_a", "ent_b").distinct()
    both = pairs.join(names.toDF("doc_id", "ent_a", "x"), ["doc_id", "ent_a"]).join(names.toDF("doc_id", "ent_b", "y"), ["doc_id", "ent_b"])
    return asking.same_entity(both).select("doc_id", "ent_a", "ent_b", "same").distinct()


@query("entity_graphs")
def entity_graphs(spark: SparkSession, d: str) -> DataFrame:
    """A graph of each title's entity from the sentences of its document."""
    docs = table(spark, d, "documents").select("doc_id", "text", "title")
    return asking.entity_graphs(docs.select("doc_id", F.col("title").alias("name")), docs.select("doc_id", "text"))


@query("cluster_relations")
def cluster_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations between the unlinked subjects of each relation of a document, from the first three evidences of each."""
    t = triples(spark, d)
    loose = L.unlinked(t.select("doc_id", F.col("relation").alias("cluster"), F.col("subject").alias("name")), t)
    proof = L.first_evidence(t, t, "subject", "triple_id").select("doc_id", F.col("entity").alias("name"), "evidence")
    told = loose.join(proof, ["doc_id", "name"]).select("doc_id", "cluster", "evidence").distinct()
    told = told.groupBy("doc_id", "cluster").agg(F.array_join(F.array_sort(F.collect_list("evidence")), "\n").alias("evidence"))
    return asking.cluster_relations(loose, told)


@query("batch_job", "SELECT 'summary|item_' || item_id AS custom_id, true AS success, substr(text, 1, 500) AS content FROM benchmark")
def batch_job(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of the reference items as a batch job, run twice: the second run finds all answers."""
    ask = F.concat(F.lit("Summarise the text.\n\n"), "text").alias("prompt")
    requests = table(spark, d, "benchmark").select(F.concat(F.lit("summary|item_"), "item_id").alias("custom_id"), ask)
    folder = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
    for _ in range(2):
        done = asking.run_batch(spark, requests, folder)
    return done.select("custom_id", "success", "content")


@query("repaired_answers")
def repaired_answers(spark: SparkSession, d: str) -> DataFrame:
    """Triples of the stored answers, those cut inside closed again by the model."""
    from ..functions.answers import answer_triples

    rows = results(spark, d).where("custom_id like 'triples|%' and content is not null")
    parts = asking.parses(F.col("content"))
    broken = cut(rows.where(~F.coalesce(parts, F.lit(False))).select("result_id", F.concat(F.lit("Repair the JSON.\n\n"), "content").alias("p")))
    mended = asking.complete(broken, "p", "content", asking.RuleBackend).select("result_id", "content")
    return answer_triples(rows.where(parts).select("result_id", "content").unionByName(mended), "content", ["result_id"])


_LEMMA = "CASE WHEN length(w) > 5 AND w LIKE '%ies' THEN substr(w, 1, length(w) - 3) || 'y' WHEN length(w) > 6 AND w LIKE '%sses' THEN substr(w, 1, length(w) - 2) WHEN length(w) > 5 AND w LIKE '%xes' THEN substr(w, 1, length(w) - 2) WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' AND w NOT LIKE '%us' AND w NOT LIKE '%is' THEN substr(w, 1, length(w) - 1) ELSE w END"


@query("lemma_dedup", f"SELECT doc_id, array_to_string(list_transform(string_split(lower({sq('name')}), ' '), lambda w: {_LEMMA}), ' ') AS lemma, arg_min(name, ent_id) AS name, min(ent_id) AS ent_id FROM {SQL_ENTITIES} WHERE name IS NOT NULL GROUP BY 1, 2")
def lemma_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first entity of each lemma form of a document, as it was written."""
    rows = entities(spark, d).where("name is not null").groupBy("doc_id", T.lemmas(F.col("name")).alias("lemma")).agg(F.min(F.struct("ent_id", "name")).alias("m"))
    return rows.select("doc_id", "lemma", "m.name", "m.ent_id")


@query(
    "described_entities",
    f"""WITH m AS (SELECT doc_id, lower(subject) AS e, string_agg(relation || ' -> ' || object, '; ' ORDER BY triple_id, relation || ' -> ' || object) AS told FROM {SQL_TRIPLES} GROUP BY 1, 2),
o AS (SELECT doc_id, lower(name) AS e, arg_max(string_split(description, ';;;')[1], ent_id) AS own FROM {SQL_ENTITIES} WHERE coalesce(description, '') <> '' GROUP BY 1, 2)
SELECT n.doc_id, n.e AS entity, coalesce(own, told, n.e) AS description FROM (SELECT DISTINCT doc_id, lower(name) AS e FROM {SQL_ENTITIES} WHERE name IS NOT NULL) n LEFT JOIN m USING (doc_id, e) LEFT JOIN o USING (doc_id, e)""",
)
def described_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities by their own description (the last one stored, its first part), else by their triples, else by name."""
    t = triples(spark, d).select("doc_id", F.lower("subject").alias("entity"), "triple_id", F.concat_ws(" -> ", "relation", "object").alias("line"))
    told = t.groupBy("doc_id", "entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("triple_id", "line"))), lambda x: x["line"]), "; ").alias("told"))
    return L.overridden(entities(spark, d), told)


@query("context_sentences", None)
def context_sentences(spark: SparkSession, d: str) -> DataFrame:
    """For each candidate fact the five nearest sentences of its document and the ones that its chunk begins with, each once."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("doc_id"), "text")
    facts = embedded(candidates(spark, d).where("fact is not null").select("doc_id", "cand_id", "fact", "chunk_uid"), "fact", "fv")
    from ..operators.segment import sentence_rows

    sents = embedded(sentence_rows(docs.join(facts.select("doc_id").distinct(), "doc_id", "left_semi"), ["doc_id"]), "sentence", "sv")
    scored = facts.join(sents, "doc_id").select("cand_id", "pos", vectors.dot(F.col("fv"), F.col("sv")).alias("sim"))
    best = vectors.top_k(scored, "cand_id", "sim", "pos", 5)
    own = facts.select("doc_id", "cand_id", "fact").join(sents.select("doc_id", "pos", "sentence"), "doc_id").where(F.contains("sentence", F.col("fact")))
    return retrieval.with_own(best, own, ["cand_id"], "pos")


@query("token_f1")
def token_f1(spark: SparkSession, d: str) -> DataFrame:
    """Token-level similarity of the proposed entity names: precision, recall and F1 of the best match of each token."""
    names = entities(spark, d).select("doc_id", "ent_key", "name")
    pairs = table(spark, d, "candidate_pairs").select("doc_id", "ent_a", "ent_b").distinct()
    both = pairs.join(names.toDF("doc_id", "ent_a", "x"), ["doc_id", "ent_a"]).join(names.toDF("doc_id", "ent_b", "y"), ["doc_id", "ent_b"])
    return both.select("doc_id", "ent_a", "ent_b", vectors.token_scores(F.col("x"), F.col("y")).alias("s")).select("doc_id", "ent_a", "ent_b", "s.*")


@query(
    "status_rows",
    f"SELECT provider, status, count(*) AS n FROM (SELECT custom_id, last(provider ORDER BY finished_at, result_id) AS provider, CASE WHEN bool_or(success AND content IS NOT NULL) THEN 'done' WHEN bool_or(NOT success) THEN 'failed' ELSE 'empty' END AS status FROM batch_results GROUP BY 1) GROUP BY 1, 2",
)
def status_rows(spark: SparkSession, d: str) -> DataFrame:
    """One status a request over all shards of its answers: done by any of them, else failed, else empty."""
    done = F.bool_or(F.col("success") & F.col("content").isNotNull())
    failed = F.bool_or(~F.col("success"))
    rows = table(spark, d, "batch_results").groupBy("custom_id").agg(F.max(F.struct("finished_at", "result_id", "provider"))["provider"].alias("provider"), F.when(done, "done").when(failed, "failed").otherwise("empty").alias("status"))
    return rows.groupBy("provider", "status").agg(F.count("*").alias("n"))


@query(
    "token_misses",
    """WITH t AS (SELECT provider, sum(length(content)) AS n FROM batch_results GROUP BY 1), c AS (SELECT judge_model AS provider, count(DISTINCT custom_id) AS docs FROM judge_outcomes GROUP BY 1 UNION ALL SELECT provider, count(DISTINCT custom_id) FROM batch_results WHERE provider <> 'tern' GROUP BY 1)
SELECT coalesce(t.provider, c.provider) AS provider, CASE WHEN t.provider IS NULL THEN 'no_tokens' WHEN c.provider IS NULL THEN 'no_documents' ELSE 'ok' END AS reason, round(n / docs, 6) AS mean FROM t FULL JOIN c USING (provider)""",
)
def token_misses(spark: SparkSession, d: str) -> DataFrame:
    """Sizes against document counts; what is missing on one side is named instead of dropped."""
    r, j = table(spark, d, "batch_results"), table(spark, d, "judge_outcomes")
    t = r.groupBy("provider").agg(F.sum(F.length("content")).alias("n"), F.lit(True).alias("t"))
    c = j.groupBy(F.col("judge_model").alias("provider")).agg(F.count_distinct("custom_id").alias("docs")).unionByName(r.where("provider <> 'tern'").groupBy("provider").agg(F.count_distinct("custom_id").alias("docs")))
    both = t.join(c.withColumn("c", F.lit(True)), "provider", "full")
    reason = F.when(F.col("t").isNull(), "no_tokens").when(F.col("c").isNull(), "no_documents").otherwise("ok")
    return both.select("provider", reason.alias("reason"), rnd(F.col("n") / F.col("docs")).alias("mean"))
