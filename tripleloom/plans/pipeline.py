"""Extraction as stages over tables: chunks, entities, refined entities, triples, checks, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import answer_triples, json_body
from ..functions.text import clean_entity, clean_relation, squeeze
from ..operators.resolve import resolved, valid_relation, valid_split
from ..operators.segment import sentence_chunks
from ..session import cut
from .asking import rewritten
from .backends import RuleBackend, complete


#: Asks for one triple for each entity: a hub for lists, a chain or nesting for entities that depend on each other.
SPLIT = 'Split the triple so that every entity is the object of a triple: from the subject for lists, from the entity before for chains and nestings. Answer {"triples": [{"subject": "", "relation": "", "object": ""}]}.'


def entities_of(chunks: DataFrame, backend=RuleBackend) -> DataFrame:
    """(doc_id, chunk_id, ent_ord, name): cleaned entities of each chunk in the order of the answer."""
    asked = complete(chunks.withColumn("prompt", F.concat(F.lit("List the entities of the text.\n\n"), "text")), "prompt", "answer", backend)
    v = F.try_variant_get(F.try_parse_json(json_body(F.col("answer"))), "$.entities", "array<string>")
    rows = asked.select("doc_id", "chunk_id", F.posexplode(v).alias("ent_ord", "name"))
    return rows.withColumn("name", clean_entity(F.col("name"))).where("name is not null")


def refined(entities: DataFrame) -> DataFrame:
    """(doc_id, name, first): distinct entities of each document by first appearance."""
    return entities.groupBy("doc_id", "name").agg(F.min(F.struct("chunk_id", "ent_ord")).alias("first"))


def triples_of(chunks: DataFrame, backend=RuleBackend) -> DataFrame:
    """(doc_id, chunk_id, triple_ord, subject, relation, object, evidence); the evidence is the text of the chunk."""
    asked = complete(chunks.withColumn("prompt", F.concat(F.lit("List the triples of the text.\n\n"), "text")), "prompt", "answer", backend)
    rows = answer_triples(asked.withColumnRenamed("text", "evidence"), "answer", ["doc_id", "chunk_id", "evidence"])
    return rows.select("doc_id", "chunk_id", "triple_ord", clean_entity(F.col("subject")).alias("subject"), clean_relation(F.col("relation")).alias("relation"), clean_entity(F.col("object")).alias("object"), "evidence")


def verified(triples: DataFrame) -> DataFrame:
    """Adds status valid or discarded: relations that repeat an end go."""
    return triples.withColumn("status", F.when(valid_relation(F.col("subject"), F.col("relation"), F.col("object")), "valid").otherwise("discarded"))


def repaired(triples: DataFrame, entities: DataFrame, backend=RuleBackend) -> DataFrame:
    """(triple_id, doc_id, part, subject, relation, object, status, method, n_entities): the resolution of objects, those of several entities split.

    Objects with text after their one entity have their relation rewritten by the model. Of several entities it gets the triple with its entities, the texts around them and the start of the evidence if there is one.
    A split without a blank part whose objects meet every entity replaces the triple by its parts, numbered from 0; any
    other answer leaves the triple failed as it was.
    """
    done = rewritten(cut(resolved(triples, entities, parts=True)), backend)
    asked = done.where("method = 'multi'")
    body = F.to_json(F.struct("context", "subject", "relation", "object", F.col("parts").alias("entities")))
    asked = cut(complete(asked.select("triple_id", "parts", F.concat(F.lit(SPLIT + "\n\n"), body).alias("prompt")), "prompt", "answer", backend))
    found = answer_triples(asked.select("triple_id", "answer"), "answer", ["triple_id"])
    splits = found.groupBy("triple_id").agg(F.sort_array(F.collect_list(F.struct("triple_ord", "subject", "relation", "object"))).alias("split"))
    whole = F.forall("split", lambda t: (squeeze(t["subject"]) != "") & (squeeze(t["relation"]) != ""))
    good = asked.join(splits, "triple_id").where(whole & valid_split(F.transform("parts", lambda p: p["term"]), F.transform("split", lambda t: t["object"])))
    rows = done.join(good.select("triple_id", "split"), "triple_id", "left")
    same = F.array(F.struct(F.lit(0).alias("triple_ord"), "subject", "relation", "object"))
    status = F.when(F.col("split").isNotNull(), "repaired").otherwise(F.col("status")).alias("status")
    rows = rows.select("triple_id", "doc_id", status, "method", "n_entities", F.posexplode(F.coalesce("split", same)).alias("part", "t"))
    return rows.select("triple_id", "doc_id", "part", "t.subject", "t.relation", "t.object", "status", "method", "n_entities")


def extract(docs: DataFrame, backend=RuleBackend) -> DataFrame:
    """(doc_id, triple_id, part, subject, relation, object, status, method) of documents (doc_id, text).

    Answers are materialised before they are used twice, so that no prompt is asked again.
    """
    chunks = sentence_chunks(docs, ["doc_id"])
    ents = refined(cut(entities_of(chunks, backend)))
    found = verified(cut(triples_of(chunks, backend))).where("status = 'valid'")
    found = found.withColumn("triple_id", F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string"), F.col("triple_ord").cast("string")))
    return repaired(found, ents, backend).select("doc_id", "triple_id", "part", "subject", "relation", "object", "status", "method")
