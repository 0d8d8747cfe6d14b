"""Record shapes: token spans, class lists, nested graphs, entity maps, list-form triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Bracket and quote tokens of a treebank and what they stand for.
TREEBANK = {"-LRB-": "(", "-RRB-": ")", "-LSB-": "[", "-RSB-": "]", "-LCB-": "{", "-RCB-": "}", "``": '"', "''": '"', "`": "'"}


def plain_tokens(tokens: Column) -> Column:
    """Tokens with treebank signs replaced."""
    known = F.create_map(*(F.lit(x) for kv in TREEBANK.items() for x in kv))
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t))


def surface(tokens: Column, first: Column, last: Column) -> Column:
    """Text of a token span whose end is included, positions from 0."""
    return F.array_join(F.slice(tokens, first + 1, last - first + 1), " ")


def class_lists(facts: DataFrame, keys: list[str], place: str, label: str, labels: list[str]) -> DataFrame:
    """(keys..., one sorted list of places for each label)."""
    return facts.groupBy(*keys).agg(*(F.sort_array(F.collect_list(F.when(F.col(label) == x, F.col(place)))).alias(x) for x in labels))


def entity_maps(df: DataFrame, payload: str, keys: list[str], order: str) -> DataFrame:
    """(keys..., ent_no, name, type, description) of JSON maps of entities, numbered per key in order; State payloads and nameless entries go."""
    m = F.from_json(payload, "map<string,struct<name:string,type:string,description:string>>")
    rows = df.where(~F.contains(F.coalesce(F.col(payload), F.lit("")), F.lit('"State"'))).select(*keys, order, F.posexplode(F.map_entries(m)).alias("_k", "_e"))
    rows = rows.where("trim(coalesce(_e.value.name, '')) <> ''")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "_k"))
    return rows.select(*keys, n.alias("ent_no"), "_e.value.name", F.coalesce("_e.value.type", F.lit("")).alias("type"), F.coalesce("_e.value.description", F.lit("")).alias("description"))


_KG = "struct<central_entity:struct<name:string,type:string,relationships:array<struct<relation:string,target_name:string>>>>"


def kg_triples(df: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """(keys..., subject, relation, object) of entity-centred graphs; a target may be a name or a list of names."""
    c = F.from_json(payload, _KG)["central_entity"]
    rows = df.select(*keys, c["name"].alias("subject"), F.explode(c["relationships"]).alias("r"))
    names = F.coalesce(F.from_json("r.target_name", "array<string>"), F.array("r.target_name"))
    names = F.when(F.startswith("r.target_name", F.lit("[")), names).otherwise(F.array("r.target_name"))
    rows = rows.select(*keys, "subject", F.col("r.relation").alias("relation"), F.explode(names).alias("object"))
    return rows.where("subject is not null and relation is not null and object is not null")


def list_triples(df: DataFrame, relations: str, keys: list[str]) -> DataFrame:
    """(keys..., triple_ord, subject, relation, object) of arrays of three; shorter items go."""
    rows = df.select(*keys, F.posexplode(relations).alias("triple_ord", "t")).where("size(t) >= 3")
    return rows.select(*keys, "triple_ord", F.col("t")[0].alias("subject"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("object"))


#: Characters of the start of a probe that look it up.
GRAM = 12
#: Probes up to this number are broadcast; more are joined by a shuffle.
BROADCAST_PROBES = 100_000


def best_probe(items: DataFrame, docs: DataFrame, prefix: int = 250, probe: int = 80) -> DataFrame:
    """(item, doc_id, how): documents (doc_id, text) for items (item, text) by an equal start, else by probes.

    Four probes of an item are looked up; two hits in a document are needed and the document with most hits
    wins, the smaller id on ties. Probes meet documents through their first GRAM characters, whatever
    the script; only a probe shorter than that is compared with every document.
    """
    head = lambda c: F.substring(c, 1, prefix)
    exact = items.select("item", head("text").alias("h")).join(docs.select("doc_id", head("text").alias("h")), "h").groupBy("item").agg(F.min("doc_id").alias("doc_id"), F.lit("prefix").alias("how"))
    rest = items.join(exact.select("item"), "item", "left_anti")
    step = F.greatest(F.floor((F.length("text") - probe) / 3), F.lit(1))
    places = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (k * step + 1).cast("int"))
    probes = rest.select("item", "text", F.posexplode(places).alias("k", "at")).select("item", "k", F.substring(F.col("text"), F.col("at"), F.lit(probe)).alias("p"))
    probes = cut(probes.where("p <> ''").withColumn("key", F.substring("p", 1, GRAM)))
    keyed, short = (probes.where(F.length("p") >= GRAM), probes.where(F.length("p") < GRAM))
    keys = keyed.select("item", "k", "key")
    # every position of a text starts a run of GRAM characters
    grams = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))).alias("key"))
    near = grams.join(F.broadcast(keys) if keys.count() <= BROADCAST_PROBES else keys, "key").select("doc_id", "item", "k").distinct()
    hits = near.join(docs.select("doc_id", "text"), "doc_id").join(keyed.select("item", "k", "p"), ["item", "k"]).where(F.contains("text", F.col("p"))).select("item", "doc_id", "k")
    if not short.isEmpty():
        hits = hits.unionByName(docs.join(F.broadcast(short), F.contains("text", F.col("p"))).select("item", "doc_id", "k"))
    count = hits.select("item", "doc_id", "k").distinct().groupBy("item", "doc_id").agg(F.count("*").alias("n")).where("n >= 2")
    best = count.groupBy("item").agg(F.max(F.struct("n", (-F.col("doc_id")).alias("d"))).alias("m")).select("item", (-F.col("m.d")).alias("doc_id"), F.lit("probes").alias("how"))
    return exact.unionByName(best)
