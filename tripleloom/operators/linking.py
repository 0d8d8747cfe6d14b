"""Links between entities and triples: evidence, descriptions, pairs without a link, exact differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ends(triples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., end) of both ends of each triple in lower case, once where they are equal."""
    both = F.array_distinct(F.array(F.lower("subject"), F.lower("object")))
    return triples.select(*keys, F.explode(both).alias("end"))


def first_evidence(entities: DataFrame, triples: DataFrame, name: str, order: str, n: int = 3) -> DataFrame:
    """(doc_id, entity, k, evidence): the first n different evidences of triples that touch each entity.

    Evidence is made distinct by its first place before it is ranked.
    """
    touch = ends(triples.where("evidence is not null"), ["doc_id", "evidence", order])
    names = entities.select("doc_id", F.lower(name).alias("end")).distinct()
    hits = names.join(touch, ["doc_id", "end"]).groupBy("doc_id", "end", "evidence").agg(F.min(order).alias("place"))
    w = Window.partitionBy("doc_id", "end").orderBy("place", "evidence")
    return hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("doc_id", F.col("end").alias("entity"), "k", "evidence")


def descriptions(triples: DataFrame, order: str) -> DataFrame:
    """(doc_id, entity, description): the links of each entity as seen from it, in order, joined by semicolons."""
    out = triples.select("doc_id", F.col("subject").alias("entity"), (F.col(order) * 2).alias("place"), F.concat_ws(" -> ", "relation", "object").alias("line"))
    into = triples.select("doc_id", F.col("object").alias("entity"), (F.col(order) * 2 + 1).alias("place"), F.concat_ws(" -> ", "subject", "relation").alias("line"))
    rows = out.unionByName(into)
    return rows.groupBy("doc_id", "entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "; ").alias("description"))


def unlinked(members: DataFrame, triples: DataFrame) -> DataFrame:
    """(doc_id, cluster, name) of the members that no triple links to another member of their cluster."""
    m = members.select("doc_id", "cluster", F.lower("name").alias("name")).distinct()
    e = triples.select("doc_id", F.lower("subject").alias("x"), F.lower("object").alias("y")).where("x <> y").distinct()
    x = m.select("doc_id", F.col("cluster"), F.col("name").alias("x"))
    y = m.select("doc_id", F.col("cluster"), F.col("name").alias("y"))
    inside = e.join(x, ["doc_id", "x"]).join(y, ["doc_id", "cluster", "y"])
    linked = inside.select("doc_id", "cluster", F.explode(F.array("x", "y")).alias("name")).distinct()
    return m.join(linked, ["doc_id", "cluster", "name"], "left_anti")


def new_triples(found: DataFrame, stated: DataFrame) -> DataFrame:
    """Distinct found triples that are not stated, then the stated ones: (doc_id, subject, relation, object, origin)."""
    key = ["doc_id", "subject", "relation", "object"]
    fresh = found.select(*key).distinct().join(stated.select(*key).distinct(), key, "left_anti")
    return fresh.withColumn("origin", F.lit("semantic")).unionByName(stated.select(*key, "origin"))


def checked_relations(triples: DataFrame, entities: DataFrame, name: str) -> DataFrame:
    """Triples whose both ends are entities of their document."""
    names = entities.select("doc_id", F.lower(name).alias("n")).distinct()
    df = triples.withColumns({"_s": F.lower("subject"), "_o": F.lower("object")})
    df = df.join(names.withColumnRenamed("n", "_s"), ["doc_id", "_s"], "left_semi").join(names.withColumnRenamed("n", "_o"), ["doc_id", "_o"], "left_semi")
    return df.drop("_s", "_o")


def overridden(entities: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, entity, description): the first part of the last description stored for a name, else `told` (doc_id, entity, told), else the name."""
    names = entities.where("name is not null").select("doc_id", F.lower("name").alias("entity")).distinct()
    own = entities.where("coalesce(description, '') <> ''").groupBy("doc_id", F.lower("name").alias("entity"))
    own = own.agg(F.split(F.max(F.struct("ent_id", "description"))["description"], ";;;")[0].alias("own"))
    both = names.join(told, ["doc_id", "entity"], "left").join(own, ["doc_id", "entity"], "left")
    return both.select("doc_id", "entity", F.coalesce("own", "told", "entity").alias("description"))


def context_vectors(names: DataFrame, evidence: DataFrame, embed, n: int = 3) -> DataFrame:
    """(doc_id, entity, vector): the mean of the vectors of a name and of its first n evidences joined; a name without evidence has its own.

    `evidence` comes from `first_evidence`; `embed` adds a column of vectors to a table, as in `embedded(df, text, out)`.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "evidence"))), lambda x: x["evidence"]), " ")
    told = evidence.where(F.col("k") <= n).groupBy("doc_id", "entity").agg(text.alias("_text"))
    rows = embed(embed(names.select("doc_id", "entity").join(told, ["doc_id", "entity"], "left"), "entity", "_v"), "_text", "_c")
    mean = F.when(F.col("_c").isNull(), F.col("_v")).otherwise(F.zip_with("_v", "_c", lambda a, b: (a + b) / 2))
    return rows.select("doc_id", "entity", mean.alias("vector"))
