"""Object resolution: triples whose objects hide entities, repaired by rule or handed to a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, squeeze
from .matching import matches, segments

# Words dropped before a merged prefix, and marks stripped around it.
LEADING = ("and", "then", "or")
STRIPPED = ",.:;!?"
#: A merged relation of more than MANY words keeps those up to KEPT.
MANY, KEPT = 10, 8


def normalized(text: Column) -> Column:
    """Lower case, no marks at the ends, single blanks, no leading article."""
    t = F.lower(squeeze(text))
    t = F.regexp_replace(t, r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")
    return F.regexp_replace(t, r"^(?:a|an|the)\s+", "")


def valid_relation(s: Column, r: Column, o: Column) -> Column:
    """Whether the relation contains neither subject nor object."""
    low = F.lower(r)
    return ~(F.contains(low, F.lower(s)) | F.contains(low, F.lower(o)))


def merged_relation(relation: Column, prefix: Column) -> Column:
    """The relation extended by what stood before the entity in the object."""
    p = F.regexp_replace(prefix, f"^[{STRIPPED}\\s]+|[{STRIPPED}\\s]+$", "")
    p = F.regexp_replace(p, r"^(?:" + "|".join(LEADING) + r")(?:\s+|$)", "")
    words = F.filter(F.split(F.concat_ws(" ", relation, p), r"\s+"), lambda w: w != "")
    return let(words, lambda w: F.array_join(F.when(F.size(w) > MANY, F.slice(w, 1, KEPT)).otherwise(w), " "))


def resolved(triples: DataFrame, entities: DataFrame, key: str = "triple_id", group: str = "doc_id", parts: bool = False) -> DataFrame:
    """(key, group, subject, relation, object, status, method, entity): every triple once, repaired where a rule can.

    No entity in the object: clean. One that is the whole object: kept as exact. One with text only before
    it: that text joins the relation and the entity becomes the object. Text after it too, the rule appends
    both sides to the relation and marks the triple for a rewrite by a model. Several entities: failed here, to be
    split by a model. Entities come from the names of the same group. With `parts`, the entities of the object
    and the texts around them come along, the relation as stated, the object as compared, and the start of the evidence.
    """
    names = entities.select(group, normalized(F.col("name")).alias("name")).where("length(name) > 1").distinct()
    context = F.substring("evidence", 1, 500) if "evidence" in triples.columns else F.lit(None).cast("string")
    texts = triples.select(key, group, "subject", "relation", "object", context.alias("_context"), normalized(F.col("object")).alias("_norm"))
    found = matches(texts, names, [key], group, "_norm", "name")
    df = texts.join(found, key, "left")
    one, n = F.col("found")[0], F.coalesce(F.size("found"), F.lit(0))
    n = F.when(F.col("found").isNull(), 0).otherwise(n)
    before = F.trim(F.substring(F.col("_norm"), F.lit(1), one["st"]))
    after = F.trim(F.substring(F.col("_norm"), one["en"] + 1, F.length("_norm")))
    method = (
        F.when(n == 0, "none").when(n > 1, "multi").when(F.col("_norm") == one["term"], "exact").when(after == "", "prefix").otherwise("rewrite")
    )
    df = df.withColumns({"method": method, "_before": before, "_after": after, "_n": n})
    sides = F.trim(F.concat_ws(" ", "_before", "_after"))
    moved = F.col("method").isin("prefix", "rewrite")
    relation = F.when(moved, merged_relation(F.col("relation"), sides)).otherwise(F.col("relation"))
    obj = F.when(moved, one["term"]).otherwise(F.col("object"))
    status = F.when(n == 0, "clean").when(n == 1, "repaired").otherwise("failed")
    return df.select(key, group, "subject", relation.alias("relation"), obj.alias("object"), status.alias("status"), "method", F.col("_n").alias("n_entities"), *([segments(F.col("_norm"), F.col("found")).alias("parts"), F.col("_context").alias("context"), F.col("relation").alias("stated"), F.col("_norm").alias("whole")] if parts else []))


def valid_split(entities: Column, objects: Column) -> Column:
    """Whether a model's split is acceptable: every entity meets some object, and no object is blank."""
    low = F.transform(objects, lambda o: F.lower(squeeze(o)))
    return F.forall(low, lambda o: o != "") & F.forall(entities, lambda e: F.exists(low, lambda o: F.contains(o, F.lower(e)) | F.contains(F.lower(e), o)))
