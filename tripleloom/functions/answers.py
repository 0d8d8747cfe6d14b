"""Parsing of model answers: triples in several shapes, verdicts, batch envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_to_null, let, squeeze_ends, without_fence, without_thinking

# Names that the parts of a triple go by, in order of preference.
ALIASES = {"subject": ("subject", "head", "source"), "relation": ("relation", "predicate", "relation_type"), "object": ("object", "tail", "target")}
# Verdicts, and what older verdicts became.
VERDICTS = ("SUPPORTED", "NOT_SUPPORTED")
OLD_VERDICTS = {"CONTRADICTED": "NOT_SUPPORTED", "NOT_STATED": "NOT_SUPPORTED"}

_ITEM = ", ".join(f"{k} string" for ks in ALIASES.values() for k in ks)


def json_body(text: Column) -> Column:
    """The JSON part of an answer: no thinking, no fence, and nothing before the first or after the last bracket."""
    t = without_fence(without_thinking(text))
    return F.regexp_extract(t, r"(?s)([\[{].*[\]}])", 1)


def answer_triples(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., triple_ord, subject, relation, object) of answers that hold triples.

    An answer is {"triples": [...]} or a bare list; an item is an object under any alias or a list of three.
    Triples with a blank part and answers that do not parse give no row.
    """
    v = F.try_parse_json(json_body(F.col(text)))
    items = F.coalesce(F.try_variant_get(v, "$.triples", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
    rows = df.select(*keep, F.posexplode(items).alias("triple_ord", "_item"))

    def part(i: int, name: str) -> Column:
        named = [F.try_variant_get("_item", f"$.{k}", "string") for k in ALIASES[name]]
        return blank_to_null(squeeze_ends(F.coalesce(*named, F.try_variant_get("_item", f"$[{i}]", "string"))))

    out = rows.select(*keep, "triple_ord", *(part(i, n).alias(n) for i, n in enumerate(ALIASES)))
    return out.where("subject is not null and relation is not null and object is not null")


def triple_columns(df: DataFrame) -> DataFrame:
    """Fills subject, relation and object from the payload where all three columns are null."""
    v = F.try_parse_json("payload")
    bare = F.col("subject").isNull() & F.col("relation").isNull() & F.col("object").isNull()
    for name, ks in ALIASES.items():
        df = df.withColumn(f"_{name}", F.when(bare, F.coalesce(*(F.try_variant_get(v, f"$.{k}", "string") for k in ks))).otherwise(F.col(name)))
    return df.drop(*ALIASES, "payload").withColumnsRenamed({f"_{n}": n for n in ALIASES})


def binary_verdict(text: Column) -> Column:
    """1 or 0 of true, false, "1", "0" in any dress; anything else is null."""
    t = F.lower(F.regexp_replace(squeeze_ends(text), r"^\"|\"$|\.$", ""))
    return F.when(t.isin("1", "true", "yes"), 1).when(t.isin("0", "false", "no"), 0)


def verdict(text: Column) -> Column:
    """A known verdict in upper case, old ones mapped; anything else, null too, is JUDGE_ERROR."""
    t = F.translate(F.upper(squeeze_ends(text)), "- ", "__")
    out = F.when(t.isin(*VERDICTS), t)
    for old, new in OLD_VERDICTS.items():
        out = out.when(t == old, new)
    return out.otherwise("JUDGE_ERROR")


def category(text: Column, known: tuple[str, ...]) -> Column:
    """An upper-case category with underscores if it is known, else null."""
    t = F.translate(F.upper(squeeze_ends(text)), "- ", "__")
    return F.when(t.isin(*known), t)


def response_status(success: Column, status: Column, content: Column) -> Column:
    """ok or the reason why a batch answer failed."""
    return F.when(~F.coalesce(success, F.lit(False)), "error").when(content.isNull(), "missing").when(status >= 400, "status").otherwise("ok")


def response_text(body: Column, path: str = "output") -> Column:
    """Text parts of a nested answer body joined: output[].content[].text, or choices[].message.content."""
    v = F.try_parse_json(body)
    if path == "chat":
        return F.try_variant_get(v, "$.choices[0].message.content", "string")
    if path == "parts":
        return F.array_join(F.try_variant_get(v, "$.candidates[0].content.parts", "array<struct<text:string>>").getField("text"), "")
    parts = F.try_variant_get(v, "$.output", "array<struct<content:array<struct<text:string>>>>")
    return F.array_join(F.flatten(F.transform(parts, lambda p: F.coalesce(p["content"].getField("text"), F.array().cast("array<string>")))), "")


def inner_relation(sentence: Column, subject: Column, entity: Column) -> Column:
    """What stands between the subject that begins a sentence and the entity that ends it, in lower case.

    Without these ends the text before the last place of the entity counts. Fewer than two characters are null.
    """
    whole = F.regexp_replace(F.lower(squeeze_ends(sentence)), r"[.!?]+$", "")
    ends = F.struct(F.lower(squeeze_ends(subject)).alias("a"), F.lower(squeeze_ends(entity)).alias("b"), whole.alias("s"))

    def without_subject(t: Column) -> Column:
        return F.when((t["a"] != "") & F.startswith(t["s"], t["a"]), F.substring(t["s"], F.length(t["a"]) + 1, F.length(t["s"]))).otherwise(t["s"])

    def before_entity(t: Column) -> Column:
        s, b = t["s"], t["b"]
        # characters before the last place of the entity
        cut_at = F.length(s) - F.instr(F.reverse(s), F.reverse(b)) - F.length(b) + 1
        return F.when((b != "") & F.endswith(s, b), F.substring(s, F.lit(1), F.length(s) - F.length(b))).when((b != "") & F.contains(s, b), F.substring(s, F.lit(1), cut_at)).otherwise(s)

    inner = let(ends, lambda t: let(F.struct(t["b"].alias("b"), without_subject(t).alias("s")), before_entity))
    return let(squeeze_ends(inner), lambda r: F.when(F.length(r) >= 2, r))


def strict_triples(text: Column) -> Column:
    """Array of (subject, relation, object) of an answer: a list, {"triples": [...]} or one object; null if any item is bad or none is there."""
    v = F.try_parse_json(json_body(text))
    items = F.coalesce(F.try_variant_get(v, "$.triples", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.when(F.try_variant_get(v, "$.subject", "string").isNotNull(), F.array(v)))
    part = lambda x, k: blank_to_null(squeeze_ends(F.try_variant_get(x, f"$.{k}", "string")))
    rows = F.transform(items, lambda x: F.struct(*(part(x, k).alias(k) for k in ALIASES)))
    good = F.forall(rows, lambda t: t["subject"].isNotNull() & t["relation"].isNotNull() & t["object"].isNotNull())
    return F.when((F.size(rows) > 0) & good, rows)
