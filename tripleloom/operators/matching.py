"""Entities inside texts: bounded search, all spans, non-overlapping matches, order and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(term: Column) -> Column:
    """A pattern that matches the term literally."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def first_place(text: Column, term: Column) -> Column:
    """Offset of the first whole-word hit of a term, from 0; null if there is none."""
    at = F.regexp_instr(text, F.concat(F.lit(r"\b"), quoted(term), F.lit(r"\b")))
    return F.when((term != "") & (at > 0), at - 1)


def all_places(text: Column, term: Column) -> Column:
    """Offsets of all hits of a term that no ASCII letter or digit touches, from 0."""
    gaps = F.split(text, F.concat(F.lit("(?<![a-z0-9])"), quoted(term), F.lit("(?![a-z0-9])")), -1)
    n = F.length(term)
    ends = F.transform(F.slice(gaps, 1, F.size(gaps) - 1), lambda g, i: F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * n)
    return F.when(F.size(gaps) > 1, ends).otherwise(F.array().cast("array<int>"))


def keep_longest(spans: Column) -> Column:
    """Spans (nl, st, en, term), nl being minus the length, kept longest first where they do not overlap, in order of place."""
    kind = "array<struct<nl:int,st:int,en:int,term:string>>"
    kept = F.aggregate(
        F.array_sort(spans),
        F.array().cast(kind),
        lambda acc, x: F.when(F.exists(acc, lambda k: ~((x["en"] <= k["st"]) | (x["st"] >= k["en"]))), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_sort(kept, lambda a, b: a["st"] - b["st"])


def span(at: Column, term: Column) -> Column:
    return F.struct((-F.length(term)).alias("nl"), at.cast("int").alias("st"), (at + F.length(term)).cast("int").alias("en"), term.alias("term"))


def _pairs_beyond_ascii(text: Column) -> Column:
    """Neighbouring characters of a text that are not both ASCII, marked as keys."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    return F.transform(F.filter(F.transform(at, lambda i: F.substring(text, i, F.lit(2))), lambda p: p.rlike(r"[^\x00-\x7f]")), lambda p: F.concat(F.lit("#"), p))


def matches(texts: DataFrame, terms: DataFrame, keys: list[str], group: str, text: str, term: str) -> DataFrame:
    """(keys..., found): per text the non-overlapping terms of its group, longest first, listed by place.

    Texts and terms are in lower case; `keys` name a text. A hit holds the first ASCII word of its term as a whole word,
    so texts meet terms by group and word, not every text of a group with every term; terms without an ASCII word go by
    their first two characters. The words travel without their text, which is fetched once for the terms it may hold.
    """
    word = F.regexp_extract("_term", "[a-z0-9]+", 0)
    names = terms.select(group, F.col(term).alias("_term")).where("_term <> ''").distinct()
    names = names.withColumn("_key", F.when(word != "", word).otherwise(F.concat(F.lit("#"), F.substring("_term", 1, 2))))
    t = F.col(text)
    runs = F.array_distinct(F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0)))
    runs = F.when(t.rlike(r"[^\x00-\x7f]"), F.array_union(runs, _pairs_beyond_ascii(t))).otherwise(runs)
    words = texts.select(*keys, group, F.explode(runs).alias("_key"))
    may = words.join(names, [group, "_key"]).groupBy(*keys).agg(F.collect_set("_term").alias("_terms"))
    rows = texts.select(*keys, t.alias("_text")).distinct().join(may, keys)
    held = F.filter("_terms", lambda x: F.contains(F.col("_text"), x))
    spans = F.flatten(F.transform(held, lambda x: F.transform(all_places(F.col("_text"), x), lambda at: span(at, x))))
    return rows.withColumn("_spans", spans).where(F.size("_spans") > 0).select(*keys, keep_longest(F.col("_spans")).alias("found"))


def segments(text: Column, found: Column) -> Column:
    """(term, before, after) of each match in order: the text up to it since the match before, and up to the next one."""
    n = F.size(found)
    return F.transform(
        found,
        lambda m, i: F.struct(
            m["term"].alias("term"),
            F.trim(F.substring(text, F.when(i > 0, F.try_element_at(found, i)["en"]).otherwise(0) + 1, m["st"] - F.when(i > 0, F.try_element_at(found, i)["en"]).otherwise(0))).alias("before"),
            F.trim(F.substring(text, m["en"] + 1, F.when(i + 1 < n, F.try_element_at(found, i + 2)["st"]).otherwise(F.length(text)) - m["en"])).alias("after"),
        ),
    )
