"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as other languages' regular expressions see it.
WS = r"(?U)\s+"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once; written out, its code would be repeated at every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """White space runs to one blank, none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(text, WS, " "))


def blank_to_null(text: Column) -> Column:
    return F.when(text != "", text)


def clean_entity(text: Column, max_words: int | None = 3) -> Column:
    """Lower case, single blanks, the first words only if limited; blank becomes null."""
    t = squeeze(text)
    if max_words:
        t = F.array_join(F.slice(F.split(t, " "), 1, max_words), " ")
    return blank_to_null(F.lower(t))


def clean_relation(text: Column) -> Column:
    return F.lower(squeeze(text))


def for_match(text: Column) -> Column:
    """Lower case, single blanks, and no blanks around punctuation."""
    t = F.lower(squeeze(text))
    return F.regexp_replace(F.regexp_replace(t, r"\s+(?=[^\w\s])", ""), r"(?<=[^\w\s])\s+", "")


def letters_and_digits(text: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def edge_string(s: Column, r: Column, o: Column) -> Column:
    """The parts of a triple joined by semicolons, lower case."""
    return F.lower(F.trim(F.concat_ws(";", F.coalesce(s, F.lit("")), F.coalesce(r, F.lit("")), F.coalesce(o, F.lit("")))))


def verbalized(s: Column, r: Column, o: Column) -> Column:
    """The parts that are not blank, joined by blanks."""
    return F.concat_ws(" ", *(blank_to_null(squeeze(x)) for x in (s, r, o)))


def malformed(s: Column, r: Column, o: Column) -> Column:
    """Whether a part is missing or blank."""
    return F.exists(F.array(s, r, o), lambda x: F.coalesce(squeeze(x), F.lit("")) == "")


def templated(s: Column, r: Column, o: Column) -> Column:
    return F.concat(squeeze(s), F.lit(" "), squeeze(r), F.lit(" "), squeeze(o), F.lit("."))


def without_thinking(text: Column) -> Column:
    """What follows the first closing think tag; the whole text if there is none."""
    at = F.instr(text, "</think>")
    return F.when(at > 0, F.trim(F.substring(text, at + 8, F.length(text)))).otherwise(text)


def without_fence(text: Column) -> Column:
    """The inside of a fenced answer, without the language tag."""
    t = F.regexp_replace(squeeze_ends(text), r"^```(?:json)?\s*", "")
    return squeeze_ends(F.regexp_replace(t, r"\s*```$", ""))


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parsed_statement(text: Column) -> Column:
    """First line of an answer without fence, label and outer quotes; blank becomes null."""
    t = F.regexp_replace(without_fence(text), r"(?i)^statement:\s*", "")
    line = squeeze_ends(F.split(t, "\n")[0])
    return blank_to_null(squeeze_ends(F.regexp_replace(line, "^\"|\"$", "")))


def with_json_word(prompt: Column) -> Column:
    """Adds a closing request for JSON to a prompt that does not mention it."""
    return F.when(F.contains(F.lower(prompt), F.lit("json")), prompt).otherwise(F.concat(prompt, F.lit("\n\nAnswer in JSON.")))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WS), lambda w: w != ""))


def char_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters; two empty texts give 0."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    x, y = F.array_remove(x, ""), F.array_remove(y, "")
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(0.0)


def percent(text: Column) -> Column:
    """"66.67%" as 66.67; what is no number becomes null."""
    return F.regexp_replace(F.trim(text), r"\s*%$", "").try_cast("double")


def config_hash(config: Column) -> Column:
    """First twelve hexadecimal digits of the SHA-256 of a configuration text."""
    return F.substring(F.sha2(config, 256), 1, 12)


def name_class(name: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first rule whose fragment the lower-case name contains."""
    out = None
    for fragment, label in rules:
        hit = F.contains(F.lower(name), F.lit(fragment))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def entity_label(n: Column, binary: bool = False) -> Column:
    """ambiguous, single or multi by the number of entities; in binary form none counts as multi."""
    return F.when(n == 1, "single").when(n >= 2, "multi").otherwise("multi" if binary else "ambiguous")


# Plural endings, what they become, and the least length of a word beside the ending.
PLURALS = (("ies", "y", 3), ("sses", "ss", 3), ("xes", "x", 3))


def lemma(word: Column) -> Column:
    """A lower-case word without its English plural ending; a stand-in for a lemmatiser."""
    out = None
    for end, new, least in PLURALS:
        hit = F.endswith(word, F.lit(end)) & (F.length(word) >= len(end) + least)
        stem = F.concat(F.substring(word, F.lit(1), F.length(word) - len(end)), F.lit(new))
        out = F.when(hit, stem) if out is None else out.when(hit, stem)
    s = F.endswith(word, F.lit("s")) & (F.length(word) > 3) & ~word.rlike("(?:ss|us|is)$")
    return out.when(s, F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def lemmas(text: Column, lemmatise=lemma) -> Column:
    """Words of a text in lower case, each by its lemma. `lemmatise` is a column function, a dictionary lookup for instance."""
    return F.array_join(F.transform(F.split(F.lower(squeeze(text)), " "), lemmatise), " ")


# Function words and pronouns that name nothing.
STOP = tuple("a an the and or but if of in on at to by for from with as is are was were be been it its he she they we you i this that these those which who whom whose what his her their our your my not no".split())


def content_lemmas(text: Column, lemmatise=lemma) -> Column:
    """Distinct lemmas of the words of a text that are neither numbers, signs, pronouns nor function words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(*STOP) & ~w.rlike(r"^[\p{N}_]+$")), lemmatise))
