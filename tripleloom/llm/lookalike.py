"""Visually identical text with different characters: one consistent form for texts that look the same.

Look-alike pairs of strings and code points are closed by union-find into classes; the member that the
corpus uses most is the representative of its class. A multi-pattern automaton then rewrites each text,
longest match first, until nothing changes. Pairs of documents come from equal rewritten texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table

# Letters of other scripts beside the Latin letters that they look like.
CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "а": "a", "е": "e", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "ѕ": "s", "у": "y", "х": "x", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
}
GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
}
# Code points that show nothing, and hyphens that show as the ASCII one.
INVISIBLE = tuple(
    map(chr, (0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF, *range(0xE0000, 0xE0080), *range(0xE0100, 0xE01F0)))
)
HYPHENS = ("\u2010", "\u2011", "\ufe63")
#: Every space separator of Unicode except the plain one.
BLANKS = tuple(c for c in map(chr, range(0x80, 0x3001)) if unicodedata.category(c) == "Zs")

#: Rows of one string that a task takes when pairs are formed; the rows of a string that has more are dealt out.
DEALT = 50_000


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def union(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def pairs() -> Iterator[tuple[str, str]]:
    """Pairs that look the same, by rule from the Unicode data except for the letters listed above."""
    for table_ in (CYRILLIC, GREEK):
        yield from table_.items()
    yield from ((c, "") for c in INVISIBLE)
    yield from ((c, " ") for c in BLANKS)
    yield from ((c, "-") for c in HYPHENS)
    for n in range(0x110000):
        kind, _, rest = unicodedata.decomposition(c := chr(n)).rpartition("> ")
        if not rest:
            continue
        if kind in ("<wide", "<narrow") or 0xFB00 <= n <= 0xFB06:
            yield c, unicodedata.normalize("NFKC", c)
        elif not kind or n in (0x0E33, 0x0EB3):  # canonical, or the Thai and Lao vowels written in two signs
            yield c, unicodedata.normalize("NFKD" if kind else "NFD", c)
            yield c, "".join(chr(int(x, 16)) for x in rest.split())


def rules(counts: dict[str, int], more: Iterable[tuple[str, str]] = ()) -> dict[str, str]:
    """Pattern -> representative, for the code points of the corpus; ties go to the smaller string.

    `more` has further pairs that look the same.

    A class that holds the empty string is deleted. Otherwise the most frequent member of a class is its
    representative, an accented letter counting whole and in parts. Classes are transitive: parts of a
    string that have other representatives put the rewritten string in the same class.
    """
    classes, known = Classes(), [*pairs(), *more]
    seen = set(counts)
    known = [(a, b) for a, b in known if a in seen or (len(b) > 1 and set(b) <= seen) or len(b) <= 1]
    for a, b in known:
        classes.union(a, b)
    # a string whose letters belong to other classes joins the string of their least members
    single: dict[str, str] = {}
    for x in list(classes.up):
        if len(x) == 1:
            members = single.setdefault(classes.find(x), x)
            single[classes.find(x)] = min(members, x)
    for a, b in known:
        if len(b) > 1:
            base = "".join(single.get(classes.find(ch), ch) if ch in classes.up else ch for ch in b)
            classes.union(a, base)
            if len(composed := unicodedata.normalize("NFC", base)) == 1:
                classes.union(base, composed)
    groups: dict[str, list[str]] = {}
    for x in list(classes.up):
        groups.setdefault(classes.find(x), []).append(x)
    found: dict[str, str] = {}
    for members in groups.values():
        if "" in members:
            best = ""
        else:
            best = min(members, key=lambda m: (-min((counts.get(ch, 0) for ch in m), default=0), len(m), m))
        for m in members:
            if m not in ("", best):
                found[m] = best
    return found


def char_class(chars: Iterable[str]) -> str:
    """A set of characters in a pattern, neighbours as ranges: a long list beyond the basic plane would be searched one by one."""
    points, out = sorted(map(ord, chars)), []
    for n in points:
        if out and n == out[-1][1] + 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return "[" + "".join(re.escape(chr(a)) + (f"-{re.escape(chr(z))}" if z > a else "") for a, z in out) + "]"


def rewriter(found: dict[str, str]):
    """text -> text by a multi-pattern automaton, leftmost longest, repeated until nothing changes."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for pattern, best in found.items():
        automaton.add_word(pattern, (len(pattern), best))
    if not found:
        return lambda text: text
    automaton.make_automaton()
    single = {ord(p): b for p, b in found.items() if len(p) == 1}
    # a pattern of several code points matches only where its second one occurs, which is mostly a mark
    seconds = {p[1] for p in found if len(p) > 1}
    touched = frozenset(seconds | {p for p in found if len(p) == 1})
    no_ascii = not any(c.isascii() for c in touched)
    multi = re.compile(char_class(seconds)) if seconds else None

    def once(text: str) -> str:
        if multi is None or not multi.search(text):
            return text.translate(single)  # what the automaton does when only one-letter patterns can match
        out, at = [], 0
        for end, (n, best) in automaton.iter_long(text):
            out += (text[at : end - n + 1], best)
            at = end + 1
        out.append(text[at:])
        return "".join(out)

    def rewrite(text: str) -> str:
        if no_ascii and text.isascii() or touched.isdisjoint(text):
            return text
        before = set()
        while (after := once(text)) != text:
            # a pass can only join what the one before left side by side, so few are needed; pairs that chase each other never end
            if after in before:
                raise ValueError("the pairs rewrite each other in a circle")
            before.add(text)
            text = after
        return text

    return rewrite


def code_points(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often the corpus uses each code point; bounded by the size of Unicode.

    Counts are combined within each task before the shuffle.
    """

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        total: Counter[str] = Counter()
        for b in batches:
            for x in b["t"]:
                if x:
                    total.update(x)
        if total:  # an empty frame of strings cannot be converted
            yield pd.DataFrame({"c": list(total), "n": list(total.values())})

    part = docs.select(F.col(text).alias("t")).mapInPandas(count, "c string, n long")
    return {r["c"]: r["n"] for r in part.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def consistent(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_text: bool = True, more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(id, canonical, look, own): the consistent form (if asked for) and 128-bit keys of form and text.

    A null text stays null with null keys, an empty text stays empty; every row of the input gives one
    row, repeated ids included.
    """
    found = rules(code_points(docs, text), more)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        rewrite = rewriter(found)
        for b in batches:
            forms = [None if t is None else rewrite(t) for t in b["t"]]
            out = {"id": b["id"], "look": [None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in forms]}
            out["own"] = [None if t is None else xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in b["t"]]
            if with_text:
                out["canonical"] = forms
            if len(b):
                yield pd.DataFrame(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, look binary, own binary" + ", canonical string" * with_text
    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).mapInPandas(run, schema)


def mixed_looks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(look, own, id) of the rows whose look several different strings share, each once.

    Classes of exact copies only are dropped by a grouped minimum and maximum.
    """
    keys = cut(consistent(docs, id_col, text, with_text=False, more=more).where("id is not null and look is not null"))
    mixed = keys.groupBy("look").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("look")
    return cut(keys.join(mixed, "look", "left_semi").select("look", "own", "id").distinct())


def variants(rows: DataFrame) -> DataFrame:
    """(look, own, rep, n): the strings of each look with their smallest document and number of documents."""
    return rows.groupBy("look", "own").agg(F.min("id").alias("rep"), F.count("*").alias("n"))


def look_members(docs: DataFrame, id_col: str = "doc_id", text: str = "text", more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(look_id, string_id, id): membership; a look and a string are named by their smallest document."""
    rows = mixed_looks(docs, id_col, text, more)
    look = Window.partitionBy("look")
    least = variants(rows).select("look", "own", F.min("rep").over(look).alias("look_id"), F.col("rep").alias("string_id"))
    return rows.join(least, ["look", "own"]).select("look_id", "string_id", "id")


def same_look_pairs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """(doc_a, doc_b), a before b, of texts that differ as strings but have one consistent form.

    Pairs are formed between strings first, one row a string, and then filled with their documents, so copies of one
    string never meet each other. The documents of a string with more than DEALT are dealt over several keys. Null ids
    and texts form no pair; repeated rows count once; other columns are ignored; an empty table gives no row.
    """
    rows = mixed_looks(docs, id_col, text, more)
    every = cut(variants(rows).withColumn("deals", F.ceil(F.col("n") / DEALT)))
    # at most rows / DEALT strings are dealt out
    hot = F.broadcast(every.where("deals > 1").select("look", "own", "deals"))
    rows = rows.join(hot, ["look", "own"], "left").withColumn("deal", F.pmod(F.xxhash64("id"), F.coalesce("deals", F.lit(1))))

    def side(x: str) -> DataFrame:
        return rows.select("look", F.col("own").alias(f"own_{x}"), F.col("deal").alias(f"deal_{x}"), F.col("id").alias(f"id_{x}"))

    deals = lambda x: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"deals_{x}") - 1)).alias(f"deal_{x}")
    a, b = (every.select("look", F.col("own").alias(f"own_{x}"), F.col("deals").alias(f"deals_{x}")) for x in "ab")
    strings = a.join(b, "look").where("own_a < own_b")
    half = strings.select("*", deals("a")).join(side("a"), ["look", "own_a", "deal_a"])
    full = half.select("look", "own_b", "deals_b", "id_a").select("look", "own_b", "id_a", deals("b")).join(side("b"), ["look", "own_b", "deal_b"])
    # documents that share an identifier are no pair
    return full.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b")).distinct()


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_look_pairs(table(spark, folder, "documents"))


def p8_consistent(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in its consistent form, and whether that changed it."""
    docs = table(spark, folder, "documents")
    return consistent(docs).select(F.col("id").alias("doc_id"), "canonical", (F.col("look") != F.col("own")).alias("changed"))


def p8_members(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of a look that several strings share, under the look's and its own string's smallest document."""
    return look_members(table(spark, folder, "documents")).select("look_id", "string_id", F.col("id").alias("doc_id"))


QUERIES = {"p8_found": p8_found, "p8_consistent": p8_consistent, "p8_members": p8_members}


def sql_look(text: str) -> str:
    """SQL of a form that texts of one look share, whatever the corpus prefers: one-to-one letters, then composed accents."""
    one: dict[str, str] = {**CYRILLIC, **GREEK, **{c: " " for c in BLANKS}, **{c: "-" for c in HYPHENS}}
    several: dict[str, str] = {"\u0e33": "\u0e4d\u0e32", "\u0eb3": "\u0ecd\u0eb2"}
    for n in range(0x80, 0x30000):
        kind, _, rest = unicodedata.decomposition(c := chr(n)).rpartition("> ")
        if not rest or c in one or c in several:
            continue
        if kind in ("<wide", "<narrow") or 0xFB00 <= n <= 0xFB06:
            new = unicodedata.normalize("NFKC", c)
        elif not kind:
            new = unicodedata.normalize("NFC", "".join(one.get(x, x) for x in unicodedata.normalize("NFD", c)))
        else:
            continue
        if new != unicodedata.normalize("NFC", c) or kind:
            (one if len(new) == 1 else several)[c] = "".join(one.get(x, x) for x in new) if len(new) == 1 else new
    out = f"regexp_replace({text}, '[{''.join(f'\\x{{{ord(c):x}}}' for c in INVISIBLE)}]', '', 'g')"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for c, new in several.items():
        out = f"replace({out}, {quoted(c)}, {quoted(new)})"
    return f"nfc_normalize(translate({out}, {quoted(''.join(one))}, {quoted(''.join(one.values()))}))"


_LOOKS = f"WITH t AS (SELECT doc_id, text, {sql_look('text')} AS look FROM documents WHERE text IS NOT NULL), m AS (SELECT *, min(doc_id) OVER (PARTITION BY look) AS look_id, min(doc_id) OVER (PARTITION BY text) AS string_id FROM t WHERE look IN (SELECT look FROM t GROUP BY 1 HAVING count(DISTINCT text) > 1)) "
ORACLE = {
    "p8_found": _LOOKS + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM m a JOIN m b ON a.look = b.look AND a.doc_id < b.doc_id AND a.text <> b.text",
    "p8_members": _LOOKS + "SELECT look_id, string_id, doc_id FROM m",
}
