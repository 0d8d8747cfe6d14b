"""Evaluation texts leaking into training text, found through a positional inverted index.

The corpus is counted for the terms of the test items, all of it. Each window of the wanted length is looked up by
the term of it that the corpus uses least, and the postings (term, document, position) of these terms and of the
second rarest are stored and intersected after taking off their offset. The lists of the other, common terms are
stored for the documents that are left only, and intersected at the same offset; runs of consecutive positions are leaks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .lookalike import CYRILLIC, GREEK, INVISIBLE

#: Consecutive words, or letters and digits for items in scripts without blanks, that make a leak.
MIN_WORDS = 12
MIN_CHARS = 24
BY_CHARS = ("zh",)
#: Offsets that a proximity match may drift apart by inserted or dropped words.
DRIFT = 3
#: Offsets of a document that the search for proximity matches takes at once.
BLOCK = 4096
#: Terms and anchors up to this number are broadcast (20 bytes each at most); more are joined by a shuffle.
BROADCAST_TERMS = 200_000


def _letters() -> tuple[str, str]:
    """(from, to) of the one-to-one folding: look-alikes by shape, full-width forms, accents off; the rest of `from` is deleted."""
    pairs = {**CYRILLIC, **GREEK}
    for n in range(0xFF10, 0xFF5B):
        if (c := chr(n)).isalnum():
            pairs[c] = chr(n - 0xFEE0)
    for n in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", c := chr(n))
        if len(base) > 1 and all(unicodedata.combining(x) for x in base[1:]):
            pairs[c] = pairs.get(base[0], base[0])
    gone = [*INVISIBLE, *map(chr, range(0x300, 0x370))]
    gone = [c for c in gone if c not in pairs and (c in INVISIBLE or unicodedata.combining(c))]
    return "".join(pairs) + "".join(gone), "".join(pairs.values())


_FROM, _TO = _letters()
# a capital that looks Latin must fold like its small letter, whatever that looks like
_SMALL = {k.lower(): v.lower() for k, v in CYRILLIC.items() if k.isupper() and k.lower() not in CYRILLIC}
_LIGATURES = {chr(n): unicodedata.normalize("NFKC", chr(n)) for n in range(0xFB00, 0xFB07)} | {"ß": "ss"}


def folded(text: Column) -> Column:
    """Lower-case text of one shape per letter; signs and blanks are left for the split."""
    out = text
    for a, b in _LIGATURES.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.translate(F.lower(F.translate(out, _FROM, _TO)), "".join(_SMALL), "".join(_SMALL.values()))
    # an ASCII text has one byte a character and nothing to fold but case
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(out)


def words(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.array_remove(F.split(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def letters(text: Column) -> Column:
    """Letters and digits, in order."""
    return F.array_remove(F.split(F.regexp_replace(folded(text), r"[^\p{L}\p{N}]+", ""), ""), "")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, by_char, need, ipos, term) of items (item_id, lang, text); repeated items count once."""
    base = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    by_char = F.lower(F.coalesce("lang", F.lit(""))).substr(1, 2).isin(*BY_CHARS)
    toks = F.when(by_char, letters(F.col("text"))).otherwise(words(F.col("text")))
    need = F.when(by_char, MIN_CHARS).otherwise(MIN_WORDS)
    out = base.select("item_id", by_char.alias("by_char"), need.alias("need"), F.posexplode(toks).alias("ipos", "tok"))
    return out.select("item_id", "by_char", "need", "ipos", _term().alias("term"))


def _term() -> Column:
    return F.xxhash64(F.col("tok"), F.col("by_char"))


def postings(docs: DataFrame, vocabulary: DataFrame, chars_too: bool) -> DataFrame:
    """(term, doc_id, pos) of the training text for the terms of the vocabulary (a table of distinct terms)."""
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    streams = rows.select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "tok"), F.lit(False).alias("by_char"))
    if chars_too:
        han = rows.where(F.col("text").rlike(r"\p{IsHan}"))
        streams = streams.unionByName(han.select("doc_id", F.posexplode(letters(F.col("text"))).alias("pos", "tok"), F.lit(True).alias("by_char")))
    return _with(streams.select(_term().alias("term"), "doc_id", "pos"), vocabulary, "term", "left_semi")


def _with(big: DataFrame, small: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join with a stored table, broadcast only if it is counted to be small."""
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_TERMS else small, on, how)


def aligned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, need, off, ipos): item positions that the document repeats at one offset, around its rarest terms."""
    terms = cut(item_terms(items))
    vocabulary = cut(terms.select("term").distinct())
    chars_too = not terms.where("by_char").isEmpty()
    counts = postings(docs, vocabulary, chars_too).groupBy("term").agg(F.count("*").alias("n"))
    rated = cut(terms.join(counts, "term", "left").select("item_id", "need", "ipos", "term", F.coalesce("n", F.lit(0)).alias("n")))
    # the two rarest terms of each window; a window with a term that the corpus lacks cannot occur in it
    picks = []
    for need in (MIN_WORDS, MIN_CHARS):
        w = Window.partitionBy("item_id").orderBy("ipos").rowsBetween(0, need - 1)
        rare = F.sort_array(F.collect_list(F.struct("n", "ipos", "term")).over(w))
        best = rated.where(F.col("need") == need).select("item_id", rare.alias("m")).where((F.size("m") == need) & (F.col("m")[0]["n"] > 0))
        one, two = F.col("m")[0], F.col("m")[1]
        picks.append(best.select("item_id", one["ipos"].alias("apos"), one["term"].alias("term"), two["ipos"].alias("bpos"), two["term"].alias("bterm")).distinct())
    anchors = cut(picks[0].unionByName(picks[1]))
    index = cut(postings(docs, cut(anchors.select("term").union(anchors.select("bterm")).distinct()), chars_too))
    hits = _with(index, anchors, "term").select("item_id", "doc_id", (F.col("pos") - F.col("apos")).alias("off"), "apos", "bpos", F.col("bterm").alias("term"))
    # the list of the second rarest term, its offset taken off, leaves few of the hits
    hits = hits.withColumn("pos", F.col("off") + F.col("bpos")).join(index, ["doc_id", "term", "pos"])
    hits = cut(hits.groupBy("item_id", "doc_id", "off").agg(F.min("apos").alias("lo"), F.max("apos").alias("hi")))
    # the postings that the windows around the hits would need, at their place in the document
    near = terms.select("item_id", "need", "ipos", "term")
    wanted = hits.join(near, "item_id").where("ipos > lo - need and ipos < hi + need")
    wanted = wanted.select("item_id", "doc_id", "need", "off", "ipos", "term", (F.col("ipos") + F.col("off")).alias("pos"))
    found_in = _with(docs.select("doc_id", "text"), cut(hits.select("doc_id").distinct()), "doc_id", "left_semi")
    return wanted.join(postings(found_in, vocabulary, chars_too), ["doc_id", "term", "pos"]).select("item_id", "doc_id", "need", "off", "ipos").distinct()


def runs(matches: DataFrame) -> DataFrame:
    """(item_id, doc_id, need, off, first, length) of maximal runs of consecutive positions at one offset."""
    w = Window.partitionBy("item_id", "doc_id", "off").orderBy("ipos")
    islands = matches.withColumn("island", F.col("ipos") - F.row_number().over(w))
    return islands.groupBy("item_id", "doc_id", "off", "island").agg(F.first("need").alias("need"), F.min("ipos").alias("first"), F.count("*").alias("length")).drop("island")


def exact_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id) for each item of which the document repeats a passage of the least length, word for word.

    Null texts and ids match nothing; items shorter than the least length cannot leak; repeated rows
    count once; other columns are ignored; an empty table on either side gives no row.
    """
    return runs(aligned(docs, items)).where("length >= need").select("item_id", "doc_id").distinct()


def _near(stream: np.ndarray, vocabulary: np.ndarray, first: np.ndarray, item: np.ndarray, ipos: np.ndarray, need: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(item code, longest, matched) of the items that a document, a stream of terms, matches within DRIFT offsets.

    Places of the vocabulary's term k are first[k]:first[k + 1] of item and ipos; `most` is the largest place.
    """
    n, blocks = len(first) - 1, []
    at = np.minimum(np.searchsorted(vocabulary, stream), n - 1)
    pos = np.flatnonzero(vocabulary[at] == stream)
    at = at[pos]
    # an offset belongs to one block; the last DRIFT of a block are the first of the next
    for start in range(-most, len(stream), BLOCK):
        lo, hi = np.searchsorted(pos, (start, start + BLOCK + DRIFT + most))
        k, p = at[lo:hi], pos[lo:hi]
        size = first[k + 1] - first[k]
        where = np.repeat(first[k] - np.cumsum(size) + size, size) + np.arange(size.sum())
        off = np.repeat(p, size) - ipos[where] - start
        fits = (off >= 0) & (off < BLOCK + DRIFT)
        blocks.append((start, item[where[fits]], off[fits], ipos[where[fits]]))
    # cells of DRIFT + 1 offsets: a window lies in two neighbours, so both together must hold enough hits
    wide = (min(BLOCK, len(stream) + most) + DRIFT) // (DRIFT + 1) + 2
    some = np.zeros(len(need), bool)
    for _, i, off, _ in blocks:
        cells = np.bincount(i * wide + off // (DRIFT + 1), minlength=len(need) * wide).reshape(len(need), wide)
        some |= (cells[:, :-1] + cells[:, 1:]).max(1) >= need
    best: dict[int, list[int]] = {}
    for start, i, off, at in blocks:
        keep = some[i]
        i, off, at = i[keep], off[keep], at[keep]
        order = np.lexsort((at, off, i))
        i, off, at = i[order], off[order], at[order]
        new = np.ones(len(i), bool)
        new[1:] = (np.diff(i) != 0) | (np.diff(off) != 0) | (np.diff(at) != 1)
        edge = np.flatnonzero(new)
        for c, length in zip(i[edge].tolist(), np.diff([*edge, len(i)]).tolist()):
            b = best.setdefault(c, [0, 0])
            b[0] = max(b[0], length)
        for c in np.unique(i).tolist():
            a, z = np.searchsorted(i, (c, c + 1))
            o, x = off[a:z], at[a:z]
            starts = np.unique(o)
            left, right = np.searchsorted(o, starts), np.searchsorted(o, starts + DRIFT, "right")
            # only windows of more hits than the best so far can hold more positions
            for l, r in zip(left.tolist(), right.tolist()):
                if r - l > best[c][1]:
                    best[c][1] = max(best[c][1], len(np.unique(x[l:r])))
    return [(c, *b) for c, b in best.items() if b[1] >= need[c]]


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, kind, longest, matched): exact leaks, and proximity matches of as many words at drifting offsets.

    `longest` is the longest run at one offset, `matched` the item positions met within DRIFT offsets, counted over
    all terms: a match needs no particular word. Documents are read one by one against the places of the items' terms,
    those of about BROADCAST_TERMS places at a time.
    """
    terms = cut(item_terms(items))
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    hashed = lambda toks, by_char: F.transform(toks, lambda t: F.xxhash64(t, F.lit(by_char)))
    kind = f"code int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, longest int, matched int"
    out = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {docs.schema['doc_id'].dataType.simpleString()}, need int, longest int, matched int")
    for by_char in (False, True):
        side = terms.where(F.col("by_char") == by_char)
        parts = -(-side.count() // BROADCAST_TERMS) if BROADCAST_TERMS else 1
        stream = rows.where(F.col("text").rlike(r"\p{IsHan}")).select("doc_id", hashed(letters(F.col("text")), True).alias("s")) if by_char else rows.select("doc_id", hashed(words(F.col("text")), False).alias("s"))
        for part in range(parts):
            mine = side.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
            ids = mine.groupBy("item_id").agg(F.first("need").alias("need"), F.count("*").alias("n")).where("n >= need").toPandas()
            if not len(ids):
                continue
            ids["code"] = np.arange(len(ids), dtype=np.int32)
            codes = spark.createDataFrame(ids[["code", "item_id", "need"]], f"code int, item_id {items.schema['item_id'].dataType.simpleString()}, need int")
            places = mine.join(F.broadcast(codes.select("code", "item_id")), "item_id").select("term", "code", "ipos").toPandas().sort_values("term", kind="stable")
            vocabulary, first = np.unique(places["term"].to_numpy(), return_index=True)
            shared = spark.sparkContext.broadcast((vocabulary, np.append(first, len(places)), places["code"].to_numpy().astype(np.int64), places["ipos"].to_numpy().astype(np.int64), ids["need"].to_numpy().astype(np.int64), int(places["ipos"].max())))

            def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    found = []
                    for doc, s in zip(batch.column(0), batch.column(1)):
                        found += [(c, doc.as_py(), a, b) for c, a, b in _near(s.values.to_numpy(), *shared.value)]
                    cols = list(zip(*found)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], batch.schema.field(0).type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["code", "doc_id", "longest", "matched"])

            out = out.unionByName(stream.mapInArrow(run, kind).join(F.broadcast(codes), "code").drop("code"))
    out = out.groupBy("item_id", "doc_id").agg(F.max("need").alias("need"), F.max("longest").alias("longest"), F.max("matched").alias("matched"))
    return out.select("item_id", "doc_id", F.when(F.col("longest") >= F.col("need"), "exact").otherwise("near").alias("kind"), "longest", "matched")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return exact_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return leak_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {"p7_found": p7_found, "p7_report": p7_report}


def _sql_folded(text: str) -> str:
    for a, b in _LIGATURES.items():
        text = f"replace({text}, '{a}', '{b}')"
    return f"translate(lower(translate({text}, '{_FROM}', '{_TO}')), '{''.join(_SMALL)}', '{''.join(_SMALL.values())}')"


_GRAMS = "(SELECT DISTINCT {id} AS id, unnest(list_transform(range(1, len(t) - {last} + 1), lambda i: array_to_string(t[i : i + {last}], '{sep}'))) AS g FROM (SELECT {id}, {toks} AS t FROM {table} WHERE {where}) WHERE len(t) > {last})"
_SQL_WORDS = f"list_filter(regexp_split_to_array({_sql_folded('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_SQL_LETTERS = f"list_filter(string_split(regexp_replace({_sql_folded('text')}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'), ''), lambda w: w <> '')"


def _sql_leaks(toks: str, need: int, sep: str, items: str, docs: str) -> str:
    side = lambda id_, table_, where: _GRAMS.format(id=id_, toks=toks, last=need - 1, sep=sep, table=table_, where=where)
    return f"SELECT DISTINCT i.id AS item_id, d.id AS doc_id FROM {side('item_id', 'benchmark', items)} i JOIN {side('doc_id', 'documents', docs)} d USING (g)"


ORACLE = {
    "p7_found": _sql_leaks(_SQL_WORDS, MIN_WORDS, " ", "coalesce(lang, '') NOT LIKE 'zh%'", "text IS NOT NULL")
    + " UNION "
    + _sql_leaks(_SQL_LETTERS, MIN_CHARS, "", "lang LIKE 'zh%'", "regexp_matches(text, '\\p{Han}')")
}
