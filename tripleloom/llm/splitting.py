"""Splitting oversized items at natural boundaries, by lexical cohesion.

Sentences of an oversized text are compared block against block; where the similarity of the blocks on both
sides of a boundary has a valley, the topic changes. Within each size window the deepest valley is the cut,
and the next piece begins the stated overlap before it. A window without a sentence end is cut at a blank,
and one without a blank at a code point that starts a character.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .sentences import segment
from .tokens import DEFAULT_TOKENIZER, token_starts, tokenizer

#: Sentences on each side of a boundary that are compared.
BLOCK_SENTENCES = 3
#: Hashed word counts have so many places.
DIMS = 256
#: A cut keeps at least this share of the window unless no boundary lies beyond it.
LEAST_FILL = 0.5

_WORDS = re.compile(r"[^ \t\n]+")
_TERM = re.compile(r"[^\W_]+")
_NO_BLANKS = re.compile("[฀-๿぀-ヿ㐀-鿿]")


def _terms(sentence: str) -> Iterator[str]:
    for w in _TERM.findall(sentence.lower()):
        if _NO_BLANKS.search(w):
            yield from (w[i : i + 2] for i in range(max(1, len(w) - 1)))
        else:
            yield w


def valley_depths(sentences: list[str]) -> np.ndarray:
    """Depth of the similarity valley after each sentence but the last."""
    n = len(sentences)
    if n < 2:
        return np.zeros(max(0, n - 1))
    counts = np.zeros((n + 1, DIMS))
    for i, s in enumerate(sentences):
        for w in _terms(s):
            counts[i + 1, zlib.crc32(w.encode("utf-8", "surrogatepass")) % DIMS] += 1
    total = counts.cumsum(0)
    at = np.arange(1, n)
    left = total[at] - total[np.maximum(0, at - BLOCK_SENTENCES)]
    right = total[np.minimum(n, at + BLOCK_SENTENCES)] - total[at]
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    sim = np.einsum("ij,ij->i", left, right) / np.maximum(norm, 1e-12)
    # the peaks that enclose a valley: the highest similarity reached without first going down again
    up_left, up_right = sim.copy(), sim.copy()
    for i in range(1, n - 1):
        if sim[i - 1] >= sim[i]:
            up_left[i] = max(sim[i], up_left[i - 1])
    for i in range(n - 3, -1, -1):
        if sim[i + 1] >= sim[i]:
            up_right[i] = max(sim[i], up_right[i + 1])
    return up_left + up_right - 2 * sim


def cut_points(text: str, starts: list[int], ends: list[int], max_size: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first unit, unit after the last, kind of cut) of the pieces of a text whose units lie at [starts[i], ends[i])."""
    n = len(starts)
    if n <= max_size:
        return [(0, n, "end")]
    spans = segment([text])[0]
    depth = valley_depths([text[a:b] for a, b in spans])
    # sentence ends in units: the unit count up to the end; an end inside a unit is none
    bound: list[int] = []
    deep: list[float] = []
    for (_, e), d in zip(spans, depth):
        u = bisect_right(ends, e)
        if u < n and (u == 0 or ends[u - 1] <= e) and starts[u] >= e and (not bound or u > bound[-1]):
            bound.append(u)
            deep.append(float(d))
    by_char = ends[0] - starts[0] == 1 and ends[-1] - starts[-1] == 1 and n == len(text)
    overlap = max(0, min(overlap, max_size - 1))
    pieces, s, done = [], 0, 0
    while n - s > max_size:
        # beyond `done` there must be progress; up to the limit everything is allowed
        hi, lo = s + max_size, max(done, s + overlap) + 1
        kind = "sentence"
        a, b = bisect_left(bound, max(lo, s + int(max_size * LEAST_FILL))), bisect_right(bound, hi)
        if a >= b:
            a = bisect_left(bound, lo)
        if a < b:
            e = max(range(a, b), key=lambda i: (deep[i], bound[i]))
            e = bound[e]
        elif by_char:
            e, kind = hi, "blank"
            while e >= lo and not (text[e].isspace() and not text[e - 1].isspace()):
                e -= 1
            if e < lo:
                e, kind = hi, "hard"
                while e > lo and (unicodedata.combining(text[e]) or unicodedata.category(text[e]) in ("Mn", "Mc", "Cf")):
                    e -= 1
        else:
            e, kind = hi, "blank" if starts[hi] > ends[hi - 1] else "hard"
        pieces.append((s, e, kind))
        done, s = e, e - overlap
    pieces.append((s, n, "end"))
    return pieces


def units(text: str, unit: str, encoding=None) -> tuple[list[int], list[int]]:
    """(starts, ends) of the units of a text: code points, runs without space, tab and newline, or tokens."""
    if unit == "chars":
        return list(range(len(text))), list(range(1, len(text) + 1))
    if unit == "words":
        found = [m.span() for m in _WORDS.finditer(text)]
        return [a for a, _ in found], [b for _, b in found]
    starts = token_starts(encoding, text)
    return starts, [*starts[1:], len(text)] if starts else []


def size_in(text: Column, unit: Column) -> Column:
    """Size of a text in code points or words; tokens by the upper bound that bytes give."""
    words = F.size(F.filter(F.split(text, "[ \t\n]+"), lambda w: w != ""))
    return F.when(unit == "chars", F.length(text)).when(unit == "words", words).when(unit == "tokens", F.octet_length(text))


def split_oversized(items: DataFrame, tokens_from: str = DEFAULT_TOKENIZER) -> DataFrame:
    """Pieces of the items (id, text, unit, max_size, overlap) that exceed their size.

    Gives (id, piece_no, piece_start, piece_end, size, cut, text): code-point offsets, the size in the
    item's unit, and how the piece was cut: sentence, blank, hard or end. Consecutive pieces share exactly
    the overlap (at most max_size - 1). Items that fit, null texts, and items without unit or limit give no
    row; a size equal to the limit fits. Repeated ids count once.
    """
    big = items.where("id is not null and max_size > 0").where(size_in(F.col("text"), F.col("unit")) > F.col("max_size"))
    big = big.select("id", "text", "unit", "max_size", F.coalesce("overlap", F.lit(0)).alias("overlap")).dropDuplicates(["id", "unit"])
    kind = items.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece_no int, piece_start bigint, piece_end bigint, size int, cut string, text string"

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = None
        for batch in batches:
            rows = []
            for id_, text, unit, most, overlap in batch.itertuples(index=False):
                if unit == "tokens" and encoding is None:
                    encoding = tokenizer(tokens_from)
                starts, ends = units(text, unit, encoding)
                pieces = cut_points(text, starts, ends, int(most), int(overlap))
                if len(pieces) < 2:
                    continue
                for k, (a, b, cut) in enumerate(pieces):
                    x = 0 if a == 0 else starts[a]
                    y = len(text) if b == len(starts) else ends[b - 1]
                    rows.append((id_, k, x, y, b - a, cut, text[x:y]))
            if rows:
                yield pd.DataFrame(rows, columns=["id", "piece_no", "piece_start", "piece_end", "size", "cut", "text"])

    return big.mapInPandas(run, schema)


def chunk_items(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Chunks with the limit of their pipeline; the limits are a handful of rows, whatever the data."""
    lim = limits.where("pipeline is not null").groupBy("pipeline").agg(F.first("unit").alias("unit"), F.first("max_size").alias("max_size"), F.first("overlap").alias("overlap"))
    return chunks.select(F.col("chunk_uid").alias("id"), "text", "pipeline").join(lim, "pipeline")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(chunk_items(table(spark, folder, "chunks"), table(spark, folder, "size_limits")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece_no = 0").select(F.col("id").alias("chunk_uid"))


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).withColumnRenamed("id", "chunk_uid")


def p4_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per oversized chunk: where its pieces begin and end, pieces above the limit, and gaps between pieces: none of either."""
    limits = table(spark, folder, "size_limits").select("pipeline", "max_size")
    home = table(spark, folder, "chunks").select("chunk_uid", "pipeline").distinct().join(limits, "pipeline").select("chunk_uid", "max_size")
    p = p4_pieces(spark, folder).join(home, "chunk_uid")
    before = F.lag("piece_end").over(Window.partitionBy("chunk_uid").orderBy("piece_no"))
    p = p.withColumn("gap", F.coalesce(F.col("piece_start") > before, F.lit(False)))
    return p.groupBy("chunk_uid").agg(F.min("piece_start").alias("first"), F.max("piece_end").alias("last"), F.count_if(F.col("size") > F.col("max_size")).alias("n_large"), F.count_if("gap").alias("n_gaps"))


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_cover": p4_cover}
_LARGE = """FROM (SELECT DISTINCT chunk_uid, text, pipeline FROM chunks) c JOIN size_limits l ON l.pipeline = c.pipeline
WHERE CASE l.unit WHEN 'chars' THEN length(c.text) WHEN 'words' THEN len(list_filter(regexp_split_to_array(c.text, '[ \\t\\n]+'), lambda w: w <> '')) END > l.max_size"""
ORACLE = {
    "p4_found": """
SELECT DISTINCT c.chunk_uid FROM chunks c JOIN size_limits l ON l.pipeline = c.pipeline
WHERE CASE l.unit WHEN 'chars' THEN length(c.text) WHEN 'words' THEN len(list_filter(regexp_split_to_array(c.text, '[ \\t\\n]+'), lambda w: w <> '')) END > l.max_size""",
    # gaps between pieces can only be blanks, which no unit of words holds
    "p4_cover": "SELECT chunk_uid, 0::BIGINT AS first, length(text)::BIGINT AS last, 0::BIGINT AS n_large, 0::BIGINT AS n_gaps " + _LARGE,
}
