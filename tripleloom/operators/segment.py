"""Text segmentation: rule sentences, and chunks by sentences, characters or paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, word_count

#: Blanks after a closing mark, but not after a single letter and a point. Spelled without word boundaries, which
#: engines define differently beside accented letters.
SENTENCE_GAP = r"(?<![^\p{L}\p{N}_][A-Za-z]\.)(?<!^[A-Za-z]\.)(?<=[.!?])\s+"


def rule_sentences(text: Column) -> Column:
    """Array of the sentences of a text, blank ones dropped."""
    return F.filter(F.split(text, SENTENCE_GAP), lambda s: F.regexp_replace(s, r"\s+", "") != "")


def sentence_rows(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep..., pos, sentence), pos from 0."""
    return docs.select(*keep, F.posexplode(rule_sentences(F.col(text))).alias("pos", "sentence"))


def sentence_chunks(docs: DataFrame, keep: list[str], text: str = "text", size: int = 4) -> DataFrame:
    """(keep..., chunk_id, text, word_count): `size` sentences a chunk, chunk_id from 1; a text without sentence is one chunk.

    The chunks are slices of the sentence array, so nothing is shuffled.
    """
    s = F.when(F.size(rule_sentences(F.col(text))) > 0, rule_sentences(F.col(text))).otherwise(F.array(F.col(text)))
    rows = docs.where(F.col(text).isNotNull()).select(*keep, s.alias("_s"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("_s") / size).cast("int") - 1)
    rows = rows.select(*keep, F.explode(F.transform(starts, lambda i: F.struct((i + 1).alias("chunk_id"), squeeze(F.array_join(F.slice("_s", i * size + 1, size), " ")).alias("text")))).alias("_c"))
    return rows.select(*keep, "_c.chunk_id", "_c.text", word_count(F.col("_c.text")).alias("word_count"))


def pack_chars(sentences: list[str], most: int) -> list[str]:
    """Greedy chunks of sentences up to `most` characters; a longer sentence is cut at words, a longer word stays whole."""
    out, now = [], ""
    for s in sentences:
        pieces = [s]
        if len(s) > most:
            pieces, line = [], ""
            for w in s.split():
                if line and len(line) + 1 + len(w) > most:
                    pieces.append(line)
                    line = w
                else:
                    line = f"{line} {w}" if line else w
            if line:
                pieces.append(line)
        for p in pieces:
            if now and len(now) + 1 + len(p) > most:
                out.append(now)
                now = p
            else:
                now = f"{now} {p}" if now else p
    return [*out, now] if now else out


_GAP = re.compile(r"(?<![\W][A-Za-z]\.)(?<!^[A-Za-z]\.)(?<=[.!?])\s+")


def char_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 5000) -> DataFrame:
    """(id, chunk_id, text): greedy chunks of whole sentences up to a number of characters."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k + 1, c) for i, t in zip(b["id"], b["t"]) for k, c in enumerate(pack_chars([s for s in _GAP.split(t) if s.strip()], most))]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "chunk_id", "text"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where("t is not null").mapInPandas(run, f"id {kind}, chunk_id int, text string")


def pack_paragraphs(text: str, most: int = 300, carry: int = 50, stride: int = 250) -> list[str]:
    """Paragraphs packed up to `most` words, each chunk beginning with the last `carry` words of the one before.

    The paragraph that follows carried words is not checked against the limit with them, so a chunk may reach `most` +
    `carry` words; later paragraphs are. A longer paragraph becomes windows every `stride` words, without a carry.
    """
    out: list[str] = []
    now: list[str] = []
    for p in re.split(r"\n\s*\n", text):
        words = p.split()
        if not words:
            continue
        if len(words) > most:
            if now:
                out.append(" ".join(now))
                now = []
            for a in range(0, len(words), stride):
                out.append(" ".join(words[a : a + most]))
                if a + most >= len(words):
                    break
            continue
        if now and len(now) + len(words) > most:
            out.append(" ".join(now))
            now = now[-carry:] + words
        else:
            now = now + words
    if now:
        out.append(" ".join(now))
    return out


def paragraph_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", most: int = 300, carry: int = 50, stride: int = 250) -> DataFrame:
    """(id, chunk_id, text): paragraph windows with carried words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k + 1, c) for i, t in zip(b["id"], b["t"]) for k, c in enumerate(pack_paragraphs(t, most, carry, stride))]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "chunk_id", "text"])

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where("t is not null").mapInPandas(run, f"id {kind}, chunk_id int, text string")


def sentence_numbers(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """(keep..., sentence, sentence_no): a repeated sentence has the number of its last place, from 1."""
    return sentence_rows(docs, keep, text).groupBy(*keep, "sentence").agg((F.max("pos") + 1).alias("sentence_no"))
