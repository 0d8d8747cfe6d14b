"""Filling fixed-capacity containers with items, in the order of a space-filling curve.

Hashed word counts of each text are projected to a few dimensions and placed on a Hilbert curve. The curve
is range-sorted, and every range is packed in one pass over windows of neighbours: longest first, each into
the open container that it fills best. Only texts above the capacity are split, into full containers and a
remainder that is packed like any other item.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .tokens import DEFAULT_TOKENIZER, tokenizer

DIMS, BITS, HASHED = 4, 8, 512
#: Neighbours that are sorted by length before packing, and containers that stay open.
WINDOW, OPEN = 1024, 512
#: Tokens that one task packs; a range leaves at most OPEN containers partly filled, most of them nearly full.
RANGE_TOKENS = 50_000_000

_WORD = re.compile(r"[^\W_]+")
_NO_BLANKS = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_PROJECTION = np.random.default_rng(20240601).standard_normal((HASHED, DIMS))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) with `bits` bits a dimension."""
    x = points.astype(np.int64).copy()
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, d - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(texts: list[str]) -> np.ndarray:
    counts = np.zeros((len(texts), HASHED))
    for i, t in enumerate(texts):
        for w in _WORD.findall(t.lower()):
            if _NO_BLANKS.search(w):
                for k in range(max(1, len(w) - 1)):
                    counts[i, zlib.crc32(w[k : k + 2].encode("utf-8", "surrogatepass")) % HASHED] += 1
            else:
                counts[i, zlib.crc32(w.encode("utf-8", "surrogatepass")) % HASHED] += 1
    np.log1p(counts, out=counts)
    norm = np.linalg.norm(counts, axis=1, keepdims=True)
    spread = (counts / np.maximum(norm, 1e-12)) @ _PROJECTION
    # the projection of a unit vector is about standard normal: its distribution function spreads the cells evenly
    cell = (1 / (1 + np.exp(-1.7 * spread)) * (1 << BITS)).astype(np.int64)
    return hilbert(np.clip(cell, 0, (1 << BITS) - 1))


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", tokens_from: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(id, n_tokens, curve) of every text that is not null; the tokens of whole texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tokenizer(tokens_from)
        for batch in batches:
            # a few hundred texts at a time bound the dense counts
            for a in range(0, len(batch), 512):
                part = batch.iloc[a : a + 512]
                texts = part["t"].tolist()
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n_tokens": [len(encoding.encode_ordinary(t)) for t in texts], "curve": curve_keys(texts)})

    return docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null").mapInPandas(run, f"id {kind}, n_tokens bigint, curve bigint")


class Packer:
    """Best fit into a bounded number of open containers; windows of items arrive longest first."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.open: list[tuple[int, int]] = []  # (room, container), sorted

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, n: int) -> int:
        at = bisect_left(self.open, (n, -1))
        if at < len(self.open):
            room, box = self.open.pop(at)
        else:
            room, box = self.capacity, self.new()
        if room - n > 0:
            insort(self.open, (room - n, box))
            if len(self.open) > OPEN:
                self.open.pop(0)  # the fullest
        return box


def pack_window(packer: Packer, ids: list, sizes: list[int]) -> list[tuple]:
    """(id, part_no, container, first token, token after the last) for a window of items."""
    cap, rows, rest = packer.capacity, [], []
    for id_, n in zip(ids, sizes):
        at = part = 0
        if n > cap:
            while n - at >= cap:
                rows.append((id_, part, packer.new(), at, at + cap))
                at, part = at + cap, part + 1
        if n - at > 0 or n == 0:
            rest.append((n - at, id_, part, at))
    rest.sort(key=lambda r: -r[0])
    for left, id_, part, at in rest:
        rows.append((id_, part, packer.put(left), at, at + left))
    return rows


def containers(sized: DataFrame, capacity: int) -> DataFrame:
    """(id, part_no, container_id, tok_start, tok_end) of items (id, n_tokens, curve).

    An item of at most the capacity stays whole; a larger one fills containers of its own and its remainder
    is packed. An empty text takes a place of size zero. Repeated rows are repeated items; an empty table
    gives no row. Items of one curve place, such as copies, are spread over ranges by their id.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_TOKENS))
    spread = F.xxhash64("id")
    ordered = sized.select("id", "n_tokens", "curve", spread.alias("h")).repartitionByRange(ranges, "curve", "h").sortWithinPartitions("curve", "h")
    kind = sized.schema["id"].dataType.simpleString()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer, ids, sizes = Packer(capacity), [], []

        def rows() -> pd.DataFrame:
            out = pd.DataFrame(pack_window(packer, ids, sizes), columns=["id", "part_no", "container_id", "tok_start", "tok_end"])
            out["container_id"] += base
            ids.clear()
            sizes.clear()
            return out

        for batch in batches:
            for id_, n in zip(batch["id"].tolist(), batch["n_tokens"].tolist()):
                ids.append(id_)
                sizes.append(n)
                if len(ids) == WINDOW:
                    yield rows()
        if ids:
            yield rows()

    return ordered.select("id", "n_tokens").mapInPandas(run, f"id {kind}, part_no int, container_id bigint, tok_start bigint, tok_end bigint")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every text in a container, for each container capacity of size_limits."""
    sized = cut(measured(table(spark, folder, "documents")))
    limits = table(spark, folder, "size_limits").where("pipeline like 'pack%' and unit = 'tokens'").select("pipeline", "max_size").distinct().orderBy("pipeline").collect()
    parts = [containers(sized, r.max_size).select(F.lit(r.pipeline).alias("pipeline"), "container_id", F.col("id").alias("doc_id"), "part_no", "tok_start", "tok_end") for r in limits]
    schema = f"pipeline string, container_id bigint, doc_id {sized.schema['id'].dataType.simpleString()}, part_no int, tok_start bigint, tok_end bigint"
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity: containers, tokens and the share of room that is used."""
    boxes = p6_containers(spark, folder).groupBy("pipeline", "container_id").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("used"))
    limits = table(spark, folder, "size_limits").select("pipeline", "max_size").distinct()
    agg = boxes.groupBy("pipeline").agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
    return agg.join(limits, "pipeline").select("pipeline", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("max_size"))).alias("fill"))


def p6_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Per capacity and document: whether its parts hold every token once, only split above the capacity, in containers that fit."""
    rows = p6_containers(spark, folder)
    limits = table(spark, folder, "size_limits").select("pipeline", "max_size").distinct()
    over = cut(rows.groupBy("pipeline", "container_id").agg(F.sum(F.col("tok_end") - F.col("tok_start")).alias("used")).join(limits, "pipeline").where("used > max_size").select("pipeline", "container_id"))
    rows = rows.join(over.withColumn("over", F.lit(True)), ["pipeline", "container_id"], "left").join(limits, "pipeline")
    size = F.max("tok_end")
    whole = (F.min("tok_start") == 0) & (F.sum(F.col("tok_end") - F.col("tok_start")) == size) & ((F.count("*") == 1) | (size > F.first("max_size"))) & (F.count("over") == 0)
    return rows.groupBy("pipeline", "doc_id").agg(whole.alias("whole"))


QUERIES = {"p6_containers": p6_containers, "p6_fill": p6_fill, "p6_cover": p6_cover}
ORACLE = {"p6_cover": "SELECT DISTINCT pipeline, doc_id, true AS whole FROM documents, size_limits WHERE pipeline LIKE 'pack%' AND unit = 'tokens' AND text IS NOT NULL"}
