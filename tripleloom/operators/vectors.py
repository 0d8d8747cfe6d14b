"""Vector similarity: cosine, top-k, thresholded pairs inside groups, and match scores between two sides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors that one task compares at a time with as many others.
BLOCK = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one of them is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def similar_pairs(vectors: DataFrame, group: str, id_col: str, vec: str, least: float, strict: bool = False) -> DataFrame:
    """(group, i, j, sim), i before j, of the pairs inside a group whose cosine reaches `least` (passes it if strict).

    Each group is dealt into blocks of about BLOCK vectors; a block meets every block of its group once, as
    one matrix product, so a large group spreads over many tasks and only pairs above the bar come out.
    """
    kind = {c: vectors.schema[c].dataType.simpleString() for c in (group, id_col)}
    sizes = vectors.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias("_nb"))
    rows = vectors.select(group, F.col(id_col).alias("_id"), F.col(vec).alias("_v")).join(sizes, group)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.col("_nb")))
    # a vector goes to the pairs (its block, other block) it belongs to, the smaller block first
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nb") - 1)))
    rows = rows.select(group, "_id", "_v", "_b", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        m = np.array(pdf["_v"].tolist(), dtype=np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        ids, block = pdf["_id"].to_numpy(), pdf["_b"].to_numpy()
        a, b = np.flatnonzero(block == x), np.flatnonzero(block == y)
        sim = m[a] @ m[b].T
        hit = sim > least if strict else sim >= least
        p, q = np.nonzero(hit)
        i, j, s = ids[a[p]], ids[b[q]], sim[p, q]
        # inside one block a pair turns up in both orders, between two blocks once in either order
        keep = i < j if x == y else i != j
        i, j, s = i[keep], j[keep], s[keep]
        return pd.DataFrame({"g": [key[0]] * len(i), "i": np.minimum(i, j), "j": np.maximum(i, j), "sim": s})

    return rows.groupBy(group, "_x", "_y").applyInPandas(run, f"g {kind[group]}, i {kind[id_col]}, j {kind[id_col]}, sim double").withColumnRenamed("g", group)


def top_k(scores: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each query, ties by the smaller `tie`; adds `rank` from 1."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(tie))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_sides(scores: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """(keys..., precision, recall, f1) by many-to-many matching of score rows (keys..., p, g, sim).

    Each prediction and each gold item counts its best score, or 0 below `least`.
    """
    def side(c: str, name: str) -> DataFrame:
        best = scores.groupBy(*keys, c).agg(F.max("sim").alias("m"))
        return best.groupBy(*keys).agg(F.avg(F.when(F.col("m") >= least, F.col("m")).otherwise(0.0)).alias(name))

    both = side("p", "precision").join(side("g", "recall"), keys)
    s = F.col("precision") + F.col("recall")
    return both.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0))


def assignment(score: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) of greatest total score, by shortest augmenting paths with potentials."""
    flip = score.shape[0] > score.shape[1]
    cost = -(score.T if flip else score)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            reduced = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (reduced < low[1:])
            low[1:][better], back[1:][better] = reduced[better], j0
            j1 = 1 + int(np.argmin(np.where(free, low[1:], np.inf)))
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[back[j0]], back[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) for a, b in pairs) if flip else sorted(pairs)


def one_to_one(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., total, precision, recall, f1) by the best one-to-one matching of score rows (keys..., p, g, sim).

    The keys must bound the groups to what a task can hold; missing cells score 0.
    """
    kinds = ", ".join(f"{k} {scores.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, g = pdf["p"].factorize(sort=True), pdf["g"].factorize(sort=True)
        m = np.zeros((len(p[1]), len(g[1])))
        m[p[0], g[0]] = pdf["sim"]
        total = float(sum(m[a, b] for a, b in assignment(m)))
        pr, re_ = total / m.shape[0], total / m.shape[1]
        row = {k: pdf[k].iloc[0] for k in keys} | {"total": total, "precision": pr, "recall": re_, "f1": 2 * pr * re_ / (pr + re_) if pr + re_ else 0.0}
        return pd.DataFrame([row])

    return scores.groupBy(*keys).applyInPandas(run, f"{kinds}, total double, precision double, recall double, f1 double")


def letter_vectors(tokens: list[str], dims: int = 64) -> np.ndarray:
    """Unit vectors of hashed letter pairs, a stand-in for the token vectors of a model."""
    import zlib

    out = np.zeros((len(tokens), dims))
    for i, t in enumerate(tokens):
        t = f" {t} "
        for k in range(len(t) - 1):
            out[i, zlib.crc32(t[k : k + 2].encode("utf-8", "surrogatepass")) % dims] += 1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def token_scores(a: Column, b: Column, encode=letter_vectors) -> Column:
    """(precision, recall, f1) of two texts by the best cosine of each token with the tokens of the other text; zeros if one is empty."""

    @F.pandas_udf("precision double, recall double, f1 double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            x, y = (x or "").lower().split(), (y or "").lower().split()
            if not x or not y:
                rows.append((0.0, 0.0, 0.0))
                continue
            m = encode(x) @ encode(y).T
            p, r = float(m.max(1).mean()), float(m.max(0).mean())
            rows.append((p, r, 2 * p * r / (p + r) if p + r else 0.0))
        return pd.DataFrame(rows, columns=["precision", "recall", "f1"])

    return run(a, b)
