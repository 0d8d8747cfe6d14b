"""Clusters of triples and entities: threshold components, unique-information ratio, merge, density and leader clustering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import star_components


def threshold_clusters(items: DataFrame, pairs: DataFrame, group: str, id_col: str) -> DataFrame:
    """(group, id, cluster): components of the pairs (group, i, j); the smallest id names a cluster.

    The ids must be unique over all groups. Large groups are no different from small ones: the components
    come from grouped minima and joins.
    """
    roots = star_components(pairs, "i", "j")
    return items.select(group, F.col(id_col).alias("id")).join(roots.withColumnRenamed("node", "id"), "id", "left").select(group, "id", F.coalesce("root", "id").alias("cluster"))


def information_ratio(clusters: DataFrame, group: str) -> DataFrame:
    """(group, n_items, n_clusters, uir): clusters over items, so 1 for a single item."""
    out = clusters.groupBy(group).agg(F.count("*").alias("n_items"), F.count_distinct("cluster").alias("n_clusters"))
    return out.withColumn("uir", F.col("n_clusters") / F.col("n_items"))


def pooled_ratio(per_group: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over groups of two items or more, mean over all, and clusters over items of all groups pooled."""
    real = F.when(F.col("n_items") >= 2, F.col("uir"))
    return per_group.groupBy(*keys).agg(
        F.count("*").alias("n_groups"), F.count(real).alias("n_real"), F.avg(real).alias("mean_real"), F.avg("uir").alias("mean_all"),
        (F.sum("n_clusters") / F.sum("n_items")).alias("pooled"), F.coalesce(F.stddev_pop(real), F.lit(0.0)).alias("std_real"),
    )


def merged_entities(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """(ent_id, name, descriptions, chunk_ids, n_merged): one entity a group, the first seen; distinct texts joined in order.

    `groups` has (ent_id, group_id). Texts are made distinct before they are gathered.
    """
    rows = entities.join(groups, "ent_id")
    first = rows.groupBy("group_id").agg(F.min(F.struct("ent_id", "name")).alias("m"), F.count_distinct("ent_id").alias("n_merged"))

    def joined(c: str, name: str) -> DataFrame:
        parts = rows.where(F.coalesce(F.col(c), F.lit("")) != "").select("group_id", c).distinct()
        return parts.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list(c)), ";;;").alias(name))

    out = first.join(joined("description", "descriptions"), "group_id", "left").join(joined("chunkid", "chunk_ids"), "group_id", "left")
    return out.select("m.ent_id", "m.name", "descriptions", "chunk_ids", "n_merged")


def leader_labels(vectors: np.ndarray, least: float) -> list[int]:
    """Order-dependent clusters: an item joins the best earlier leader that it reaches, or leads a new cluster."""
    leaders: list[int] = []
    labels = []
    for i, v in enumerate(vectors):
        best = max(leaders, key=lambda k: float(vectors[k] @ v), default=None)
        if best is not None and float(vectors[best] @ v) >= least:
            labels.append(best)
        else:
            leaders.append(i)
            labels.append(i)
    return labels


def density_labels(x: np.ndarray, min_size: int = 2, epsilon: float = 0.05) -> np.ndarray:
    """Clusters by excess of mass over the condensed single-linkage tree of Euclidean distances; -1 is noise.

    Minimum samples is 1, so mutual reachability is the distance itself; clusters that split below
    `epsilon` stay merged.
    """
    n = len(x)
    if n < max(2, min_size):
        return np.full(n, -1)
    seen, low, near, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):
        seen[at] = True
        # one row of distances at a time: the tree needs no matrix
        dist = np.sqrt(np.maximum(((x - x[at]) ** 2).sum(-1), 0))
        better = ~seen & (dist < low)
        low[better], near[better] = dist[better], at
        at = int(np.argmin(np.where(seen, np.inf, low)))
        edges.append((low[at], near[at], at))
    edges.sort()
    # single linkage: node n + k joins two nodes at a distance
    top, size, kids, height = list(range(n)), [1] * n, {}, {}

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    up = list(range(2 * n - 1))
    for k, (h, a, b) in enumerate(edges):
        p, q, new = root(a), root(b), n + k
        kids[new], height[new] = (p, q), h
        size.append(size[p] + size[q])
        up[p] = up[q] = new
    del top
    # condense: a split counts only if both sides have the least size
    clusters: dict[int, dict] = {}
    stack = [(2 * n - 2, None, 0.0)]
    while stack:
        node, parent, birth = stack.pop()
        me = {"parent": parent, "birth": birth, "mass": 0.0, "kids": [], "points": [], "height": None}
        clusters[node] = me
        todo = [node]
        while todo:
            c = todo.pop()
            if c < n:
                me["points"].append(c)
                continue
            lam = 1 / max(height[c], 1e-12)
            p, q = kids[c]
            if size[p] >= min_size and size[q] >= min_size:
                me["mass"] += size[c] * (lam - birth)
                me["kids"], me["height"] = [p, q], height[c]
                stack += [(p, node, lam), (q, node, lam)]
            else:
                for s in (p, q):
                    if size[s] < min_size:
                        me["mass"] += size[s] * (lam - birth)
                        me["points"] += _leaves(s, kids, n)
                    else:
                        todo.append(s)
    chosen: set[int] = set()
    best: dict[int, float] = {}
    for node in sorted(clusters):
        me = clusters[node]
        below = sum(best[k] for k in me["kids"])
        keep = me["parent"] is not None and (not me["kids"] or me["mass"] >= below or (me["height"] or 0) < epsilon)
        if keep:
            chosen -= set(_under(node, clusters))
            chosen.add(node)
        best[node] = max(me["mass"], below) if keep else below
    labels = np.full(n, -1)
    for i, node in enumerate(sorted(chosen)):
        for c in [node, *_under(node, clusters)]:
            labels[clusters[c]["points"]] = i
    return labels


def _leaves(node: int, kids: dict, n: int) -> list[int]:
    out, todo = [], [node]
    while todo:
        c = todo.pop()
        if c < n:
            out.append(c)
        else:
            todo += kids[c]
    return out


def _under(node: int, clusters: dict) -> list[int]:
    out, todo = [], list(clusters[node]["kids"])
    while todo:
        c = todo.pop()
        out.append(c)
        todo += clusters[c]["kids"]
    return out


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def per_group(vectors: DataFrame, group: str, id_col: str, vec: str, how) -> DataFrame:
    """(group, id, cluster) by an algorithm that needs a whole group; a task holds the vectors of one group of any size."""
    g, i = (vectors.schema[c].dataType.simpleString() for c in (group, id_col))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        return pd.DataFrame({"g": pdf["g"], "i": pdf["i"], "cluster": np.asarray(how(_unit(pdf["v"])), dtype=np.int64)})

    rows = vectors.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(vec).alias("v"))
    return rows.groupBy("g").applyInPandas(run, f"g {g}, i {i}, cluster bigint").withColumnsRenamed({"g": group, "i": id_col})


def leader_clusters(vectors: DataFrame, group: str, id_col: str, vec: str, least: float) -> DataFrame:
    """(group, id, cluster) as leader_labels gives them: groups are streamed in the order of their ids, only leaders are held."""
    g, i = (vectors.schema[c].dataType.simpleString() for c in (group, id_col))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, n, k, places, leaders = None, 0, 0, [], None
        for pdf in batches:
            if pdf.empty:
                continue
            labels = []
            for key, v in zip(pdf["key"].tolist(), _unit(pdf["v"])):
                if key != at:
                    at, n, k, places, leaders = key, 0, 0, [], np.empty((16, len(v)))
                sims = leaders[:k] @ v
                best = int(sims.argmax()) if k else -1
                if k and sims[best] >= least:
                    labels.append(places[best])
                else:
                    if k == len(leaders):
                        leaders = np.concatenate([leaders, np.empty_like(leaders)])
                    leaders[k] = v
                    k += 1
                    places.append(n)
                    labels.append(n)
                n += 1
            yield pd.DataFrame({"g": pdf["g"], "i": pdf["i"], "cluster": np.array(labels, dtype=np.int64)})

    rows = vectors.select(F.col(group).alias("g"), F.col(id_col).alias("i"), F.col(vec).alias("v"), F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"))
    rows = rows.repartition("key").sortWithinPartitions("key", "i")
    return rows.mapInPandas(run, f"g {g}, i {i}, cluster bigint").withColumnsRenamed({"g": group, "i": id_col})
