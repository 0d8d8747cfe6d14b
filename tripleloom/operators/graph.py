"""Graphs from triples: vertices in order of appearance, degrees and statistics, ranks, strong components."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, squeeze
from ..session import cut


def clean_edges(triples: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., src, rel, dst) of the triples without a blank part; repeated relations stay."""
    parts = {"src": "subject", "rel": "relation", "dst": "object"}
    out = triples.select(*keep, *(blank_to_null(squeeze(F.col(c))).alias(n) for n, c in parts.items()))
    return out.where("src is not null and rel is not null and dst is not null")


def vertices(edges: DataFrame, group: str, order: str) -> DataFrame:
    """(group, name, place): distinct ends by first appearance, a subject before the object of its triple."""
    ends = edges.select(group, F.col("src").alias("name"), (F.col(order) * 2).alias("place")).unionByName(edges.select(group, F.col("dst").alias("name"), (F.col(order) * 2 + 1).alias("place")))
    return ends.groupBy(group, "name").agg(F.min("place").alias("place"))


def graph_stats(edges: DataFrame, group: str) -> DataFrame:
    """Per group: nodes, parallel-free edges, relations, relation names, mean and largest degree, density, reciprocity, relation entropy.

    Parallel edges count once in degrees and density, every triple counts in relation counts.
    """
    simple = edges.select(group, "src", "dst").distinct()
    ends = simple.select(group, F.col("src").alias("v")).unionByName(simple.select(group, F.col("dst").alias("v")))
    deg = ends.groupBy(group, "v").agg(F.count("*").alias("deg"))
    nodes = deg.groupBy(group).agg(F.count("*").alias("n_nodes"), F.sum("deg").alias("_d"), F.max("deg").alias("max_degree"))
    back = simple.select(group, F.col("src").alias("dst"), F.col("dst").alias("src"), F.lit(1).alias("back"))
    e = simple.join(back, [group, "src", "dst"], "left").groupBy(group).agg(F.count("*").alias("n_edges"), F.count("back").alias("_back"))
    rel = edges.groupBy(group, "rel").agg(F.count("*").alias("c"))
    rel = rel.groupBy(group).agg(F.sum("c").alias("n_relations"), F.count("*").alias("n_relation_names"), F.sum(F.col("c") * F.log2("c")).alias("_clog"))
    df = nodes.join(e, group).join(rel, group)
    return df.select(
        group, "n_nodes", "n_edges", "n_relations", "n_relation_names", "max_degree",
        (F.col("_d") / F.col("n_nodes")).alias("mean_degree"),
        F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("density"),
        (F.col("_back") / F.col("n_edges")).alias("reciprocity"),
        (F.log2("n_relations") - F.col("_clog") / F.col("n_relations")).alias("relation_entropy"),
    )


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(v, rank) by power iteration over distinct (src, dst) edges; ranks sum to 1, dangling mass is spread evenly.

    Contributions are combined by vertex before the shuffle, so a hub costs no more than its edges.
    """
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("n_out"))
    e = cut(e.join(out, "src"))
    v = cut(e.select(F.col("src").alias("v")).unionByName(e.select(F.col("dst").alias("v"))).distinct().join(out.withColumnRenamed("src", "v"), "v", "left"))
    n = v.count()
    if n == 0:
        return v.select("v", F.lit(0.0).alias("rank"))
    ranks = v.select("v", "n_out", F.lit(1.0 / n).alias("rank"))
    for _ in range(rounds):
        lost = ranks.where("n_out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        got = e.join(ranks.select(F.col("v").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") / F.col("n_out")).alias("got"))
        ranks = cut(v.join(got, "v", "left").select("v", "n_out", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
    return ranks.select("v", "rank")


def strong_components(nodes: Iterable, edges: list[tuple]) -> list[list]:
    """Strongly connected components by two depth-first passes without recursion."""
    out: dict = {v: [] for v in nodes}
    into: dict = {v: [] for v in out}
    for a, b in edges:
        out[a].append(b)
        into[b].append(a)
    order, seen = [], set()
    for root in out:
        stack = [(root, iter(out[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            v, it = stack[-1]
            w = next((w for w in it if w not in seen), None)
            if w is None:
                order.append(v)
                stack.pop()
            else:
                seen.add(w)
                stack.append((w, iter(out[w])))
    found, done = [], set()
    for root in reversed(order):
        if root in done:
            continue
        done.add(root)
        comp, todo = [], [root]
        while todo:
            v = todo.pop()
            comp.append(v)
            for w in into[v]:
                if w not in done:
                    done.add(w)
                    todo.append(w)
        found.append(comp)
    return found


def betweenness(nodes: list, edges: list[tuple]) -> dict:
    """Share of shortest directed paths through each node, normalised by (n - 1)(n - 2)."""
    out: dict = {v: [] for v in nodes}
    for a, b in edges:
        out[a].append(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, before, order, todo = {s: 0}, {s: 1.0}, {s: []}, [], [s]
        for v in todo:
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w], before[w] = dist[v] + 1, 0.0, []
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        weight = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                weight[v] += paths[v] / paths[w] * (1 + weight[w])
            if w != s:
                score[w] += weight[w]
    n = len(nodes)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return {v: x * scale for v, x in score.items()}


#: The strong components of a group of more edges than this come from joins; smaller groups fit one task.
GROUP_EDGES = 20_000
BETWEENNESS_NODES = 100


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, c): the least label c that reaches v along the edges (src, dst), by rounds of grouped minima until none changes."""
    before = None
    while True:
        moved = edges.join(labels.withColumnRenamed("v", "src"), "src").select(F.col("dst").alias("v"), "c")
        labels = cut(labels.unionByName(moved).groupBy("v").agg(F.min("c").alias("c")))
        now = labels.agg(F.count("*"), F.sum(F.xxhash64("v", "c").cast("decimal(38,0)"))).first()
        if now == before:
            return labels
        before = now


def joined_strong_components(edges: DataFrame) -> DataFrame:
    """(v, root) of an edge table (src, dst): strongly connected components by joins; no component is ever collected.

    Vertices without an edge in or out are components of their own and trimmed, as long as that takes a good part. Then
    the least vertex that reaches v colours it; those of a colour that reach its first vertex back are its component.
    """
    e = cut(edges.select("src", "dst").distinct())
    live = cut(e.select(F.col("src").alias("v")).unionByName(e.select(F.col("dst").alias("v"))).distinct())
    e, left, found = e.where("src <> dst"), live.count(), []
    while left:
        inner = cut(e.select(F.col("src").alias("v")).intersect(e.select(F.col("dst").alias("v"))))
        kept = inner.count()
        if kept < left:
            found.append(live.join(inner, "v", "left_anti").select("v", F.col("v").alias("root")))
        e = cut(e.join(inner.select(F.col("v").alias("src")), "src", "left_semi").join(inner.select(F.col("v").alias("dst")), "dst", "left_semi"))
        trimmed, live, left = left - kept, inner, kept
        if not left or trimmed * 10 > left:
            continue
        colours = _spread(live.select("v", F.col("v").alias("c")), e)
        # only edges within a colour can lie in a component; followed back from the first vertex
        c = lambda end: colours.select(F.col("v").alias(end), F.col("c").alias(f"c_{end}"))
        within = cut(e.join(c("src"), "src").join(c("dst"), "dst").where("c_src = c_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        comps = _spread(colours.where("v = c"), within).select("v", F.col("c").alias("root"))
        found.append(comps)
        live = cut(live.join(comps, "v", "left_anti"))
        e = cut(e.join(live.select(F.col("v").alias("src")), "src", "left_semi").join(live.select(F.col("v").alias("dst")), "dst", "left_semi"))
        left = live.count()
    if not found:
        return live.select("v", F.col("v").alias("root"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def group_structure(edges: DataFrame, group: str) -> DataFrame:
    """(group, n_strong, largest_strong, max_betweenness) of the distinct edges of each group.

    Betweenness is null from BETWEENNESS_NODES nodes on. Groups of up to GROUP_EDGES edges are taken whole by a task,
    larger ones by joins.
    """
    e = cut(edges.select(group, "src", "dst").distinct())
    sizes = cut(e.groupBy(group).agg(F.count("*").alias("n")))
    kind = edges.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*pdf["src"], *pdf["dst"]})
        links = list(zip(pdf["src"], pdf["dst"]))
        comps = strong_components(nodes, links)
        most = max(betweenness(nodes, links).values()) if len(nodes) < BETWEENNESS_NODES else None
        return pd.DataFrame({"g": [pdf[group].iloc[0]], "n_strong": [len(comps)], "largest_strong": [max(map(len, comps))], "max_betweenness": pd.array([most], dtype="Float64")})

    large = sizes.where(F.col("n") > GROUP_EDGES).select(group)
    same = F.col(group).eqNullSafe(F.col("_g"))
    big = large.withColumnRenamed(group, "_g")
    small = e.join(big, same, "left_anti").groupBy(group).applyInPandas(run, f"g {kind}, n_strong long, largest_strong long, max_betweenness double")
    small = small.withColumnRenamed("g", group)
    if large.isEmpty():
        return small
    # more than GROUP_EDGES distinct edges need more than BETWEENNESS_NODES nodes
    node = lambda c: F.struct(F.col(group).alias("g"), F.col(c).alias("v"))
    ids = joined_strong_components(e.join(big, same, "left_semi").select(node("src").alias("src"), node("dst").alias("dst")))
    comps = ids.groupBy("root").agg(F.count("*").alias("n"))
    counts = comps.groupBy(F.col("root.g").alias(group)).agg(F.count("*").alias("n_strong"), F.max("n").alias("largest_strong"))
    return small.unionByName(counts.withColumn("max_betweenness", F.lit(None).cast("double")))
