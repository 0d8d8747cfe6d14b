"""Consolidating pairwise matches into groups: strip, compress, solve the core, restore.

Pairs of a document form chains and stars with a small core. Each round strips vertices of degree one
(each points to its neighbour) and compresses paths of degree-two vertices to one edge between their
ends, found by list ranking: every arc that enters a path doubles its pointer until it leaves the path,
so a path of length n takes log2(n) joins. What is left is solved by star contraction, and the removed
vertices take the label of the vertex they point to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import star_components
from ..session import cut
from ..sources.tables import table

#: Strip-and-compress rounds before the core goes to the star solver; each cuts trees by at least half of their leaves.
ROUNDS = 6
#: A round that removes less than this share of the vertices is the last.
LEAST_SHARE = 0.05


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).groupBy("v").agg(F.count("*").alias("deg"))


def _strip(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, parents (v, parent)) after removing every vertex of degree one; of a lone pair the larger goes."""
    deg = _degrees(edges)
    one = deg.where("deg = 1").select("v")
    e = (
        edges.join(one.select(F.col("v").alias("a"), F.lit(True).alias("a1")), "a", "left")
        .join(one.select(F.col("v").alias("b"), F.lit(True).alias("b1")), "b", "left")
        .select("a", "b", F.coalesce("a1", F.lit(False)).alias("a1"), F.coalesce("b1", F.lit(False)).alias("b1"))
    )
    e = cut(e)
    gone = e.where("a1 or b1").select(
        F.when(F.col("b1"), F.col("b")).otherwise(F.col("a")).alias("v"),
        F.when(F.col("b1"), F.col("a")).otherwise(F.col("b")).alias("parent"),
    )
    return e.where("not a1 and not b1").select("a", "b"), gone


def _compress(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges left, parents) after replacing each maximal path of degree-two vertices by one edge.

    An arc (t -> h) with h of degree two has one successor (h -> w), w being the other neighbour of h.
    List ranking doubles the successor; `low` keeps the least vertex passed, which ends pure cycles.
    """
    deg = _degrees(edges)
    arcs = edges.select(F.col("a").alias("t"), F.col("b").alias("h")).unionByName(edges.select(F.col("b").alias("t"), F.col("a").alias("h")))
    two = deg.where("deg = 2").select(F.col("v").alias("h"))
    # both neighbours of a degree-two vertex, by a grouped minimum and maximum of two values
    sides = arcs.select(F.col("h"), F.col("t")).join(two, "h", "left_semi").groupBy("h").agg(F.min("t").alias("n1"), F.max("t").alias("n2"))
    sides = cut(sides)
    if sides.isEmpty():
        return edges, edges.select(F.col("a").alias("v"), F.col("b").alias("parent")).limit(0)
    # an arc (v -> n) out of a path vertex goes on with (n -> w) if n is a path vertex, w its other neighbour;
    # otherwise it ends at the anchor n. Arcs that have ended point to themselves.
    lists = sides.select(F.col("h").alias("v"), F.explode(F.array("n1", "n2")).alias("n"))
    on = sides.select(F.col("h").alias("n"), F.col("n1"), F.col("n2"))
    inner = F.col("n1").isNotNull()
    lists = lists.join(on, "n", "left").select(
        "v",
        "n",
        F.when(inner, F.col("n")).otherwise(F.col("v")).alias("pv"),
        F.when(inner, F.when(F.col("n1") == F.col("v"), F.col("n2")).otherwise(F.col("n1"))).otherwise(F.col("n")).alias("pn"),
        F.when(~inner, F.col("n")).alias("end"),
        F.least("v", "n").alias("low"),
    )
    lists = cut(lists)
    seen = None
    while True:
        now = lists.where("end is null").agg(F.count("*"), F.sum(F.col("low").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        ahead = lists.select(F.col("v").alias("pv"), F.col("n").alias("pn"), F.col("pv").alias("qv"), F.col("pn").alias("qn"), F.col("end").alias("qend"), F.col("low").alias("qlow"))
        lists = cut(
            lists.join(ahead, ["pv", "pn"]).select("v", "n", F.col("qv").alias("pv"), F.col("qn").alias("pn"), F.coalesce("end", "qend").alias("end"), F.least("low", "qlow").alias("low"))
        )
    # a vertex of a pure cycle points to the least vertex of the cycle; others to the smaller of their two ends
    cycle = lists.where("end is null").groupBy("v").agg(F.min("low").alias("parent")).where("v <> parent")
    ends = lists.where("end is not null").groupBy("v").agg(F.min("end").alias("lo"), F.max("end").alias("hi"))
    gone = ends.select("v", F.col("lo").alias("parent")).unionByName(cycle)
    bridges = ends.where("lo <> hi").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    removed = sides.select(F.col("h"))
    kept = edges.join(removed.select(F.col("h").alias("a")), "a", "left_anti").join(removed.select(F.col("h").alias("b")), "b", "left_anti")
    return cut(kept.select("a", "b").unionByName(bridges).distinct()), gone


def match_groups(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group_id) for every node that a pair links; group_id is the smallest node of the group.

    Null ends, self-pairs, repeated and reversed pairs change nothing; extra columns are ignored; an
    empty table gives no row. Hub vertices only meet grouped minima, which are combined before the
    shuffle, and joins that adaptive execution splits, so no group is collected in one task.
    """
    e = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = cut(e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node"))).distinct())
    total = left = nodes.count()
    parents: DataFrame | None = None
    for _ in range(ROUNDS):
        if left == 0:
            break
        e, gone1 = _strip(e)
        e, gone2 = _compress(e)
        gone = gone1.unionByName(gone2)
        parents = gone if parents is None else parents.unionByName(gone)
        after = e.select("a").unionByName(e.select(F.col("b").alias("a"))).agg(F.count_distinct("a")).first()[0]
        last, left = left, after
        if last - left < LEAST_SHARE * total:
            break
    roots = nodes.select("node", F.col("node").alias("root")) if parents is None else None
    if parents is not None:
        # every removed vertex points to one removed later, or to one left over: doubling ends after log2(rounds) joins
        forest = cut(parents)
        while True:
            up = forest.select(F.col("v").alias("parent"), F.col("parent").alias("above"))
            forest = cut(forest.join(up, "parent", "left").select("v", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
            if forest.where("moved").isEmpty():
                break
            forest = forest.select("v", "parent")
        roots = nodes.join(forest.select(F.col("v").alias("node"), F.col("parent").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    if left:
        core = star_components(e, "a", "b").select(F.col("node").alias("root"), F.col("root").alias("core_root"))
        roots = roots.join(core, "root", "left").select("node", F.coalesce("core_root", "root").alias("root"))
    roots = cut(roots)
    least = roots.groupBy("root").agg(F.min("node").alias("group_id"))
    return roots.join(least, "root").select("node", "group_id")


def entity_pairs(entities: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(a, b) entity ids of the confirmed pairs whose keys both exist in their document.

    Redelivered entity rows count once, the earliest id if a key came with several; nulls link nothing.
    """
    ents = entities.where("doc_id is not null and ent_key is not null and ent_id is not null").groupBy("doc_id", "ent_key").agg(F.min("ent_id").alias("ent_id"))
    ents = cut(ents)
    pairs = confirmed.select("doc_id", "ent_a", "ent_b").where("ent_a <> ent_b").distinct()
    left = ents.select("doc_id", F.col("ent_key").alias("ent_a"), F.col("ent_id").alias("a"))
    right = ents.select("doc_id", F.col("ent_key").alias("ent_b"), F.col("ent_id").alias("b"))
    return pairs.join(left, ["doc_id", "ent_a"]).join(right, ["doc_id", "ent_b"]).select("a", "b")


def entity_groups(entities: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(ent_id, group_id) for every entity, singletons under their own id."""
    groups = match_groups(entity_pairs(entities, confirmed))
    every = entities.select("ent_id").where("ent_id is not null").distinct()
    return every.join(groups.select(F.col("node").alias("ent_id"), "group_id"), "ent_id", "left").select("ent_id", F.coalesce("group_id", "ent_id").alias("group_id"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    groups = match_groups(entity_pairs(table(spark, folder, "raw_entities"), table(spark, folder, "confirmed_pairs")))
    return groups.where("node <> group_id").select("group_id", F.col("node").alias("ent_id"))


def p1_entity_groups(spark: SparkSession, folder: str) -> DataFrame:
    return entity_groups(table(spark, folder, "raw_entities"), table(spark, folder, "confirmed_pairs"))


def p1_group_report(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: pairs proposed and answered "same", groups and entities in them, largest group."""
    entities, confirmed, proposed = (table(spark, folder, t) for t in ("raw_entities", "confirmed_pairs", "candidate_pairs"))
    home = entities.groupBy("ent_id").agg(F.min("doc_id").alias("doc_id"))
    groups = match_groups(entity_pairs(entities, confirmed)).select(F.col("node").alias("ent_id"), "group_id")
    sizes = groups.join(home, "ent_id").groupBy("doc_id", "group_id").agg(F.count("*").alias("n"))
    per_doc = sizes.groupBy("doc_id").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_grouped"), F.max("n").alias("largest"))
    ends = (F.least("ent_a", "ent_b").alias("x"), F.greatest("ent_a", "ent_b").alias("y"))
    same = confirmed.where("ent_a <> ent_b").select("doc_id", *ends).distinct()
    asked = proposed.where("ent_a <> ent_b").select("doc_id", *ends).distinct()
    counts = (
        same.withColumn("s", F.lit(1)).join(asked.withColumn("p", F.lit(1)), ["doc_id", "x", "y"], "full")
        .groupBy("doc_id").agg(F.count("p").alias("n_proposed"), F.count("s").alias("n_same"), F.count(F.when(F.col("s").isNotNull() & F.col("p").isNull(), 1)).alias("n_same_unproposed"))
    )
    return counts.join(per_doc, "doc_id", "left").na.fill(0, ["n_groups", "n_grouped", "largest"])


QUERIES = {"p1_found": p1_found, "p1_entity_groups": p1_entity_groups, "p1_group_report": p1_group_report}

_REACH = """
WITH RECURSIVE ents AS (SELECT doc_id, ent_key, min(ent_id) AS ent_id FROM raw_entities GROUP BY 1, 2),
pr AS (SELECT DISTINCT x.ent_id AS a, y.ent_id AS b FROM confirmed_pairs c JOIN ents x ON x.doc_id = c.doc_id AND x.ent_key = c.ent_a
       JOIN ents y ON y.doc_id = c.doc_id AND y.ent_key = c.ent_b WHERE x.ent_id <> y.ent_id),
sym AS (SELECT a, b FROM pr UNION SELECT b, a FROM pr),
reach AS (SELECT a AS node, a AS other FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.other),
lab AS (SELECT node, min(other) AS group_id FROM reach GROUP BY 1)
"""
ORACLE = {
    "p1_found": _REACH + "SELECT group_id, node AS ent_id FROM lab WHERE node <> group_id",
    "p1_entity_groups": _REACH + "SELECT e.ent_id, coalesce(l.group_id, e.ent_id) AS group_id FROM (SELECT DISTINCT ent_id FROM raw_entities) e LEFT JOIN lab l ON l.node = e.ent_id",
    "p1_group_report": _REACH
    + """, home AS (SELECT ent_id, min(doc_id) AS doc_id FROM raw_entities GROUP BY 1),
sz AS (SELECT h.doc_id, l.group_id, count(*) AS n FROM lab l JOIN home h ON h.ent_id = l.node GROUP BY 1, 2),
pd AS (SELECT doc_id, count(*) AS n_groups, sum(n)::BIGINT AS n_grouped, max(n) AS largest FROM sz GROUP BY 1),
s AS (SELECT DISTINCT doc_id, least(ent_a, ent_b) AS x, greatest(ent_a, ent_b) AS y, 1 AS s FROM confirmed_pairs WHERE ent_a <> ent_b),
p AS (SELECT DISTINCT doc_id, least(ent_a, ent_b) AS x, greatest(ent_a, ent_b) AS y, 1 AS p FROM candidate_pairs WHERE ent_a <> ent_b),
c AS (SELECT doc_id, count(p) AS n_proposed, count(s) AS n_same, count(*) FILTER (s IS NOT NULL AND p IS NULL) AS n_same_unproposed FROM s FULL JOIN p USING (doc_id, x, y) GROUP BY 1)
SELECT c.*, coalesce(n_groups, 0) AS n_groups, coalesce(n_grouped, 0) AS n_grouped, coalesce(largest, 0) AS largest FROM c LEFT JOIN pd USING (doc_id)""",
}
