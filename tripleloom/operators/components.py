"""Connected components over an edge table: the reference's small-cluster grouping and a general core solver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of an edge table; root is the smallest node of its component.

    Alternating large-star and small-star rounds: each is a grouped minimum (combined before the
    shuffle) and an equi-join, so no group is ever collected. Ends when a round changes nothing.
    Null ends and self-links are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: link each larger neighbour of u to the least of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: link the smaller neighbours of u, and u, to the least of them
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(
            e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """First row of each key in the order given; a null key counts as a value."""
    from pyspark.sql import Window

    name = "_rank"
    while name in df.columns:
        name += "_"
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)
