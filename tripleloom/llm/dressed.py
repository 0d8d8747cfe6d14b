"""Duplicates hidden by formatting differences: one record per canonical key, with its number of copies.

Keys whose exact count (partial counts, combined before the shuffle) passes a share of a partition are
hot. Hot keys are few by construction, so their rows meet a salted two-level minimum; all other rows
take one shuffle by key. The representative of a key is its smallest identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, partitions
from ..sources.tables import table

#: Names of the three parts in a payload, by preference.
ALIASES = {"subject": ("subject", "head", "source"), "relation": ("relation", "predicate", "relation_type"), "object": ("object", "tail", "target")}
#: A key is hot if it has more rows than an even share of a shuffle partition divided by this, but never fewer than LEAST_HOT.
HOT_FACTOR = 4
LEAST_HOT = 1000
SALTS = 64

_PAYLOAD = ", ".join(f"{k} string" for names in ALIASES.values() for k in names) + ", _bad string"


def canonical(text: Column) -> Column:
    """Letters, marks and digits in order, upper case; a point stays only between two digits.

    Null stays null, a text without a letter or digit becomes the empty string.
    """
    no_point = F.regexp_replace(text, r"(?<!\p{Nd})\.|\.(?!\p{Nd})", "")
    # upper, not lower: it also brings sharp s and final sigma to one form
    return F.upper(F.regexp_replace(no_point, r"[^\p{L}\p{M}\p{N}.]", ""))


def parts(triples: DataFrame) -> DataFrame:
    """(triple_id, subject, relation, object) from the three columns or, those all null, from the payload.

    A payload that is no JSON object gives nulls.
    """
    inside = F.from_json("payload", _PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"})
    bare = F.col("subject").isNull() & F.col("relation").isNull() & F.col("object").isNull() & F.col("payload").isNotNull()
    df = triples.select("triple_id", "subject", "relation", "object", F.when(bare, inside).alias("p"))
    ok = F.col("p._bad").isNull()
    picked = [F.coalesce(F.col(name), F.when(ok, F.coalesce(*(F.col(f"p.{k}") for k in ks)))).alias(name) for name, ks in ALIASES.items()]
    return df.select("triple_id", *picked)


def keyed(records: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, k1, k2): a 128-bit key of the canonical parts; rows with an empty part drop out.

    At 10^11 different keys the chance of any false match is below 10^-15, and no text is shuffled.
    """
    canon = [canonical(F.col(f)).alias(f"_c{i}") for i, f in enumerate(fields)]
    df = records.select(F.col(id_col).alias("id"), *canon).where(F.col("id").isNotNull())
    for i in range(len(fields)):
        df = df.where(F.col(f"_c{i}") != "")
    cs = [F.col(f"_c{i}") for i in range(len(fields))]
    sep = [x for c in cs for x in (c, F.lit("\x1f"))]
    return df.select("id", F.xxhash64(*sep).alias("k1"), F.xxhash64(F.lit("second"), *reversed(sep)).alias("k2"))


def copies(rows: DataFrame, total: int | None = None) -> DataFrame:
    """(kept_id, copy_id) of rows (id, k1, k2): one row for each other identifier of a key.

    `total` is the number of rows or an upper bound of it, if known; it only moves the bar for hot keys.
    Repeated (id, key) rows count once. Empty input gives no row.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    counts = rows.groupBy("k1", "k2").agg(F.count("*").alias("c"))
    counts = counts.where(F.col("c") > LEAST_HOT)  # so that only keys worth a look are kept
    total = rows.count() if total is None else total
    # more than total / bar keys can't pass the bar: at most HOT_FACTOR * partitions keys are hot
    bar = max(LEAST_HOT, total // (HOT_FACTOR * n))
    hot = cut(counts.where(F.col("c") > bar).select("k1", "k2"))
    n_hot = hot.count()
    w = Window.partitionBy("k1", "k2").orderBy("id")
    cold_rows = rows.join(F.broadcast(hot), ["k1", "k2"], "left_anti") if n_hot else rows
    cold = (
        cold_rows.select("k1", "k2", "id", F.first("id").over(w).alias("kept_id"), F.lag("id").over(w).alias("before"))
        .where((F.col("id") != F.col("kept_id")) & (F.col("before").isNull() | (F.col("before") != F.col("id"))))
        .select("kept_id", F.col("id").alias("copy_id"))
    )
    if not n_hot:
        return cold
    # level one: each salt of a hot key keeps its distinct identifiers; level two: the minimum over the salts
    warm = rows.join(F.broadcast(hot), ["k1", "k2"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    warm = warm.groupBy("k1", "k2", "salt", "id").agg(F.count("*").alias("n_rows"))
    least = warm.groupBy("k1", "k2", "salt").agg(F.min("id").alias("m")).groupBy("k1", "k2").agg(F.min("m").alias("kept_id"))
    found = warm.join(F.broadcast(least), ["k1", "k2"]).where("id <> kept_id").select("kept_id", F.col("id").alias("copy_id"))
    return cold.unionByName(found)


def triple_copies(triples: DataFrame) -> DataFrame:
    return copies(keyed(parts(triples), "triple_id", ["subject", "relation", "object"]), triples.count())


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return triple_copies(table(spark, folder, "triples"))


def p5_records(spark: SparkSession, folder: str) -> DataFrame:
    """Each kept triple with its parts as stated and its number of copies (itself included)."""
    triples = table(spark, folder, "triples")
    found = triple_copies(triples)
    n = found.groupBy("kept_id").agg(F.count("*").alias("n"))
    rows = parts(triples)
    for f in ALIASES:
        rows = rows.where(canonical(F.col(f)) != "")
    rows = rows.groupBy("triple_id").agg(*(F.min(f).alias(f) for f in ALIASES))
    rows = rows.join(found.select(F.col("copy_id").alias("triple_id")), "triple_id", "left_anti")
    return rows.join(n.withColumnRenamed("kept_id", "triple_id"), "triple_id", "left").select(
        F.col("triple_id").alias("kept_id"), *ALIASES, (F.coalesce("n", F.lit(0)) + 1).alias("n_copies")
    )


QUERIES = {"p5_found": p5_found, "p5_records": p5_records}

_CANON = "upper(regexp_replace(regexp_replace(regexp_replace({}, '(^|[^0-9])\\.', '\\1', 'g'), '\\.([^0-9]|$)', '\\1', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}.]', '', 'g'))"


def _part(name: str) -> str:
    inside = ", ".join(f"json_extract_string(payload, '$.{k}')" for k in ALIASES[name])
    return f"CASE WHEN subject IS NULL AND relation IS NULL AND object IS NULL THEN CASE WHEN json_valid(payload) THEN coalesce({inside}) END ELSE {name} END"


_ROWS = (
    "WITH t AS (SELECT triple_id, " + ", ".join(f"min({_part(n)}) AS {n[0]}" for n in ALIASES) + " FROM triples GROUP BY triple_id), "
    + "k AS (SELECT *, " + ", ".join(_CANON.format(n[0]) + f" AS k{n[0]}" for n in ALIASES) + " FROM t), "
    + "g AS (SELECT *, min(triple_id) OVER (PARTITION BY ks, kr, ko) AS kept_id, count(*) OVER (PARTITION BY ks, kr, ko) AS n FROM k WHERE ks <> '' AND kr <> '' AND ko <> '') "
)
ORACLE = {
    "p5_found": _ROWS + "SELECT kept_id, triple_id AS copy_id FROM g WHERE triple_id <> kept_id",
    "p5_records": _ROWS + "SELECT kept_id, s AS subject, r AS relation, o AS object, n AS n_copies FROM g WHERE triple_id = kept_id",
}
