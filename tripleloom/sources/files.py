"""Scans and sinks of the file layouts that extraction runs leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.answers import ALIASES
from ..functions.text import blank_to_null, squeeze_ends

_T = "struct<" + ",".join(f"{k}:string" for ks in ALIASES.values() for k in ks) + ",evidence:string,chunk_id:int>"
FINAL = f"triples_final array<{_T}>, chunks array<struct<id:int,text:string,relations:array<{_T}>>>, summary string"


def stem(path: Column) -> Column:
    """File name without folder and ending."""
    return F.regexp_extract(path, r"([^/\\]+?)(?:\.[^./\\]+)?$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def doc_order(doc_id: Column) -> list[Column]:
    """Sort keys that put doc_<N> by number before all other names."""
    n = F.regexp_extract(doc_id, r"^doc_(\d+)$", 1).try_cast("bigint")
    return [n.asc_nulls_last(), doc_id.asc()]


def scan_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text), one row for each text file."""
    return spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("text"))


def _parts(item: Column) -> list[Column]:
    return [blank_to_null(squeeze_ends(F.coalesce(*(item[k] for k in ks)))).alias(name) for name, ks in ALIASES.items()]


def scan_final_output(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, triple_ord, subject, relation, object, evidence) of <folder>/<doc>/final_output.json.

    Without final triples the relations of the chunks count, in order. Triples with a blank part drop out.
    """
    raw = spark.read.schema(FINAL).json(f"{folder}/*/final_output.json", multiLine=True).withColumn("doc_id", parent(F.col("_metadata.file_path")))
    items = F.when(F.size("triples_final") > 0, F.col("triples_final")).otherwise(F.flatten(F.transform("chunks", lambda c: F.coalesce(c["relations"], F.array().cast(f"array<{_T}>")))))
    rows = raw.select("doc_id", F.posexplode(items).alias("triple_ord", "t"))
    return rows.select("doc_id", "triple_ord", *_parts(F.col("t")), "t.evidence").where("subject is not null and relation is not null and object is not null")


def scan_flat_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, triple_ord, subject, relation, object) of <folder>/<doc>.json: the first of relations, edges and triples_final that holds triples."""
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.try_parse_json("value").alias("v"))

    def looks(path: str) -> Column:
        items = F.try_variant_get("v", path, "array<variant>")
        first = F.get(items, F.lit(0))
        named = F.coalesce(*(F.try_variant_get(first, f"$.{k}", "string") for k in ALIASES["subject"]), F.try_variant_get(first, "$[2]", "string"))
        return F.when(named.isNotNull(), items)

    rows = raw.select("doc_id", F.posexplode(F.coalesce(*(looks(f"$.{k}") for k in ("relations", "edges", "triples_final")))).alias("triple_ord", "t"))
    part = lambda i, ks: blank_to_null(squeeze_ends(F.coalesce(*(F.try_variant_get("t", f"$.{k}", "string") for k in ks), F.try_variant_get("t", f"$[{i}]", "string"))))
    out = rows.select("doc_id", "triple_ord", *(part(i, ks).alias(n) for i, (n, ks) in enumerate(ALIASES.items())))
    return out.where("subject is not null and relation is not null and object is not null")


def scan_gold_facts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, fact_ord, fact, label): facts with the class lists that name them by position; ambiguous counts as multi."""
    raw = spark.read.json(f"{folder}/*.json", multiLine=True, schema="facts array<string>, `single-entity` array<int>, `multiple-entity` array<int>, ambiguous array<int>")
    rows = raw.select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.posexplode("facts").alias("fact_ord", "fact"), F.col("`single-entity`").alias("one"))
    label = F.when(F.array_contains(F.coalesce("one", F.array().cast("array<int>")), F.col("fact_ord")), "single").otherwise("multi")
    return rows.select("doc_id", "fact_ord", "fact", label.alias("label"))


def scan_results(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, n, n_hit, accuracy) of results_<N>.json, whose last element holds the accuracy."""
    raw = spark.read.text(f"{folder}/results_*.json", wholetext=True).select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.from_json("value", "array<struct<evaluation:int,accuracy:string>>").alias("r"))
    hits = F.filter("r", lambda x: x["evaluation"].isNotNull())
    acc = F.regexp_replace(F.try_element_at("r", F.lit(-1))["accuracy"], "%$", "").try_cast("double")
    return raw.select("doc_id", F.size(hits).alias("n"), F.size(F.filter(hits, lambda x: x["evaluation"] == 1)).alias("n_hit"), acc.alias("accuracy"))


def scan_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines cache with the last line of each custom_id; blank and broken lines are skipped."""
    raw = spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = raw.where("_bad is null and custom_id is not null").drop("_bad")
    place = F.struct(F.monotonically_increasing_id().alias("at"), *rows.columns)
    return rows.select("custom_id", place.alias("r")).groupBy("custom_id").agg(F.max_by("r", "r.at").alias("r")).select(*(f"r.{c}" for c in rows.columns))


def scan_logs(spark: SparkSession, folder: str) -> DataFrame:
    """(experiment, line) of all log files below a folder; the experiment is the folder right below it."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(folder)
    base = folder.rstrip("/").rpartition("/")[2]
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), rf"/\Q{base}\E/([^/]+)/", 1).alias("experiment"), F.col("value").alias("line"))


def paired_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(line_no, a, b) of two files whose lines belong together, blank lines skipped; raises if they differ in length."""

    def lines(path: str, name: str) -> DataFrame:
        kept = F.filter(F.split("value", r"\r?\n"), lambda x: squeeze_ends(x) != "")
        return spark.read.text(path, wholetext=True).select(F.posexplode(kept).alias("line_no", name))

    both = lines(left, "a").join(lines(right, "b"), "line_no", "full")
    ok = F.assert_true(F.col("a").isNotNull() & F.col("b").isNotNull(), "the files differ in length")
    return both.withColumn("_ok", ok).where("_ok is null").drop("_ok")


def latest(spark: SparkSession, folder: str, pattern: str = "*.json") -> str | None:
    """Path of the newest snapshot by name, backups left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path").where(~F.contains("path", F.lit(".bak.")))
    return files.agg(F.max("path")).first()[0]


def write_by_doc(df: DataFrame, path: str) -> None:
    """One folder a document; rows of a document are brought together first so that it has one file."""
    df.repartition("doc_id").write.mode("overwrite").partitionBy("doc_id").json(path)


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str) -> None:
    """Replaces the rows of a Parquet folder that share a key with the new ones; the folder as it was stays beside it as a backup.

    The new rows are written whole before the folders change names, so a crash leaves either state complete.
    """
    base = path.rstrip("/")
    stage, backup = f"{base}__stage", f"{base}.bak"
    old = spark.read.parquet(path)
    old.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows).write.mode("overwrite").parquet(stage)
    files = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    at = spark._jvm.org.apache.hadoop.fs.Path
    files.delete(at(backup), True)
    files.rename(at(base), at(backup))
    files.rename(at(stage), at(base))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder or file is there, on any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def write_requests(df: DataFrame, path: str, most: int = 50_000, most_bytes: int = 200 * 1024 * 1024) -> None:
    """Request lines as JSON; raises on none, repeated, null or blank ids, or more rows or bytes than a provider takes."""
    size = F.octet_length(F.to_json(F.struct(*df.columns))) + 1
    n, ids, named, total = df.agg(F.count("*"), F.count_distinct("custom_id"), F.count_if(F.trim("custom_id") != ""), F.sum(size)).first()
    if n == 0 or ids != n or named != n or n > most or total > most_bytes:
        raise ValueError(f"{n} requests with {ids} different ids in {total} bytes; 1 to {most} unique ones in {most_bytes} bytes are allowed")
    df.write.mode("overwrite").json(path)


def write_graph(edges: DataFrame, path: str, replace: bool = False) -> None:
    """Adds (src, rel, dst, evidence) to a graph folder: vertices once by name, every edge as a row of its own."""
    spark = edges.sparkSession
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    if not replace and exists(spark, f"{path}/vertices"):
        names = names.join(spark.read.parquet(f"{path}/vertices"), "name", "left_anti")
    mode = "overwrite" if replace else "append"
    names.write.mode(mode).parquet(f"{path}/vertices")
    edges.write.mode(mode).parquet(f"{path}/edges")
