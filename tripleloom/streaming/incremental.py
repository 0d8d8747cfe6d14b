"""Incremental runs: new rows of a growing folder are processed once, whatever is delivered again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import exists


def run_new(spark: SparkSession, source: str, schema: str, out: str, state: str, key: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Processes all files of `source` that no earlier run has seen, and ends.

    `work` must keep the key. A row whose key is in `out` already is left out, and so are repeats within a
    batch, so a restart after a failure adds nothing twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.dropDuplicates([key])
        if exists(spark, out):
            rows = rows.join(spark.read.parquet(out).select(key), key, "left_anti")
        work(rows).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
