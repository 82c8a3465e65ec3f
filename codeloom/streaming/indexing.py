"""Keeping name counts of a growing set of source files up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators import terms


def source_stream(spark: SparkSession, folder: str) -> DataFrame:
    """file_id, path, source of Parquet files that appear in a folder."""
    return spark.readStream.schema("file_id bigint, path string, source string").parquet(folder)


def term_deltas(sources: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch writes the counts of its own files under its number, so a repeated batch counts once; counts() adds them up."""

    def batch(rows: DataFrame, n: int) -> None:
        terms.counted(terms.tokens(rows, F.col("source"))).write.mode("overwrite").parquet(f"{out}/batch={n}")

    w = sources.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")).start()


def counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("term").agg(F.sum("value").alias("value"))
