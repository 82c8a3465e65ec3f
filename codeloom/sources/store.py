"""Tables the engine keeps: the symbol index by location, import references, terms, the update log, failed modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom import schemas


def save_index(entries: DataFrame, path: str) -> None:
    """entries has a column location, which becomes the partition: looking up one location reads one directory. Rows of a location
    are brought together first, spread over a few files so that a large location is not one task."""
    salt = F.pmod(F.xxhash64("symbol_name"), F.lit(8))
    entries.repartition(F.col("location"), salt).sortWithinPartitions("location", "symbol_name").write.partitionBy("location").mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str, schema: str = schemas.SYMBOL_ENTRIES) -> DataFrame:
    """Shards that are damaged are left out."""
    return spark.read.schema(schema + ", location string").option("ignoreCorruptFiles", "true").parquet(path)


def save_import_refs(refs: DataFrame, path: str, buckets: int = 32) -> None:
    """Few files for many modules: one directory for each bucket of importers."""
    refs.withColumn("bucket", F.pmod(F.xxhash64("importer"), F.lit(buckets)).cast("int")).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def save_terms(terms: DataFrame, path: str) -> None:
    """Sorted, so that statistics of row groups let a search for a prefix skip most of the file."""
    terms.select("term", "value").repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TERMS).parquet(path)


def append_actions(actions: DataFrame, path: str) -> None:
    actions.select("timestamp", "action_type", "data", "filename").write.mode("append").option("header", "true").csv(path)


def load_actions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.UPDATE_LOG).option("header", "true").csv(path)


def not_failed(files: DataFrame, failed: DataFrame) -> DataFrame:
    """Files that did not fail before."""
    return files.join(failed.select("path").distinct(), "path", "left_anti")


def typed_json(rows: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """(type, payload) rows: the named columns as one JSON object."""
    return rows.select(F.lit(kind).alias("type"), F.to_json(F.struct(*columns)).alias("payload"))


def from_typed_json(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    return rows.filter(F.col("type") == kind).select(F.from_json("payload", schema).alias("p")).select("p.*")
