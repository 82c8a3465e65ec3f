"""Keeping the symbol index of a code base up to date from changed files only.

The state is two tables: what each file defines (index_of_files) and what it imports (resolved imports). An update
takes the facts of changed and removed files out, puts those of the changed files in, and moves import counts by signed deltas.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import code, fixing, symbols

TARGET = ["target_id", "is_module_itself", "value"]


@dataclass(frozen=True)
class IndexState:
    files: DataFrame  # file_id, path, root
    entries: DataFrame  # index_of_files
    imports: DataFrame  # code.imports, with path and root
    refs: DataFrame  # importer, target_id, is_module_itself, value; each once
    counts: DataFrame  # TARGET, import_count


def references(resolved: DataFrame) -> DataFrame:
    itself = F.coalesce(F.col("is_module"), F.lit(False)) | F.col("value").isNull()
    return (
        resolved.filter("target_id IS NOT NULL AND value IS DISTINCT FROM '*'")
        .select(F.col("file_id").alias("importer"), "target_id", itself.alias("is_module_itself"), F.coalesce(F.when(~itself, F.col("value")), F.lit("")).alias("value")).distinct()
    )


def build(files: DataFrame) -> IndexState:
    """The state of all files (file_id, path, root, source)."""
    x = code.extract(files, "import", "entry")
    refs = references(code.resolved_imports(x.imports, x.files))
    return IndexState(x.files, fixing.index_of_files(x.files, x), x.imports, refs, refs.groupBy(*TARGET).agg(F.count(F.lit(1)).alias("import_count")))


def update(old: IndexState, changed: DataFrame, removed: DataFrame) -> IndexState:
    """The state after some files (file_id, path, root, source) changed or came and others (file_id) went. Imports are resolved
    again for all files, as a new or lost file changes what others' imports mean; only changed files are parsed."""
    gone = changed.select("file_id").unionByName(removed.select("file_id")).distinct()
    kept = lambda df: df.join(gone, "file_id", "left_anti")
    x = code.extract(changed, "import", "entry")
    files = kept(old.files).unionByName(x.files)
    entries = kept(old.entries).unionByName(fixing.index_of_files(x.files, x))
    imports = kept(old.imports).unionByName(x.imports)
    refs = references(code.resolved_imports(imports, files))
    deltas = symbols.import_count_deltas(old.refs, refs, "importer", TARGET)
    counts = old.counts.join(deltas, TARGET, "full_outer").select(*TARGET, (F.coalesce("import_count", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("import_count"))
    return IndexState(files, entries, imports, refs, counts.filter("import_count > 0"))


def with_counts(state: IndexState) -> DataFrame:
    """The entries with their import counts, as with_import_counts gives them for a full build."""
    named = state.entries.withColumn("value", F.when(~F.col("is_module_itself"), F.col("symbol_name")).otherwise(F.lit("")))
    c = state.counts.withColumnRenamed("target_id", "file_id")
    return named.join(c, ["file_id", "is_module_itself", "value"], "left").drop("value").withColumn("import_count", F.coalesce("import_count", F.lit(0)))
