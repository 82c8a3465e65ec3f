"""Source files and notebooks from a file system."""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from codeloom.session import ship


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, mtime in zip(b["path"].to_pylist(), b["mtime"].to_pylist(), strict=True):  # one file at a time is held
            text, error = None, None
            try:
                with open(path, "rb") as f:
                    text = f.read().decode()
            except (OSError, UnicodeDecodeError) as e:
                error = type(e).__name__
            yield pa.RecordBatch.from_pydict({"path": [path], "source": [text], "mtime": [mtime], "error": [error]}, schema=_SOURCE)


_SOURCE = pa.schema([("path", pa.string()), ("source", pa.string()), ("mtime", pa.float64()), ("error", pa.string())])


def python_sources(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, source, mtime, error of all .py and .pyi files below a root that all executors see. A file that cannot be read as UTF-8
    has a null source and its error. (Spark's own file sources leave out names that begin with an underscore, as __init__.py does.)"""
    spark.dataSource.register(TreeSource)
    ship(spark)
    files = spark.read.format("source_tree").load(root).filter(F.col("path").rlike(r"\.pyi?$") & ~F.col("is_dir"))
    if not recursive:
        files = files.filter(~F.col("path").substr(len(root.rstrip("/")) + 2, 1 << 20).contains("/"))
    return files.select("path", "mtime").mapInArrow(_read, "path string, source string, mtime double, error string")


def from_strings(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """file_id, path, source of texts at hand."""
    return spark.createDataFrame([(n, p, s) for n, (p, s) in enumerate(sources.items())], "file_id bigint, path string, source string")


def notebook_code(notebooks: DataFrame, source: Column) -> DataFrame:
    """notebooks with code: the code cells of each notebook in order, joined by blank lines; null for what is no notebook. A cell's
    source may be one string or a list of lines."""
    cells = F.from_json(source, "cells array<struct<cell_type:string,source:string>>")["cells"]
    code = F.filter(cells, lambda c: c["cell_type"] == "code")
    texts = F.transform(code, lambda c: F.coalesce(F.array_join(F.from_json(c["source"], "array<string>"), ""), c["source"], F.lit("")))
    return notebooks.withColumn("code", F.array_join(texts, "\n\n"))


class TreeSource(DataSource):
    """spark.read.format('source_tree').load(root): path, is_dir, mtime below a root, its directories walked in parallel.

    Options: exclude (comma-separated names not entered, default .git), packages_only (true: only directories with an
    __init__.py, below the root), pushdown (true: filters on the start of path keep whole directories from being entered; needs
    spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, is_dir boolean, mtime double"

    def reader(self, schema: StructType) -> TreeReader:
        return (PushedTreeReader if self.options.get("pushdown", "false").lower() == "true" else TreeReader)(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/") or "/"
        self.exclude = [x.strip() for x in options.get("exclude", ".git").split(",") if x.strip()]
        self.packages_only = options.get("packages_only", "false").lower() == "true"
        self.prefix = ""

    def _enter(self, path: str) -> bool:
        name = os.path.basename(path)
        if any(fnmatch.fnmatch(name, x) for x in self.exclude):
            return False
        if self.prefix and not (path + "/").startswith(self.prefix) and not self.prefix.startswith(path + "/"):
            return False
        return not self.packages_only or os.path.exists(os.path.join(path, "__init__.py"))

    def partitions(self) -> list[InputPartition]:
        with os.scandir(self.root) as entries:
            top = sorted(e.path for e in entries if e.is_dir(follow_symlinks=False))
        return [InputPartition(("", self.root)), *(InputPartition(("walk", p)) for p in top if self._enter(p))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        how, at = partition.value
        if how:
            yield at + "/", True, os.path.getmtime(at)
            for base, dirs, files in os.walk(at):
                dirs[:] = sorted(d for d in dirs if self._enter(os.path.join(base, d)))
                yield from ((os.path.join(base, d) + "/", True, os.path.getmtime(os.path.join(base, d))) for d in dirs)
                yield from ((os.path.join(base, f), False, os.path.getmtime(os.path.join(base, f))) for f in sorted(files))
        else:
            with os.scandir(at) as entries:
                yield from ((e.path, False, e.stat().st_mtime) for e in entries if e.is_file(follow_symlinks=False))


class PushedTreeReader(TreeReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefix = max(self.prefix, f.value, key=len)
            elif isinstance(f, EqualTo) and f.attribute == ("path",):
                self.prefix = str(f.value)
            yield f  # Spark checks them again
