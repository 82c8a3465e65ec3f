"""python -m codeloom COMMAND ...: the engine over source trees on disk."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import code, fixing
from codeloom.sources import files as source_files
from codeloom.streaming import service


def _files(spark: SparkSession, root: str) -> DataFrame:
    found = source_files.python_sources(spark, root).filter("source IS NOT NULL")
    return found.select(F.xxhash64("path").alias("file_id"), "path", "source", F.lit(root.rstrip("/")).alias("root"))


def _index(x: code.Facts) -> DataFrame:
    return fixing.with_import_counts(fixing.index_of_files(x.files, x), code.resolved_imports(x.imports, x.files))


def main() -> None:
    p = argparse.ArgumentParser(prog="codeloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, words in (("index", "write the symbol index"), ("missing", "names without definition or import"), ("exports", "what modules export"), ("counts", "names by how often they occur"), ("fix", "sources with their imports put right")):
        c = sub.add_parser(name, help=words)
        c.add_argument("root")
        c.add_argument("out", help="folder of Parquet files to write")
    c = sub.add_parser("serve", help="answer JSON lines that appear in a folder")
    c.add_argument("root")
    c.add_argument("requests")
    c.add_argument("out")
    c.add_argument("--once", action="store_true", help="end when all requests there are answered")
    a = p.parse_args()
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    files = _files(spark, a.root)
    if a.command == "counts":
        code.name_counts(files).orderBy(F.desc("value"), "term").write.mode("overwrite").parquet(a.out)
        return
    x = code.extract(files)
    if a.command == "serve":
        q = service.serve(spark.readStream.text(a.requests), _index(x).persist(), f"{a.out}/responses", f"{a.out}/checkpoint", once=a.once)
        q.awaitTermination()
        return
    named = x.files.select("file_id", "path")
    out = {
        "index": lambda: _index(x),
        "missing": lambda: code.missing_of(x),
        "exports": lambda: x.exports.join(named, "file_id"),
        "fix": lambda: fixing.fix_files(files, _index(x), x, location=a.root),
    }[a.command]()
    out.write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
