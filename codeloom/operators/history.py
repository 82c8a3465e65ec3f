"""Snapshots of files against what was processed, and the log of what was done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths


def snapshot_diff(listing: DataFrame, stored: DataFrame, key: str, listed_at: str, stored_at: str) -> DataFrame:
    """key, change: 'added', 'modified' (listed later than stored) or 'removed'. Unchanged keys are left out."""
    both = listing.select(key, listed_at).join(stored.select(key, stored_at), key, "full_outer")
    change = F.when(F.col(stored_at).isNull(), "added").when(F.col(listed_at).isNull(), "removed").when(F.col(listed_at) > F.col(stored_at), "modified")
    return both.select(key, change.alias("change")).filter(F.col("change").isNotNull())


def removed_with_directories(removed: DataFrame, listing: DataFrame) -> DataFrame:
    """path of removed files, and of the directories (with final slash) that lost all their files with them."""
    up = removed.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    left = listing.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct()
    return removed.select("path").unionByName(up.join(left, "path", "left_anti"))


def upsert(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """path, ts: what was seen last (path, ts, seq; the largest seq, then the largest ts) takes the place of what is stored,
    whatever its ts."""
    every = stored.select("path", "ts", F.lit(None).cast("bigint").alias("seq")).unionByName(seen.select("path", "ts", F.col("seq").cast("bigint")))
    return every.groupBy("path").agg(F.max(F.struct(F.col("seq").isNotNull().alias("new"), "seq", "ts")).alias("last")).select("path", F.col("last.ts").alias("ts"))


def _python_files(listing: DataFrame) -> DataFrame:
    """path, dir of the Python files of a listing (path), each once; dir has no final slash."""
    files = listing.select("path").filter(paths.is_python_file(F.col("path"))).distinct()
    return files.withColumn("dir", paths.directory(F.col("path")))


def _beginnings(files: DataFrame) -> DataFrame:
    """dir, at, is_package: every folder at or above the folders of files, and whether it is a package: it holds __init__.py and is not
    .git. Folders are few beside files, so what is exploded and joined is small."""
    dirs = files.select("dir").distinct()
    packages = files.filter(paths.file_name(F.col("path")) == "__init__.py").select(F.col("dir").alias("at"), F.lit(True).alias("is_package")).filter("at <> '' AND at NOT LIKE '%/.git' AND at <> '.git'").distinct()
    up = dirs.select("dir", F.explode(paths.beginnings(F.col("dir"))).alias("at"))
    return up.join(packages, "at", "left").select("dir", "at", F.coalesce("is_package", F.lit(False)).alias("is_package"))


def _package_base(up: DataFrame) -> DataFrame:
    """dir, base: the length of the deepest folder at or above dir that is no package; -1 if all are."""
    return up.groupBy("dir").agg(F.coalesce(F.max(F.when(~F.col("is_package"), F.length("at"))), F.lit(-1)).alias("base"))


def package_files(listing: DataFrame, roots: DataFrame) -> DataFrame:
    """root, path of the Python files a walk from each root (no final slash) meets that enters packages only: files directly in
    a root count whether or not it is a package, and nothing beneath a folder that is none. A file may lie beneath several roots."""
    files = _python_files(listing)
    up = _beginnings(files)
    # a walk from a root reaches a folder if all folders below the root, down to it, are packages
    reached = up.join(roots.select(F.col("root").alias("at")).distinct(), "at").join(_package_base(up), "dir").filter(F.length("at") >= F.col("base"))
    return files.join(reached.select("dir", F.col("at").alias("root")), "dir").select("root", "path")


def full_module_names(listing: DataFrame) -> DataFrame:
    """path, full_name, package_root of the Python files: the dotted name from the highest folder that can be climbed to through packages
    only, and the folder above those. A package's __init__ has the package's name; outside of any package its name is ''."""
    files = _python_files(listing)
    based = files.join(_package_base(_beginnings(files)), "dir")
    stem = F.regexp_replace(paths.file_name(F.col("path")), r"(?<=.)\.[^.]*$", "")
    inside = F.expr("translate(substring(dir, base + 2), '/', '.')")
    return based.select("path", paths.join_names(inside, F.when(stem != "__init__", stem)).alias("full_name"), F.expr("substring(dir, 1, greatest(base, 0))").alias("package_root"))


def modules_under(listing: DataFrame, root: str, excluded: list[str]) -> DataFrame:
    """path of the Python files anywhere beneath a folder, without those whose path has one of the excluded texts in it."""
    p = F.col("path")
    wanted = paths.is_python_file(p) & p.startswith(root.rstrip("/") + "/")
    for text in excluded:
        wanted &= ~p.contains(text)
    return listing.filter(wanted).select("path").distinct()


def update_report(log: DataFrame) -> DataFrame:
    """How often each action was taken on each day."""
    return log.groupBy("action_type", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n_actions"))
