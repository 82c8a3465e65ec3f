"""Processing only what was added to a log since the last successful run.

A log is a folder of Parquet files, or one file, to which records are appended: by new files, or by a longer file in place of one,
which begins with the same rows. Each file is a partition of the log and the position of a row in its file is the offset. Both
follow from the order of arrival, not from a column, so records that come late, out of order or without any number are taken as well.

A run

1. lists the log, and writes its plan before it touches data: the range of offsets of each file that is new or has grown;
2. reads those files and no others, and writes the rows of the ranges into the folder of its batch, replacing what an earlier
   attempt left there;
3. writes a commit.

A run that finds a plan without commit repeats that very plan, so a failure at any point neither skips nor repeats a row.
Readers see committed batches only and take each key, file and offset once. Every few batches the sink is folded into a state, so
what readers read grows with what is stored and not with all that ever came.

The driver holds the names of the files of one batch, of which there are at most max_files, and never rows. A run costs a listing of
the log, as any reader of a folder needs, and the reading of what is new.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLAN = "path string, uri string, size bigint, mtime timestamp, lo bigint, hi bigint"
#: A batch takes at most so many files; what is beyond comes in the next one.
MAX_FILES = 10_000
#: After so many batches the sink is folded.
FOLD_EVERY = 8


class _Files:
    """Small files in the shared folder, through the file system the cluster uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All or nothing: the file gets its name by a rename."""
        part = self.path(name + ".part")
        out = self.fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.fs.rename(part, self.path(name)):
            raise OSError(f"{name} is there already")


class ChangeCapture:
    """Captures the log at a path in batches under root.

    keep: what of the log's rows is captured (a projection and filter); its rows must still have the columns of key. fold: rows to the
    rows that readers may still need, of the same columns; folding what was folded, with more rows, must come to the same
    (None: all rows are kept). A log with no files gives nothing to capture; files that became shorter are refused."""

    def __init__(
        self, spark: SparkSession, root: str, log: str, key: list[str], keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
        fold: Callable[[DataFrame], DataFrame] | None = None, max_files: int = MAX_FILES, fold_every: int = FOLD_EVERY,
    ):
        self.spark, self.root, self.log, self.key, self.keep, self.fold = spark, root.rstrip("/"), log, key, keep, fold
        self.max_files, self.fold_every = max_files, fold_every
        self.files = _Files(spark, root)

    def _numbers(self, kind: str) -> list[int]:
        return [int(n[:-5]) for n in self.files.names(f"{self.root}/{kind}") if n.endswith(".json")]

    def _plan(self, n: int) -> list[dict]:
        return [json.loads(x) for x in self.files.read(f"{self.root}/plans/{n:08d}.json").splitlines()]

    def _grown(self, plans: list[int]) -> list[dict]:
        """The files of the log that are not as they were when last taken, at most max_files."""
        # of binary files only what the listing tells is read, as the contents are not asked for
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(self.log)
        m = F.col("_metadata")
        now = listed.select("path", m["file_path"].alias("uri"), m["file_size"].alias("size"), m["file_modification_time"].alias("mtime")).filter("size > 0")
        if plans:
            before = self.spark.read.schema(PLAN).json([f"{self.root}/plans/{n:08d}.json" for n in plans])
            last = before.groupBy("uri").agg(F.max(F.struct("hi", "mtime", "size")).alias("last"))
            same = F.coalesce((F.col("last.size") == F.col("size")) & (F.col("last.mtime") == F.col("mtime")), F.lit(False))
            now = now.join(last, "uri", "left").filter(~same).select("path", "uri", "size", "mtime", F.coalesce("last.hi", F.lit(0)).alias("lo"))
        else:
            now = now.withColumn("lo", F.lit(0))
        return [r.asDict() for r in now.orderBy("mtime", "uri").limit(self.max_files).collect()]

    def plan(self) -> tuple[int, list[dict], bool] | None:
        """The plan to run and whether it is new: one without commit if there is one, else a new one, else None as nothing is new."""
        plans, commits = self._numbers("plans"), set(self._numbers("commits"))
        for n in plans:
            if n not in commits:
                return n, self._plan(n), False
        grown = self._grown(plans)
        if not grown:
            return None
        # counted without reading a column
        rows = self.spark.read.parquet(*[f["path"] for f in grown]).groupBy(F.col("_metadata.file_path").alias("uri")).count()
        hi = {r["uri"]: r["count"] for r in rows.collect()}
        for f in grown:
            f["hi"], f["mtime"] = hi.get(f["uri"], 0), f["mtime"].isoformat()
            if f["hi"] < f["lo"]:
                raise ValueError(f"{f['path']} lost rows that were captured")
        n = plans[-1] + 1 if plans else 0
        self.files.write(f"{self.root}/plans/{n:08d}.json", "\n".join(map(json.dumps, grown)))
        return n, grown, True

    def rows(self, plan: list[dict], new: bool = False) -> DataFrame:
        """The log's rows in the ranges of a plan, with log_part and log_offset. Of a new plan, files that come for the first time are
        read whole: should one have grown in between, its last rows come again with the next batch and count once."""
        log = self.spark.read.parquet(*[f["path"] for f in plan])
        m = F.col("_metadata")
        at = log.select("*", F.xxhash64(m["file_path"]).alias("log_part"), m["row_index"].alias("log_offset"))
        if new and not any(f["lo"] for f in plan):
            return at
        ranges = self.spark.createDataFrame([(f["uri"], f["lo"], f["hi"]) for f in plan], "uri string, lo bigint, hi bigint")
        ranges = ranges.select(F.xxhash64("uri").alias("log_part"), "lo", "hi")  # at most max_files rows
        return at.join(F.broadcast(ranges), "log_part").filter("log_offset >= lo AND log_offset < hi").drop("lo", "hi")

    def run(self, fail: Callable[[str], None] = lambda step: None) -> int | None:
        """One batch; gives its number, or None if there was nothing new. fail is called after each step (tests raise in it)."""
        todo = self.plan()
        return None if todo is None else self._batch(*todo, fail)

    def _batch(self, n: int, plan: list[dict], new: bool, fail: Callable[[str], None] = lambda step: None) -> int:
        fail("planned")
        self._write(self.keep(self.rows(plan, new)), f"sink/batch={n}")
        fail("written")
        self.files.write(f"{self.root}/commits/{n:08d}.json", "{}")
        if self.fold and (n + 1) % self.fold_every == 0:
            fail("committed")
            self._write(self.fold(self.captured()), f"state/upto={n}")
            self.files.write(f"{self.root}/states/{n:08d}.json", "{}")
        return n

    def catch_up(self) -> int:
        """Batches until all is taken that was there at the last listing; gives their number."""
        done = 0
        while (todo := self.plan()) is not None:
            self._batch(*todo)
            done += 1
            if todo[2] and len(todo[1]) < self.max_files:
                break
        return done

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")

    def captured(self) -> DataFrame | None:
        """The rows of all committed batches, each key, file and offset once; those of folded batches as the fold left them."""
        done, folded = self._numbers("commits"), self._numbers("states")
        if not done:
            return None
        names = [f"state/upto={folded[-1]}"] if folded else []
        names += [f"sink/batch={n}" for n in done if not folded or n > folded[-1]]
        return self.spark.read.parquet(*[f"{self.root}/{x}" for x in names]).dropDuplicates([*self.key, "log_part", "log_offset"])


# --- files of an indexed root -------------------------------------------------------------------------------------


def bare_root(root: Column) -> Column:
    return F.when(root.rlike("^/+$"), F.lit("/")).otherwise(F.regexp_replace(root, "/+$", ""))


def file_log(history: DataFrame) -> DataFrame:
    """The log of file records: directories and rows without path or root left out, roots without final slash."""
    at = [c for c in ("log_part", "log_offset") if c in history.columns]
    return history.filter(F.col("root_dir").isNotNull() & ~F.col("path").endswith("/")).select("run_id", bare_root(F.col("root_dir")).alias("root_dir"), "path", "removed", "file_timestamp", *at)


def file_capture(spark: SparkSession, root: str, log: str, runs: DataFrame, **options) -> ChangeCapture:
    return ChangeCapture(spark, root, log, ["root_dir", "path"], file_log, lambda rows: undecided_files(rows, runs), **options)


def undecided_files(captured: DataFrame, runs: DataFrame) -> DataFrame:
    """The records that may still count: per root and path those of its latest successful run and of later runs, whose
    status may yet become 'ok'. One record of each run is kept, the one stored_files would take."""
    good = runs.filter(F.lower("status") == "ok").select("run_id", F.lit(True).alias("good")).distinct()
    each = captured.groupBy("root_dir", "path", "run_id").agg(F.max(F.struct(*_record(), "removed", "file_timestamp", "log_part", "log_offset")).alias("r"))
    best = Window.partitionBy("root_dir", "path")  # a row for each run since the last fold
    marked = each.join(good, "run_id", "left").withColumn("best", F.max(F.when(F.col("good"), F.col("run_id"))).over(best))
    kept = marked.filter("best IS NULL OR run_id >= best")
    return kept.select("run_id", "root_dir", "path", "r.removed", "r.file_timestamp", "r.log_part", "r.log_offset")


def _record() -> list[Column]:
    return [F.coalesce("removed", F.lit(False)).alias("gone"), F.coalesce("file_timestamp", F.lit(0.0)).alias("ts")]


def stored_files(captured: DataFrame, runs: DataFrame) -> DataFrame:
    """root_dir, path, file_timestamp of the files that successful runs left: the record of the largest run_id counts. Statuses
    are read now, so a run that ends well later makes its records count then. A null `removed` is false."""
    good = runs.filter(F.lower("status") == "ok").select("run_id").distinct()
    last = captured.join(good, "run_id", "left_semi").groupBy("root_dir", "path").agg(F.max(F.struct("run_id", *_record())).alias("s"))
    return last.filter(~F.col("s.gone")).select("root_dir", "path", F.col("s.ts").alias("file_timestamp"))


def changed_files(stored: DataFrame, listing: DataFrame) -> DataFrame:
    """root_dir, path, updated: 1 for a listed file newer than stored (0 where nothing is stored), 0 for a stored file not listed.
    Of a path listed more than once the largest mtime counts, null being 0. Directories and rows without path or root are left out."""
    listed = (
        listing.filter(F.col("root_dir").isNotNull() & ~F.coalesce("is_dir", F.lit(False)) & ~F.col("path").endswith("/"))
        .select(bare_root(F.col("root_dir")).alias("root_dir"), "path", F.coalesce("mtime", F.lit(0.0)).alias("mtime"))
        .groupBy("root_dir", "path")
        .agg(F.max("mtime").alias("mtime"))
    )
    both = listed.join(stored, ["root_dir", "path"], "full_outer")
    updated = F.when(F.col("mtime") > F.coalesce("file_timestamp", F.lit(0.0)), 1).when(F.col("mtime").isNull(), 0)
    return both.select("root_dir", "path", updated.alias("updated")).filter(F.col("updated").isNotNull())
