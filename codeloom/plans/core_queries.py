"""Queries p1, p2 and p5 over the symbol index, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import changelog, keytotals, orphans
from codeloom.session import table, work_path, written


def _module_text(m="module_key"):
    return F.concat(F.col(f"{m}.module_source_type").cast("string"), F.lit("|"), F.col(f"{m}.id"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    entries, aliases, modules = (table(spark, d, t) for t in ("symbol_entries", "symbol_aliases", "modules"))
    found = orphans.orphan_references(orphans.symbol_index_references(entries, aliases), orphans.symbol_index_targets(modules, entries))
    return found.select("ref_table", "ref_id", F.date_format("ref_ts", "yyyy-MM").alias("ref_month"), "status")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and status."""
    return p1_found(spark, d).groupBy("ref_table", "ref_month", "status").agg(F.count(F.lit(1)).alias("n_orphans"))


def p1_keys_now(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "symbol_entries").drop("ingested_at").dropDuplicates(["entry_id"])
    aliases = table(spark, d, "symbol_aliases").dropDuplicates(["alias_id"])
    modules = table(spark, d, "modules").dropDuplicates(["module_row_id"])
    return orphans.orphan_keys_now(orphans.symbol_index_references(entries, aliases), orphans.symbol_index_targets(modules, entries))


def p1_keys_maintained(spark: SparkSession, d: str) -> DataFrame:
    """p1_keys_now, reached by keeping the counts of an older day and applying the changes since."""
    entries = table(spark, d, "symbol_entries").drop("ingested_at").dropDuplicates(["entry_id"])
    aliases, modules = table(spark, d, "symbol_aliases").dropDuplicates(["alias_id"]), table(spark, d, "modules").dropDuplicates(["module_row_id"])
    deltas = orphans.key_deltas(orphans.symbol_index_references(entries, aliases), orphans.symbol_index_targets(modules, entries))
    late = F.coalesce(F.col("ts") >= "2024-07-01", F.lit(False))
    state = written(orphans.apply_deltas(deltas.limit(0), deltas.filter(~late)), "orphan-counts")
    return orphans.apply_deltas(state, deltas.filter(late)).filter("n_refs > 0 AND n_live = 0")


def _key_totals(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "symbol_entries")
    return keytotals.key_totals(entries, F.col("entry_id"), _module_text(), F.col("symbol_name"), F.col("import_count"))


def _named(totals: DataFrame, *cols: str) -> DataFrame:
    name = F.when(F.col("field") == 0, "module_key").otherwise("symbol_name")
    return totals.select(name.alias("field_name"), "key_value", *cols)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _named(keytotals.heavy_keys(written(_key_totals(spark, d), "key-totals"), 2))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    return _named(_key_totals(spark, d), F.col("n_rows").alias("n_entries"), F.col("n_partners").alias("n_others"), F.col("total").alias("sum_import_count"))


def _changed(capture: changelog.ChangeCapture, runs: DataFrame, listing: DataFrame) -> DataFrame:
    captured = capture.captured()
    stored = listing.select("root_dir", "path", F.lit(0.0).alias("file_timestamp")).limit(0) if captured is None else changelog.stored_files(captured, runs)
    return changelog.changed_files(stored, listing)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    runs, listing = table(spark, d, "index_runs"), table(spark, d, "file_listing")
    capture = changelog.file_capture(spark, work_path(spark, "file-log"), f"{d}/file_history.parquet", runs)
    capture.catch_up()
    return _changed(capture, runs, listing)


def p5_three_runs(spark: SparkSession, d: str) -> DataFrame:
    """p5_found with the records arriving in three deliveries that mix early and late ones, and a run after each; the second run
    is lost after it has written and is repeated. Each run reads the files of its own delivery."""
    history, runs, listing = (table(spark, d, t) for t in ("file_history", "index_runs", "file_listing"))
    log, work = work_path(spark, "deliveries"), work_path(spark, "file-log")

    def lost(step: str) -> None:
        if step == "written":
            raise InterruptedError

    for k in range(3):
        history.filter(F.pmod(F.xxhash64("history_id", "run_id"), F.lit(3)) == k).write.mode("append").parquet(log)
        capture = changelog.file_capture(spark, work, log, runs, fold_every=2)
        if k == 1:
            try:
                capture.run(lost)
            except InterruptedError:
                capture = changelog.file_capture(spark, work, log, runs, fold_every=2)
        capture.catch_up()
    return _changed(capture, runs, listing)


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_keys_now": p1_keys_now, "p1_keys_maintained": p1_keys_maintained, "p2_found": p2_found, "p2_totals": p2_totals, "p5_found": p5_found, "p5_three_runs": p5_three_runs}

_NORMAL = """CASE WHEN starts_with(module_key.id, '/') THEN coalesce(nullif(list_reduce(list_filter(string_split(module_key.id, '/'), lambda x: x <> '' AND x <> '.'),
  lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END, ''), ''), '/') ELSE module_key.id END"""

_P1_REFS = f"""refs AS (
  SELECT DISTINCT 'symbol_entries' ref_table, entry_id ref_id, added_at ts, removed_at gone, 'module' kind, module_key.module_source_type kt, module_key.id ki, '' kn, false kf
  FROM symbol_entries WHERE NOT (coalesce(not_yet_found_in_module, false) AND coalesce(import_count, 0) <= 0)
  UNION ALL
  SELECT DISTINCT 'symbol_aliases', alias_id, recorded_at, CAST(NULL AS TIMESTAMP), 'entry', module_key.module_source_type, {_NORMAL}, real_name, is_module_itself
  FROM symbol_aliases WHERE coalesce(import_count, 0) > 0),
targets AS (
  SELECT 'module' kind, module_key.module_source_type kt, module_key.id ki, '' kn, false kf, first_seen_at b, removed_at e FROM (SELECT DISTINCT * FROM modules)
  UNION ALL
  SELECT 'entry', kt, ki, symbol_name, is_module_itself, added_at, removed_at FROM (SELECT DISTINCT entry_id, module_key.module_source_type kt, module_key.id ki, symbol_name, is_module_itself, added_at, removed_at
  FROM symbol_entries WHERE NOT coalesce(not_yet_found_in_module, false)))"""

_P1 = f"""WITH {_P1_REFS},
found AS (
  SELECT r.ref_table, r.ref_id, r.ts, count(t.kind) n, count(*) FILTER (t.b <= r.ts) begun, count(*) FILTER (t.b <= r.ts AND (t.e IS NULL OR t.e > r.ts)) live
  FROM refs r LEFT JOIN targets t ON r.kind = t.kind AND r.kt = t.kt AND r.ki = t.ki AND r.kn = t.kn AND r.kf = t.kf
  WHERE r.ts IS NOT NULL AND r.kt IS NOT NULL AND r.ki IS NOT NULL AND r.kn IS NOT NULL AND r.kf IS NOT NULL GROUP BY 1, 2, 3),
out AS (SELECT ref_table, ref_id, strftime(ts, '%Y-%m') ref_month, CASE WHEN n = 0 THEN 'missing' WHEN begun > 0 THEN 'deleted' ELSE 'late' END status FROM found WHERE live = 0)"""

_P2 = """WITH once AS (SELECT DISTINCT entry_id, CAST(module_key.module_source_type AS VARCHAR) || '|' || module_key.id m, symbol_name s, coalesce(import_count, 0) c FROM symbol_entries),
totals AS (SELECT 'module_key' field_name, m key_value, count(*) n_entries, count(DISTINCT coalesce(s, '')) n_others, CAST(sum(c) AS BIGINT) sum_import_count FROM once GROUP BY m
  UNION ALL SELECT 'symbol_name', s, count(*), count(DISTINCT coalesce(m, '')), CAST(sum(c) AS BIGINT) FROM once GROUP BY s)"""

ORACLES = {
    "p1_found": f"{_P1} SELECT * FROM out",
    "p1_report": f"{_P1} SELECT ref_table, ref_month, status, count(*) n_orphans FROM out GROUP BY 1, 2, 3",
    "p1_keys_now": f"""WITH {_P1_REFS}, sums AS (SELECT kind, kt, ki, kn, kf, sum(r) n_refs, sum(l) n_live FROM (
        SELECT kind, kt, ki, kn, kf, 1 r, 0 l FROM refs WHERE ts IS NOT NULL AND gone IS NULL UNION ALL SELECT kind, kt, ki, kn, kf, 0, CASE WHEN b IS NOT NULL AND e IS NULL THEN 1 ELSE 0 END FROM targets) GROUP BY 1, 2, 3, 4, 5)
        SELECT kind, kt key_type, ki key_id, kn key_name, kf key_itself, CAST(n_refs AS BIGINT) n_refs, CAST(n_live AS BIGINT) n_live FROM sums
        WHERE n_refs > 0 AND n_live = 0 AND kt IS NOT NULL AND ki IS NOT NULL AND kn IS NOT NULL AND kf IS NOT NULL""",
    "p2_found": f"{_P2} SELECT field_name, key_value FROM totals WHERE key_value IS NOT NULL AND n_entries * 50 > (SELECT count(*) FROM once)",
    "p2_totals": f"{_P2} SELECT * FROM totals",
    "p5_found": r"""WITH good AS (SELECT DISTINCT run_id FROM index_runs WHERE lower(status) = 'ok'),
        h AS (SELECT run_id, regexp_replace(root_dir, '/+$', '') root_dir, path, coalesce(removed, false) removed, coalesce(file_timestamp, 0) ts
          FROM file_history SEMI JOIN good USING (run_id) WHERE path NOT LIKE '%/'),
        last AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY root_dir, path ORDER BY run_id DESC, removed DESC, ts DESC) = 1),
        stored AS (SELECT root_dir, path, ts FROM last WHERE NOT removed),
        listed AS (SELECT regexp_replace(root_dir, '/+$', '') root_dir, path, max(coalesce(mtime, 0)) mtime FROM file_listing WHERE NOT coalesce(is_dir, false) AND path NOT LIKE '%/' GROUP BY 1, 2)
        SELECT root_dir, path, 1 updated FROM listed LEFT JOIN stored USING (root_dir, path) WHERE mtime > coalesce(ts, 0)
        UNION ALL SELECT root_dir, path, 0 FROM stored ANTI JOIN listed USING (root_dir, path)""",
}

ORACLES |= {"p1_keys_maintained": ORACLES["p1_keys_now"], "p5_three_runs": ORACLES["p5_found"]}
