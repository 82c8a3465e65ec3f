"""References to records that do not exist, from signed counts per key.

Every target row becomes two deltas (+1 where it begins, -1 where it ends) and the running sum of the deltas of a key is
the number of targets of that key that exist. A reference is an orphan where that sum is zero.

Rows of one key are summed in one window, in as many tasks as the counted rows need. Keys that hold more rows than a task should
are dealt out by rows: their copies are combined, the rest is range-partitioned by key, time and reference, so that even rows of
one key and one microsecond spread over tasks, and each range opens with the sums of the ranges before it. Which keys those are is
decided on a fixed-size array of row counts per hash bucket; dealing a key out changes where its rows are summed, never the sum.

Defined cases: a reference without time or with a null field in its key refers to nothing and is left out; a target
with a null key is no target; a target without begin is never live, yet counts as a row of its key; a target that ends
at or before its begin is never live. Rows delivered twice change no sum from or to zero, and a reference delivered twice
comes out once. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import written

KEY = ["kind", "key_type", "key_id", "key_name", "key_itself"]
BUCKETS = 1 << 16
#: Rows a task should sum, while there are not more than MAX_TASKS tasks. Hash buckets with more than half of that, and more than four
#: times the usual number, are dealt out by rows.
ROWS_PER_TASK = 1 << 18
MAX_TASKS = 50_000


def normal_path(path: Column) -> Column:
    """Empty, '.' and '..' segments of a path that begins with a slash are resolved; other ids stay as they are."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    walked = F.aggregate(
        parts, F.lit(""), lambda acc, x: F.when(x == "..", F.regexp_replace(acc, "/[^/]*$", "")).otherwise(F.concat(acc, F.lit("/"), x))
    )
    odd = path.rlike(r"//|/\.\.?(/|$)|.+/$")
    return F.when(path.startswith("/") & odd, F.when(walked == "", F.lit("/")).otherwise(walked)).otherwise(path)


def _events(targets: DataFrame) -> DataFrame:
    none, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    lives = F.col("begin_ts").isNotNull() & (F.col("end_ts").isNull() | (F.col("end_ts") > F.col("begin_ts")))
    begun = F.when(F.col("begin_ts").isNotNull(), one).otherwise(none)
    start = F.struct(F.col("begin_ts").alias("ts"), F.when(lives, one).otherwise(none).alias("live"), begun.alias("begun"), one.alias("total"))
    stop = F.struct(F.col("end_ts").alias("ts"), (-one).alias("live"), none.alias("begun"), none.alias("total"))
    each = F.when(lives & F.col("end_ts").isNotNull(), F.array(start, stop)).otherwise(F.array(start))
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in KEY])
    return targets.filter(whole).select(*KEY, F.explode(each).alias("e")).select(*KEY, "e.*")


def orphan_references(refs: DataFrame, targets: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """refs: KEY, ref_table, ref_id, ref_ts; targets: KEY, begin_ts, end_ts. Gives ref_table, ref_id, ref_ts, status for every
    reference that has no live target at ref_ts: 'missing' if its key never has a target row, 'deleted' if one began at or
    before ref_ts, else 'late'."""
    spark, zero, null = refs.sparkSession, F.lit(0).cast("bigint"), F.lit(None)
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*KEY, "ref_ts"]])
    key_hash = F.xxhash64(*KEY).alias("key_hash")
    r = refs.filter(whole).select(*KEY, F.col("ref_ts").alias("ts"), "ref_table", "ref_id", key_hash)
    e = _events(targets).select("*", key_hash)

    bucket = F.pmod("key_hash", F.lit(BUCKETS)).cast("int")
    counts = targets.select(key_hash).unionByName(refs.select(key_hash))
    rows_in = {x["b"]: x["count"] for x in counts.groupBy(bucket.alias("b")).count().collect()}  # at most BUCKETS rows
    total = sum(rows_in.values())
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MAX_TASKS, -(-total // rows_per_task)))
    above = max(max(rows_per_task, total // tasks) // 2, 4 * total // BUCKETS)
    hot = {b: n for b, n in rows_in.items() if n > above}

    def of_both(references: DataFrame, events: DataFrame) -> DataFrame:
        a = references.select(*KEY, "key_hash", "ts", zero.alias("live"), zero.alias("begun"), zero.alias("total"), "ref_table", "ref_id")
        return a.unionByName(events.select(*KEY, "key_hash", "ts", "live", "begun", "total", null.cast("string").alias("ref_table"), null.cast("bigint").alias("ref_id")))

    is_hot = bucket.isin(list(hot)) if hot else F.lit(False)
    both = of_both(r.filter(~is_hot), e.filter(~is_hot)).withColumn("slice", F.lit(-1))
    if hot:
        steps = e.filter(is_hot).groupBy(*KEY, "key_hash", "ts").agg(*[F.sum(c).alias(c) for c in ("live", "begun", "total")])
        order = ["key_hash", *KEY, F.col("ts").asc_nulls_first(), F.col("ref_table").asc_nulls_first(), "ref_id"]
        ranges = of_both(r.filter(is_hot).distinct(), steps).repartitionByRange(-(-2 * sum(hot.values()) // above), *order)
        dealt = written(ranges.withColumn("slice", F.spark_partition_id()), "orphan-ranges")
        # a row for each key and range it lies in; how many ranges there are is known
        sums = dealt.groupBy("key_hash", *KEY, "slice").agg(*[F.sum(c).alias(c) for c in ("live", "begun", "total")])
        by_key = Window.partitionBy("key_hash", *KEY)
        before = by_key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        opening = sums.select(
            *KEY, "key_hash", null.cast(both.schema["ts"].dataType).alias("ts"), F.coalesce(F.sum("live").over(before), zero).alias("live"), F.coalesce(F.sum("begun").over(before), zero).alias("begun"),
            F.sum("total").over(by_key).alias("total"), null.cast("string").alias("ref_table"), null.cast("bigint").alias("ref_id"), "slice",
        )
        both = both.unionByName(dealt.withColumn("total", zero)).unionByName(opening)

    group = Window.partitionBy("key_hash", *KEY, "slice")
    upto = group.orderBy(F.col("ts").asc_nulls_first(), F.col("ref_table").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    counted = both.repartition(tasks, "key_hash", "slice").select(
        "ref_table", "ref_id", "ts", F.sum("live").over(upto).alias("live"), F.sum("begun").over(upto).alias("begun"), F.sum("total").over(group).alias("total"),
    )
    orphans = counted.filter(F.col("ref_table").isNotNull() & (F.col("live") == 0))
    status = F.when(F.col("total") == 0, "missing").when(F.col("begun") > 0, "deleted").otherwise("late")
    return orphans.select("ref_table", "ref_id", F.col("ts").alias("ref_ts"), status.alias("status")).distinct()


def _ref_events(refs: DataFrame) -> DataFrame:
    """KEY, ts, n_refs: +1 where a reference begins and -1 where it ends (ref_end, if refs has it). A reference that ends at or before its
    begin never was."""
    one, whole = F.lit(1).cast("bigint"), reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in [*KEY, "ref_ts"]])
    start = F.struct(F.col("ref_ts").alias("ts"), one.alias("n_refs"))
    if "ref_end" not in refs.columns:
        return refs.filter(whole).select(*KEY, "ref_ts", one.alias("n_refs")).withColumnRenamed("ref_ts", "ts")
    stop = F.struct(F.col("ref_end").alias("ts"), (-one).alias("n_refs"))
    each = F.when(F.col("ref_end").isNull(), F.array(start)).when(F.col("ref_end") > F.col("ref_ts"), F.array(start, stop)).otherwise(F.slice(F.array(start), 1, 0))
    return refs.filter(whole).select(*KEY, F.explode(each).alias("e")).select(*KEY, "e.*")


def key_deltas(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """KEY, ts, n_refs, n_live: what each begin or end of a reference and of a target changes in the counts of its key."""
    zero = F.lit(0).cast("bigint")
    of_targets = _events(targets).select(*KEY, "ts", zero.alias("n_refs"), F.col("live").alias("n_live"))
    return _ref_events(refs).select(*KEY, "ts", "n_refs", zero.alias("n_live")).unionByName(of_targets)


def orphan_keys_now(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Keys that are still referred to and have no target that still exists: KEY, n_refs, n_live. Counts are the sums of all deltas;
    refs and targets must hold every row once."""
    sums = key_deltas(refs, targets).groupBy(*KEY).agg(F.sum("n_refs").alias("n_refs"), F.sum("n_live").alias("n_live"))
    return sums.filter("n_refs > 0 AND n_live = 0")


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """Signed maintenance of KEY, n_refs, n_live: the state after a batch of deltas; keys with both counts zero leave it."""
    cols = [*KEY, "n_refs", "n_live"]
    sums = state.select(*cols).unionByName(deltas.select(*cols)).groupBy(*KEY).agg(F.sum("n_refs").alias("n_refs"), F.sum("n_live").alias("n_live"))
    return sums.filter("n_refs <> 0 OR n_live <> 0")


# --- the symbol index ---------------------------------------------------------------------------------------------


def _key(kind: str, t: Column, i: Column, name: Column, itself: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), t.alias("key_type"), i.alias("key_id"), name.alias("key_name"), itself.alias("key_itself")]


def symbol_index_references(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """What entries and aliases of the symbol index refer to: entries to their module, until they are removed, aliases to an entry."""
    n, absent = F.coalesce("import_count", F.lit(0)), F.coalesce("not_yet_found_in_module", F.lit(False))
    m, none, no = F.col("module_key"), F.lit(""), F.lit(False)
    of_entries = entries.filter(~(absent & (n <= 0))).select(
        *_key("module", m["module_source_type"], m["id"], none, no),
        F.lit("symbol_entries").alias("ref_table"), F.col("entry_id").alias("ref_id"), F.col("added_at").alias("ref_ts"), F.col("removed_at").alias("ref_end"),
    )
    of_aliases = aliases.filter(n > 0).select(
        *_key("entry", m["module_source_type"], normal_path(m["id"]), F.col("real_name"), F.col("is_module_itself")),
        F.lit("symbol_aliases").alias("ref_table"), F.col("alias_id").alias("ref_id"), F.col("recorded_at").alias("ref_ts"),
    )
    return of_entries.unionByName(of_aliases, allowMissingColumns=True)


def symbol_index_targets(modules: DataFrame, entries: DataFrame) -> DataFrame:
    m, none, no = F.col("module_key"), F.lit(""), F.lit(False)
    found = ~F.coalesce("not_yet_found_in_module", F.lit(False))
    of_modules = modules.select(*_key("module", m["module_source_type"], m["id"], none, no), F.col("first_seen_at").alias("begin_ts"), F.col("removed_at").alias("end_ts"))
    of_entries = entries.filter(found).select(
        *_key("entry", m["module_source_type"], m["id"], F.col("symbol_name"), F.col("is_module_itself")),
        F.col("added_at").alias("begin_ts"), F.col("removed_at").alias("end_ts"),
    )
    return of_modules.unionByName(of_entries)
