"""The operators behind p1, p2 and p5 on small rows: nulls, ties, repeats, empty tables, hot keys, failures."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloom import session
from codeloom.operators import changelog, keytotals, orphans

T0 = datetime(2024, 1, 1)
REF = "kind string, key_type int, key_id string, key_name string, key_itself boolean, ref_table string, ref_id bigint, ref_ts timestamp_ntz"
TGT = "kind string, key_type int, key_id string, key_name string, key_itself boolean, begin_ts timestamp_ntz, end_ts timestamp_ntz"


def _day(n):
    return None if n is None else T0 + timedelta(hours=n)


def _brute(refs, targets):
    out = set()
    for *key, t, i, ts in refs:
        if ts is None or None in key:
            continue
        mine = [(b, e) for *k, b, e in targets if k == key]
        if not any(b is not None and b <= ts and (e is None or e > ts) for b, e in mine):
            out.add((t, i, "missing" if not mine else "deleted" if any(b is not None and b <= ts for b, _ in mine) else "late"))
    return out


@pytest.mark.parametrize("rows_per_task", [10**6, 50, 2])
def test_orphans_against_brute_force(spark, rows_per_task):
    rng = random.Random(3)
    key = lambda: ["m", rng.choice([3, 3, 1, None]), rng.choice(["a", "a", "a", "b", "c", None]), "", False]
    refs = [(*key(), "t", n, _day(rng.choice([None, *range(60)]))) for n in range(300)]
    targets = [(*key(), _day(rng.choice([None, *range(60)])), _day(rng.choice([None, *range(60)]))) for _ in range(12)]
    r = spark.createDataFrame(refs + refs[:50], REF).withColumn("live", F.lit("clash")).withColumn("total", F.lit(1))
    t = spark.createDataFrame(targets + targets[:5], TGT).withColumn("ts", F.lit("clash"))
    got = {(x["ref_table"], x["ref_id"], x["status"]) for x in orphans.orphan_references(r, t, rows_per_task).collect()}
    assert got == _brute(refs, targets)
    assert got


@pytest.mark.parametrize("copies", [False, True])
def test_a_key_with_all_rows_in_one_microsecond_is_spread(spark, monkeypatch, copies):
    seen = []
    monkeypatch.setattr(orphans, "written", lambda df, name: seen.append(session.written(df, name)) or seen[-1])
    key = [F.lit("m").alias("kind"), F.lit(3).alias("key_type"), F.lit("hot").alias("key_id"), F.lit("").alias("key_name"), F.lit(False).alias("key_itself")]
    ids = F.lit(7).cast("bigint") if copies else F.col("id")
    refs = spark.range(20_000).select(*key, F.lit("t").alias("ref_table"), ids.alias("ref_id"), F.lit(T0).cast("timestamp_ntz").alias("ref_ts"))
    ended = spark.createDataFrame([("m", 3, "hot", "", False, T0 - timedelta(days=1), T0)] * 3, TGT)
    got = orphans.orphan_references(refs, ended, 1000)
    assert [(x["status"], x["n"]) for x in got.groupBy("status").agg(F.count("*").alias("n")).collect()] == [("deleted", 1 if copies else 20_000)]
    sizes = [x["count"] for x in seen[0].groupBy("slice").count().collect()]
    assert max(sizes) < 2000 and (copies or len(sizes) > 20)
    live = spark.createDataFrame([("m", 3, "hot", "", False, T0, None)], TGT)
    assert orphans.orphan_references(refs, live, 1000).count() == 0


def test_tasks_follow_the_rows(spark):
    r, t = spark.createDataFrame([], REF), spark.createDataFrame([], TGT)
    many = spark.range(3000).select(F.lit("m").alias("kind"), F.lit(3).alias("key_type"), F.col("id").cast("string").alias("key_id"), F.lit("").alias("key_name"), F.lit(False).alias("key_itself"), F.lit("t").alias("ref_table"), F.col("id").alias("ref_id"), F.lit(T0).cast("timestamp_ntz").alias("ref_ts"))
    for refs, per_task, tasks in ((r, 10, 4), (many, 1000, 4), (many, 100, 30)):
        plan = orphans.orphan_references(refs, t, per_task)._jdf.queryExecution().executedPlan().toString()
        assert f"hashpartitioning(key_hash" in plan and f", {tasks}), REPARTITION_BY_NUM" in plan


def test_orphans_of_empty_tables(spark):
    r, t = spark.createDataFrame([], REF), spark.createDataFrame([], TGT)
    assert orphans.orphan_references(r, t).count() == 0
    one = spark.createDataFrame([("m", 3, "x", "", False, "t", 1, T0)], REF)
    assert [x["status"] for x in orphans.orphan_references(one, t).collect()] == ["missing"]


def test_signed_deltas_equal_recount(spark):
    cols = "kind string, key_type int, key_id string, key_name string, key_itself boolean, n_refs bigint, n_live bigint"
    k = ("m", 3, "x", "", False)
    state = spark.createDataFrame([(*k, 2, 1)], cols)
    gone = orphans.apply_deltas(state, spark.createDataFrame([(*k, 0, -1), (*k, 1, 0)], cols))
    assert [(x["n_refs"], x["n_live"]) for x in gone.collect()] == [(3, 0)]
    assert orphans.apply_deltas(gone, spark.createDataFrame([(*k, -3, 0)], cols)).count() == 0


def test_keys_now_with_references_that_end(spark):
    k, day = ("m", 3, "x", "", False), timedelta(days=1)
    other = ("m", 3, "y", "", False)
    refs = spark.createDataFrame([(*k, "t", 1, T0, None), (*k, "t", 2, T0, T0 + day), (*k, "t", 3, T0, T0), (*k, "t", 4, None, None), (*other, "t", 5, T0, T0 + day)], REF + ", ref_end timestamp_ntz")
    targets = spark.createDataFrame([(*k, T0, T0 + day), (*k, T0, T0), (*other, None, None)], TGT)
    assert [(x["key_id"], x["n_refs"], x["n_live"]) for x in orphans.orphan_keys_now(refs, targets).collect()] == [("x", 1, 0)]
    deltas = orphans.key_deltas(refs, targets)
    first = orphans.apply_deltas(deltas.limit(0), deltas.filter(F.col("ts") <= F.lit(T0)))
    assert {(x["key_id"], x["n_refs"], x["n_live"]) for x in first.collect()} == {("x", 2, 1), ("y", 1, 0)}
    assert {(x["key_id"], x["n_refs"], x["n_live"]) for x in orphans.apply_deltas(first, deltas.filter(F.col("ts") > F.lit(T0))).collect()} == {("x", 1, 0)}


@pytest.mark.parametrize(("path", "want"), [("/a//b/./c", "/a/b/c"), ("/a/../../b", "/b"), ("/..", "/"), ("a/../b", "a/../b"), ("/a/b/", "/a/b"), ("/a/..b/.c", "/a/..b/.c"), ("", ""), (None, None)])
def test_normal_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(orphans.normal_path(F.col("p"))).first()[0] == want


def test_key_totals(spark):
    rows = [(n, "hot" if n % 3 else f"k{n}", f"s{n % 7}", n % 5) for n in range(500)] + [(900, None, "s1", None), (901, "ä", None, -4), (902, "ä", None, 2**61)]
    df = spark.createDataFrame(rows + rows[:100], "i bigint, a string, b string, w bigint").withColumn("n_rows", F.lit("clash"))
    got = {(x["field"], x["key_value"]): (x["n_rows"], x["n_partners"], x["total"]) for x in keytotals.key_totals(df, F.col("i"), F.col("a"), F.col("b"), F.col("w")).collect()}
    want = {}
    for field in (0, 1):
        for key in {r[1 + field] for r in rows}:
            own = [r for r in rows if r[1 + field] == key]
            want[field, key] = (len(own), len({r[2 - field] for r in own}), sum(r[3] or 0 for r in own))
    assert got == want
    small = keytotals.key_totals(df, F.col("i"), F.col("a"), F.col("b"), F.col("w"), block_keys=3)
    assert {(x["field"], x["key_value"]): (x["n_rows"], x["n_partners"], x["total"]) for x in small.collect()} == want
    totals = keytotals.key_totals(df, F.col("i"), F.col("a"), F.col("b"), F.col("w"))
    heavy = {(x["field"], x["key_value"]) for x in keytotals.heavy_keys(totals, 2).collect()}
    assert heavy == {k for k, v in want.items() if k[1] is not None and v[0] > 0.02 * len(rows)}


def test_key_totals_of_nothing(spark):
    df = spark.createDataFrame([], "i bigint, a string, b string, w bigint")
    totals = keytotals.key_totals(df, F.col("i"), F.col("a"), F.col("b"), F.col("w"))
    assert totals.count() == 0
    assert keytotals.heavy_keys(totals, 2).count() == 0


class Boom(Exception):
    pass


LOG = "history_id bigint, root_dir string, path string, run_id bigint, removed boolean, file_timestamp double"
RUNS = "run_id bigint, status string"


def _at(step):
    def fail(s):
        if s == step:
            raise Boom

    return fail


def _deliver(spark, log, rows):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(log)


def _ids(cap):
    return sorted(x["run_id"] for x in cap.captured().collect())


def test_capture_survives_failures(spark, tmp_path):
    log, root, runs = f"file://{tmp_path}/a log", f"file://{tmp_path}/capture", spark.createDataFrame([], RUNS)
    # the run_id, used as an identifier here, follows no order at all
    rows = [(None, "/r", f"/r/{n % 5}", 7 * n % 20, False, float(n)) for n in range(20)]
    cap = changelog.file_capture(spark, root, log, runs)
    assert cap.captured() is None
    _deliver(spark, log, rows[:12])
    with pytest.raises(Boom):
        cap.run(_at("planned"))
    assert cap.captured() is None
    _deliver(spark, log, rows[12:])
    assert cap.run() == 0  # repeats the old plan although the log has grown
    assert _ids(cap) == sorted(7 * n % 20 for n in range(12))
    with pytest.raises(Boom):
        cap.run(_at("written"))
    assert len(_ids(cap)) == 12
    again = changelog.file_capture(spark, root, log, runs)
    assert again.run() == 1
    assert _ids(again) == list(range(20))
    assert again.run() is None


def test_a_run_reads_only_what_is_new(spark, tmp_path):
    log, runs = f"file://{tmp_path}/log", spark.createDataFrame([], RUNS)
    cap = changelog.file_capture(spark, f"file://{tmp_path}/capture", log, runs)
    _deliver(spark, log, [(n, "/r", f"/r/{n}", n, False, 1.0) for n in range(100)])
    first = cap.rows(cap.plan()[1]).inputFiles()
    cap.run()
    _deliver(spark, log, [(n, "/r", f"/r/{n}", n, False, 1.0) for n in (5, 3, 200)])  # repeats, late and new
    plan = cap.plan()[1]
    assert [(f["lo"], f["hi"]) for f in plan] == [(0, 3)]
    assert not set(first) & set(cap.rows(plan).inputFiles())
    assert cap.rows(plan, new=True).count() == cap.rows(plan).count() == 3
    cap.run()
    assert len(_ids(cap)) == 103


def test_files_that_grow_shrink_and_come_in_parts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def put(name, n):
        t = {"history_id": list(range(n)), "root_dir": ["/r"] * n, "path": [f"{name}{k}" for k in range(n)], "run_id": list(range(n)), "removed": [False] * n, "file_timestamp": [1.0] * n}
        pq.write_table(pa.table(t), tmp_path / "log" / f"{name}.parquet")

    (tmp_path / "log").mkdir()
    cap = changelog.file_capture(spark, f"file://{tmp_path}/capture", f"file://{tmp_path}/log", spark.createDataFrame([], RUNS), max_files=2)
    assert cap.run() is None
    for name in "abc":
        put(name, 3)
    assert cap.catch_up() == 2
    assert len(_ids(cap)) == 9
    put("b", 5)
    with pytest.raises(Boom):
        cap.run(_at("planned"))
    put("b", 8)
    cap.run()
    assert len(_ids(cap)) == 11  # the plan's range, though the file is longer by now
    cap.run()
    assert len(_ids(cap)) == 14
    put("b", 2)
    with pytest.raises(ValueError, match="lost rows"):
        cap.run()


def test_folding_keeps_what_may_still_count(spark, tmp_path):
    log, root = f"file://{tmp_path}/log", f"file://{tmp_path}/capture"
    before = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, None)], RUNS)
    after = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, "Ok"), (3, "Ok")], RUNS)
    cap = changelog.file_capture(spark, root, log, before, fold_every=2)
    _deliver(spark, log, [(1, "/r", "/r/a", 1, False, 1.0), (2, "/r", "/r/a", 3, True, None), (3, "/r", "/r/b", 2, False, 2.0)])
    cap.run()
    _deliver(spark, log, [(4, "/r", "/r/a", 2, False, 4.0), (5, "/r", "/r/b", 1, None, 9.0), (6, "/r", "/r/b", None, False, 1.0), (4, "/r", "/r/a", 2, False, 4.0)])
    with pytest.raises(Boom):
        cap.run(_at("committed"))
    cap = changelog.file_capture(spark, root, log, before, fold_every=2)
    stored = lambda runs: {tuple(x) for x in changelog.stored_files(cap.captured(), runs).collect()}
    assert stored(before) == {("/r", "/r/a", 4.0), ("/r", "/r/b", 2.0)}
    for _ in range(2):
        _deliver(spark, log, [(7, "/r", "/r/c", 1, False, 1.0)])
        cap.run()
    assert cap._numbers("states") == [3]
    assert sorted((x["path"], x["run_id"]) for x in cap.captured().collect()) == [("/r/a", 2), ("/r/a", 3), ("/r/b", 2), ("/r/c", 1)]
    assert stored(before) == {("/r", "/r/a", 4.0), ("/r", "/r/b", 2.0), ("/r", "/r/c", 1.0)}
    assert stored(after) == {("/r", "/r/b", 2.0), ("/r", "/r/c", 1.0)}


def test_changed_files(spark, tmp_path):
    runs = spark.createDataFrame([(1, "OK"), (2, "failed"), (3, "ok"), (3, "ok"), (4, None)], RUNS)
    log = [
        (1, "/r/", "/r/same", 1, False, 5.0), (2, "/r", "/r/newer", 1, None, 5.0), (3, "/r", "/r/newer", 2, False, 50.0), (4, "/r", "/r/gone", 3, False, 1.0),
        (5, "/r", "/r/removed", 1, False, 1.0), (6, "/r//", "/r/removed", 3, True, None), (7, "/r", "/r/dir/", 1, False, 1.0), (8, "/r", "/r/gone", 3, False, 1.0), (9, "/r", "/r/unknown", 9, False, 1.0),
    ]
    listing = [("/r", "/r/same", False, 5.0), ("/r/", "/r/same", False, 4.0), ("/r", "/r/newer", None, 6.0), ("/r", "/r/fresh", False, 1.0), ("/r", "/r/never", False, None), ("/r", "/r/d", True, 9.0), ("/r2", "/r/same", False, 1.0)]
    listing += [(None, "/r/x", False, 9.0), ("/r", None, False, 9.0)]
    log += [(10, None, "/r/y", 1, False, 1.0), (11, "/r", None, 1, False, 1.0), (12, "/r", "/r/z", None, False, 1.0)]
    _deliver(spark, f"file://{tmp_path}/log", log)
    cap = changelog.file_capture(spark, f"file://{tmp_path}/files", f"file://{tmp_path}/log", runs)
    cap.run()
    got = {tuple(x) for x in changelog.changed_files(changelog.stored_files(cap.captured(), runs), spark.createDataFrame(listing, "root_dir string, path string, is_dir boolean, mtime double")).collect()}
    assert got == {("/r", "/r/newer", 1), ("/r", "/r/fresh", 1), ("/r", "/r/gone", 0), ("/r2", "/r/same", 1)}


def test_written_tables_are_cleaned(spark):
    df = session.written(spark.range(3), "x")
    assert df.count() == 3
    session.clean(spark)
    with pytest.raises(Exception, match="(?i)exist"):
        df.count()
