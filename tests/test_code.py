"""Facts, fixes, sources, the store and the services over small code bases."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from codeloom import schemas, session
from codeloom.functions import udtf
from codeloom.operators import code, fixing, incremental, symbols
from codeloom.sources import files as source_files
from codeloom.sources import store
from codeloom.streaming import indexing, service

PROJECT = {
    "/p/app/__init__.py": "",
    "/p/app/shapes.py": "class Circle:\n    def area(self):\n        return 1\n\ndef make():\n    return Circle()\n",
    "/p/app/other.py": "Circle = 3\n",
    "/p/app/user.py": '"""Uses shapes."""\nimport os\n\nc = Circle()\nprint(c, make())\n',
    "/p/app/star.py": "from .shapes import *\nimport app.shapes as s\n\nx = make(), Circle, s, lost\n",
    "/p/lib/far.py": "from app.shapes import make\nfrom app import shapes\n\nmake(shapes)\n",
    "/p/lib/broken.py": "import os\n\ndef f(:\n    pass\n\ny = os\n",
}


@pytest.fixture(scope="module")
def project(spark):
    return source_files.from_strings(spark, PROJECT).withColumn("root", F.lit("/p")).persist()


def _by_path(project, df, *cols):
    return sorted(tuple(r) for r in df.join(project.select("file_id", "path"), "file_id").select("path", *cols).collect())


def test_resolution(project):
    got = _by_path(project, code.resolved_imports(code.imports(project), project).join(project.select(F.col("file_id").alias("target_id"), F.col("path").alias("target")), "target_id", "left"), "module", "value", "target", "is_module")
    assert ("/p/app/star.py", ".shapes", "*", "/p/app/shapes.py", False) in got
    assert ("/p/app/star.py", "app.shapes", None, "/p/app/shapes.py", False) in got
    assert ("/p/lib/far.py", "app.shapes", "make", "/p/app/shapes.py", False) in got
    assert ("/p/lib/far.py", "app", "shapes", "/p/app/shapes.py", True) in got
    assert ("/p/app/user.py", "os", None, None, None) in got


def test_missing_and_unused(project):
    resolved = code.resolved_imports(code.imports(project), project)
    assert _by_path(project, code.missing_symbols(code.uses(project), resolved, code.exports(project)), "symbol") == [("/p/app/star.py", "lost"), ("/p/app/user.py", "Circle"), ("/p/app/user.py", "make")]
    assert _by_path(project, code.unused_imports(code.imports(project), code.uses(project)), "bound") == [("/p/app/user.py", "os")]


def test_fix(spark, project):
    index = fixing.with_import_counts(fixing.index_of_files(project), code.resolved_imports(code.imports(project), project))
    counts = {(r["symbol_name"], r["module_key"]["id"], r["is_module_itself"]): r["import_count"] for r in index.collect()}
    assert counts["make", "/p/app/shapes.py", False] == 1 and counts["shapes", "/p/app/shapes.py", True] == 2 and counts["Circle", "/p/app/other.py", False] == 0
    new = {r["path"]: r["new_source"] for r in fixing.fix_files(project.drop("root"), index, location="/p").collect()}
    # Circle is called, which the constant of that name cannot be
    assert new["/p/app/user.py"] == '"""Uses shapes."""\nfrom .shapes import (Circle, make)\n\nc = Circle()\nprint(c, make())\n'
    assert new["/p/lib/broken.py"] == PROJECT["/p/lib/broken.py"]
    assert new["/p/lib/far.py"] == PROJECT["/p/lib/far.py"]


def test_stripped_imports_come_back(spark):
    """Take all from-imports out, generate them again: the same names come from the same modules."""
    files = {"/p/a.py": "def alpha(): pass\ndef beta(): pass\n", "/p/b.py": "class Gamma: pass\n", "/p/use.py": "from a import (alpha, beta)\nfrom b import Gamma\n\nalpha(beta(), Gamma())\n"}
    bare = files | {"/p/use.py": "alpha(beta(), Gamma())\n"}
    df = source_files.from_strings(spark, bare)
    index = fixing.with_import_counts(fixing.index_of_files(df), code.resolved_imports(code.imports(df), df))
    new = {r["path"]: r["new_source"] for r in fixing.fix_files(df, index, location="/p/").collect()}
    assert new["/p/use.py"] == "from a import (alpha, beta)\nfrom b import Gamma\nalpha(beta(), Gamma())\n"


@pytest.mark.parametrize(
    ("target", "kind", "at", "want"),
    [("sys", 0, "/p/a.py", "sys"), ("/p/x/y.py", 3, "/p/x/z.py", ".y"), ("/p/x/y.py", 3, "/p/q/r/z.py", "x.y"), ("/p/x/__init__.py", 3, "/p/q/z.py", "x"), ("/else/y.py", 3, "/p/z.py", "..else.y"), ("/p/a/b/c/d.py", 3, "/p/a/b/e/f.py", "..c.d")],
)
def test_module_names(target, kind, at, want):
    assert fixing.module_name(target, kind, at, "/p/") == want


def test_node_tables(project):
    n = code.nodes(project)
    assert _by_path(project, code.descendants(n, ["FunctionDef"]), "name") == [("/p/app/shapes.py", "area"), ("/p/app/shapes.py", "make")]
    assert _by_path(project, code.descendants(n, ["FunctionDef"], recursive=False), "name") == [("/p/app/shapes.py", "make")]
    left = code.without_kinds(n, ["ClassDef", "FunctionDef"]).filter("name IS NOT NULL")
    assert not [r for r in _by_path(project, left, "kind") if r[0] == "/p/app/shapes.py"]
    lines = [r["line"] for r in code.pretty(n).join(project.select("file_id", "path"), "file_id").filter("path LIKE '%other.py'").orderBy("node_id").collect()]
    assert lines == ["Module", "  Assign", "    Name Circle", "    Constant"]
    assert _by_path(project, code.parse_failures(project), "error_kind", "n_skipped_lines") == [("/p/lib/broken.py", "SyntaxError", 3)]
    ctx = {(p, s): json.loads(c) for p, s, c in _by_path(project, code.merged_contexts(code.uses(project)).withColumn("c", F.to_json("contexts")), "symbol", "c")}
    assert ctx["/p/app/user.py", "Circle"] == [{"kind": "call", "attribute": "", "argc": 0}]


def test_empty_and_null_sources(spark):
    df = spark.createDataFrame([(1, "/a.py", None), (2, "/b.py", "")], "file_id bigint, path string, source string")
    assert code.definitions(df).count() == 0 and code.nodes(df).count() == 1 and code.values(df.limit(0)).count() == 0
    twice = df.unionByName(df)
    assert code.python_files(twice, F.col("file_id"), F.col("path"), F.col("source")).count() == 1


def test_edits_as_rows(spark):
    e = [("replace", 0, 0, 0, 1, "b"), ("insert", 0, -1, 0, -1, "!")]
    df = spark.createDataFrame([(1, "a c\n", e), (2, "abc", [("delete", 0, 0, 0, 2, ""), ("replace", 0, 1, 0, 3, "x")]), (3, None, e), (4, "x", [])], f"id bigint, text string, edits array<{fixing.EDIT}>")
    got = {r["id"]: (r["text"], r["error"]) for r in fixing.apply_edits(df).collect()}
    assert got[1] == ("b c!\n", None) and got[2][0] == "abc" and got[2][1] and got[3] == (None, None) and got[4] == ("x", None)


def test_incremental_equals_rebuild(spark):
    before = {"/p/a.py": "def f(): pass\n", "/p/b.py": "from a import f\nimport a\n", "/p/c.py": "from a import f, gone\n"}
    after = {"/p/a.py": "def f(): pass\ndef gone(): pass\n", "/p/b.py": "import a as q\n", "/p/d.py": "from a import f\nfrom b import q\n"}
    ids = {p: n for n, p in enumerate(sorted({*before, *after}))}

    def frame(files):
        return spark.createDataFrame([(ids[p], p, "/p", s) for p, s in files.items()], "file_id bigint, path string, root string, source string")

    changed = frame(after)
    removed = spark.createDataFrame([(ids["/p/c.py"],)], "file_id bigint")
    got = incremental.with_counts(incremental.update(incremental.build(frame(before)), changed, removed))
    x = code.extract(changed)
    want = fixing.with_import_counts(fixing.index_of_files(changed, x), code.resolved_imports(x.imports, changed))
    cols = ["symbol_name", "module_key", "is_module_itself", "symbol_type", "import_count", "file_id"]
    assert got.select(cols).exceptAll(want.select(cols)).count() == 0 and want.select(cols).exceptAll(got.select(cols)).count() == 0
    assert {(r["symbol_name"], r["import_count"]) for r in want.collect()} == {("f", 1), ("gone", 0), ("a", 1), ("b", 0), ("d", 0)}


def test_small_ones(spark, project):
    assert _by_path(project, code.first_of_kind(code.nodes(project), "ClassDef"), "name") == [("/p/app/shapes.py", "Circle")]
    assert ("/p/app/shapes.py", "", 1, 1, 0) in _by_path(project, code.members_by_kind(code.definitions(project)), "scope", "classes", "functions", "assignments")
    nested = source_files.from_strings(spark, {"/n.py": "def f(a):\n    b = 1\n    def g(c):\n        def h():\n            return a, b, c\n        return h\n    return g"})
    assert {(r["function"], r["symbol"]) for r in code.new_cells(code.closures(nested)).collect()} == {("f", "a"), ("f", "b"), ("f.g", "c")}
    chosen = spark.createDataFrame([(1, "f", 9), (1, "g", 9), (2, "f", 9)], "file_id bigint, symbol string, target_id bigint")
    have = spark.createDataFrame([(1, 9, "f"), (2, 9, "*")], "file_id bigint, target_id bigint, bound string")
    assert {(r["file_id"], r["symbol"]) for r in symbols.already_imported(chosen, have).collect()} == {(1, "f"), (2, "f")}
    udtf.register(spark)
    project.createOrReplaceTempView("project_files")
    got = {tuple(r) for r in spark.sql("SELECT path, name FROM project_files, LATERAL code_definitions(source) WHERE scope = ''").collect()}
    assert ("/p/app/shapes.py", "make") in got and ("/p/app/other.py", "Circle") in got


def test_nearest_against_all_pairs(spark):
    rng = random.Random(4)
    path = lambda: "/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + f"/{rng.choice('xyz')}.py"
    files = {n: path() for n in range(60)}
    candidates = sorted({(rng.choice("fg"), rng.choice([3, 3, 3, 0]), path()) for _ in range(40)})
    ways = spark.createDataFrame([(n, p, s, []) for n, p in files.items() for s in "fgh"], "file_id bigint, path string, symbol string, contexts array<string>")
    # the entries of a symbol lie in two classes
    entries = spark.createDataFrame([(2 * ord(s) + k % 2, (t, p if t else "mod" + p), False) for k, (s, t, p) in enumerate(candidates)], "class_id bigint, module_key struct<module_source_type:int,id:string>, is_module_itself boolean")
    best = spark.createDataFrame([(s, [], 2 * ord(s) + k) for s in "fg" for k in (0, 1)], "symbol string, contexts array<string>, class_id bigint")
    got = {(r["file_id"], r["symbol"]): (r["distance"], r["n_best"], r["winner"] and r["winner"]["module_key"]["id"]) for r in fixing.nearest(ways, best, entries).collect()}
    want = {}
    for n, p in files.items():
        for s in "fg":
            far = []
            for s2, t, q in candidates:
                if s2 == s:
                    a, b = q.split("/"), os.path.dirname(p).split("/")
                    c = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                    far.append((max(len(a), len(b)) - c if t else 4, q if t else "mod" + q))
            d = min(far)[0]
            tied = [q for x, q in far if x == d]
            want[n, s] = (d, len(tied), tied[0] if len(tied) == 1 and tied[0] != p else None)
    assert got == want


# --- sources and store


def test_files_from_disk(spark, tmp_path):
    (tmp_path / "pkg" / "sub").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    for name, data in {"pkg/__init__.py": b"", "pkg/a.py": b"x = 1\n", "pkg/bad.py": b"\xff\xfe", "pkg/sub/b.pyi": b"y: int\n", "pkg/c.txt": b"", ".git/d.py": b"", "e.py": b"z"}.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.relpath(r["path"], tmp_path): (r["source"], r["error"]) for r in source_files.python_sources(spark, str(tmp_path)).collect()}
    assert got["pkg/a.py"] == ("x = 1\n", None) and got["pkg/bad.py"] == (None, "UnicodeDecodeError") and "pkg/sub/b.pyi" in got and "pkg/c.txt" not in got and "pkg/__init__.py" in got and ".git/d.py" not in got
    assert source_files.python_sources(spark, str(tmp_path / "pkg"), recursive=False).count() == 3
    spark.dataSource.register(source_files.TreeSource)
    walk = lambda **o: {os.path.relpath(r["path"], tmp_path): r["is_dir"] for r in spark.read.format("source_tree").options(**o).load(str(tmp_path)).collect()}
    assert walk() == {"pkg": True, "pkg/sub": True, "pkg/__init__.py": False, "pkg/a.py": False, "pkg/bad.py": False, "pkg/sub/b.pyi": False, "pkg/c.txt": False, "e.py": False}
    assert "pkg/sub" not in walk(packages_only="true")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    some = spark.read.format("source_tree").option("pushdown", "true").load(str(tmp_path)).filter(F.col("path").startswith(f"{tmp_path}/pkg/sub/"))
    assert {os.path.basename(r["path"].rstrip("/")) for r in some.collect()} == {"sub", "b.pyi"}


def test_notebooks(spark):
    nb = {"cells": [{"cell_type": "markdown", "source": ["# t"]}, {"cell_type": "code", "source": ["a = 1\n", "b"]}, {"cell_type": "code", "source": "c"}]}
    df = spark.createDataFrame([(json.dumps(nb),), ("{",), (None,), ('{"cells": []}',)], "s string")
    assert [r["code"] for r in source_files.notebook_code(df, F.col("s")).collect()] == ["a = 1\nb\n\nc", None, None, ""]


def test_store(spark, tmp_path):
    e = spark.createDataFrame([("f", 1, (3, "a"), False, False, False, 2, "/x/"), ("g", 1, (3, "b"), False, False, False, 2, "/y/")], schemas.SYMBOL_ENTRIES + ", location string")
    store.save_index(e, f"{tmp_path}/index")
    back = store.load_index(spark, f"{tmp_path}/index")
    assert back.exceptAll(e).count() == 0 and back.count() == 2
    store.save_import_refs(spark.createDataFrame([((3, "a"), (3, "b"), "f", None)], schemas.IMPORT_REFS), f"{tmp_path}/refs")
    assert spark.read.parquet(f"{tmp_path}/refs").count() == 1
    t = spark.createDataFrame([("b", 1), ("a", 2)], schemas.TERMS)
    store.save_terms(t, f"{tmp_path}/terms")
    assert sorted(tuple(r) for r in store.load_terms(spark, f"{tmp_path}/terms").collect()) == [("a", 2), ("b", 1)]
    log = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS timestamp, 'fix' AS action_type, 'x,\"y\"' AS data, 'f.py' AS filename")
    store.append_actions(log, f"{tmp_path}/log")
    store.append_actions(log, f"{tmp_path}/log")
    assert store.load_actions(spark, f"{tmp_path}/log").exceptAll(log.union(log)).count() == 0
    failed = spark.createDataFrame([("/a",), ("/a",)], "path string")
    assert store.not_failed(spark.createDataFrame([("/a",), ("/b",)], "path string"), failed).count() == 1
    j = store.typed_json(t, "term", ["term", "value"])
    assert store.from_typed_json(j, "term", schemas.TERMS).exceptAll(t).count() == 0


# --- services


def _requests():
    return [
        {"request_id": 1, "command_id": "get_capabilities"}, {"request_id": 2, "command_id": "fix_code_in_file", "source": "import os\nmake()\n", "filename": "/p/app/new.py"},
        {"request_id": 0, "command_id": "get_capabilities"}, {"request_id": 3}, {"request_id": 4, "command_id": "dance"}, {"request_id": 5, "command_id": "fix_code_in_file", "source": "def (", "filename": "/p/x.py"},
    ]


def test_service(spark, project, tmp_path):
    index = fixing.with_import_counts(fixing.index_of_files(project), code.resolved_imports(code.imports(project), project)).persist()
    lines = [json.dumps(r) for r in _requests()] + ["not json"]
    got = {}
    for r in service.answers(spark.createDataFrame([(x,) for x in lines], "value string"), index).collect():
        got[r["id"]] = (r["result_code"], json.loads(r["response"]))
    assert got["1"][0] == 0 and "fix_code_in_file" in got["1"][1]["capabilities"]
    assert got["2"][0] == 0 and [e["text"] for e in got["2"][1]["inserts"]] == ["from .shapes import make\n"]
    assert len(got["2"][1]["deletions"]) == 1 and got["2"][1]["replacements"] == []
    assert [got[k][0] for k in ("0", "3", "4", "5", "-1")] == [1] * 5
    assert "valid command_id" in got["4"][1]["failure_reason"] and got["0"][1]["failure_reason"] == "Empty request id"

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines[:4]) + "\n")
    stream = spark.readStream.text(str(tmp_path / "in"))
    service.serve(stream, index, f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination(180)
    assert spark.read.text(f"{tmp_path}/out/ok").count() == 2 and spark.read.text(f"{tmp_path}/out/failed").count() == 2
    (tmp_path / "in" / "b.txt").write_text(lines[4] + "\n")
    before = session.work_path(spark, "x").rpartition("/")[0].removeprefix("file://")
    held = set(os.listdir(before))
    service.serve(stream, index, f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination(180)
    assert spark.read.text(f"{tmp_path}/out/failed").count() == 3
    assert set(os.listdir(before)) == held  # a batch leaves nothing behind


def test_term_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x y x"), (2, "b", None)], "file_id bigint, path string, source string")
    df.write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):
        indexing.term_deltas(indexing.source_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert {tuple(r) for r in indexing.counts(spark, f"{tmp_path}/out").collect()} == {("x", 2), ("y", 1)}
    df.write.mode("append").parquet(f"{tmp_path}/in")
    indexing.term_deltas(indexing.source_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    assert {tuple(r) for r in indexing.counts(spark, f"{tmp_path}/out").collect()} == {("x", 4), ("y", 2)}


def test_a_common_name_with_many_shapes_and_modules(spark, monkeypatch):
    """What is made on the way grows with modules and shapes, not with their product."""
    seen = {}
    monkeypatch.setattr(fixing, "written", lambda df, name: seen.setdefault(name, session.written(df, name)))
    modules, shapes = 2000, 200
    index = spark.range(modules).select(
        F.lit("get").alias("symbol_name"), F.struct(F.lit(3).alias("module_source_type"), F.format_string("/p/d%d/m%d.py", F.col("id") % 50, "id").alias("id")).alias("module_key"), F.lit(False).alias("is_module_itself"),
        F.lit(0).alias("symbol_type"), F.lit(False).alias("not_yet_found_in_module"), F.lit(False).alias("imported"), F.array(F.lit("a"), F.lit("b")).alias("members"), F.lit(1).cast("bigint").alias("import_count"),
    )
    ways = spark.range(shapes).select(F.col("id").alias("file_id"), F.format_string("/p/d%d/u%d.py", F.col("id") % 50, "id").alias("path"), F.lit("get").alias("symbol"), F.array(F.struct(F.lit("call").alias("kind"), F.lit("").alias("attribute"), F.col("id").cast("int").alias("argc"))).alias("contexts"))
    files = ways.select("file_id", "path")
    got = fixing.choose_imports(ways, files, index).collect()
    assert len(got) == shapes and all(r["ambiguous"] and r["n_best"] == modules // 50 and r["distance"] == 1 for r in got)
    assert seen["best-classes"].count() == shapes and seen["index-classes"].count() == modules


def test_values_through_imports(spark):
    files = source_files.from_strings(spark, {"/p/a.py": "x = 1\ny = 'q'\n", "/p/b.py": "from a import x as z, y\n", "/p/c.py": "from b import z\nfrom b import y as w\n", "/p/d.py": "from c import z, w\nfrom nowhere import v\nfrom d import own\nz2 = 3\n"}).withColumn("root", F.lit("/p"))
    got = {(r["file_id"], r["name"]): (r["kinds"], r["texts"]) for r in code.follow_imports(code.values(files), code.resolved_imports(code.imports(files), files)).collect()}
    assert got[3, "z"] == (["native"], ["1"]) and got[3, "w"] == (["native"], ["'q'"]) and got[2, "z"] == got[1, "z"] == got[0, "x"]
    assert got[3, "v"] == (["unknown"], [None]) and got[3, "own"] == (["unknown"], [None]) and got[3, "z2"] == (["native"], ["3"])


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Conf)  # noqa: N815

    class Session:
        conf, sparkContext = Conf, Context  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.work_root(Session)
