"""Relational operators on small rows."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import fuzzy, paths
from codeloom.operators import history, symbols, terms
from codeloom.plans import term_queries


def _terms(spark, rows):
    return spark.createDataFrame(rows, "term string, value bigint")


def test_prefix_questions(spark):
    t = _terms(spark, [("ab", 3), ("abc", 3), ("abd", 5), ("b", 1), ("", 9), ("éa", 2)])
    best = {r["prefix"]: (r["term"], r["value"]) for r in terms.best_by_prefix(t).collect()}
    assert best == {"a": ("abd", 5), "ab": ("abd", 5), "abc": ("abc", 3), "abd": ("abd", 5), "b": ("b", 1), "é": ("éa", 2), "éa": ("éa", 2)}
    assert [tuple(r) for r in terms.best_under(t, "a").collect()] == [("abd", 5)]
    assert terms.best_under(t, "zz").count() == 0
    wanted = spark.createDataFrame([("a",), ("q",), ("q",)], "prefix string")
    assert sorted(tuple(r) for r in terms.max_under(t, wanted).collect()) == [("a", 5), ("q", 0)]
    tie = _terms(spark, [("abc", 3), ("ab", 3), ("aa", 3)])
    assert terms.best_under(tie, "a").first()["term"] == "aa"
    tree = {r["prefix"]: tuple(r)[1:] for r in terms.tree(t.filter("term like 'a%'")).collect()}
    assert tree == {"a": (False, None, 5, "b"), "ab": (True, 3, 5, "d"), "abc": (True, 3, 3, None), "abd": (True, 5, 5, None)}


def test_long_number_literals(spark):
    texts = ["0b1111000011110000", "0b" + "1" * 63, "0b" + "1" * 64, "0o777777777777777777777", "0o1" + "0" * 21, "0x7fff_ffff_ffff_ffff", "0xffffffffffffffff", "0x" + "0" * 20 + "a", "0b00", "0x" + "1" * 17, "0b2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").select("n", paths.number_literal(F.col("t")).alias("v")).orderBy("n").collect()
    assert [r["v"] for r in rows] == [0xF0F0, 2**63 - 1, None, 2**63 - 1, None, 2**63 - 1, None, 10, 0, None, None]


def test_max_under_long_prefixes(spark, monkeypatch):
    tables = {"documents": spark.createDataFrame([("wonderfully wonderful wonderfully",)], "text string"), "common_words": spark.createDataFrame([("wonderfull",), ("wonder",), ("x",)], "word string")}
    monkeypatch.setattr(term_queries, "table", lambda spark, d, name: tables[name])
    assert sorted(tuple(r) for r in term_queries.prefix_max_value(spark, "").collect()) == [("wonder", 2), ("wonderfull", 2), ("x", 0)]
    assert terms.max_under(_terms(spark, [("a", 1)]), spark.createDataFrame([], "prefix string")).count() == 0


def test_every_term_has_its_end(spark):
    t = _terms(spark, [("core.loader.sources_of_files", 3), ("core.x", 1), ("é" * 40, 2)])
    nodes = terms.tree(t).collect()
    assert {r["prefix"]: r["value"] for r in nodes if r["end_point"]} == {r["term"]: r["value"] for r in t.collect()}
    assert len(nodes) == 28 + 1 + 40
    assert {r["prefix"] for r in terms.best_by_prefix(t).collect()} == {r["prefix"] for r in nodes}


def test_accumulate(spark):
    adds = [(1, "a", 5, True), (2, "a", 1, False), (3, "a", 2, True), (1, "b", 4, True), (2, "b", 4, True), (1, "c", 7, True), (2, "c", 0, False)]
    got = terms.accumulated(spark.createDataFrame(adds, "seq bigint, term string, value bigint, add_value boolean")).collect()
    assert sorted(tuple(r) for r in got) == [("a", 3), ("b", 8), ("c", 0)]


def test_subtrees_and_lines(spark):
    t = _terms(spark, [("a.b", 1), ("a.c", 2), ("b", 3)])
    assert terms.without_subtree(t, "a.").count() == 1 and terms.under(t, "a.").count() == 2 and terms.without_term(t, "b").count() == 2 and terms.pruned(t, 2).count() == 2
    p = spark.createDataFrame([("/r/a/x",), ("/r/a/y",), ("/r/b",), ("/q/c",), ("/r/",)], "path string")
    assert sorted(tuple(r) for r in terms.children(p, "/r/").collect()) == [("a", True), ("b", False)]
    texts = spark.createDataFrame([("a.b\nxaxbx\nb a",), (None,), ("",)], "t string")
    assert sorted(r[0] for r in terms.subsequence_lines(texts, F.col("t"), "ab").collect()) == ["a.b", "xaxbx"]
    assert [r[0] for r in terms.subsequence_lines(texts, F.col("t"), "a.").collect()] == ["a.b"]


ENTRY = "symbol_name string, module_key struct<module_source_type:int,id:string>, is_module_itself boolean, symbol_type int, not_yet_found_in_module boolean, imported boolean, import_count bigint"


def test_index_view_and_choice(spark):
    k = lambda x: (3, x)
    e = spark.createDataFrame([("f", k("a"), False, 1, False, False, 2), ("f", k("b"), False, 1, False, True, 2), ("g", k("a"), False, 0, False, False, 1), ("g", k("b"), False, 0, False, False, 1)], ENTRY)
    a = spark.createDataFrame([("ff", "f", k("a"), False, 7), ("zz", "none", k("a"), False, 1)], "as_name string, real_name string, module_key struct<module_source_type:int,id:string>, is_module_itself boolean, import_count bigint")
    view = symbols.complete_view(e, a)
    assert [(r["real_name"], r["import_count"], r["is_alias"]) for r in symbols.find_symbol(view, "ff").collect()] == [("f", 7, True)]
    assert symbols.find_symbol(view, "f").count() == 2 and symbols.find_symbol(view, "zz").count() == 0
    best = {r["symbol_name"]: r for r in symbols.best_candidates(e, ["symbol_name"], symbols.preference()).collect()}
    assert best["f"]["winner"]["module_key"]["id"] == "a" and not best["f"]["ambiguous"]
    assert best["g"]["ambiguous"] and best["g"]["winner"] is None and best["g"]["n_best"] == 2
    gone = spark.createDataFrame([(k("a"),)], "module_key struct<module_source_type:int,id:string>")
    left = symbols.without_modules(e.withColumn("import_count", F.when(F.col("symbol_name") == "g", 0).otherwise(F.col("import_count"))), gone)
    assert sorted((r["symbol_name"], r["module_key"]["id"], r["not_yet_found_in_module"]) for r in left.collect()) == [("f", "a", True), ("f", "b", False), ("g", "b", False)]
    assert symbols.differences(e, e).count() == 0 and symbols.differences(e, e.limit(3)).count() == 1


def test_count_deltas(spark):
    refs = "importer int, target string"
    old, new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (1, "b")], refs), spark.createDataFrame([(2, "a"), (3, "c"), (1, "b")], refs)
    assert sorted(tuple(r) for r in symbols.import_counts(old, "importer", ["target"]).collect()) == [("a", 2), ("b", 1)]
    d = symbols.import_count_deltas(old, new, "importer", ["target"])
    assert sorted(tuple(r) for r in d.collect()) == [("a", -1), ("c", 1)]
    e = spark.createDataFrame([("a", 1, True), ("b", 1, False)], "target string, import_count bigint, not_yet_found_in_module boolean")
    got = symbols.apply_count_deltas(e, d, ["target"]).select("target", "import_count", "not_yet_found_in_module").collect()
    assert sorted(tuple(r) for r in got) == [("b", 1, False), ("c", 1, True)]


CTX = "contexts array<struct<kind:string,attribute:string>>, t int, members array<string>"


@pytest.mark.parametrize(("contexts", "t", "want"), [([("call", "")], 1, True), ([("call", "")], 2, False), ([("subscript", "")], 1, False), ([("subscript", "")], 2, True), ([("attribute", "x")], 0, True), ([("attribute", "y")], 0, False), ([("raw", "")], 3, True), ([("call", ""), ("attribute", "y")], 0, False), ([("call", "")], 5, True), ([], 2, True)])
def test_matches_context(spark, contexts, t, want):
    df = spark.createDataFrame([(contexts, t, ["x"])], CTX)
    assert df.select(symbols.matches_context(F.col("t"), F.col("contexts"), F.col("members"))).first()[0] is want


def test_routing(spark):
    p = spark.createDataFrame([("/a/b/c.py",), ("/a/x.py",), ("/q.py",), ("/a/bb/c.py",)], "path string")
    locations = spark.createDataFrame([("/a/",), ("/a/b/",)], "location string")
    assert {tuple(r) for r in symbols.route_to_location(p, locations).collect()} == {("/a/b/c.py", "/a/b/"), ("/a/x.py", "/a/"), ("/q.py", None), ("/a/bb/c.py", "/a/")}


@pytest.mark.parametrize(
    ("fn", "args", "want"),
    [
        (paths.module_basename, ["/a/b/__init__.py"], "b"), (paths.module_basename, ["/a/_h.cpython-37m.so"], "_h"), (paths.module_basename, ["x.py"], "x"), (paths.dotted_module, ["a/b/c.py"], "a.b.c"), (paths.dotted_module, ["a/b/__init__.pyi"], "a.b"),
        (paths.join_attribute, ["..", "x"], "..x"), (paths.join_attribute, ["a", "x"], "a.x"), (paths.relative_module_path, ["..a.b"], "../a/b"), (paths.relative_module_path, [".a"], "./a"), (paths.relative_module_path, ["."], "."), (paths.relative_module_path, ["...a"], "../../a"), (paths.relative_module_path, ["a.b"], "a/b"),
        (paths.shorten_path, ["/usr/some_dir/file_name.py"], "/u/s_d/file_name.py"), (paths.shorten_path, ["name"], "name"), (paths.file_distance, ["/a/b/c.py", "/a/b"], 1), (paths.file_distance, ["/a/b", "/a/b"], 0), (paths.file_distance, ["/a/x/y/z", "/a/b"], 3),
        (paths.join_names, ["a", "", "b"], "a.b"), (paths.strip_underscores, ["__a_"], "a_"), (paths.strip_underscores, ["__"], ""), (paths.import_statement, ["a", "b", "c"], "from a import b as c"), (paths.import_statement, ["a", None, None], "import a"),
        (paths.number_literal, ["0x1F"], 31), (paths.number_literal, ["1_000"], 1000), (paths.number_literal, ["0b101"], 5), (paths.number_literal, ["1.5"], None), (paths.directory, ["a.py"], ""), (paths.directory, ["/a/b.py"], "/a"),
    ],
)
def test_paths(spark, fn, args, want):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{n} string" for n in range(len(args))))
    assert df.select(fn(*(F.col(c) for c in df.columns))).first()[0] == want


def test_more_paths(spark):
    df = spark.createDataFrame([("/a/b/c.py", True, "x = 1\ny = 2", 3)], "p string, d boolean, code string, n int")
    r = df.select(paths.ancestors(F.col("p")), paths.as_directory(F.col("p"), F.col("d")), paths.code_context(F.col("p"), F.col("n"), F.col("code"))).first()
    assert list(r) == [["/", "/a/", "/a/b/"], "/a/b/c.py/", "/a/b/c.py:3: x = 1 [Trimmed]"]


@pytest.mark.parametrize(("possible", "want"), [([True, True], True), ([True, False], None), ([False, None], None), ([False, False], False), ([], False), ([None], None)])
def test_fuzzy(spark, possible, want):
    df = spark.createDataFrame([(possible,)], "p array<boolean>")
    assert df.select(fuzzy.all_true(F.col("p"))).first()[0] is want
    rows = df.select(F.explode("p").alias("x"))
    if possible:
        assert rows.agg(fuzzy.all_true_agg(F.col("x"))).first()[0] is want


def test_values(spark):
    df = spark.createDataFrame([(["a"], {"k": "v"}, 7, -2)], "p array<string>, m map<string,string>, a bigint, b bigint")
    c = F.col
    r = df.select(
        fuzzy.single_value(c("p")), fuzzy.value_or_unknown(c("m"), F.lit("k")), fuzzy.value_or_unknown(c("m"), F.lit("q")), fuzzy.item(c("p"), F.lit(-1)), fuzzy.item(c("p"), F.lit(4)), fuzzy.either(c("p"), F.array(F.lit("b"))),
        *(fuzzy.BINARY[o](c("a"), c("b")) for o in ("//", "%", "**", "/")), fuzzy.BINARY["<<"](c("a"), F.lit(2)), fuzzy.BINARY[">>"](c("a"), F.lit(1)), fuzzy.BINARY["/"](c("a"), F.lit(0)), fuzzy.BINARY["%"](c("a"), F.lit(0)),
    ).first()
    assert list(r) == ["a", "v", "unknown", "a", None, ["a", "b"], -4, -1, pytest.approx(7**-2), -3.5, 28, 3, None, None]


def test_snapshots(spark):
    listing = spark.createDataFrame([("/r/a", 5.0), ("/r/b", 6.0), ("/r/new", 1.0)], "path string, mtime double")
    stored = spark.createDataFrame([("/r/a", 5.0), ("/r/b", 5.0), ("/r/d/e/f", 1.0), ("/r/d/g", 1.0)], "path string, ts double")
    got = {tuple(r) for r in history.snapshot_diff(listing, stored, "path", "mtime", "ts").collect()}
    assert got == {("/r/b", "modified"), ("/r/new", "added"), ("/r/d/e/f", "removed"), ("/r/d/g", "removed")}
    gone = stored.join(listing, "path", "left_anti")
    assert {r[0] for r in history.removed_with_directories(gone, listing).collect()} == {"/r/d/e/f", "/r/d/g", "/r/d/", "/r/d/e/"}
    seen = spark.createDataFrame([("/r/a", 9.0, 1), ("/r/a", 8.0, 2), ("/r/z", 1.0, 1)], "path string, ts double, seq int")
    up = {r["path"]: r["ts"] for r in history.upsert(stored, seen).collect()}
    assert up["/r/a"] == 8.0 and up["/r/z"] == 1.0 and up["/r/b"] == 5.0
    assert history.upsert(stored.limit(0), seen.limit(0)).count() == 0


def test_package_walk(spark):
    every = ["/r/top.py", "/r/pkg/__init__.py", "/r/pkg/m.py", "/r/pkg/sub/__init__.py", "/r/pkg/sub/x.pyi", "/r/pkg/plain/y.py", "/r/notpkg/pkg/__init__.py", "/r/notpkg/pkg/m.py", "/r/.git/__init__.py", "/r/pkg/t.txt", "rel/__init__.py", "rel/a.b.py", "z.py"]
    listing = spark.createDataFrame([(x,) for x in [*every, *every[:3], None]], "path string").withColumn("dir", F.lit("clash"))
    got = {}
    for r in history.package_files(listing, spark.createDataFrame([("/r",), ("/r/pkg",), ("/r/notpkg",), ("/r/pkg/plain",), ("/x",), ("/r",)], "root string")).collect():
        got.setdefault(r["root"], []).append(r["path"])
    assert {k: sorted(v) for k, v in got.items()} == {
        "/r": ["/r/pkg/__init__.py", "/r/pkg/m.py", "/r/pkg/sub/__init__.py", "/r/pkg/sub/x.pyi", "/r/top.py"], "/r/pkg": ["/r/pkg/__init__.py", "/r/pkg/m.py", "/r/pkg/sub/__init__.py", "/r/pkg/sub/x.pyi"],
        "/r/notpkg": ["/r/notpkg/pkg/__init__.py", "/r/notpkg/pkg/m.py"], "/r/pkg/plain": ["/r/pkg/plain/y.py"],
    }
    names = {r["path"]: (r["full_name"], r["package_root"]) for r in history.full_module_names(listing).collect()}
    assert names["/r/pkg/sub/x.pyi"] == ("pkg.sub.x", "/r") and names["/r/pkg/sub/__init__.py"] == ("pkg.sub", "/r") and names["/r/top.py"] == ("top", "/r")
    assert names["/r/notpkg/pkg/m.py"] == ("pkg.m", "/r/notpkg") and names["/r/pkg/plain/y.py"] == ("y", "/r/pkg/plain") and names["/r/.git/__init__.py"] == ("", "/r/.git")
    assert names["rel/a.b.py"] == ("rel.a.b", "") and names["z.py"] == ("z", "") and len(names) == len(every) - 1
    assert sorted(r[0] for r in history.modules_under(listing, "/r/", ["notpkg", ".git", "sub"]).collect()) == ["/r/pkg/__init__.py", "/r/pkg/m.py", "/r/pkg/plain/y.py", "/r/top.py"]
    none = listing.limit(0)
    assert history.package_files(none, none.select(F.col("path").alias("root"))).count() == history.full_module_names(none).count() == 0
