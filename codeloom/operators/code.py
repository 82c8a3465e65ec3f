"""Facts of source files as DataFrames. Files are parsed in Arrow batches, one file at a time; only facts leave the worker.

files: file_id BIGINT, path STRING, source STRING; null sources give no facts. A file that does not parse as a whole gives the
facts of the statements that do, and a row in parse_failures.
"""

from __future__ import annotations

import ast
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom.extract import evaluate, facts, parsing, scopes
from codeloom.functions import paths
from codeloom.operators.orphans import normal_path
from codeloom.session import ship, written

NODES = (
    "file_id bigint, node_id int, parent_id int, depth int, kind string, name string, complete_name string, scope_id int, is_expr boolean, "
    "lineno int, col int, end_lineno int, end_col int, above array<string>, attrs map<string,string>"
)
DEFINITIONS = "file_id bigint, scope string, name string, symbol_type int, lineno int"
IMPORTS = "file_id bigint, kind string, module string, value string, as_name string, bound string, top_level boolean, lineno int, end_lineno int"
USES = "file_id bigint, symbol string, kind string, attribute string, argc int, missing boolean"
PARAMETERS = "file_id bigint, function string, position int, name string, kind string, hint string, default string"
REFERENCES = "file_id bigint, name string, resolved string, context string, lineno int"
STATEMENTS = "file_id bigint, kind string, lineno int, code string"
CLOSURES = "file_id bigint, function string, symbol string, around string"
EXPORTS = "file_id bigint, symbol string"
TOKENS = "term string, value bigint"
VALUES = "file_id bigint, name string, n_values int, ambiguous boolean, kinds array<string>, types array<string>, texts array<string>"
STATISTICS = "file_id bigint, path string, position int, symbol_type int, name string, complete_name string, lineno int, code string"
MEMBERS = "file_id bigint, owner string, owner_kind string, name string, kind string, type string, value string"
FAILURES = "file_id bigint, error_kind string, message string, n_skipped_lines int"

#: Rows are handed over in batches of about this many.
BATCH_ROWS = 20_000


def _frames(source: str) -> int:
    """Frames a walk of the source may need; they are on the heap."""
    return 10_000 + 20 * len(source)


def _rows(make: Callable[..., Iterator[tuple]], schema: str, beside: tuple[str, ...] = (), also: Callable[..., Iterator[tuple]] | None = None):
    """make gives the rows of a source, after its file_id; it is called with the source and the columns beside it. also gives rows of every
    file, of null sources too, from those columns alone."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True)) if held else [[] for _ in arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            more = zip(*(b[c].to_pylist() for c in beside), strict=True) if beside else [()] * b.num_rows
            for i, s, m in zip(b["file_id"].to_pylist(), b["source"], more, strict=True):
                if also:
                    held += [(i, *r) for r in also(*m)]
                if (text := s.as_py()) is None:
                    continue
                sys.setrecursionlimit(_frames(text))
                try:
                    held += [(i, *r) for r in make(text, *m)]
                except RecursionError:  # nested beyond what is walked; parse_failures has it
                    continue
                if len(held) >= BATCH_ROWS:
                    yield out()
                    held.clear()
        yield out()

    return run


def _facts(files: DataFrame, make: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    ship(files.sparkSession)
    return files.select("file_id", "source").mapInArrow(_rows(make, schema), schema)


def _of_tree(fn: Callable) -> Callable[[str], Iterator[tuple]]:
    return lambda source: fn(parsing.parse_tolerant(source)[0])


def evenly(rows: DataFrame) -> DataFrame:
    """Rows with sources dealt out in turn over all tasks, however few bytes they are, as parsing costs far more than moving them. Not by
    file_id: where an aggregate or join by it lies before, that would be left out and the few bytes drawn together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def python_files(sources: DataFrame, file_id: Column, path: Column, source: Column) -> DataFrame:
    """file_id, path, source of the Python files, each once."""
    rows = sources.select(file_id.alias("file_id"), path.alias("path"), source.alias("source"))
    once = rows.filter(paths.is_python_file(F.lower("path")) & F.col("source").isNotNull()).dropDuplicates(["file_id"])
    return evenly(once)


@dataclass(frozen=True)
class Facts:
    """What a set of files says, from one parse of each, without their sources. What concerns one file alone is put together where it is
    parsed, so none of it needs a shuffle."""

    files: DataFrame  # file_id, path, root
    definitions: DataFrame
    imports: DataFrame  # and path, root, used: whether the rest of the file uses the name
    uses: DataFrame
    exports: DataFrame
    gaps: DataFrame  # file_id, path, symbol, contexts of the names that the file neither defines nor imports
    entries: DataFrame  # file_id, path, symbol (null for the module itself), symbol_type, members: what the index has of the file


_FACTS = ("definition", "import", "use", "export", "file", "gap", "entry")
_PARTS = [x.removeprefix("file_id bigint, ") for x in (DEFINITIONS, IMPORTS + ", used boolean", USES)]
_FIELDS = [[c.split()[0] for c in p.split(", ")] for p in _PARTS]
_STRUCTS = ", ".join(f"{n} struct<{', '.join(':'.join(c.split()) for c in p.split(', '))}>" for n, p in zip(("d", "i", "u"), _PARTS, strict=True))
_EVERY = f"file_id bigint, fact string, {_STRUCTS}, symbol string, f struct<path:string,root:string>, contexts array<struct<kind:string,attribute:string,argc:int>>, symbol_type int, members array<string>"
_MODULE = 3


def _row(fact: int, part: int | None = None, values: tuple = (), symbol: str | None = None, f: dict | None = None, contexts: list | None = None, symbol_type: int | None = None, members: list | None = None) -> tuple:
    parts = [None, None, None]
    if part is not None:
        parts[part] = dict(zip(_FIELDS[part], values, strict=True))
    return _FACTS[fact], *parts, symbol, f, contexts, symbol_type, members


def _of_file(path: str, root: str, *_) -> Iterator[tuple]:
    yield _row(4, f={"path": path, "root": root})


def _every(source: str, path: str | None = None, root: str | None = None, wanted: str | None = None) -> Iterator[tuple]:
    """wanted: the names of the facts to give, with commas between; all if it is null."""
    tree, f, want = parsing.parse_tolerant(source)[0], {"path": path, "root": root}, set(wanted.split(",")) if wanted else {*_FACTS, "used"}
    defined = list(facts.definitions(tree)) if want & {"definition", "entry"} else []
    if "definition" in want:
        for r in defined:
            yield _row(0, 0, r)
    used, gaps = set(), {}
    looked = bool(want & {"use", "gap", "used"})
    if looked:
        for r in facts.uses(tree):
            used.add(r[0])
            if r[4]:
                gaps.setdefault(r[0], set()).add(r[1:4])
            if "use" in want:
                yield _row(2, 2, r)
    if "import" in want:
        for r in facts.imports(tree):
            yield _row(1, 1, (*r, r[4] in used if looked else None), f=f)
    if "export" in want:
        for x in sorted(scopes.exports(tree)):
            yield _row(3, symbol=x)
    if "gap" in want:
        for x, how in gaps.items():
            yield _row(5, symbol=x, f=f, contexts=[{"kind": k, "attribute": a, "argc": n} for k, a, n in sorted(how)])
    if "entry" in want:
        top, inside = {}, {}
        for scope, name, kind, line in defined:
            if not scope:
                top[name] = min(top.get(name, (line, kind)), (line, kind))
            elif "." not in scope:
                inside.setdefault(scope, set()).add(name)
        for x, (_, kind) in top.items():
            yield _row(6, symbol=x, f=f, symbol_type=kind, members=sorted(inside.get(x, ())))
        yield _row(6, f=f, symbol_type=_MODULE, members=sorted(top))


def extract(files: DataFrame, *wanted: str) -> Facts:
    """The facts, or those of the kinds that are wanted ('definition', 'import', 'use', 'export', 'gap', 'entry'), are written once, a folder
    for each kind. Sources are read in this pass only. Whether imports are used is known if 'use', 'gap' or 'used' is wanted too."""
    ship(files.sparkSession)
    root = F.col("root") if "root" in files.columns else F.lit("")
    rows = files.select("file_id", "path", root.alias("root"), "source", F.lit(",".join(wanted) or None).cast("string").alias("wanted"))
    run = _rows(_every, _EVERY, ("path", "root", "wanted"), _of_file)
    done = written(rows.mapInArrow(run, _EVERY), "code-facts", "fact")
    of = lambda kind, *cols: done.filter(F.col("fact") == kind).select("file_id", *cols)
    return Facts(
        of("file", "f.*"), of("definition", "d.*"), of("import", "i.*", "f.path", "f.root"), of("use", "u.*"), of("export", "symbol"),
        of("gap", "f.path", "symbol", "contexts"), of("entry", "f.path", "symbol", "symbol_type", "members"),
    )


def nodes(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(facts.nodes), NODES)


def definitions(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(facts.definitions), DEFINITIONS)


def imports(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(facts.imports), IMPORTS)


def uses(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(facts.uses), USES)


def parameters(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(facts.parameters), PARAMETERS)


def references(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(facts.references), REFERENCES)


def statements(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(facts.statements), STATEMENTS)


def closures(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(scopes.closures), CLOSURES)


def exports(files: DataFrame) -> DataFrame:
    return _facts(files, _of_tree(lambda t: ((x,) for x in sorted(scopes.exports(t)))), EXPORTS)


def name_counts(files: DataFrame) -> DataFrame:
    """term, value: how often each name token occurs. Files are counted where they are read; only the sums of a batch travel."""
    ship(files.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(TOKENS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for b in batches:
            for s in b["source"]:
                if s.is_valid:
                    n.update(facts.name_tokens(s.as_py()))
            if len(n) >= BATCH_ROWS:
                yield pa.RecordBatch.from_pydict({"term": list(n), "value": list(n.values())}, schema=arrow)
                n.clear()
        yield pa.RecordBatch.from_pydict({"term": list(n), "value": list(n.values())}, schema=arrow)

    return files.select("source").mapInArrow(run, TOKENS).groupBy("term").agg(F.sum("value").alias("value"))


def _values(source: str) -> Iterator[tuple]:
    for name, values in evaluate.evaluate(parsing.parse_tolerant(source)[0]).items():
        yield name, len(values), len(values) != 1, [v.kind for v in values], [v.type_name() for v in values], [v.text() for v in values]


def values(files: DataFrame) -> DataFrame:
    return _facts(files, _values, VALUES)


def _members(source: str) -> Iterator[tuple]:
    def of(owner: str, kind: str, found: dict[str, evaluate.Values]) -> Iterator[tuple]:
        for name, values in found.items():
            for v in values:
                yield owner, kind, name, v.kind, v.type_name(), v.text()

    top = evaluate.evaluate(parsing.parse_tolerant(source)[0])
    yield from of("", "module", top)
    for values in top.values():
        for v in values:
            if v.kind in ("class", "instance"):
                yield from of(v.name, v.kind, v.members)


def members(files: DataFrame) -> DataFrame:
    """What modules hold, and the classes and instances they name: owner ('' for the module itself), its kind, the member and a row for each
    value it may have."""
    return _facts(files, _members, MEMBERS)


def _statistics(source: str, path: str) -> Iterator[tuple]:
    lines = _LINE_END.split(source)
    found = sorted(facts.definitions(parsing.parse_tolerant(source)[0]), key=lambda r: r[3])
    for n, (scope, name, kind, line) in enumerate(found):
        yield path, n, kind, name, f"{scope}.{name}" if scope else name, line, lines[line].strip(" ")


_LINE_END = re.compile(r"\r\n|\r|\n")


def statistics(files: DataFrame) -> DataFrame:
    """Definitions with the line of code that begins them; position is their place in the file, by line."""
    ship(files.sparkSession)
    return files.select("file_id", "path", "source").mapInArrow(_rows(_statistics, STATISTICS, ("path",)), STATISTICS)


#: What reads a source, by the facts it gives.
_READERS: dict[str, Callable[..., Iterator[tuple]]] = {
    "definitions, imports, uses, exports": _every, "nodes": _of_tree(facts.nodes), "parameters": _of_tree(facts.parameters), "references": _of_tree(facts.references), "statements": _of_tree(facts.statements), "closures": _of_tree(scopes.closures),
    "values": _values,
}
#: Sources nested less are walked by all of these.
SURELY_WALKED = 200


def _failure(source: str) -> Iterator[tuple]:
    """Sources that do not parse as a whole, and the facts of which a source has none because it is nested beyond what is walked."""
    tree, bad, error = parsing.parse_tolerant(source)
    if error is not None:
        kind, _, message = error.partition(": ")
        yield kind, message, sum(b - a + 1 for a, b in bad)
    if _nested(tree, SURELY_WALKED):
        for name, read in _READERS.items():
            try:
                for _ in read(source):
                    pass
            except RecursionError:
                yield "RecursionError", f"no {name}: nested too deeply", len(source.splitlines())


def _nested(tree: ast.AST, depth: int) -> bool:
    """Whether nodes are nested more deeply than so."""
    level = [tree]
    while level and depth >= 0:
        level, depth = [c for n in level for c in ast.iter_child_nodes(n)], depth - 1
    return bool(level)


def parse_failures(files: DataFrame) -> DataFrame:
    return _facts(files, _failure, FAILURES)


# --- relations between files --------------------------------------------------------------------------------------


def resolved_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """found with target_id: the file each import names, and is_module: whether its value is a submodule. Relative names start at the
    importing file, absolute ones at its root (root of files if they have one, else ''); path and root are taken from found if it has them.

    A from-import may name a submodule: module.value is tried before module. Packages come before modules, stubs before the
    package's source and after the module's. Each row of found comes out once."""
    where = files.select("file_id", "path", (F.col("root") if "root" in files.columns else F.lit("")).alias("root"))
    known = where.select(F.col("file_id").alias("target_id"), F.explode(paths.module_stems(F.col("path"))).alias("s"))
    known = known.groupBy("s.stem").agg(F.min(F.struct("s.form", "target_id")).alias("best")).select("stem", F.col("best.target_id").alias("target_id"))
    named = found if {"path", "root"} <= set(found.columns) else found.join(where, "file_id")
    base = F.when(F.col("module").startswith("."), paths.directory(F.col("path"))).otherwise(F.col("root"))

    def stem(name: Column) -> Column:
        # imports that name nothing so are spread by their file instead of meeting in one task
        at = normal_path(F.concat_ws("/", base, paths.relative_module_path(name)))
        return F.when(name.isNotNull(), at).otherwise(F.concat(F.lit("\0"), F.col("file_id").cast("string")))

    full = F.when((F.col("kind") == "from") & (F.col("value") != "*"), paths.join_attribute(F.col("module"), F.col("value")))
    named = named.withColumns({"stem_of_value": stem(full), "stem_of_module": stem(F.col("module"))})
    for k in ("value", "module"):
        named = named.join(known.select(F.col("stem").alias(f"stem_of_{k}"), F.col("target_id").alias(f"target_of_{k}")), f"stem_of_{k}", "left")
    target = F.coalesce("target_of_value", "target_of_module")
    cols = [c for c in found.columns if c not in ("path", "root")]
    return named.select(*cols, target.alias("target_id"), F.when(target.isNotNull(), F.col("target_of_value").isNotNull()).alias("is_module"))


def missing_symbols(found_uses: DataFrame, found_imports: DataFrame, found_exports: DataFrame) -> DataFrame:
    """file_id, symbol, contexts of names no definition, import or builtin gives, nor a star import of a known file. found_imports
    has target_id (resolved_imports)."""
    gaps = found_uses.filter("missing").groupBy("file_id", "symbol").agg(F.collect_set(F.struct("kind", "attribute", "argc")).alias("contexts"))
    return _without_stars(gaps, found_imports, found_exports)


def _without_stars(gaps: DataFrame, found_imports: DataFrame, found_exports: DataFrame) -> DataFrame:
    """The gaps that no star import of a known file fills."""
    star = found_imports.filter("value = '*' AND target_id IS NOT NULL").select("file_id", "target_id").distinct()
    given = star.join(found_exports.withColumnRenamed("file_id", "target_id"), "target_id").select("file_id", "symbol")
    return gaps.join(given, ["file_id", "symbol"], "left_anti")


def missing_of(facts: Facts) -> DataFrame:
    """missing_symbols (and path) of extracted facts: only star imports are resolved."""
    return _without_stars(facts.gaps, resolved_imports(facts.imports.filter("value = '*'"), facts.files), facts.exports)


def unused_imports(found_imports: DataFrame, found_uses: DataFrame) -> DataFrame:
    """Top-level imports whose name the rest of the file does not use."""
    return found_imports.filter("top_level AND value IS DISTINCT FROM '*'").join(found_uses.select("file_id", F.col("symbol").alias("bound")), ["file_id", "bound"], "left_anti")


def unused_of(facts: Facts) -> DataFrame:
    """unused_imports of extracted facts."""
    return facts.imports.filter("top_level AND value IS DISTINCT FROM '*' AND NOT used")


def follow_imports(found: DataFrame, resolved: DataFrame) -> DataFrame:
    """found (values), where names that a from-import at the top level binds have the values of what they import, also through modules that only pass a
    name on. Names of modules that are not known, names that go round in a circle and modules themselves stay as they are.

    A name's way is followed by halves: after n rounds, each of which joins the links with themselves, all ways of up to 2 ** n steps are at their end."""
    link = resolved.filter("kind = 'from' AND top_level AND value <> '*' AND target_id IS NOT NULL AND NOT is_module")
    link = link.groupBy("file_id", F.col("bound").alias("name")).agg(F.max(F.struct("lineno", "target_id", "value")).alias("t"))
    links = written(link.select("file_id", "name", F.col("t.target_id").alias("to_file"), F.col("t.value").alias("to_name")), "import-links")
    for _ in range(links.count().bit_length()):
        on = links.select(F.col("file_id").alias("to_file"), F.col("name").alias("to_name"), F.col("to_file").alias("next_file"), F.col("to_name").alias("next_name"))
        step = links.join(on, ["to_file", "to_name"], "left")
        links = written(step.select("file_id", "name", F.coalesce("next_file", "to_file").alias("to_file"), F.coalesce("next_name", "to_name").alias("to_name"), F.col("next_file").isNotNull().alias("moved")), "import-links")
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    plain = [c for c in found.columns if c not in ("file_id", "name")]
    there = links.join(found.select(F.col("file_id").alias("to_file"), F.col("name").alias("to_name"), F.struct(*plain).alias("there")), ["to_file", "to_name"]).select("file_id", "name", "there")
    opaque = (F.col("n_values") == 1) & (F.element_at("kinds", 1) == "unknown")
    both = found.join(there, ["file_id", "name"], "left")
    return both.select("file_id", "name", *[F.when(opaque & F.col("there").isNotNull(), F.col(f"there.{c}")).otherwise(F.col(c)).alias(c) for c in plain])


def merged_contexts(found_uses: DataFrame) -> DataFrame:
    """file_id, symbol, contexts: the ways a name is used; plain uses say nothing once there are others."""
    ctx = F.array_sort(F.collect_set(F.struct("kind", "attribute", "argc")))
    each = found_uses.groupBy("file_id", "symbol").agg(ctx.alias("contexts"))
    some = F.filter("contexts", lambda c: c["kind"] != "raw")
    return each.withColumn("contexts", F.when(F.size(some) > 0, some).otherwise(F.col("contexts")))


def descendants(tree: DataFrame, kinds: list[str], recursive: bool = True) -> DataFrame:
    """Nodes of some kinds; not recursive: the direct children of their module only."""
    wanted = tree.filter(F.col("kind").isin(kinds))
    return wanted if recursive else wanted.filter("depth = 1")


def without_kinds(tree: DataFrame, kinds: list[str]) -> DataFrame:
    """The nodes left when those of some kinds go with everything beneath them."""
    gone = F.array(*[F.lit(k) for k in kinds])
    return tree.filter(~F.col("kind").isin(kinds) & ~F.arrays_overlap("above", gone))


def pretty(tree: DataFrame) -> DataFrame:
    """file_id, node_id, line: one indented line for each node; order by node_id to print a file."""
    return tree.select("file_id", "node_id", F.concat(F.repeat(F.lit("  "), F.col("depth")), "kind", F.when(F.col("name").isNotNull(), F.concat(F.lit(" "), "name")).otherwise(F.lit(""))).alias("line"))


def first_of_kind(tree: DataFrame, kind: str) -> DataFrame:
    """The first node of a kind in each file."""
    wanted = tree.filter(F.col("kind") == kind)
    return wanted.groupBy("file_id").agg(F.min(F.struct("node_id", "name", "lineno")).alias("n")).select("file_id", "n.*")


def members_by_kind(found: DataFrame) -> DataFrame:
    """file_id, scope, and how many classes, functions and assignments each scope has."""
    n = lambda t: F.count_if(F.col("symbol_type") == t)
    return found.groupBy("file_id", "scope").agg(n(0).alias("classes"), n(1).alias("functions"), n(2).alias("assignments"))


def new_cells(found: DataFrame) -> DataFrame:
    """Names of a function that functions inside it take from it or through it, without those it takes from outside itself."""
    outer = found.select("file_id", F.col("around").alias("function"), "symbol")
    return outer.distinct().join(found.select("file_id", "function", "symbol"), ["file_id", "function", "symbol"], "left_anti")
