"""From missing names to the imports that give them: candidates, choice, edits and new sources, for all files at once."""

from __future__ import annotations

import keyword
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeloom.extract import edits, parsing
from codeloom.functions import paths
from codeloom.operators import code, symbols
from codeloom.session import ship, written

EDIT = "struct<kind:string,line:int,col:int,end_line:int,end_col:int,text:string>"
RESULT = f"file_id bigint, path string, new_source string, edits array<{EDIT}>, error string"


def index_of_files(files: DataFrame, facts: code.Facts | None = None) -> DataFrame:
    """Entries of the index for what files define at their top level, and for the modules themselves. Adds members,
    the names a symbol has. facts: those of the files, if they are at hand."""
    found = (facts or code.extract(files, "entry")).entries
    key = F.struct(F.lit(3).alias("module_source_type"), F.col("path").alias("id")).alias("module_key")
    flags = [F.lit(False).alias("not_yet_found_in_module"), F.lit(False).alias("imported")]
    name = F.coalesce("symbol", paths.module_basename(F.col("path"))).alias("symbol_name")
    return found.select(name, key, F.col("symbol").isNull().alias("is_module_itself"), "symbol_type", *flags, "members", "file_id")


def with_import_counts(index: DataFrame, resolved: DataFrame) -> DataFrame:
    """index with import_count: how many files import each entry (resolved: resolved_imports)."""
    itself = F.coalesce(F.col("is_module"), F.lit(False)) | F.col("value").isNull()
    refs = resolved.filter("target_id IS NOT NULL AND value IS DISTINCT FROM '*'").select(
        F.col("file_id").alias("importer"), F.col("target_id").alias("file_id"), itself.alias("is_module_itself"), F.when(~itself, F.col("value")).alias("value")
    )
    counts = symbols.import_counts(refs, "importer", ["file_id", "is_module_itself", "value"])
    named = index.withColumn("value", F.when(~F.col("is_module_itself"), F.col("symbol_name")))
    on = [F.col("i.file_id") == F.col("c.file_id"), F.col("i.is_module_itself") == F.col("c.is_module_itself"), F.col("i.value").eqNullSafe(F.col("c.value"))]
    return named.alias("i").join(counts.alias("c"), on, "left").select("i.*", F.coalesce("c.import_count", F.lit(0)).alias("import_count")).drop("value")


_PREFERENCE = ["import_count", "imported", "is_module_itself"]


def choose_imports(missing: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """file_id, symbol, ambiguous, winner for each missing name some entry could give. No module is imported into
    itself: where it would be the best, nothing is chosen. missing: file_id, symbol, contexts, and path if it is at hand.

    Entries of a symbol that are alike in what contexts and preference look at form a class. Each shape of contexts meets each class,
    not each entry; distance then decides between the entries of the best classes."""
    there = missing if "path" in missing.columns else missing.join(files.select("file_id", "path"), "file_id")
    ways = written(there.select("file_id", "path", "symbol", F.array_sort("contexts").alias("contexts")), "missing-names")
    alike = ["symbol_type", F.array_sort("members").alias("members"), *_PREFERENCE]
    entries = index.select(F.col("symbol_name").alias("symbol"), *alike, "module_key")
    entries = written(entries.withColumn("class_id", F.xxhash64("symbol", "symbol_type", "members", *_PREFERENCE)), "index-classes")
    classes = entries.select("symbol", "class_id", "symbol_type", "members", *_PREFERENCE).distinct()
    fits = ways.select("symbol", "contexts").distinct().join(classes, "symbol").filter(symbols.matches_context(F.col("symbol_type"), F.col("contexts"), F.col("members")))
    first = F.rank().over(Window.partitionBy("symbol", "contexts").orderBy(*symbols.preference()))
    best = written(fits.withColumn("k", first).filter("k = 1").select("symbol", "contexts", "class_id"), "best-classes")
    return nearest(ways, best, entries)


#: Stands for the directory of modules that are no files, which are equally far from everywhere.
_NOWHERE = "?"


def nearest(ways: DataFrame, best: DataFrame, entries: DataFrame) -> DataFrame:
    """For each file and name of ways (file_id, path, symbol, contexts) the one entry whose file is nearest, among those of the classes that
    best gives for symbol and contexts, without meeting all pairs of files and entries.

    The distance of an entry of length n from a folder of length m that share c components is max(n, m) - c. Entries are
    counted by each beginning of their path and by length; a folder looks under each of its own beginnings. Under a beginning
    shorter than what an entry really shares it seems farther than it is, so the smallest distance, and how many
    entries have it, come out right. What is joined grows with the depth of paths, not with the number of entries."""
    is_file = F.col("module_key.module_source_type").isin(1, 3)
    parts = F.when(is_file, paths.beginnings(F.col("module_key.id"))).otherwise(F.array(F.lit(_NOWHERE)))
    chosen = entries.join(best.select("class_id").distinct(), "class_id", "left_semi")
    under = chosen.select("class_id", "module_key", "is_module_itself", F.explode(parts).alias("beginning")).withColumn("n", F.when(is_file, _components(F.col("module_key.id"))).otherwise(1))
    counted = under.groupBy("class_id", "beginning", "n").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("module_key", "is_module_itself")).alias("w"))
    # files of one folder that miss the same name in the same ways find the same
    key = ["folder", "symbol", "contexts"]
    there = ways.withColumn("folder", paths.directory(F.col("path")))
    # dealt out by number, as each row becomes many
    places = there.select(*key).repartition(int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key).distinct()
    looks = places.join(best, ["symbol", "contexts"]).select(*key, "class_id", F.posexplode(F.concat(paths.beginnings(F.col("folder")), F.array(F.lit(_NOWHERE)))).alias("pos", "beginning"))
    far = F.when(F.col("beginning") == _NOWHERE, F.lit(paths.NO_FILE_DISTANCE)).otherwise(F.greatest("n", _components(F.col("folder"))) - F.col("pos") - 1)
    at = looks.join(counted, ["class_id", "beginning"]).groupBy(*key, far.alias("distance")).agg(F.sum("k").alias("n_best"), F.min("w").alias("w"))
    near = at.groupBy(*key).agg(F.min(F.struct("distance", "n_best", "w")).alias("b")).select(*key, "b.*")
    one = (F.col("n_best") == 1) & (F.col("w.module_key.id") != F.col("path"))
    return there.join(near, key).select("file_id", "symbol", "distance", "n_best", (F.col("n_best") > 1).alias("ambiguous"), F.when(one, F.col("w")).alias("winner"))


def _components(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def module_name(target: str, source_type: int, from_path: str, location: str) -> str:
    """How a file names a module: relative where that is nearer than from the location, else absolute; bare names stay."""
    if source_type not in (1, 3):
        return target
    folder = os.path.dirname(from_path)
    rel = os.path.relpath(target, folder or "/") if target.startswith("/") else os.path.relpath("/" + target, "/" + folder)
    ups = rel.count("../")
    distance = max(len(rel.split("/")) - ups, ups)
    inside = target.startswith(location)
    plain = target[len(location) :].lstrip("/")
    if inside and distance >= len(plain.split("/")):
        return _dotted(plain) or "."
    return "." * (ups + 1) + _dotted(rel[3 * ups :])


def _dotted(path: str) -> str:
    folder, name = os.path.split(path)
    name = name.split(".", 1)[0]
    return folder.replace("/", ".") if name == "__init__" else f"{folder.replace('/', '.')}.{name}" if folder else name


def _wanted(f: dict, path: str, location: str) -> edits.Wanted | None:
    """The import a choice stands for; None where the module has no name code could say, as folders with hyphens in them."""
    key = f["module_key"]
    module = module_name(key["id"], key["module_source_type"], path, location)
    if not all(p.isidentifier() and not keyword.iskeyword(p) for p in module.lstrip(".").split(".") if module.strip(".")):
        return None
    if not f["is_module_itself"]:
        return edits.Wanted(module, f["symbol"])
    dots = len(module) - len(module.lstrip("."))
    rest = module[dots:]
    if "." in rest:
        return edits.Wanted(module[:dots] + rest.rpartition(".")[0], rest.rpartition(".")[2])
    return edits.Wanted("." * dots, rest) if dots else edits.Wanted(module)


def _fix(location: str):
    schema = to_arrow_schema(StructType.fromDDL(RESULT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                source = r["source"] or ""
                tree, error = parsing.parse(source)
                if tree is None:  # positions of a broken file are not trusted; it stays as it is
                    rows.append((r["file_id"], r["path"], r["source"], [], error))
                    continue
                wanted = [w for f in r["fixes"] or [] if (w := _wanted(f, r["path"], location))]
                todo = edits.import_edits(tree, wanted, r["unused"] or [])
                try:
                    rows.append((r["file_id"], r["path"], edits.apply(source, todo), [e._asdict() for e in todo], None))
                except edits.Conflict as e:
                    rows.append((r["file_id"], r["path"], r["source"], [], str(e)))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def apply_imports(files: DataFrame, chosen: DataFrame, unused: DataFrame, location: str = "") -> DataFrame:
    """Every file with the chosen imports added and the unused ones removed: new_source and the edits that lead there."""
    ship(files.sparkSession)
    fix = F.struct("symbol", "winner.module_key", "winner.is_module_itself")
    fixes = chosen.filter("winner IS NOT NULL").groupBy("file_id").agg(F.sort_array(F.collect_list(fix)).alias("fixes"))
    gone = unused.groupBy("file_id").agg(F.sort_array(F.collect_set("bound")).alias("unused"))
    rows = files.select("file_id", "path", "source").join(fixes, "file_id", "left").join(gone, "file_id", "left")
    return code.evenly(rows).mapInArrow(_fix(location), RESULT)


def fix_files(files: DataFrame, index: DataFrame, facts: code.Facts | None = None, location: str = "", remove_unused: bool = True) -> DataFrame:
    """The whole way for files (file_id, path, source): what is missing, which entries of the index give it, the new sources.
    facts: those of the files, if they are at hand."""
    facts = facts or code.extract(files, "import", "export", "gap")
    unused = code.unused_of(facts)
    return apply_imports(files, choose_imports(code.missing_of(facts), facts.files, index), unused if remove_unused else unused.limit(0), location)


def apply_edits(texts: DataFrame) -> DataFrame:
    """id, text with its edits made, error where they conflict. texts: id BIGINT, text, edits ARRAY of edits (see EDIT)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    out.append((r["id"], None if r["text"] is None else edits.apply(r["text"], [edits.Edit(**e) for e in r["edits"] or []]), None))
                except edits.Conflict as e:
                    out.append((r["id"], r["text"], str(e)))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()), strict=True)], names=["id", "text", "error"])

    return texts.select("id", "text", F.col("edits").cast(f"array<{EDIT}>").alias("edits")).mapInArrow(run, "id bigint, text string, error string")
