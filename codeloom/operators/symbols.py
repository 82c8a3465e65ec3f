"""The symbol index: entries, aliases, lookup, import counts and the choice among candidates.

entries: symbol_name, symbol_type, module_key, is_module_itself, not_yet_found_in_module, imported, import_count
aliases: as_name, real_name, module_key, is_module_itself, import_count
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import paths

TYPE, FUNCTION, ASSIGNMENT, MODULE, UNKNOWN, AMBIGUOUS = range(6)
ENTRY_KEY = ["symbol_name", "module_key", "is_module_itself"]
ALIAS_KEY = ["as_name", "real_name", "module_key", "is_module_itself"]


def latest(rows: DataFrame, key: list[str], at: list[str], columns: list[str]) -> DataFrame:
    """The newest row of each key, as one maximum per key (combined on the map side)."""
    newest = rows.groupBy(*key).agg(F.max(F.struct(*at, *columns)).alias("r"))
    return newest.select(*key, *[F.col(f"r.{c}").alias(c) for c in columns])


def current_entries(passes: DataFrame) -> DataFrame:
    """One entry for each symbol, module and is_module_itself out of what index passes recorded; nulls in counts are 0, in flags false."""
    e = latest(passes, ENTRY_KEY, ["added_at", "entry_id"], ["symbol_type", "not_yet_found_in_module", "imported", "import_count"])
    no, zero = F.lit(False), F.lit(0)
    return e.select(
        *ENTRY_KEY, "symbol_type", F.coalesce("not_yet_found_in_module", no).alias("not_yet_found_in_module"),
        F.coalesce("imported", no).alias("imported"), F.coalesce("import_count", zero).alias("import_count"),
    )


def current_aliases(recorded: DataFrame) -> DataFrame:
    a = latest(recorded, ALIAS_KEY, ["recorded_at", "alias_id"], ["import_count"])
    return a.select(*ALIAS_KEY, F.coalesce("import_count", F.lit(0)).alias("import_count"))


def complete_view(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """What a symbol may mean: the entries its aliases stand for, with the alias's own import count, and the entries of that name."""
    cols = ["symbol", "real_name", "module_key", "is_module_itself", "symbol_type", "imported", "import_count", "is_alias"]
    e = entries.drop("import_count").withColumnRenamed("symbol_name", "real_name")
    by_alias = aliases.withColumnRenamed("as_name", "symbol").join(e, ["real_name", "module_key", "is_module_itself"]).withColumn("is_alias", F.lit(True))
    direct = entries.select(F.col("symbol_name").alias("symbol"), F.col("symbol_name").alias("real_name"), "*").withColumn("is_alias", F.lit(False))
    return by_alias.select(*cols).unionByName(direct.select(*cols))


def find_symbol(view: DataFrame, symbol: str) -> DataFrame:
    return view.filter(F.col("symbol") == symbol)


def import_counts(refs: DataFrame, importer: str, target: list[str]) -> DataFrame:
    """target, import_count: each importing module counts once for each thing it imports."""
    return refs.select(importer, *target).distinct().groupBy(*target).agg(F.count(F.lit(1)).alias("import_count"))


def import_count_deltas(old: DataFrame, new: DataFrame, importer: str, target: list[str]) -> DataFrame:
    """target, delta between two states of the references, zeros left out."""
    one = F.lit(1).cast("bigint")
    signed = new.select(importer, *target).distinct().withColumn("d", one).unionByName(old.select(importer, *target).distinct().withColumn("d", -one))
    return signed.groupBy(*target).agg(F.sum("d").alias("delta")).filter("delta <> 0")


def apply_count_deltas(entries: DataFrame, deltas: DataFrame, key: list[str]) -> DataFrame:
    """entries with their counts changed. A key without entry gets one that is not yet found in its module; an entry not found there
    disappears with its last import."""
    merged = entries.join(deltas, key, "full_outer")
    count = F.coalesce("import_count", F.lit(0)) + F.coalesce("delta", F.lit(0))
    out = merged.withColumns({"import_count": count, "not_yet_found_in_module": F.coalesce("not_yet_found_in_module", F.lit(True))}).drop("delta")
    return out.filter(~F.col("not_yet_found_in_module") | (F.col("import_count") > 0))


def without_modules(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries left when modules are removed; those still imported elsewhere stay as not found in their module."""
    marked = entries.join(gone.select("module_key").distinct().withColumn("gone", F.lit(True)), "module_key", "left")
    missing = F.coalesce("gone", F.lit(False))
    return (
        marked.filter(~missing | (F.col("import_count") > 0))
        .withColumn("not_yet_found_in_module", F.col("not_yet_found_in_module") | missing).drop("gone").select(*entries.columns)
    )


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, rows that only one of two indexes has; no rows if they are equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def preference() -> list[Column]:
    """What makes a candidate better: more imports, not itself imported, the module itself."""
    return [F.desc("import_count"), F.col("imported").asc(), F.desc("is_module_itself")]


def best_candidates(candidates: DataFrame, per: list[str], order: list[Column]) -> DataFrame:
    """The one best candidate of each group; where several are equally good the group is ambiguous and its winner null.

    Gives per, n_best, ambiguous and winner (a struct of the other columns)."""
    rest = [c for c in candidates.columns if c not in per]
    # rank is cut at 1 below the exchange, so large groups shrink before they travel
    first = candidates.withColumn("__rank", F.rank().over(Window.partitionBy(*per).orderBy(*order))).filter("__rank = 1")
    best = first.groupBy(*per).agg(F.count(F.lit(1)).alias("n_best"), F.min(F.struct(*rest)).alias("w"))
    return best.select(*per, "n_best", (F.col("n_best") > 1).alias("ambiguous"), F.when(F.col("n_best") == 1, F.col("w")).alias("winner"))


def module_distance(module_type: Column, module_id: Column, from_dir: Column) -> Column:
    """How far a module's file is from a directory; modules that are no files have a fixed distance."""
    return F.when(module_type.isin(1, 3), paths.file_distance(module_id, from_dir)).otherwise(F.lit(paths.NO_FILE_DISTANCE))


def matches_context(symbol_type: Column, contexts: Column, members: Column) -> Column:
    """Whether a candidate can be used as all contexts (structs of kind, attribute) do. members: names the candidate has."""

    def one(c: Column) -> Column:
        kind = c["kind"]
        return (
            F.when(kind == "call", symbol_type.isin(FUNCTION, TYPE)).when(kind == "subscript", symbol_type != FUNCTION)
            .when(kind == "attribute", F.coalesce(F.array_contains(members, c["attribute"]), F.lit(False))).otherwise(F.lit(True))
        )

    return symbol_type.isin(AMBIGUOUS, UNKNOWN) | F.forall(contexts, one)


def route_to_location(paths_df: DataFrame, locations: DataFrame) -> DataFrame:
    """path, location: the deepest location directory (with final slash) above each path, null if none. The prefixes of a path are
    exploded, which makes the prefix join an equi-join."""
    up = paths_df.select("path").distinct().withColumn("location", F.explode(paths.ancestors(F.col("path"))))
    best = up.join(locations.select("location").distinct(), "location").groupBy("path").agg(F.max(F.struct(F.length("location").alias("n"), "location")).alias("b"))
    return paths_df.select("path").distinct().join(best, "path", "left").select("path", F.col("b.location").alias("location"))


def stub_of(modules: DataFrame, stubs: DataFrame) -> DataFrame:
    """modules (with module_name) and stub_path: the stub of the lowest version that is not of the second language version alone;
    null where there is none."""
    best = stubs.filter("version <> '2'").groupBy("module_name").agg(F.min(F.struct("version", "path")).alias("b")).select("module_name", F.col("b.path").alias("stub_path"))
    return modules.join(best, "module_name", "left")


def location_of(modules: DataFrame, locations: DataFrame) -> DataFrame:
    """module_key, location: bad modules have none, builtins the one of that name, others the deepest directory above."""
    keys = modules.select("module_key").distinct()
    kind, ident = F.col("module_key.module_source_type"), F.col("module_key.id")
    routed = route_to_location(keys.filter(kind.isin(1, 3)).select(ident.alias("path")), locations).withColumnRenamed("path", "id")
    found = keys.withColumn("id", ident).join(routed, "id", "left")
    return found.select("module_key", F.when(kind == 0, "builtins").when(kind != 2, F.col("location")).alias("location"))


def already_imported(chosen: DataFrame, resolved: DataFrame) -> DataFrame:
    """Of chosen imports (file_id, symbol, target_id), those a file has already, by that name or by a star import of the module."""
    has = resolved.select("file_id", "target_id", F.col("bound").alias("symbol"))
    return chosen.join(has.filter("symbol <> '*'"), ["file_id", "target_id", "symbol"], "left_semi").unionByName(chosen.join(has.filter("symbol = '*'").drop("symbol"), ["file_id", "target_id"], "left_semi").select(*chosen.columns)).distinct()
