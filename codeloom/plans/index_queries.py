"""Queries over the symbol index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import symbols
from codeloom.session import table

_CUT = "1998-01-01"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return symbols.current_entries(table(spark, d, "symbol_entries"))


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"module_type": F.col("module_key.module_source_type"), "module_id": F.col("module_key.id")}).drop("module_key")


def current_entries(spark, d):
    return _flat(_entries(spark, d))


def _view(spark, d):
    return symbols.complete_view(_entries(spark, d), symbols.current_aliases(table(spark, d, "symbol_aliases")))


def symbol_lookup_alias(spark, d):
    return _flat(_view(spark, d))


def find_symbol(spark, d):
    return _flat(symbols.find_symbol(_view(spark, d), "np"))


def import_counts(spark, d):
    return symbols.import_counts(table(spark, d, "lineitem"), "l_orderkey", ["l_partkey"])


def import_counts_delta(spark, d):
    lines = table(spark, d, "lineitem")
    return symbols.import_count_deltas(lines.filter(F.col("l_shipdate") < _CUT), lines, "l_orderkey", ["l_partkey"])


def import_counts_maintained(spark, d):
    """The counts of an older state with the deltas applied."""
    lines = table(spark, d, "lineitem")
    old = symbols.import_counts(lines.filter(F.col("l_shipdate") < _CUT), "l_orderkey", ["l_partkey"]).withColumn("not_yet_found_in_module", F.lit(False))
    return symbols.apply_count_deltas(old, import_counts_delta(spark, d), ["l_partkey"]).select("l_partkey", "import_count")


def rank_candidates_ambiguous(spark, d):
    best = symbols.best_candidates(_entries(spark, d).select("symbol_name", "import_count", "imported", "is_module_itself", "module_key"), ["symbol_name"], symbols.preference())
    return best.select("symbol_name", "n_best", "ambiguous", F.col("winner.module_key.id").alias("module_id"), F.col("winner.module_key.module_source_type").alias("module_type"))


def rank_candidates_distance(spark, d):
    c = _entries(spark, d).select("symbol_name", "import_count", "imported", "is_module_itself", "module_key")
    far = symbols.module_distance(F.col("module_key.module_source_type"), F.col("module_key.id"), F.lit("/srv/code/shared/corekit"))
    best = symbols.best_candidates(c.withColumn("distance", far), ["symbol_name"], [*symbols.preference(), F.asc("distance")])
    return best.select("symbol_name", "n_best", "ambiguous", F.col("winner.module_key.id").alias("module_id"), F.col("winner.distance").alias("distance"))


def context_match(spark, d):
    """Entries by whether they can be called, subscripted, and read for an attribute of their own name."""
    one = lambda kind, a: F.array(F.struct(F.lit(kind).alias("kind"), a.alias("attribute")))
    name, members = F.col("symbol_name"), F.array(F.lit("Config"), F.lit("logger"))
    t = F.col("symbol_type")
    return _entries(spark, d).select(
        "symbol_type", symbols.matches_context(t, one("call", name), members).alias("callable"), symbols.matches_context(t, one("subscript", name), members).alias("subscriptable"),
        symbols.matches_context(t, one("attribute", name), members).alias("has_attribute"), symbols.matches_context(t, F.concat(one("raw", name), one("call", name)), members).alias("both"),
    ).groupBy("symbol_type", "callable", "subscriptable", "has_attribute", "both").agg(F.count(F.lit(1)).alias("n"))


def definitions_by_symbol(spark, d):
    """The inverted index: a row for each symbol and module that defines it, with the kinds of definition; rows rather than a list
    per symbol, as some symbols are nearly everywhere."""
    return _flat(_entries(spark, d).groupBy("symbol_name", "module_key").agg(F.count(F.lit(1)).alias("n_definitions"), F.min("symbol_type").alias("first_type"), F.max("symbol_type").alias("last_type")))


def index_without_modules(spark, d):
    e = _entries(spark, d)
    gone = table(spark, d, "modules").groupBy("module_key").agg(F.count_if(F.col("removed_at").isNull()).alias("open")).filter("open = 0")
    return _flat(symbols.without_modules(e, gone))


def index_deep_equals(spark, d):
    """Entries of old and new in which two states differ; none between equal ones."""
    e = _flat(_entries(spark, d))
    same = symbols.differences(e, e).agg(F.count(F.lit(1)).alias("n"))
    other = symbols.differences(e, e.filter("import_count > 0")).agg(F.count(F.lit(1)).alias("n"))
    return same.select(F.lit("same").alias("pair"), "n").unionByName(other.select(F.lit("imported only").alias("pair"), "n"))


def module_locations(spark, d):
    m = table(spark, d, "modules")
    return _flat(symbols.location_of(m, m.select("location").filter("location LIKE '/%'")))


def stub_lookup(spark, d):
    """Every module with the stub of its base name, if some module is one; the kind of module stands for the version."""
    m = table(spark, d, "modules").select("module_row_id", paths.module_basename(F.col("module_key.id")).alias("module_name")).distinct()
    s = table(spark, d, "modules").filter("module_key.id LIKE '%.pyi'").select(
        paths.module_basename(F.col("module_key.id")).alias("module_name"), F.col("module_key.module_source_type").cast("string").alias("version"), F.col("module_key.id").alias("path")
    )
    return symbols.stub_of(m, s)


def entries_by_month(spark, d):
    """Entries per type and month with sub-totals."""
    e = table(spark, d, "symbol_entries").drop("ingested_at").distinct()
    return e.rollup("symbol_type", F.date_format("added_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_entries"), F.sum("import_count").alias("n_imports"))


QUERIES = {
    f.__name__: f
    for f in (current_entries, symbol_lookup_alias, find_symbol, import_counts, import_counts_delta, import_counts_maintained, rank_candidates_ambiguous, rank_candidates_distance, context_match, definitions_by_symbol, index_without_modules, index_deep_equals, module_locations, stub_lookup, entries_by_month)
}

_E = """e AS (SELECT symbol_name, module_key.module_source_type AS module_type, module_key.id AS module_id, is_module_itself, symbol_type, coalesce(not_yet_found_in_module, false) AS not_yet_found_in_module,
  coalesce(imported, false) AS imported, coalesce(import_count, 0) AS import_count FROM symbol_entries
  QUALIFY row_number() OVER (PARTITION BY symbol_name, module_key, is_module_itself ORDER BY added_at DESC, entry_id DESC) = 1)"""
_VIEW = f"""{_E}, a AS (SELECT as_name, real_name, module_key.module_source_type AS module_type, module_key.id AS module_id, is_module_itself, coalesce(import_count, 0) AS import_count FROM symbol_aliases
  QUALIFY row_number() OVER (PARTITION BY as_name, real_name, module_key, is_module_itself ORDER BY recorded_at DESC, alias_id DESC) = 1),
v AS (SELECT as_name AS symbol, real_name, a.module_type, a.module_id, a.is_module_itself, symbol_type, imported, a.import_count, true AS is_alias
  FROM a JOIN e ON e.symbol_name = real_name AND e.module_type = a.module_type AND e.module_id = a.module_id AND e.is_module_itself = a.is_module_itself
  UNION ALL SELECT symbol_name, symbol_name, module_type, module_id, is_module_itself, symbol_type, imported, import_count, false FROM e)"""
_DIST = """CASE WHEN module_type IN (1, 3) THEN greatest(len(string_split(module_id, '/')), 5) - len(list_filter(range(1, least(len(string_split(module_id, '/')), 5) + 1), lambda i:
  list_slice(string_split(module_id, '/'), 1, i) = list_slice(['', 'srv', 'code', 'shared', 'corekit'], 1, i))) ELSE 4 END"""


def _best(order: str, extra: str, more: str = "") -> str:
    return f"""WITH {_E}, r AS (SELECT *, rank() OVER (PARTITION BY symbol_name ORDER BY {order}) AS k FROM (SELECT *{more} FROM e)) SELECT symbol_name, count(*) AS n_best, count(*) > 1 AS ambiguous,
        CASE WHEN count(*) = 1 THEN min(module_id) END AS module_id, {extra} FROM r WHERE k = 1 GROUP BY symbol_name"""


ORACLES = {
    "current_entries": f"WITH {_E} SELECT * FROM e",
    "symbol_lookup_alias": f"WITH {_VIEW} SELECT * FROM v",
    "find_symbol": f"WITH {_VIEW} SELECT * FROM v WHERE symbol = 'np'",
    "import_counts": "SELECT l_partkey, count(*) AS import_count FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1",
    "import_counts_delta": f"""WITH o AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_shipdate < '{_CUT}'), n AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
        SELECT l_partkey, CAST(sum(d) AS BIGINT) AS delta FROM (SELECT l_partkey, 1 d FROM n UNION ALL SELECT l_partkey, -1 FROM o) GROUP BY 1 HAVING sum(d) <> 0""",
    "import_counts_maintained": "SELECT l_partkey, count(*) AS import_count FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1",
    "rank_candidates_ambiguous": _best("import_count DESC, imported, is_module_itself DESC", "CASE WHEN count(*) = 1 THEN min(module_type) END AS module_type"),
    "rank_candidates_distance": _best("import_count DESC, imported, is_module_itself DESC, distance", "CAST(CASE WHEN count(*) = 1 THEN min(distance) END AS INTEGER) AS distance", f", {_DIST} AS distance"),
    "context_match": f"""WITH {_E} SELECT symbol_type, symbol_type IN (0, 1, 4, 5) AS callable, symbol_type <> 1 AS subscriptable, symbol_type IN (4, 5) OR symbol_name IN ('Config', 'logger') AS has_attribute,
        symbol_type IN (0, 1, 4, 5) AS both, count(*) AS n FROM e GROUP BY ALL""",
    "definitions_by_symbol": f"WITH {_E} SELECT symbol_name, module_type, module_id, count(*) AS n_definitions, min(symbol_type) AS first_type, max(symbol_type) AS last_type FROM e GROUP BY ALL",
    "index_without_modules": f"""WITH {_E}, gone AS (SELECT module_key.module_source_type AS module_type, module_key.id AS module_id, true AS gone FROM modules GROUP BY ALL HAVING count(*) FILTER (removed_at IS NULL) = 0)
        SELECT symbol_name, module_type, module_id, is_module_itself, symbol_type, not_yet_found_in_module OR coalesce(gone, false) AS not_yet_found_in_module, imported, import_count
        FROM e LEFT JOIN gone USING (module_type, module_id) WHERE NOT coalesce(gone, false) OR import_count > 0""",
    "index_deep_equals": f"WITH {_E} SELECT 'same' AS pair, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'imported only', count(*) FROM e WHERE import_count <= 0",
    "module_locations": """WITH k AS (SELECT DISTINCT module_key.module_source_type AS module_type, module_key.id AS module_id FROM modules), l AS (SELECT DISTINCT location FROM modules WHERE location LIKE '/%')
        SELECT module_type, module_id, CASE WHEN module_type = 0 THEN 'builtins' WHEN module_type <> 2 THEN max_by(location, length(location)) END AS location FROM k LEFT JOIN l ON starts_with(module_id, location) GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY module_type, module_id"),
    "stub_lookup": r"""WITH m AS (SELECT DISTINCT module_row_id, module_key.module_source_type AS v, module_key.id AS id, CASE WHEN regexp_matches(module_key.id, '(^|/)__init__\.pyi?$') THEN coalesce(list_extract(string_split(module_key.id, '/'), -2), '')
        ELSE split_part(list_extract(string_split(module_key.id, '/'), -1), '.', 1) END AS module_name FROM modules), s AS (SELECT DISTINCT ON (module_name) module_name, id AS stub_path FROM m WHERE id LIKE '%.pyi' AND v <> 2 ORDER BY module_name, v, id)
        SELECT module_row_id, module_name, stub_path FROM m LEFT JOIN s USING (module_name)""",
    "entries_by_month": """SELECT symbol_type, strftime(added_at, '%Y-%m') AS month, count(*) AS n_entries, CAST(sum(import_count) AS BIGINT) AS n_imports FROM (SELECT DISTINCT * EXCLUDE ingested_at FROM symbol_entries)
        GROUP BY ROLLUP (symbol_type, strftime(added_at, '%Y-%m'))""",
}
