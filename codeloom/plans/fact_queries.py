"""The operators on facts of code, fed with facts made of other tables, so that SQL can say what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import code, symbols, terms
from codeloom.session import table


def fact_missing_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Names in documents that the common words of their language do not give: words are uses, a language is a module all
    documents in it import with a star."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), "lang", "text")
    uses = docs.select("file_id", F.explode(F.regexp_extract_all("text", F.lit(terms.IDENTIFIER), F.lit(0))).alias("symbol"))
    uses = uses.select("*", F.lit("raw").alias("kind"), F.lit("").alias("attribute"), F.lit(0).alias("argc"), F.lit(True).alias("missing"))
    stars = docs.filter("lang IS NOT NULL").select("file_id", F.lit("*").alias("value"), F.xxhash64("lang").alias("target_id"))
    exports = table(spark, d, "common_words").select(F.xxhash64("lang").alias("file_id"), F.col("word").alias("symbol"))
    return code.missing_symbols(uses, stars, exports).select("file_id", "symbol")


def fact_unused_imports(spark: SparkSession, d: str) -> DataFrame:
    """Parts are imports of their brand; an order line of more than 49 uses its part."""
    brand = F.xxhash64("p_brand").alias("file_id")
    part = table(spark, d, "part")
    bound = F.col("p_partkey").cast("string").alias("bound")
    imports = part.select(brand, bound, F.lit("from").alias("kind"), F.col("p_type").alias("module"), F.col("p_name").alias("value"), F.lit(True).alias("top_level"))
    used = table(spark, d, "lineitem").filter("l_quantity > 49").join(part, F.col("l_partkey") == F.col("p_partkey")).select(brand, F.col("p_partkey").cast("string").alias("symbol"))
    return code.unused_imports(imports, used).select(F.col("bound").cast("bigint").alias("p_partkey"), "module", "value")


def fact_contexts(spark: SparkSession, d: str) -> DataFrame:
    """How users use event types: as plain names, calls or subscripts."""
    e = table(spark, d, "events")
    kind = F.element_at(F.array(F.lit("raw"), F.lit("call"), F.lit("subscript")), (F.col("event_id") % 3 + 1).cast("int"))
    uses = e.select(F.col("user_id").alias("file_id"), F.col("event_type").alias("symbol"), kind.alias("kind"), F.lit("").alias("attribute"), F.lit(0).alias("argc"))
    return code.merged_contexts(uses).select("file_id", "symbol", F.array_join(F.transform("contexts", lambda c: c["kind"]), ",").alias("kinds"))


def fact_new_cells(spark: SparkSession, d: str) -> DataFrame:
    """Regions hold nations hold segments; a name is taken from outside by each segment's smallest balances."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    inner = F.concat_ws(".", "r_name", "n_name", "c_mktsegment")
    taken = (F.col("c_custkey") % 11).cast("string").alias("symbol")
    found = c.select(F.lit(1).cast("bigint").alias("file_id"), inner.alias("function"), taken).unionByName(c.filter("c_custkey % 2 = 0").select(F.lit(1).cast("bigint").alias("file_id"), F.concat_ws(".", "r_name", "n_name").alias("function"), taken))
    around = F.regexp_replace("function", r"\.[^.]*$", "")
    return code.new_cells(found.distinct().withColumn("around", around)).select("function", "symbol")


def fact_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Every module imports `util` and `api` from its own package: which file is that?"""
    m = table(spark, d, "modules").filter("module_key.id LIKE '/%'").select(F.col("module_key.id").alias("path")).distinct()
    files = m.select(F.xxhash64("path").alias("file_id"), "path")
    imports = files.select("file_id", F.lit("from").alias("kind"), F.lit(".").alias("module"), F.explode(F.array(F.lit("util"), F.lit("api"))).alias("value"))
    found = code.resolved_imports(imports, files)
    named = found.join(files, "file_id").join(files.select(F.col("file_id").alias("target_id"), F.col("path").alias("target")), "target_id", "left")
    return named.select("path", "value", "target", "is_module")


def fact_public_members(spark: SparkSession, d: str) -> DataFrame:
    """Public classes and functions of each module, with how many there are of each."""
    e = symbols.current_entries(table(spark, d, "symbol_entries")).filter("NOT startswith(symbol_name, '_')")
    found = e.select(F.xxhash64("module_key").alias("file_id"), F.col("module_key.id").alias("scope"), "symbol_type")
    return code.members_by_kind(found).groupBy("scope").agg(F.sum("classes").alias("classes"), F.sum("functions").alias("functions"), F.sum("assignments").alias("assignments"))


def fact_already_imported(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as chosen imports (order, supplier, part): those of nation 7's suppliers are imported by a star, others if another
    line of the order has the pair with a return flag."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_suppkey").alias("target_id"), F.col("l_partkey").cast("string").alias("symbol"), "l_returnflag", "l_linestatus").distinct()
    star = table(spark, d, "supplier").filter("s_nationkey = 7").select(F.col("s_suppkey").alias("target_id"))
    have = lines.filter("l_returnflag = 'R'").select("file_id", "target_id", F.col("symbol").alias("bound")).unionByName(lines.join(star, "target_id").select("file_id", "target_id", F.lit("*").alias("bound")))
    return symbols.already_imported(lines.select("file_id", "symbol", "target_id").distinct(), have)


QUERIES = {f.__name__: f for f in (fact_missing_symbols, fact_unused_imports, fact_contexts, fact_new_cells, fact_resolution, fact_public_members, fact_already_imported)}

ORACLES = {
    "fact_missing_symbols": """SELECT DISTINCT doc_id AS file_id, symbol FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS symbol FROM documents) t
        WHERE NOT EXISTS (SELECT 1 FROM common_words c WHERE c.lang = t.lang AND c.word = t.symbol)""",
    "fact_unused_imports": "SELECT p_partkey, p_type AS module, p_name AS value FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "fact_contexts": """WITH u AS (SELECT DISTINCT user_id AS file_id, event_type AS symbol, (['raw', 'call', 'subscript'])[event_id % 3 + 1] AS kind FROM events)
        SELECT file_id, symbol, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (kind <> 'raw'), 'raw') AS kinds FROM u GROUP BY 1, 2""",
    "fact_new_cells": """WITH c AS (SELECT r_name || '.' || n_name AS outer_f, c_mktsegment AS seg, c_custkey, CAST(c_custkey % 11 AS VARCHAR) AS symbol FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
        f AS (SELECT DISTINCT outer_f || '.' || seg AS function, symbol FROM c UNION SELECT outer_f, symbol FROM c WHERE c_custkey % 2 = 0)
        SELECT DISTINCT regexp_replace(function, '\\.[^.]*$', '') AS function, symbol FROM f EXCEPT SELECT function, symbol FROM f""".replace("\\\\", "\\"),
    "fact_resolution": """WITH m AS (SELECT DISTINCT module_key.id AS path, regexp_extract(module_key.id, '^(.*)/[^/]*$', 1) AS dir FROM modules WHERE module_key.id LIKE '/%'), i AS (SELECT path, dir, unnest(['util', 'api']) AS value FROM m),
        c AS (SELECT i.path, i.value, CAST(k AS INTEGER) AS k, (list_concat([dir || '/' || value || '/__init__.pyi', dir || '/' || value || '/__init__.py', dir || '/' || value || '.py', dir || '/' || value || '.pyi'], [dir || '/__init__.pyi', dir || '/__init__.py', dir || '.py', dir || '.pyi']))[k] AS target FROM i, range(1, 9) r(k)),
        b AS (SELECT c.path, c.value, min(k) AS k, min_by(target, k) AS target FROM c JOIN m ON m.path = target GROUP BY 1, 2) SELECT i.path, i.value, target, k <= 4 AS is_module FROM i LEFT JOIN b USING (path, value)""",
    "fact_public_members": """WITH e AS (SELECT symbol_name, module_key.id AS scope, symbol_type FROM symbol_entries QUALIFY row_number() OVER (PARTITION BY symbol_name, module_key, is_module_itself ORDER BY added_at DESC, entry_id DESC) = 1)
        SELECT scope, count(*) FILTER (symbol_type = 0) AS classes, count(*) FILTER (symbol_type = 1) AS functions, count(*) FILTER (symbol_type = 2) AS assignments FROM e WHERE NOT starts_with(symbol_name, '_') GROUP BY scope""",
    "fact_already_imported": """WITH l AS (SELECT DISTINCT l_orderkey AS file_id, l_suppkey AS target_id, CAST(l_partkey AS VARCHAR) AS symbol, l_returnflag FROM lineitem)
        SELECT DISTINCT file_id, symbol, target_id FROM l WHERE target_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7) OR (file_id, target_id, symbol) IN (SELECT (file_id, target_id, symbol) FROM l WHERE l_returnflag = 'R')""",
}
