"""Queries over what is extracted from all source files. SQL cannot parse sources, so these have none; case_queries and tests hold exact values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import code, fixing, incremental
from codeloom.session import table, written
from codeloom.sources import files as source_files


def _files(spark: SparkSession, d: str) -> DataFrame:
    return code.python_files(table(spark, d, "source_files"), F.col("file_id"), F.col("module_key.id"), F.col("source"))


def _rooted(spark: SparkSession, d: str) -> DataFrame:
    """Files with the folder absolute imports start from: the source folder of their repository."""
    return _files(spark, d).withColumn("root", F.regexp_extract("path", "^(/srv/code/[^/]+/[^/]+)/", 1))


def code_nodes(spark, d):
    n = code.nodes(_files(spark, d))
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("depth").alias("deepest"))


def code_tree_lines(spark, d):
    return code.pretty(code.nodes(_files(spark, d)))


def code_without_functions(spark, d):
    return code.without_kinds(code.nodes(_files(spark, d)), ["FunctionDef", "AsyncFunctionDef"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n_nodes"))


def code_top_statements(spark, d):
    return code.descendants(code.nodes(_files(spark, d)), ["Import", "ImportFrom", "FunctionDef", "ClassDef"], recursive=False).select("file_id", "kind", "name", "lineno")


def code_node_fields(spark, d):
    """The fields each kind of node has."""
    n = code.nodes(_files(spark, d)).select("kind", F.explode(F.map_keys("attrs")).alias("field")).distinct()
    return n.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def code_definitions(spark, d):
    return code.definitions(_files(spark, d))


def code_public_members(spark, d):
    return code.definitions(_files(spark, d)).filter("symbol_type IN (0, 1) AND NOT startswith(name, '_')").groupBy("symbol_type", "name").agg(F.count(F.lit(1)).alias("n"))


def code_imports(spark, d):
    f = _rooted(spark, d)
    return code.resolved_imports(code.imports(f), f).select("file_id", "kind", "module", "value", "as_name", "bound", "top_level", "target_id", "is_module")


def code_missing_symbols(spark, d):
    return code.missing_of(code.extract(_rooted(spark, d), "import", "export", "gap")).select("file_id", "symbol", F.size("contexts").alias("n_contexts"))


def code_unused_imports(spark, d):
    return code.unused_of(code.extract(_files(spark, d), "import", "used")).select("file_id", "kind", "module", "value", "bound")


def code_contexts(spark, d):
    return code.merged_contexts(code.uses(_files(spark, d))).select("file_id", "symbol", F.to_json("contexts").alias("contexts"))


def code_references(spark, d):
    """How often each name is read, by what it resolves to; unknown names are one group."""
    return code.references(_files(spark, d)).groupBy("resolved").agg(F.count(F.lit(1)).alias("n"))


def code_parameters(spark, d):
    return code.parameters(_files(spark, d))


def code_statements(spark, d):
    return code.statements(_files(spark, d)).groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))


def code_exports(spark, d):
    return code.exports(_files(spark, d)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_files"))


def code_name_counts(spark, d):
    return code.name_counts(_files(spark, d))


def code_values(spark, d):
    return code.values(_files(spark, d)).select("file_id", "name", "n_values", "ambiguous", F.array_join("types", ",", "?").alias("types"))


def code_parse_failures(spark, d):
    return code.parse_failures(_files(spark, d))


def code_statistics(spark, d):
    return code.statistics(_files(spark, d)).drop("file_id")


def code_members(spark, d):
    return code.members(_files(spark, d)).select("file_id", "owner", "owner_kind", "name", "kind", "type")


def code_values_across(spark, d):
    """Values of names, imported ones as their modules have them."""
    f = _rooted(spark, d)
    found = code.follow_imports(written(code.values(f), "values"), code.resolved_imports(code.imports(f), f))
    return found.select("file_id", "name", "n_values", "ambiguous", F.array_join("types", ",", "?").alias("types"))


def _index(f, x):
    return fixing.with_import_counts(fixing.index_of_files(f, x), code.resolved_imports(x.imports, x.files))


def code_index(spark, d):
    f = _rooted(spark, d)
    index = _index(f, code.extract(f, "import", "entry"))
    return index.select("symbol_name", F.col("module_key.id").alias("module_id"), "is_module_itself", "symbol_type", "import_count")


def code_fix_imports(spark, d):
    """Missing names of every file against the index of all of them: new sources and their number of edits."""
    f = _rooted(spark, d)
    x = code.extract(f, "import", "export", "gap", "entry")
    return fixing.fix_files(f, _index(f, x), x, location="/srv/code/").select("file_id", "path", "new_source", F.size("edits").alias("n_edits"), "error")


def code_first_class(spark, d):
    return code.first_of_kind(code.nodes(_files(spark, d)), "ClassDef")


def code_members_by_kind(spark, d):
    return code.members_by_kind(code.definitions(_files(spark, d)))


def code_index_updated(spark, d):
    """The index of all files, reached by building it without one repository and then adding that."""
    f = _rooted(spark, d)
    late = F.col("path").startswith("/srv/code/soto-biri/")
    state = incremental.update(incremental.build(f.filter(~late)), f.filter(late), f.select("file_id").limit(0))
    return incremental.with_counts(state).select("symbol_name", F.col("module_key.id").alias("module_id"), "is_module_itself", "symbol_type", "import_count")


def notebook_code(spark, d):
    n = table(spark, d, "source_files").select("file_id", F.col("module_key.id").alias("path"), "source").distinct().filter("lower(path) LIKE '%.ipynb'")
    return source_files.notebook_code(n, F.col("source")).select("file_id", "code")


QUERIES = {
    f.__name__: f
    for f in (
        code_nodes, code_tree_lines, code_without_functions, code_top_statements, code_node_fields, code_definitions, code_public_members, code_imports, code_missing_symbols, code_unused_imports, code_contexts, code_references, code_parameters,
        code_statements, code_exports, code_name_counts, code_values, code_parse_failures, code_statistics, code_members, code_values_across, code_index, code_fix_imports, code_first_class, code_members_by_kind, code_index_updated, notebook_code,
    )
}
ORACLES = {
    "notebook_code": """WITH n AS (SELECT DISTINCT file_id, module_key.id AS path, source FROM source_files WHERE lower(module_key.id) LIKE '%.ipynb')
        SELECT file_id, CASE WHEN json_valid(source) AND json_type(source, '$.cells') = 'ARRAY' THEN array_to_string(list_transform(list_filter(CAST(json_extract(source, '$.cells') AS JSON[]), lambda c: json_extract_string(c, '$.cell_type') = 'code'),
          lambda c: CASE WHEN json_type(c, '$.source') = 'ARRAY' THEN array_to_string(CAST(json_extract(c, '$.source') AS VARCHAR[]), '') ELSE coalesce(json_extract_string(c, '$.source'), '') END), chr(10) || chr(10)) END AS code FROM n""",
}
