"""The operators on sources over a small code base written out here, whose facts are known: the SQL lists them.

SQL cannot parse sources, so the queries over all source files have none. These have: each gives, for the sources below, the rows that
case_answers lists. They take no table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import code, fixing, incremental
from codeloom.plans.case_answers import ANSWERS
from codeloom.sources import files as source_files
from codeloom.streaming import service

PROJECT = {
    "/c/app/__init__.py": "",
    "/c/app/shapes.py": 'LIMIT = 9\n\nclass Circle:\n    sides = 0\n\n    def area(self, r: float = 1.5):\n        return r * r\n\ndef make(*sizes, name, **more):\n    return Circle()\n',
    "/c/app/other.py": "Circle = 3\n",
    "/c/app/user.py": "import os\nimport json as j\n\nc = Circle()\nprint(c.sides, make(), j.dumps(LIMIT[0]))\n",
    "/c/app/star.py": "from .shapes import *\nfrom . import shapes as s, gone\n\nx = make(), Circle, s, lost\n",
    "/c/app/listed.py": "__all__ = ['shown', '_also']\nshown = _also = hidden = 1\n",
    "/c/lib/passed.py": "from app.shapes import LIMIT as most, make\nfrom lib.far import turn\n",
    "/c/lib/far.py": "from lib.passed import most\nfrom lib.passed import turn\nimport app.shapes\n\ntop = most\n",
    "/c/lib/nested.py": "def f(a):\n    b = 1\n    def g(c):\n        def h():\n            return a, b, c\n        return h\n    class K:\n        b = 2\n        def m(self):\n            return b, self\n    return g, [a for a in K]\n",
    "/c/lib/broken.py": "import os\n\ndef f(:\n    pass\n\ny = os\ntext = '''\none\ntwo\nthree\nfour\nfive\nsix\nseven\neight\nnine\nten\n'''\n",
    "/c/lib/values.py": "import sys\na = 1 if sys else 2\nb = [a, 'x']\nn = len(b)\nif n:\n    k = 10\nelse:\n    k = 'ten'\ndef add(p, q=2, *rest, **named):\n    return (p + q, rest, named)\nt = (3, 4, 5)\ns = add(*t)\nd = add(1, **{'q': 7, 'z': 8})\nu = add(*n)\nclass P:\n    z = 1\n    def get(self):\n        return self.z\nv = P().get()\nw = t[0] * 2 > 5 and not None\n",
}


def _files(spark: SparkSession) -> DataFrame:
    return source_files.from_strings(spark, PROJECT).withColumn("root", F.lit("/c"))


def _named(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows of df with the path of their file instead of its number."""
    return df.drop("path").join(_files(spark).select("file_id", "path"), "file_id").drop("file_id")


def case_nodes(spark, d):
    n = code.nodes(_files(spark)).filter("complete_name IS NOT NULL AND kind IN ('ClassDef', 'FunctionDef')")
    return _named(n, spark).select("path", "kind", "name", "complete_name", "depth", "lineno", F.array_join("above", ">").alias("above"))


def case_tree_lines(spark, d):
    return _named(code.pretty(code.nodes(_files(spark))), spark).filter("path LIKE '%/other.py'").select("node_id", "line")


def case_top_statements(spark, d):
    kinds = ["Import", "ImportFrom", "FunctionDef", "ClassDef"]
    return _named(code.descendants(code.nodes(_files(spark)), kinds, recursive=False), spark).select("path", "kind", "name", "lineno")


def case_without_functions(spark, d):
    left = code.without_kinds(code.nodes(_files(spark)), ["FunctionDef", "AsyncFunctionDef"])
    return _named(left, spark).filter("path LIKE '%/shapes.py'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def case_first_class(spark, d):
    return _named(code.first_of_kind(code.nodes(_files(spark)), "ClassDef"), spark).select("path", "name", "lineno")


def case_node_fields(spark, d):
    n = code.nodes(_files(spark)).filter("kind IN ('Constant', 'Name', 'ImportFrom')").select("kind", F.explode(F.map_keys("attrs")).alias("field")).distinct()
    return n.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


def case_attribute_paths(spark, d):
    n = code.nodes(_files(spark)).filter("kind = 'Attribute'")
    return _named(n, spark).select("path", "lineno", "name", F.try_element_at("attrs", F.lit("path")).alias("attribute"))


def case_definitions(spark, d):
    return _named(code.definitions(_files(spark)), spark)


def case_statistics(spark, d):
    return code.statistics(_files(spark)).drop("file_id").filter("path LIKE '%/shapes.py' OR path LIKE '%/nested.py'")


def case_members_by_kind(spark, d):
    return _named(code.members_by_kind(code.definitions(_files(spark))), spark)


def case_members(spark, d):
    return _named(code.members(_files(spark)), spark).filter("path LIKE '%/shapes.py' OR path LIKE '%/values.py' OR path LIKE '%/star.py'").select("path", "owner", "owner_kind", "name", "kind", "type", "value")


def case_imports(spark, d):
    f = _files(spark)
    found = code.resolved_imports(code.imports(f), f).join(f.select(F.col("file_id").alias("target_id"), F.col("path").alias("target")), "target_id", "left")
    return _named(found, spark).select("path", "module", "value", "bound", "target", "is_module")


def case_missing_symbols(spark, d):
    """By the facts put together in the worker, and by the relations over all uses; they must agree."""
    f = _files(spark)
    x = code.extract(f)
    each = code.missing_of(x).withColumn("way", F.lit("gaps")).drop("path").unionByName(code.missing_symbols(x.uses, code.resolved_imports(x.imports, x.files), x.exports).withColumn("way", F.lit("uses")))
    text = F.array_join(F.array_sort(F.transform("contexts", lambda c: F.concat_ws(":", c["kind"], c["attribute"], c["argc"].cast("string")))), " ")
    return _named(each.withColumn("contexts", text), spark).select("way", "path", "symbol", "contexts")


def case_unused_imports(spark, d):
    x = code.extract(_files(spark))
    cols = ["file_id", "bound"]
    each = code.unused_of(x).select(*cols, F.lit("facts").alias("way")).unionByName(code.unused_imports(x.imports, x.uses).select(*cols, F.lit("relations").alias("way")))
    return _named(each, spark)


def case_contexts(spark, d):
    text = F.array_join(F.transform("contexts", lambda c: F.concat_ws(":", c["kind"], c["attribute"], c["argc"].cast("string"))), " ")
    return _named(code.merged_contexts(code.uses(_files(spark))).withColumn("contexts", text), spark).filter("path LIKE '/c/app/%'").select("path", "symbol", "contexts")


def case_references(spark, d):
    return _named(code.references(_files(spark)), spark).filter("path LIKE '%/nested.py'").select("name", "resolved", "context", "lineno")


def case_parameters(spark, d):
    return _named(code.parameters(_files(spark)), spark).select("path", "function", "position", "name", "kind", "hint", "default")


def case_statements(spark, d):
    return _named(code.statements(_files(spark)), spark).filter("path LIKE '/c/app/%' AND kind <> 'FunctionDef'").select("path", "kind", "lineno", "code")


def case_closures(spark, d):
    return _named(code.closures(_files(spark)), spark)


def case_new_cells(spark, d):
    return _named(code.new_cells(code.closures(_files(spark))), spark)


def case_exports(spark, d):
    return _named(code.exports(_files(spark)), spark)


def case_name_counts(spark, d):
    return code.name_counts(_files(spark).filter("path LIKE '/c/app/%'"))


def case_values(spark, d):
    text = lambda c: F.array_join(c, "|", "?")
    return _named(code.values(_files(spark)), spark).filter("path LIKE '%/values.py'").select("name", "n_values", "ambiguous", text("kinds").alias("kinds"), text("types").alias("types"), text("texts").alias("texts"))


def case_values_across(spark, d):
    f = _files(spark)
    found = code.follow_imports(code.values(f), code.resolved_imports(code.imports(f), f))
    return _named(found, spark).filter("path LIKE '%/far.py' OR path LIKE '%/passed.py'").select("path", "name", F.array_join("kinds", "|").alias("kinds"), F.array_join("texts", "|", "?").alias("texts"))


def case_parse_failures(spark, d):
    return _named(code.parse_failures(_files(spark)), spark).select("path", "error_kind", "n_skipped_lines")


def _index(f: DataFrame) -> DataFrame:
    return fixing.with_import_counts(fixing.index_of_files(f), code.resolved_imports(code.imports(f), f))


def case_index(spark, d):
    index = _index(_files(spark))
    return index.select("symbol_name", F.col("module_key.id").alias("path"), "is_module_itself", "symbol_type", F.array_join(F.array_sort("members"), ",").alias("members"), "import_count")


def case_index_updated(spark, d):
    """case_index, reached from the index without two files, one of which is then new and one old in another wording, and one more that goes."""
    f = _files(spark)
    extra = spark.createDataFrame([(900, "/c/app/later.py", "from app.shapes import make, Circle\n", "/c"), (1, "/c/app/shapes.py", "make = 1\n", "/c")], f.schema)
    state = incremental.build(f.filter("path NOT IN ('/c/app/shapes.py', '/c/lib/values.py')").unionByName(extra))
    state = incremental.update(state, f.filter("path IN ('/c/app/shapes.py', '/c/lib/values.py')"), extra.filter("file_id = 900").select("file_id"))
    index = incremental.with_counts(state)
    return index.select("symbol_name", F.col("module_key.id").alias("path"), "is_module_itself", "symbol_type", F.array_join(F.array_sort("members"), ",").alias("members"), "import_count")


def case_fix_imports(spark, d):
    f = _files(spark)
    return fixing.fix_files(f, _index(f), location="/c").select("path", "new_source", F.size("edits").alias("n_edits"), "error").filter("n_edits > 0 OR error IS NOT NULL")


def case_service(spark, d):
    """Request lines answered end to end."""
    lines = [
        '{"request_id": 1, "command_id": "get_capabilities"}', '{"request_id": 2, "command_id": "fix_code_in_file", "source": "import os\\nmake()\\n", "filename": "/c/app/new.py"}', '{"request_id": 0, "command_id": "get_capabilities"}',
        '{"request_id": 3}', '{"request_id": 4, "command_id": "dance"}', '{"request_id": 5, "command_id": "fix_code_in_file", "source": "def (", "filename": "/c/x.py"}', "no json", '{"request_id": 6, "command_id": "fix_code_in_file", "source": "x = 1"}',
    ]
    got = service.answers(spark.createDataFrame([(x,) for x in lines], "value string"), _index(_files(spark)))
    r = F.col("response")
    return got.select("id", "result_code", F.get_json_object(r, "$.failure_reason").alias("failure"), F.get_json_object(r, "$.inserts[0].text").alias("inserted"), F.get_json_object(r, "$.deletions[0].line").alias("deleted_line"), F.get_json_object(r, "$.capabilities.get_capabilities.version").alias("version"))


QUERIES = {
    f.__name__: f
    for f in (
        case_nodes, case_tree_lines, case_top_statements, case_without_functions, case_first_class, case_node_fields, case_attribute_paths, case_definitions, case_statistics, case_members_by_kind, case_members, case_imports, case_missing_symbols, case_unused_imports, case_contexts,
        case_references, case_parameters, case_statements, case_closures, case_new_cells, case_exports, case_name_counts, case_values, case_values_across, case_parse_failures, case_index, case_index_updated, case_fix_imports, case_service,
    )
}

ORACLES = {name: ANSWERS[name] for name in QUERIES if name in ANSWERS}
