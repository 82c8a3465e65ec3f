"""Extraction as table functions for SQL: SELECT * FROM files, LATERAL code_definitions(source)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from codeloom.extract import facts, parsing, scopes
from codeloom.operators import code
from codeloom.session import ship


def _table(make: Callable) -> type:
    class Rows:
        def eval(self, source: str) -> Iterator[tuple]:
            if source is not None:
                yield from make(parsing.parse_tolerant(source)[0])

    return Rows


FUNCTIONS = {
    "code_nodes": (facts.nodes, code.NODES), "code_definitions": (facts.definitions, code.DEFINITIONS), "code_imports": (facts.imports, code.IMPORTS), "code_uses": (facts.uses, code.USES),
    "code_parameters": (facts.parameters, code.PARAMETERS), "code_references": (facts.references, code.REFERENCES), "code_statements": (facts.statements, code.STATEMENTS), "code_closures": (scopes.closures, code.CLOSURES),
}


def register(spark: SparkSession) -> None:
    ship(spark)
    for name, (make, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(_table(make), returnType=schema.removeprefix("file_id bigint, ")))
