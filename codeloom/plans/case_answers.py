"""What the queries over the written-out code base must give: SQL that lists the rows.

The rows were listed once from a run and then checked one by one against the sources in case_queries and the rules of each operator.
"""


def _rows(columns: str, *rows: str) -> str:
    """columns: names with types; rows: values with commas between."""
    named = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f"CAST({n}_ AS {t}) AS {n}" for n, t in named)
    return f"SELECT {cast} FROM (VALUES ({'), ('.join(rows)})) AS t({', '.join(n + '_' for n, _ in named)})"


ANSWERS = {
    "case_nodes": _rows(
        "path VARCHAR, kind VARCHAR, name VARCHAR, complete_name VARCHAR, depth INTEGER, lineno INTEGER, above VARCHAR",
        "'/c/app/shapes.py', 'ClassDef', 'Circle', 'Circle', 1, 2, 'Module'",
        "'/c/app/shapes.py', 'FunctionDef', 'area', 'Circle.area', 2, 5, 'Module>ClassDef'",
        "'/c/app/shapes.py', 'FunctionDef', 'make', 'make', 1, 8, 'Module'",
        "'/c/lib/nested.py', 'ClassDef', 'K', 'f.K', 2, 6, 'Module>FunctionDef'",
        "'/c/lib/nested.py', 'FunctionDef', 'f', 'f', 1, 0, 'Module'",
        "'/c/lib/nested.py', 'FunctionDef', 'g', 'f.g', 2, 2, 'Module>FunctionDef'",
        "'/c/lib/nested.py', 'FunctionDef', 'h', 'f.g.h', 3, 3, 'Module>FunctionDef>FunctionDef'",
        "'/c/lib/nested.py', 'FunctionDef', 'm', 'f.K.m', 3, 8, 'Module>FunctionDef>ClassDef'",
        "'/c/lib/values.py', 'ClassDef', 'P', 'P', 1, 14, 'Module'",
        "'/c/lib/values.py', 'FunctionDef', 'add', 'add', 1, 8, 'Module'",
        "'/c/lib/values.py', 'FunctionDef', 'get', 'P.get', 2, 16, 'Module>ClassDef'",
    ),
    "case_tree_lines": _rows(
        "node_id INTEGER, line VARCHAR",
        "0, 'Module'",
        "1, '  Assign'",
        "2, '    Name Circle'",
        "3, '    Constant'",
    ),
    "case_top_statements": _rows(
        "path VARCHAR, kind VARCHAR, name VARCHAR, lineno INTEGER",
        "'/c/app/shapes.py', 'ClassDef', 'Circle', 2",
        "'/c/app/shapes.py', 'FunctionDef', 'make', 8",
        "'/c/app/star.py', 'ImportFrom', NULL, 0",
        "'/c/app/star.py', 'ImportFrom', NULL, 1",
        "'/c/app/user.py', 'Import', NULL, 0",
        "'/c/app/user.py', 'Import', NULL, 1",
        "'/c/lib/broken.py', 'Import', NULL, 0",
        "'/c/lib/far.py', 'Import', NULL, 2",
        "'/c/lib/far.py', 'ImportFrom', NULL, 0",
        "'/c/lib/far.py', 'ImportFrom', NULL, 1",
        "'/c/lib/nested.py', 'FunctionDef', 'f', 0",
        "'/c/lib/passed.py', 'ImportFrom', NULL, 0",
        "'/c/lib/passed.py', 'ImportFrom', NULL, 1",
        "'/c/lib/values.py', 'ClassDef', 'P', 14",
        "'/c/lib/values.py', 'FunctionDef', 'add', 8",
        "'/c/lib/values.py', 'Import', NULL, 0",
    ),
    "case_without_functions": _rows(
        "kind VARCHAR, n BIGINT",
        "'Assign', 2",
        "'ClassDef', 1",
        "'Constant', 2",
        "'Module', 1",
        "'Name', 2",
    ),
    "case_first_class": _rows(
        "path VARCHAR, name VARCHAR, lineno INTEGER",
        "'/c/app/shapes.py', 'Circle', 2",
        "'/c/lib/nested.py', 'K', 6",
        "'/c/lib/values.py', 'P', 14",
    ),
    "case_node_fields": _rows(
        "kind VARCHAR, fields VARCHAR",
        "'Constant', 'value'",
        "'ImportFrom', 'level,module'",
        "'Name', 'id'",
    ),
    "case_attribute_paths": _rows(
        "path VARCHAR, lineno INTEGER, name VARCHAR, attribute VARCHAR",
        "'/c/app/user.py', 4, 'sides', 'c.sides'",
        "'/c/app/user.py', 4, 'dumps', 'j.dumps'",
        "'/c/lib/values.py', 17, 'z', 'self.z'",
        "'/c/lib/values.py', 18, 'get', NULL",
    ),
    "case_definitions": _rows(
        "scope VARCHAR, name VARCHAR, symbol_type INTEGER, lineno INTEGER, path VARCHAR",
        "'', 'Circle', 0, 2, '/c/app/shapes.py'",
        "'', 'Circle', 2, 0, '/c/app/other.py'",
        "'', 'LIMIT', 2, 0, '/c/app/shapes.py'",
        "'', 'P', 0, 14, '/c/lib/values.py'",
        "'', '__all__', 2, 0, '/c/app/listed.py'",
        "'', '_also', 2, 1, '/c/app/listed.py'",
        "'', 'a', 2, 1, '/c/lib/values.py'",
        "'', 'add', 1, 8, '/c/lib/values.py'",
        "'', 'b', 2, 2, '/c/lib/values.py'",
        "'', 'c', 2, 3, '/c/app/user.py'",
        "'', 'd', 2, 12, '/c/lib/values.py'",
        "'', 'f', 1, 0, '/c/lib/nested.py'",
        "'', 'hidden', 2, 1, '/c/app/listed.py'",
        "'', 'k', 2, 5, '/c/lib/values.py'",
        "'', 'k', 2, 7, '/c/lib/values.py'",
        "'', 'make', 1, 8, '/c/app/shapes.py'",
        "'', 'n', 2, 3, '/c/lib/values.py'",
        "'', 's', 2, 11, '/c/lib/values.py'",
        "'', 'shown', 2, 1, '/c/app/listed.py'",
        "'', 't', 2, 10, '/c/lib/values.py'",
        "'', 'text', 2, 6, '/c/lib/broken.py'",
        "'', 'top', 2, 4, '/c/lib/far.py'",
        "'', 'u', 2, 13, '/c/lib/values.py'",
        "'', 'v', 2, 18, '/c/lib/values.py'",
        "'', 'w', 2, 19, '/c/lib/values.py'",
        "'', 'x', 2, 3, '/c/app/star.py'",
        "'', 'y', 2, 5, '/c/lib/broken.py'",
        "'Circle', 'area', 1, 5, '/c/app/shapes.py'",
        "'Circle', 'sides', 2, 3, '/c/app/shapes.py'",
        "'P', 'get', 1, 16, '/c/lib/values.py'",
        "'P', 'z', 2, 15, '/c/lib/values.py'",
        "'f', 'K', 0, 6, '/c/lib/nested.py'",
        "'f', 'b', 2, 1, '/c/lib/nested.py'",
        "'f', 'g', 1, 2, '/c/lib/nested.py'",
        "'f.K', 'b', 2, 7, '/c/lib/nested.py'",
        "'f.K', 'm', 1, 8, '/c/lib/nested.py'",
        "'f.g', 'h', 1, 3, '/c/lib/nested.py'",
    ),
    "case_statistics": _rows(
        "path VARCHAR, position INTEGER, symbol_type INTEGER, name VARCHAR, complete_name VARCHAR, lineno INTEGER, code VARCHAR",
        "'/c/app/shapes.py', 0, 2, 'LIMIT', 'LIMIT', 0, 'LIMIT = 9'",
        "'/c/app/shapes.py', 1, 0, 'Circle', 'Circle', 2, 'class Circle:'",
        "'/c/app/shapes.py', 2, 2, 'sides', 'Circle.sides', 3, 'sides = 0'",
        "'/c/app/shapes.py', 3, 1, 'area', 'Circle.area', 5, 'def area(self, r: float = 1.5):'",
        "'/c/app/shapes.py', 4, 1, 'make', 'make', 8, 'def make(*sizes, name, **more):'",
        "'/c/lib/nested.py', 0, 1, 'f', 'f', 0, 'def f(a):'",
        "'/c/lib/nested.py', 1, 2, 'b', 'f.b', 1, 'b = 1'",
        "'/c/lib/nested.py', 2, 1, 'g', 'f.g', 2, 'def g(c):'",
        "'/c/lib/nested.py', 3, 1, 'h', 'f.g.h', 3, 'def h():'",
        "'/c/lib/nested.py', 4, 0, 'K', 'f.K', 6, 'class K:'",
        "'/c/lib/nested.py', 5, 2, 'b', 'f.K.b', 7, 'b = 2'",
        "'/c/lib/nested.py', 6, 1, 'm', 'f.K.m', 8, 'def m(self):'",
    ),
    "case_members_by_kind": _rows(
        "scope VARCHAR, classes BIGINT, functions BIGINT, assignments BIGINT, path VARCHAR",
        "'', 0, 0, 1, '/c/app/other.py'",
        "'', 0, 0, 1, '/c/app/star.py'",
        "'', 0, 0, 1, '/c/app/user.py'",
        "'', 0, 0, 1, '/c/lib/far.py'",
        "'', 0, 0, 2, '/c/lib/broken.py'",
        "'', 0, 0, 4, '/c/app/listed.py'",
        "'', 0, 1, 0, '/c/lib/nested.py'",
        "'', 1, 1, 1, '/c/app/shapes.py'",
        "'', 1, 1, 11, '/c/lib/values.py'",
        "'Circle', 0, 1, 1, '/c/app/shapes.py'",
        "'P', 0, 1, 1, '/c/lib/values.py'",
        "'f', 1, 1, 1, '/c/lib/nested.py'",
        "'f.K', 0, 1, 1, '/c/lib/nested.py'",
        "'f.g', 0, 1, 0, '/c/lib/nested.py'",
    ),
    "case_members": _rows(
        "path VARCHAR, owner VARCHAR, owner_kind VARCHAR, name VARCHAR, kind VARCHAR, type VARCHAR, value VARCHAR",
        "'/c/app/shapes.py', '', 'module', 'Circle', 'class', 'type', 'Circle'",
        "'/c/app/shapes.py', '', 'module', 'LIMIT', 'native', 'int', '9'",
        "'/c/app/shapes.py', '', 'module', 'make', 'function', 'function', 'make'",
        "'/c/app/shapes.py', 'Circle', 'class', 'area', 'function', 'function', 'area'",
        "'/c/app/shapes.py', 'Circle', 'class', 'sides', 'native', 'int', '0'",
        "'/c/app/star.py', '', 'module', 'gone', 'unknown', NULL, NULL",
        "'/c/app/star.py', '', 'module', 's', 'unknown', NULL, NULL",
        "'/c/app/star.py', '', 'module', 'x', 'instance', 'tuple', 'tuple'",
        "'/c/app/star.py', 'tuple', 'instance', '[0]', 'unknown', NULL, NULL",
        "'/c/app/star.py', 'tuple', 'instance', '[1]', 'unknown', NULL, NULL",
        "'/c/app/star.py', 'tuple', 'instance', '[2]', 'unknown', NULL, NULL",
        "'/c/app/star.py', 'tuple', 'instance', '[3]', 'unknown', NULL, NULL",
        "'/c/lib/values.py', '', 'module', 'P', 'class', 'type', 'P'",
        "'/c/lib/values.py', '', 'module', 'a', 'native', 'int', '1'",
        "'/c/lib/values.py', '', 'module', 'a', 'native', 'int', '2'",
        "'/c/lib/values.py', '', 'module', 'add', 'function', 'function', 'add'",
        "'/c/lib/values.py', '', 'module', 'b', 'instance', 'list', 'list'",
        "'/c/lib/values.py', '', 'module', 'd', 'native', 'tuple', '(8, (), {''z'': 8})'",
        "'/c/lib/values.py', '', 'module', 'k', 'native', 'int', '10'",
        "'/c/lib/values.py', '', 'module', 'k', 'native', 'str', '''ten'''",
        "'/c/lib/values.py', '', 'module', 'n', 'unknown', NULL, NULL",
        "'/c/lib/values.py', '', 'module', 's', 'native', 'tuple', '(7, (5,), {})'",
        "'/c/lib/values.py', '', 'module', 'sys', 'module', 'module', 'sys'",
        "'/c/lib/values.py', '', 'module', 't', 'native', 'tuple', '(3, 4, 5)'",
        "'/c/lib/values.py', '', 'module', 'u', 'instance', 'tuple', 'tuple'",
        "'/c/lib/values.py', '', 'module', 'v', 'native', 'int', '1'",
        "'/c/lib/values.py', '', 'module', 'w', 'native', 'bool', 'True'",
        "'/c/lib/values.py', 'P', 'class', 'get', 'function', 'function', 'get'",
        "'/c/lib/values.py', 'P', 'class', 'z', 'native', 'int', '1'",
        "'/c/lib/values.py', 'list', 'instance', '[0]', 'native', 'int', '1'",
        "'/c/lib/values.py', 'list', 'instance', '[0]', 'native', 'int', '2'",
        "'/c/lib/values.py', 'list', 'instance', '[1]', 'native', 'str', '''x'''",
        "'/c/lib/values.py', 'tuple', 'instance', '[0]', 'unknown', NULL, NULL",
        "'/c/lib/values.py', 'tuple', 'instance', '[1]', 'instance', 'tuple', 'tuple'",
        "'/c/lib/values.py', 'tuple', 'instance', '[2]', 'native', 'dict', '{}'",
    ),
    "case_imports": _rows(
        "path VARCHAR, module VARCHAR, value VARCHAR, bound VARCHAR, target VARCHAR, is_module BOOLEAN",
        "'/c/app/star.py', '.', 'gone', 'gone', '/c/app/__init__.py', false",
        "'/c/app/star.py', '.', 'shapes', 's', '/c/app/shapes.py', true",
        "'/c/app/star.py', '.shapes', '*', '*', '/c/app/shapes.py', false",
        "'/c/app/user.py', 'json', NULL, 'j', NULL, NULL",
        "'/c/app/user.py', 'os', NULL, 'os', NULL, NULL",
        "'/c/lib/broken.py', 'os', NULL, 'os', NULL, NULL",
        "'/c/lib/far.py', 'app.shapes', NULL, 'app', '/c/app/shapes.py', false",
        "'/c/lib/far.py', 'lib.passed', 'most', 'most', '/c/lib/passed.py', false",
        "'/c/lib/far.py', 'lib.passed', 'turn', 'turn', '/c/lib/passed.py', false",
        "'/c/lib/passed.py', 'app.shapes', 'LIMIT', 'most', '/c/app/shapes.py', false",
        "'/c/lib/passed.py', 'app.shapes', 'make', 'make', '/c/app/shapes.py', false",
        "'/c/lib/passed.py', 'lib.far', 'turn', 'turn', '/c/lib/far.py', false",
        "'/c/lib/values.py', 'sys', NULL, 'sys', NULL, NULL",
    ),
    "case_missing_symbols": _rows(
        "way VARCHAR, path VARCHAR, symbol VARCHAR, contexts VARCHAR",
        "'gaps', '/c/app/star.py', 'lost', 'raw::0'",
        "'gaps', '/c/app/user.py', 'Circle', 'call::0'",
        "'gaps', '/c/app/user.py', 'LIMIT', 'subscript::0'",
        "'gaps', '/c/app/user.py', 'make', 'call::0'",
        "'uses', '/c/app/star.py', 'lost', 'raw::0'",
        "'uses', '/c/app/user.py', 'Circle', 'call::0'",
        "'uses', '/c/app/user.py', 'LIMIT', 'subscript::0'",
        "'uses', '/c/app/user.py', 'make', 'call::0'",
    ),
    "case_unused_imports": _rows(
        "bound VARCHAR, way VARCHAR, path VARCHAR",
        "'app', 'facts', '/c/lib/far.py'",
        "'app', 'relations', '/c/lib/far.py'",
        "'gone', 'facts', '/c/app/star.py'",
        "'gone', 'relations', '/c/app/star.py'",
        "'make', 'facts', '/c/lib/passed.py'",
        "'make', 'relations', '/c/lib/passed.py'",
        "'most', 'facts', '/c/lib/passed.py'",
        "'most', 'relations', '/c/lib/passed.py'",
        "'os', 'facts', '/c/app/user.py'",
        "'os', 'relations', '/c/app/user.py'",
        "'turn', 'facts', '/c/lib/far.py'",
        "'turn', 'facts', '/c/lib/passed.py'",
        "'turn', 'relations', '/c/lib/far.py'",
        "'turn', 'relations', '/c/lib/passed.py'",
    ),
    "case_contexts": _rows(
        "path VARCHAR, symbol VARCHAR, contexts VARCHAR",
        "'/c/app/star.py', 'Circle', 'raw::0'",
        "'/c/app/star.py', 'lost', 'raw::0'",
        "'/c/app/star.py', 'make', 'call::0'",
        "'/c/app/star.py', 's', 'raw::0'",
        "'/c/app/user.py', 'Circle', 'call::0'",
        "'/c/app/user.py', 'LIMIT', 'subscript::0'",
        "'/c/app/user.py', 'j', 'attribute:dumps:0'",
        "'/c/app/user.py', 'make', 'call::0'",
    ),
    "case_references": _rows(
        "name VARCHAR, resolved VARCHAR, context VARCHAR, lineno INTEGER",
        "'K', 'f.K', 'f', 10",
        "'a', 'f.a', 'f', 10",
        "'a', 'f.a', 'f.g.h', 4",
        "'b', 'f.b', 'f.K.m', 9",
        "'b', 'f.b', 'f.g.h', 4",
        "'c', 'f.g.c', 'f.g.h', 4",
        "'g', 'f.g', 'f', 10",
        "'h', 'f.g.h', 'f.g', 5",
        "'self', 'f.K.m.self', 'f.K.m', 9",
    ),
    "case_parameters": _rows(
        "path VARCHAR, function VARCHAR, position INTEGER, name VARCHAR, kind VARCHAR, hint VARCHAR, default VARCHAR",
        "'/c/app/shapes.py', 'Circle.area', 0, 'self', 'single', NULL, NULL",
        "'/c/app/shapes.py', 'Circle.area', 1, 'r', 'single', 'float', '1.5'",
        "'/c/app/shapes.py', 'make', 0, 'sizes', 'args', NULL, NULL",
        "'/c/app/shapes.py', 'make', 1, 'name', 'single', NULL, NULL",
        "'/c/app/shapes.py', 'make', 2, 'more', 'kwargs', NULL, NULL",
        "'/c/lib/nested.py', 'f', 0, 'a', 'single', NULL, NULL",
        "'/c/lib/nested.py', 'f.K.m', 0, 'self', 'single', NULL, NULL",
        "'/c/lib/nested.py', 'f.g', 0, 'c', 'single', NULL, NULL",
        "'/c/lib/values.py', 'P.get', 0, 'self', 'single', NULL, NULL",
        "'/c/lib/values.py', 'add', 0, 'p', 'single', NULL, NULL",
        "'/c/lib/values.py', 'add', 1, 'q', 'single', NULL, '2'",
        "'/c/lib/values.py', 'add', 2, 'rest', 'args', NULL, NULL",
        "'/c/lib/values.py', 'add', 3, 'named', 'kwargs', NULL, NULL",
    ),
    "case_statements": _rows(
        "path VARCHAR, kind VARCHAR, lineno INTEGER, code VARCHAR",
        "'/c/app/listed.py', 'Assign', 0, '__all__ = [''shown'', ''_also'']'",
        "'/c/app/listed.py', 'Assign', 1, 'shown = _also = hidden = 1'",
        "'/c/app/other.py', 'Assign', 0, 'Circle = 3'",
        "'/c/app/shapes.py', 'Assign', 0, 'LIMIT = 9'",
        "'/c/app/shapes.py', 'Assign', 3, 'sides = 0'",
        "'/c/app/star.py', 'Assign', 3, 'x = (make(), Circle, s, lost)'",
        "'/c/app/star.py', 'ImportFrom', 0, 'from .shapes import *'",
        "'/c/app/star.py', 'ImportFrom', 1, 'from . import shapes as s, gone'",
        "'/c/app/user.py', 'Assign', 3, 'c = Circle()'",
        "'/c/app/user.py', 'Expr', 4, 'print(c.sides, make(), j.dumps(LIMIT[0]))'",
        "'/c/app/user.py', 'Import', 0, 'import os'",
        "'/c/app/user.py', 'Import', 1, 'import json as j'",
    ),
    "case_closures": _rows(
        "function VARCHAR, symbol VARCHAR, around VARCHAR, path VARCHAR",
        "'f.K.m', 'b', 'f', '/c/lib/nested.py'",
        "'f.g', 'a', 'f', '/c/lib/nested.py'",
        "'f.g', 'b', 'f', '/c/lib/nested.py'",
        "'f.g.h', 'a', 'f.g', '/c/lib/nested.py'",
        "'f.g.h', 'b', 'f.g', '/c/lib/nested.py'",
        "'f.g.h', 'c', 'f.g', '/c/lib/nested.py'",
    ),
    "case_new_cells": _rows(
        "function VARCHAR, symbol VARCHAR, path VARCHAR",
        "'f', 'a', '/c/lib/nested.py'",
        "'f', 'b', '/c/lib/nested.py'",
        "'f.g', 'c', '/c/lib/nested.py'",
    ),
    "case_exports": _rows(
        "symbol VARCHAR, path VARCHAR",
        "'Circle', '/c/app/other.py'",
        "'Circle', '/c/app/shapes.py'",
        "'LIMIT', '/c/app/shapes.py'",
        "'P', '/c/lib/values.py'",
        "'_also', '/c/app/listed.py'",
        "'a', '/c/lib/values.py'",
        "'add', '/c/lib/values.py'",
        "'app', '/c/lib/far.py'",
        "'b', '/c/lib/values.py'",
        "'c', '/c/app/user.py'",
        "'d', '/c/lib/values.py'",
        "'f', '/c/lib/nested.py'",
        "'gone', '/c/app/star.py'",
        "'j', '/c/app/user.py'",
        "'k', '/c/lib/values.py'",
        "'make', '/c/app/shapes.py'",
        "'make', '/c/lib/passed.py'",
        "'most', '/c/lib/far.py'",
        "'most', '/c/lib/passed.py'",
        "'n', '/c/lib/values.py'",
        "'os', '/c/app/user.py'",
        "'os', '/c/lib/broken.py'",
        "'s', '/c/app/star.py'",
        "'s', '/c/lib/values.py'",
        "'shown', '/c/app/listed.py'",
        "'sys', '/c/lib/values.py'",
        "'t', '/c/lib/values.py'",
        "'text', '/c/lib/broken.py'",
        "'top', '/c/lib/far.py'",
        "'turn', '/c/lib/far.py'",
        "'turn', '/c/lib/passed.py'",
        "'u', '/c/lib/values.py'",
        "'v', '/c/lib/values.py'",
        "'w', '/c/lib/values.py'",
        "'x', '/c/app/star.py'",
        "'y', '/c/lib/broken.py'",
    ),
    "case_name_counts": _rows(
        "term VARCHAR, value BIGINT",
        "'Circle', 5",
        "'LIMIT', 2",
        "'__all__', 1",
        "'_also', 1",
        "'area', 1",
        "'as', 2",
        "'c', 2",
        "'class', 1",
        "'def', 2",
        "'dumps', 1",
        "'float', 1",
        "'from', 2",
        "'gone', 1",
        "'hidden', 1",
        "'import', 4",
        "'j', 2",
        "'json', 1",
        "'lost', 1",
        "'make', 3",
        "'more', 1",
        "'name', 1",
        "'os', 1",
        "'print', 1",
        "'r', 3",
        "'return', 2",
        "'s', 2",
        "'self', 1",
        "'shapes', 2",
        "'shown', 1",
        "'sides', 2",
        "'sizes', 1",
        "'x', 1",
    ),
    "case_values": _rows(
        "name VARCHAR, n_values INTEGER, ambiguous BOOLEAN, kinds VARCHAR, types VARCHAR, texts VARCHAR",
        "'P', 1, false, 'class', 'type', 'P'",
        "'a', 2, true, 'native|native', 'int|int', '1|2'",
        "'add', 1, false, 'function', 'function', 'add'",
        "'b', 1, false, 'instance', 'list', 'list'",
        "'d', 1, false, 'native', 'tuple', '(8, (), {''z'': 8})'",
        "'k', 2, true, 'native|native', 'int|str', '10|''ten'''",
        "'n', 1, false, 'unknown', '?', '?'",
        "'s', 1, false, 'native', 'tuple', '(7, (5,), {})'",
        "'sys', 1, false, 'module', 'module', 'sys'",
        "'t', 1, false, 'native', 'tuple', '(3, 4, 5)'",
        "'u', 1, false, 'instance', 'tuple', 'tuple'",
        "'v', 1, false, 'native', 'int', '1'",
        "'w', 1, false, 'native', 'bool', 'True'",
    ),
    "case_values_across": _rows(
        "path VARCHAR, name VARCHAR, kinds VARCHAR, texts VARCHAR",
        "'/c/lib/far.py', 'app', 'module', 'app'",
        "'/c/lib/far.py', 'most', 'native', '9'",
        "'/c/lib/far.py', 'top', 'unknown', '?'",
        "'/c/lib/far.py', 'turn', 'unknown', '?'",
        "'/c/lib/passed.py', 'make', 'function', 'make'",
        "'/c/lib/passed.py', 'most', 'native', '9'",
        "'/c/lib/passed.py', 'turn', 'unknown', '?'",
    ),
    "case_parse_failures": _rows(
        "path VARCHAR, error_kind VARCHAR, n_skipped_lines INTEGER",
        "'/c/lib/broken.py', 'SyntaxError', 3",
    ),
    "case_index": _rows(
        "symbol_name VARCHAR, path VARCHAR, is_module_itself BOOLEAN, symbol_type INTEGER, members VARCHAR, import_count BIGINT",
        "'Circle', '/c/app/other.py', false, 2, '', 0",
        "'Circle', '/c/app/shapes.py', false, 0, 'area,sides', 0",
        "'LIMIT', '/c/app/shapes.py', false, 2, '', 1",
        "'P', '/c/lib/values.py', false, 0, 'get,z', 0",
        "'__all__', '/c/app/listed.py', false, 2, '', 0",
        "'_also', '/c/app/listed.py', false, 2, '', 0",
        "'a', '/c/lib/values.py', false, 2, '', 0",
        "'add', '/c/lib/values.py', false, 1, '', 0",
        "'app', '/c/app/__init__.py', true, 3, '', 0",
        "'b', '/c/lib/values.py', false, 2, '', 0",
        "'broken', '/c/lib/broken.py', true, 3, 'text,y', 0",
        "'c', '/c/app/user.py', false, 2, '', 0",
        "'d', '/c/lib/values.py', false, 2, '', 0",
        "'f', '/c/lib/nested.py', false, 1, 'K,b,g', 0",
        "'far', '/c/lib/far.py', true, 3, 'top', 0",
        "'hidden', '/c/app/listed.py', false, 2, '', 0",
        "'k', '/c/lib/values.py', false, 2, '', 0",
        "'listed', '/c/app/listed.py', true, 3, '__all__,_also,hidden,shown', 0",
        "'make', '/c/app/shapes.py', false, 1, '', 1",
        "'n', '/c/lib/values.py', false, 2, '', 0",
        "'nested', '/c/lib/nested.py', true, 3, 'f', 0",
        "'other', '/c/app/other.py', true, 3, 'Circle', 0",
        "'passed', '/c/lib/passed.py', true, 3, '', 0",
        "'s', '/c/lib/values.py', false, 2, '', 0",
        "'shapes', '/c/app/shapes.py', true, 3, 'Circle,LIMIT,make', 2",
        "'shown', '/c/app/listed.py', false, 2, '', 0",
        "'star', '/c/app/star.py', true, 3, 'x', 0",
        "'t', '/c/lib/values.py', false, 2, '', 0",
        "'text', '/c/lib/broken.py', false, 2, '', 0",
        "'top', '/c/lib/far.py', false, 2, '', 0",
        "'u', '/c/lib/values.py', false, 2, '', 0",
        "'user', '/c/app/user.py', true, 3, 'c', 0",
        "'v', '/c/lib/values.py', false, 2, '', 0",
        "'values', '/c/lib/values.py', true, 3, 'P,a,add,b,d,k,n,s,t,u,v,w', 0",
        "'w', '/c/lib/values.py', false, 2, '', 0",
        "'x', '/c/app/star.py', false, 2, '', 0",
        "'y', '/c/lib/broken.py', false, 2, '', 0",
    ),
    "case_fix_imports": _rows(
        "path VARCHAR, new_source VARCHAR, n_edits INTEGER, error VARCHAR",
        "'/c/app/star.py', 'from .shapes import *' || chr(10) || 'from . import shapes as s' || chr(10) || '' || chr(10) || 'x = make(), Circle, s, lost' || chr(10) || '', 1, NULL",
        "'/c/app/user.py', 'import json as j' || chr(10) || 'from .shapes import (Circle, LIMIT, make)' || chr(10) || '' || chr(10) || 'c = Circle()' || chr(10) || 'print(c.sides, make(), j.dumps(LIMIT[0]))' || chr(10) || '', 2, NULL",
        "'/c/lib/broken.py', 'import os' || chr(10) || '' || chr(10) || 'def f(:' || chr(10) || '    pass' || chr(10) || '' || chr(10) || 'y = os' || chr(10) || 'text = ''''''' || chr(10) || 'one' || chr(10) || 'two' || chr(10) || 'three' || chr(10) || 'four' || chr(10) || 'five' || chr(10) || 'six' || chr(10) || 'seven' || chr(10) || 'eight' || chr(10) || 'nine' || chr(10) || 'ten' || chr(10) || '''''''' || chr(10) || '', 0, 'SyntaxError: invalid syntax (<unknown>, line 3)'",
        "'/c/lib/far.py', 'from lib.passed import most' || chr(10) || '' || chr(10) || 'top = most' || chr(10) || '', 2, NULL",
        "'/c/lib/passed.py', '', 2, NULL",
    ),
    "case_service": _rows(
        "id VARCHAR, result_code INTEGER, failure VARCHAR, inserted VARCHAR, deleted_line VARCHAR, version VARCHAR",
        "'-1', 1, 'Not a JSON object', NULL, NULL, NULL",
        "'0', 1, 'Empty request id', NULL, NULL, NULL",
        "'1', 0, NULL, NULL, NULL, '0.1'",
        "'2', 0, NULL, 'from .shapes import make' || chr(10) || '', '0', NULL",
        "'3', 1, 'Invalid command_id', NULL, NULL, NULL",
        "'4', 1, '\"dance\" is not a valid command_id.', NULL, NULL, NULL",
        "'5', 1, 'SyntaxError: invalid syntax (<unknown>, line 1)', NULL, NULL, NULL",
        "'6', 1, 'source and filename are needed', NULL, NULL, NULL",
    ),
}

ANSWERS["case_index_updated"] = ANSWERS["case_index"]
