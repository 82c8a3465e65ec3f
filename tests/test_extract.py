"""Scope rules, facts, edits and evaluation on small sources written for the purpose."""

import ast
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.extract import edits, evaluate, facts, parsing, scopes
from codeloom.operators import code

MISSING = [
    ("x = y", {"y"}), ("print(y)\ny = 1", set()), ("import os\nos.path", set()), ("from a import b as c\nb, c", {"b"}), ("for i in seq:\n    i, j", {"seq", "j"}),
    ("with open(p) as f:\n    f.read()", {"p"}), ("try:\n    a()\nexcept E as e:\n    e\nfinally:\n    z", {"a", "E", "z"}), ("def f(a, *b, c=d, **e):\n    return a, b, c, e, g", {"d", "g"}),
    ("class C(B, metaclass=M):\n    k = 1\n    def m(self):\n        return k\n    n = k", {"B", "M", "k"}), ("@deco(1)\ndef f() -> T: pass", {"deco", "T"}), ("[a for a in b if c]", {"b", "c"}),
    ("{k: v}", {"k", "v"}), ("lambda x, y=z: x + y + w", {"z", "w"}), ("a.b = 1\na.c", set()), ("if (n := f()):\n    n", {"f"}), ("match p:\n    case {'k': v, **r} if v:\n        r\n    case D(q):\n        q, u", {"p", "D", "u"}),
    ("async def f():\n    async with c() as d:\n        await d", {"c"}), ("__name__, __file__, len, xrange", set()), ("type A[T] = list[T] | B", {"B"}), ("def f[T](x: T) -> T:\n    return g(x)", {"g"}), ("x: Hint = 1", {"Hint"}),
    ("a < b < c", {"a", "b", "c"}), ("def f():\n    global g\n    g = 1", set()), ("f'{a!r:{b}}'", {"a", "b"}), ("x += y", {"y"}),
]


@pytest.mark.parametrize(("source", "want"), MISSING)
def test_missing(source, want):
    assert set(scopes.missing(ast.parse(source))) == want


def test_contexts():
    got = scopes.missing(ast.parse("a(1, k=2)\na.x\nb[0]\nc\na"))
    assert got["a"] == {scopes.Use("call", argc=2), scopes.Use("attribute", "x"), scopes.Use("raw")}
    assert got["b"] == {scopes.Use("subscript")} and got["c"] == {scopes.Use("raw")}


def test_strip_imports():
    tree = ast.parse("import os\nfrom a import b\nif x:\n    import re\nos, b, re, q, x")
    assert set(scopes.missing(tree, strip_imports=True)) == {"os", "b", "re", "q", "x"}
    assert set(scopes.missing(tree)) == {"q", "x"}


@pytest.mark.parametrize("source", [s for s, _ in MISSING] + ["if a:\n    b = (c := 1)\nelif d:\n    for e in f: pass\n    else: g = 1\ntry:\n    h = 1\nexcept X as y:\n    i = 1\nelse:\n    j = 1\nfinally:\n    k = lambda: (l := 1)"])
def test_defined_is_what_a_block_defines(source):
    tree = ast.parse(source)
    assert scopes.defined(tree.body) == scopes.Scoper().group(tree.body).defs


def test_exports_and_closures():
    assert scopes.exports(ast.parse("a = 1\n_b = 2\ndef c(): d = 1\nfrom m import *")) == {"a", "c"}
    assert scopes.exports(ast.parse("__all__ = ['x', '_y']\nz = 1")) == {"x", "_y"}
    source = "def f(a):\n    b = 1\n    def g(c):\n        def h():\n            return a, b, c, d\n        return h\n    return g"
    assert set(scopes.closures(ast.parse(source))) == {("f.g", "a", "f"), ("f.g", "b", "f"), ("f.g.h", "a", "f.g"), ("f.g.h", "b", "f.g"), ("f.g.h", "c", "f.g")}


def test_tolerant_parse_keeps_places():
    tree, bad, error = parsing.parse_tolerant("a = 1\ndef f(:\n    pass\n\nclass C:\n    x = [1,\n2]\nif b:\n    c = 1\nelse:\n    d = 2\ne = (\n")
    assert [type(s).__name__ for s in tree.body] == ["Assign", "ClassDef", "If"]
    assert tree.body[1].lineno == 5 and bad[0][0] == 2 and error.startswith("SyntaxError")
    assert parsing.parse_tolerant("x = 1")[1:] == ([], None)


FAR = [
    ("s = " + q * 3 + "\n" + "".join(f"line {n} isn't \\" + q * 3 + " it (\n" for n in range(30)) + q * 3, ["Assign"]) for q in "\"'"
] + [
    ("if q == 0:\n    x = 0\n" + "".join(f"elif q == {n}:\n    x = '#('\n" for n in range(20)) + "else:\n    y = 1", ["If"]),
    ("try:\n    a()\n" + "".join(f"except E{n}:\n    pass  # (\n" for n in range(20)) + "finally:\n    b()", ["Try"]),
    ("d = [\n" + "".join(f"{n}, '[',\n" for n in range(30)) + "]", ["Assign"]), ("".join(f"@d{n}(\n1)\n" for n in range(20)) + "def g(): pass", ["FunctionDef"]), ("v = 1 + \\\n" + "2 + \\\n" * 20 + "3", ["Assign"]),
    ("s = 'a\\\n" + "b (\\\n" * 20 + "c'", ["Assign"]), ("def f():\n    " + '"""Text.\n' + "Column 0.\n" * 20 + '    """', ["FunctionDef"]),
]


@pytest.mark.parametrize(("statement", "kinds"), FAR)
def test_tolerant_parse_of_long_statements(statement, kinds):
    assert [type(s).__name__ for s in ast.parse(statement).body] == kinds
    tree, bad, _ = parsing.parse_tolerant(f"import a\ndef f(:\n    pass\n{statement}\nimport z\n" + 't = """doc"""\n')
    assert [type(s).__name__ for s in tree.body] == ["Import", *kinds, "Import", "Assign"]
    assert bad == [(2, 3)]


@pytest.mark.parametrize("line", ["x = (", "@a", "if q:", "else:", 's = """', "f(a,", "b'", "x = [1, \\", "'a\\"])
def test_tolerant_parse_ends_soon(line):
    began = time.time()
    parsing.parse_tolerant("def f(:\n" + f"{line}\n" * 1000)
    assert time.time() - began < 10


def test_definitions_and_imports():
    tree = ast.parse("import a.b as c, d.e\nfrom ..m import x as y; from ..m import *\nclass K:\n    z = 1\n    def m(self): w = 2\nif 1:\n    v = 3\n    import q\nfor i in r: u = 1")
    assert set(facts.definitions(tree)) == {
        ("", "K", 0, 2), ("K", "z", 2, 3), ("K", "m", 1, 4), ("K.m", "w", 2, 4), ("", "v", 2, 6), ("", "i", 2, 8), ("", "u", 2, 8),
    }
    assert list(facts.imports(tree)) == [
        ("import", "a.b", None, "c", "c", True, 0, 0), ("import", "d.e", None, None, "d", True, 0, 0), ("from", "..m", "x", "y", "y", True, 1, 1), ("from", "..m", "*", None, "*", True, 1, 1), ("import", "q", None, None, "q", False, 7, 7),
    ]


def test_parameters_and_references():
    tree = ast.parse("def f(a, b: int = 1, /, *c, d, e=2, **g): return len(a) + h\nclass C:\n    k = 1\n    def m(self): return k, self")
    assert list(facts.parameters(tree))[:6] == [("f", 0, "a", "single", None, None), ("f", 1, "b", "single", "int", "1"), ("f", 2, "c", "args", None, None), ("f", 3, "d", "single", None, None), ("f", 4, "e", "single", None, "2"), ("f", 5, "g", "kwargs", None, None)]
    got = {(n, r, c) for n, r, c, _ in facts.references(tree)}
    assert {("a", "f.a", "f"), ("len", "builtins.len", "f"), ("h", None, "f"), ("k", None, "C.m"), ("self", "C.m.self", "C.m")} <= got


def test_nodes_tokens_statements():
    rows = list(facts.nodes(ast.parse("class A:\n    def b(self): return 1")))
    assert [(r[0], r[1], r[2], r[3]) for r in rows[:3]] == [(0, -1, 0, "Module"), (1, 0, 1, "ClassDef"), (2, 1, 2, "FunctionDef")]
    assert rows[2][5] == "A.b" and rows[2][12] == ["Module", "ClassDef"]
    assert facts.name_tokens("a = b1 + 'c'  # d\nif (x") == ["a", "b1", "if", "x"]
    assert [x[2] for x in facts.statements(ast.parse("x=1 ;y( 2 )"))] == ["x = 1", "y(2)"]


# --- edits


def test_apply_edits():
    text = "one\ntwo\nthree\n"
    e = [edits.Edit("replace", 0, 0, 0, 3, "1"), edits.insert(1, -1, "!"), edits.Edit("delete", 2, 0, 3, 0, ""), edits.insert(1, 0, "> "), edits.insert(1, 0, ">> ")]
    assert edits.apply(text, e) == "1\n> >> two!\n"
    with pytest.raises(edits.Conflict):
        edits.apply(text, [edits.Edit("delete", 0, 0, 1, 1, ""), edits.insert(0, 2, "x")])
    with pytest.raises(edits.Conflict):
        edits.apply(text, [edits.Edit("delete", 0, 0, 1, 1, ""), edits.Edit("replace", 1, 0, 1, 2, "x")])


@settings(max_examples=200, deadline=None)
@given(st.text("ab\n", max_size=30), st.data())
def test_edits_equal_a_character_model(text, data):
    starts = edits._offsets(text)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(text)), min_size=2, max_size=8, unique=True))) if len(text) > 2 else []
    made, want, at = [], "", 0

    def place(o):
        line = max(k for k, s in enumerate(starts) if s <= o) if o < len(text) else len(starts) - 1
        return line, o - starts[line]

    for lo, hi in zip(cuts[::2], cuts[1::2], strict=False):
        new = data.draw(st.sampled_from(["", "X", "YY"]))
        made.append(edits.Edit("replace", *place(lo), *place(hi), new))
        want += text[at:lo] + new
        at = hi
    assert edits.apply(text, made) == want + text[at:]


IMPORT_EDITS = [
    ("x = 1\n", [("os", None)], [], "import os\nx = 1\n"),
    ('"""Doc."""\nx = 1\n', [("a.b", "c")], [], '"""Doc."""\nfrom a.b import c\nx = 1\n'),
    ("import b\nimport d\n", [("c", None), ("e", None), ("a", None)], [], "import a\nimport b\nimport c\nimport d\nimport e\n"),
    ("from m import a\n", [("m", "c"), ("m", "b")], [], "from m import (a, b, c)\n"),
    ("from m import (a,\n  b as c)\nx\n", [], ["c"], "from m import a\nx\n"),
    ("import os, re\nfrom m import a\n", [], ["os", "a"], "import re\n"),
    ("from __future__ import annotations\nx = 1\n", [("a", "b")], [], "from __future__ import annotations\nfrom a import b\nx = 1\n"),
    ("", [("a", "b")], [], "from a import b\n"),
]


@pytest.mark.parametrize(("source", "add", "remove", "want"), IMPORT_EDITS)
def test_import_edits(source, add, remove, want):
    assert edits.apply(source, edits.import_edits(ast.parse(source), [edits.Wanted(*w) for w in add], remove)) == want


DEEP = [" + ".join(["a"] * 9000), "a" + ".b(1)" * 3000, "a" + "[0]" * 4000, " + ".join(["f'{a}'"] * 4000)]


@pytest.mark.parametrize("deep", DEEP)
def test_deep_sources_have_their_facts(spark, deep):
    source = f"import q\ndef f(): pass\nx = {deep}\n"
    files = pa.RecordBatch.from_pydict({"file_id": pa.array([1, 2]), "source": [source, "y = 1"]})

    def facts_of(make, schema):
        return [r for b in code._rows(make, schema)(iter([files])) for r in b.to_pylist()]

    found = {r["name"] for r in facts_of(lambda s: ((r[1]["name"],) for r in code._every(s) if r[0] == "definition"), "file_id bigint, name string")}
    assert found == {"f", "x", "y"}
    assert {r["name"] for r in facts_of(code._values, code.VALUES)} == {"q", "f", "x", "y"}
    for make, schema in ((facts.references, code.REFERENCES), (facts.statements, code.STATEMENTS)):
        assert 1 in {r["file_id"] for r in facts_of(code._of_tree(make), schema)}
    assert facts_of(code._failure, code.FAILURES) == []


def test_facts_left_out_are_failures(monkeypatch):
    def read(source):
        raise RecursionError

    monkeypatch.setitem(code._READERS, "values", read)
    assert list(code._failure("x = " + " + ".join(["a"] * 300))) == [("RecursionError", "no values: nested too deeply", 1)]
    assert list(code._failure("x = 1")) == []


# --- evaluation

VALUES = [
    ("a = 1\nb = a + 2", "b", [3]), ("a, (b, *c) = 1, (2, 3, 4)", "c", [[3, 4]]), ("if q:\n    x = 1\nelse:\n    x = 'a'", "x", [1, "a"]), ("x = 1\nif q:\n    x = 2", "x", [1, 2]),
    ("def f(a, b=2):\n    return a * b\nx = f(3)", "x", [6]), ("def f(q):\n    if q:\n        return 1\n    return 2\nx = f(0)", "x", [1, 2]), ("x = 1 if q else None", "x", [1, None]),
    ("d = {'a': 1}\nd['b'] = 2\nx = d['b']", "x", [2]), ("x = [n * 2 for n in (1, 2)]", "x", [[2, 4]]), ("x = not []", "x", [True]), ("x = 0 or 'b'", "x", ["b"]), ("x = 1 < 2 < 3", "x", [True]),
    ("x = 'a' * 10 ** 9", "x", None), ("x = 1 / 0", "x", None), ("x = unknown()", "x", None), ("def f(n):\n    return f(n)\nx = f(1)", "x", None), ("x = [1, 2][5]", "x", None), ("def f(): pass\nx = f()", "x", [None]),
    ("class A:\n    k = 1\n    def __init__(self, v):\n        self.v = v\n    def get(self):\n        return self.v\nx = A(5).get()", "x", [5]), ("class A:\n    k = 1\nclass B(A): pass\nx = B().k", "x", [1]),
    ("try:\n    x = 1\nexcept E:\n    x = 2", "x", [1, 2]), ("f = lambda a: a + 1\nx = f(1)", "x", [2]), ("x = f'{1}-{2}'", "x", ["1-2"]), ("x = {**{'a': 1}, 'b': 2}", "x", [{"a": 1, "b": 2}]), ("x = (1, 2, 3)[1:]", "x", [(2, 3)]),
    ("def f():\n    global g\n    g = 4\nf()\nx = g", "x", [4]), ("def f():\n    a = 1\n    def h():\n        nonlocal a\n        a = 2\n    h()\n    return a\nx = f()", "x", [2]), ("x = 0x10 | 1", "x", [17]),
]


@pytest.mark.parametrize(("source", "name", "want"), VALUES)
def test_values(source, name, want):
    got = evaluate.evaluate(ast.parse(source))[name]
    assert ([v.value for v in got] if all(v.kind == "native" for v in got) else None) == want


def _rows_of(source):
    return {n: (n_values, ambiguous) for n, n_values, ambiguous, *_ in code._values(source)}


def test_all_branches_are_kept():
    chain = "if q == 0:\n    x = 0\n" + "".join(f"elif q == {n}:\n    x = {n}\n" for n in range(1, 40))
    assert _rows_of(chain)["x"] == (40, True)
    assert _rows_of(f"for x in {list(range(30))}:\n    y = x")["y"] == (30, True)
    calls = "def f0(): return 1\n" + "".join(f"def f{n}(): return f{n - 1}()\n" for n in range(1, 40))
    got = _rows_of(calls + "x = f20()\ny = f39()\nz = f39().a[0]() + 1")
    assert got["x"] == (1, False) and got["y"] == got["z"] == (2, True)


def test_all_combinations_are_kept():
    def one_of(name, values):
        return "".join(f"{'el' if k else ''}if q == {k}:\n    {name} = {v}\n" for k, v in enumerate(values))

    assert _rows_of(one_of("a", range(5)) + one_of("b", range(0, 40, 10)) + "x = a + b")["x"] == (20, True)
    # the first 16 combinations agree
    assert _rows_of(one_of("a", range(5)) + one_of("b", range(0, 40, 10)) + "x = a * 10 + b > 35")["x"] == (2, True)
    n = int(evaluate.MAX_COMBINATIONS**0.5)
    assert _rows_of(one_of("a", range(n)) + one_of("b", range(n)) + f"x = a * {n} + b")["x"] == (n * n, True)
    beyond = one_of("a", range(n + 1)) + one_of("b", range(n + 1)) + "x = a < 0 and b\ny = (a + b) < -1\nz = y + 1"
    assert all(_rows_of(beyond)[k][1] and _rows_of(beyond)[k][0] > 1 for k in "yz")


def test_types_and_truth():
    v = evaluate.evaluate(ast.parse("import os\nclass A: pass\na = A()\ndef f(): pass\nu = q\nm = 1 if q else 'x'\ns = ...\nb = b'x'\nc = 2j"))
    assert [v[n][0].type_name() for n in ("os", "A", "a", "f", "u", "s", "b", "c")] == ["module", "type", "A", "function", None, "ellipsis", "bytes", "complex"]
    assert evaluate.instance_of(v["m"], "int") is None and evaluate.instance_of(v["b"], "bytes") is True and evaluate.instance_of(v["b"], "int") is False and evaluate.instance_of(v["u"], "int") is None


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("def f(a, b=2, *c, d=4, **e): return (a, b, c, d, e)\nx = f(*(1, 2, 3), **{'d': 5, 'z': 6})", ["(1, 2, (3,), 5, {'z': 6})"]), ("def f(a, b): return b\nx = f(0, *[7])", ["7"]), ("def f(a, b=1): return b\nx = f(0, *q)", ["1", None]),
        ("def f(a, b=1): return b\nx = f(0, **q)", ["1", None]), ("def f(a, /, b=1): return a\nx = f(5, **q)", ["5"]), ("def f(*a): return a\nx = f(*'ab', 1)", ["('a', 'b', 1)"]), ("class A:\n    def __init__(self, n, m=0): self.n = n\nx = A(*[3]).n", ["3"]),
    ],
)
def test_starred_arguments(source, want):
    assert [v.text() for v in evaluate.evaluate(ast.parse(source))["x"]] == want


def test_long_texts_are_whole():
    assert evaluate.evaluate(ast.parse(f"x = '{'a' * 5000}'"))["x"][0].text() == f"'{'a' * 5000}'"


def test_statements_come_in_the_order_of_the_source():
    source = "if a:\n    x = 1\nelse:\n    y = 2\ntry:\n    import q\nexcept E:\n    z = 3\nfinally:\n    w = 4\nmatch m:\n    case 1:\n        v = 5\nlast = 6\n"
    tree = ast.parse(source)
    lines = [s.lineno for s in scopes.statements(tree.body)]
    assert lines == sorted(lines) and len(lines) == sum(isinstance(n, ast.stmt) for n in ast.walk(tree))
